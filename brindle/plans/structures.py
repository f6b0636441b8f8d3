"""Registered queries of modules, fields, references, specifications, globals, spans, constants, metrics and inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.fields import merge_fields
from brindle.operators.fuzz import fuzz_inputs
from brindle.operators.globals import classify_globals, constant_names
from brindle.operators.intervals import enclosing
from brindle.operators.lints import lint_functions
from brindle.operators.metrics import collect_metrics
from brindle.operators.modules import ALGORITHM_NAMES, API_NAMES, GLUE_NAMES, detect_modules, file_modules
from brindle.operators.refactor import orphan_errors, relocations, type_definitions
from brindle.operators.references import citing_references
from brindle.operators.relational import missing_names
from brindle.operators.specs import DEFLATE_MODULES, INFLATE_MODULES, LENGTH_NAMES, LENGTH_TYPES, TYPE_NAMES, matching_standards, normalize_specs, wrong_constants
from brindle.operators.stubs import find_stubs
from brindle.plans.queries import part_edges, query, table
from brindle.sources.cavp import cavp_records


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: Parts as functions of files whose names tell a category, or nothing.
STEMS = ("deflate", "util", "main", "myhash", "zeta", "io", "public", "requeue")
_FUNCTIONS = f"""fns AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'src/' || [{_listed(STEMS)}][(p_partkey % 8 + 1)::INT] || '.c' ELSE 'src/' || replace(p_brand, '#', '_') || p_partkey % 8 || '.c' END AS path,
  'f' || p_partkey AS name, p_size::BIGINT AS line_count, lower(p_type) AS category, (p_partkey % 100) / 100.0::DOUBLE AS confidence, p_partkey AS place FROM part)"""


def part_functions(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    known = F.concat(F.lit("src/"), F.get(F.array(*[F.lit(s) for s in STEMS]), (k % 8).cast("int")), F.lit(".c"))
    own = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), (k % 8).cast("string"), F.lit(".c"))
    return table(spark, d, "part").select(
        F.when(k % 3 == 0, known).otherwise(own).alias("path"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.col("p_size").cast("bigint").alias("line_count"),
        F.lower("p_type").alias("category"), ((k % 100) / 100.0).alias("confidence"), k.alias("at"),
    )


@query(f"""WITH {_FUNCTIONS}, named AS (SELECT DISTINCT path, regexp_extract(lower(path), '([^/]*)\\.c$', 1) AS name FROM fns),
votes AS (SELECT path, category, line_count * confidence AS w, place FROM fns UNION ALL SELECT path, category, 100.0, 2147483647 FROM (SELECT path, CASE WHEN name IN ({_listed(ALGORITHM_NAMES)}) THEN 'algorithm' WHEN name IN ({_listed(GLUE_NAMES)}) THEN 'glue'
  WHEN name IN ({_listed(API_NAMES)}) THEN 'api' WHEN regexp_matches(name, '{"|".join(ALGORITHM_NAMES)}') THEN 'algorithm' END AS category FROM named) WHERE category IS NOT NULL),
sums AS (SELECT path, category, sum(w) AS w, min(place) AS place FROM votes GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(w, 6) DESC, place) AS r FROM sums),
whole AS (SELECT path, sum(line_count)::BIGINT AS total_lines, count(*) AS n_functions FROM fns GROUP BY 1)
SELECT path, name, category, round(least(w / (total_lines + 1), 1.0), 6) AS confidence, total_lines, n_functions FROM top JOIN whole USING (path) JOIN named USING (path) WHERE r = 1""")
def module_files(spark, d):
    """Files classified by their functions and names."""
    m = file_modules(part_functions(spark, d))
    return m.select("path", "name", "category", F.round("confidence", 6).alias("confidence"), "total_lines", F.size("functions").cast("bigint").alias("n_functions"))


@query()
def modules(spark, d):
    """Files merged by their calls, parts that stand in one order calling each other; held against a plain greedy run."""
    calls = part_edges(spark, d).select(F.concat(F.lit("f"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("f"), F.col("dst").cast("string")).alias("dst"))
    return detect_modules(part_functions(spark, d), calls, least=5)


@query("""WITH r AS (SELECT 'T' || l_suppkey % 40 AS type_name, 'f' || l_partkey % 30 AS field, CASE l_linenumber WHEN 1 THEN 'u32' WHEN 2 THEN 'usize' WHEN 3 THEN 'Vec<u8>' ELSE '?' END AS rust_type,
  l_returnflag || l_linestatus AS source, l_linenumber::INT AS origin, l_orderkey AS place FROM lineitem)
SELECT type_name, field, coalesce(min({'o': origin, 'p': place, 't': rust_type}) FILTER (rust_type <> '?')['t'], '?') AS rust_type, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
 coalesce(array_to_string(list_sort(list(DISTINCT rust_type) FILTER (rust_type <> '?')), ','), '') AS kinds FROM r GROUP BY 1, 2""")
def merged_fields(spark, d):
    """Fields of types as lines state them; the first known type counts, others are conflicts."""
    line = F.col("l_linenumber")
    kind = F.when(line == 1, "u32").when(line == 2, "usize").when(line == 3, "Vec<u8>").otherwise("?")
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("T"), (F.col("l_suppkey") % 40).cast("string")).alias("type_name"), F.concat(F.lit("f"), (F.col("l_partkey") % 30).cast("string")).alias("field"), kind.alias("rust_type"),
        F.concat("l_returnflag", "l_linestatus").alias("source"), F.struct(line.cast("int").alias("origin"), F.col("l_orderkey").alias("place")).alias("at"),
    )
    return merge_fields(rows).select("type_name", "field", "rust_type", F.array_join("sources", ",").alias("sources"), F.array_join("kinds", ",").alias("kinds"))


@query("""WITH refs AS (SELECT 'a' || n_nationkey AS algorithm, n_name AS variant, unnest([n_nationkey::VARCHAR, 'Customer#00000' || lpad(n_nationkey::VARCHAR, 3, '0'), 'the customer#000 of ' || lpad(n_nationkey::VARCHAR, 3, '0')]) AS s FROM nation),
cited AS (SELECT algorithm, variant, lower(s) AS cited FROM refs), texts AS (SELECT DISTINCT c_name AS wanted, lower(trim(c_name)) AS text FROM customer)
SELECT wanted, algorithm, variant, max(length(cited)) AS score FROM texts JOIN cited ON contains(text, cited) OR contains(cited, text)
 OR (len(list_filter(string_split_regex(cited, '\\s+'), lambda w: length(w) > 2)) > 0 AND len(list_filter(string_split_regex(cited, '\\s+'), lambda w: length(w) > 2 AND NOT contains(text, w))) = 0) GROUP BY 1, 2, 3""")
def cited_references(spark, d):
    """Customers' names as texts that cite what nations are known by."""
    k = F.col("n_nationkey").cast("string")
    refs = table(spark, d, "nation").select(F.concat(F.lit("a"), k).alias("algorithm"), F.col("n_name").alias("variant"), F.array(k, F.concat(F.lit("Customer#00000"), F.lpad(k, 3, "0")), F.concat(F.lit("the customer#000 of "), F.lpad(k, 3, "0"))).alias("standards"))
    found = citing_references(table(spark, d, "customer").select(F.col("c_name").alias("wanted")), refs)
    return found.select("wanted", "algorithm", "variant", F.col("score").cast("bigint").alias("score"))


#: Types, directions, names and modules that lines of an order stand for.
KINDS = ("Vec<u8>", "u32 | u64", "uLong", "z_streamp", "InflateState", "Option<usize>", " u16 ", "&[u8]")
DIRECTIONS = ("input", "output", "inout")
NAMES = ("destLen", "buf", "total_out", "s")
MODULES = ("inflate", "trees", "adler32")


def _renamed_sql(t: str) -> str:
    for name, rust in TYPE_NAMES.items():
        t = f"regexp_replace({t}, '\\b{name}\\b', '{rust}', 'g')"
    return t


@query(f"""WITH lines AS (SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS i, [{_listed(NAMES)}][(l_suppkey % 4 + 1)::INT] AS name, [{_listed(KINDS)}][(l_partkey % 8 + 1)::INT] AS t, [{_listed(DIRECTIONS)}][(l_linenumber % 3 + 1)::INT] AS d,
  [{_listed(MODULES)}][(l_orderkey % 3 + 1)::INT] AS module FROM lineitem),
plain AS (SELECT *, CASE WHEN contains(trim(t), '|') THEN trim(regexp_extract(t, '([^|]*)$', 1)) ELSE trim(t) END AS t1 FROM lines), aliased AS (SELECT *, {_renamed_sql("t1")} AS t2 FROM plain),
stated AS (SELECT *, CASE WHEN regexp_matches(module, '{"|".join(INFLATE_MODULES)}') THEN replace(t2, 'DeflateState', 'InflateState') WHEN regexp_matches(module, '{"|".join(DEFLATE_MODULES)}') THEN replace(t2, 'InflateState', 'DeflateState') ELSE t2 END AS t3 FROM aliased),
done AS (SELECT *, CASE WHEN t3 = 'Vec<u8>' AND d IN ('inout', 'output') THEN '&mut [u8]' WHEN t3 = 'Vec<u8>' AND d = 'input' THEN '&[u8]'
  WHEN name IN ({_listed(LENGTH_NAMES)}) AND ((t3 IN ({_listed(LENGTH_TYPES)}) AND d IN ('inout', 'output')) OR (t3 = 'Option<usize>' AND d = 'inout')) THEN '&mut usize' ELSE t3 END AS t4 FROM stated)
SELECT k AS l_orderkey, string_agg(name || ': ' || t4, ', ' ORDER BY i, p, name, t, d) AS signature, sum((trim(t) <> t1)::INT + (t1 <> t2)::INT + (t2 <> t3)::INT + (t3 <> t4)::INT)::BIGINT + bool_or(t4 = '&mut usize')::INT AS n_changes,
 CASE WHEN bool_or(t4 = '&mut usize') THEN 'Result<usize, E>' ELSE 'Result<u64, E>' END AS return_type FROM done GROUP BY k""")
def normalized_specs(spark, d):
    """An order as a specification of one algorithm, its lines as the parameters."""
    pick = lambda values, c: F.get(F.array(*[F.lit(v) for v in values]), c.cast("int"))
    line = table(spark, d, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), pick(NAMES, F.col("l_suppkey") % 4).alias("name"), pick(KINDS, F.col("l_partkey") % 8).alias("rust_type"), pick(DIRECTIONS, F.col("l_linenumber") % 3).alias("direction")).alias("x")
    )
    inputs = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("inputs"))
    algorithm = F.struct(F.lit("compress").alias("name"), F.lit("Result<u64, E>").alias("return_type"), "inputs")
    specs = inputs.select("l_orderkey", pick(MODULES, F.col("l_orderkey") % 3).alias("name"), F.array(algorithm).alias("algorithms"))
    out = normalize_specs(specs)
    a = F.col("algorithms")[0]
    return out.select("l_orderkey", F.array_join(F.transform(a["inputs"], lambda p: F.concat(p["name"], F.lit(": "), p["rust_type"])), ", ").alias("signature"), F.size("changes").cast("bigint").alias("n_changes"), a["return_type"].alias("return_type"))


#: C types that globals have, by turns.
C_TYPES = ("int", "unsigned long", "uint16_t[256]", "char [8]", "void *", "struct tree", "size_t", "double")


@query(f"""WITH g AS (SELECT p_partkey, 'g' || p_partkey AS name, [{_listed(C_TYPES)}][(p_partkey % 8 + 1)::INT] AS t, p_size % 5 = 0 AS is_const, p_size % 11 = 0 AS is_extern, p_size % 3 = 0 AS mutated, p_size % 4 = 0 AS has_init,
  CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '{{1, 2, 3}}' WHEN 2 THEN 'make(7)' ELSE 'max(1, g' || p_partkey || '(2))' END AS code FROM part),
s AS (SELECT *, regexp_matches(t, '\\[') AS arr, code <> '' AND NOT starts_with(code, 'make') AS computable FROM g)
SELECT p_partkey, CASE WHEN is_extern OR contains(t, 'void') THEN 'opaque_extern' WHEN arr AND NOT mutated AND (is_const OR computable) THEN 'const_table' WHEN has_init AND NOT mutated THEN 'lazy_init'
 WHEN mutated AND NOT arr AND t IN ('int', 'unsigned long', 'size_t') THEN 'atomic' WHEN mutated THEN 'arc_mutex' ELSE 'const_table' END AS strategy,
 CASE WHEN is_extern OR contains(t, 'void') THEN '*mut c_void /* behind safe wrapper */' ELSE
  CASE WHEN (arr AND NOT mutated AND (is_const OR computable)) OR (NOT mutated AND NOT has_init) THEN '' WHEN has_init AND NOT mutated THEN 'std::sync::LazyLock<' WHEN mutated AND NOT arr AND t IN ('int', 'unsigned long', 'size_t') THEN 'AtomicU' ELSE 'Arc<Mutex<' END ||
  CASE WHEN mutated AND NOT arr AND t IN ('int', 'unsigned long', 'size_t') THEN CASE t WHEN 'unsigned long' THEN '64' ELSE '32' END
   ELSE CASE t WHEN 'int' THEN 'i32' WHEN 'unsigned long' THEN 'u64' WHEN 'uint16_t[256]' THEN '[u16; 256]' WHEN 'char [8]' THEN '[i8; 8]' WHEN 'size_t' THEN 'usize' WHEN 'double' THEN 'f64' ELSE 'u32' END END ||
  CASE WHEN (arr AND NOT mutated AND (is_const OR computable)) OR (NOT mutated AND NOT has_init) THEN '' WHEN has_init AND NOT mutated THEN '>' WHEN mutated AND NOT arr AND t IN ('int', 'unsigned long', 'size_t') THEN '' ELSE '>>' END END AS rust_type FROM s""")
def global_strategies(spark, d):
    """A global for each part."""
    k, n = F.col("p_partkey"), F.col("p_size")
    code = F.when(n % 4 == 0, "").when(n % 4 == 1, "{1, 2, 3}").when(n % 4 == 2, "make(7)").otherwise(F.concat(F.lit("max(1, g"), k.cast("string"), F.lit("(2))")))
    rows = table(spark, d, "part").select(
        k, F.concat(F.lit("g"), k.cast("string")).alias("name"), F.get(F.array(*[F.lit(t) for t in C_TYPES]), (k % 8).cast("int")).alias("c_type"), (n % 5 == 0).alias("is_const"), (n % 11 == 0).alias("is_extern"),
        (n % 3 == 0).alias("is_mutated_after_init"), (n % 4 == 0).alias("has_init_function"), code.alias("init_code"),
    )
    return classify_globals(rows).select("p_partkey", "strategy", "rust_type")


@query()
def constant_chain(spark, d):
    """Each part's name in terms of two smaller ones, some changed at run time, some on cycles; held against plain Python."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("bigint").cast("string"))
    code = F.concat_ws(" + ", name(F.floor(k / 2)), name(F.floor(k / 3)), F.when(k % 101 == 0, name(k + 1)))
    return constant_names(table(spark, d, "part").select(name(k).alias("name"), code.alias("code"), (k % 37 == 5).alias("fixed")))


@query("""WITH spans AS (SELECT o_custkey % 50 AS g, o_orderkey AS s, o_orderkey + o_custkey % 97 AS e FROM orders), points AS (SELECT DISTINCT l_suppkey % 50 AS g, l_orderkey AS place FROM lineitem)
SELECT points.g, place, max(s) AS span FROM points LEFT JOIN spans ON spans.g = points.g AND s <= place AND place < e GROUP BY 1, 2""")
def enclosing_spans(spark, d):
    """Lines of 50 groups as points, orders as spans of different lengths: the innermost of each point."""
    spans = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 97).alias("end"), F.col("o_orderkey").alias("span"))
    points = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), F.col("l_orderkey").alias("place")).distinct()
    return enclosing(points, spans, ["g"], "place").select("g", "place", "span")


@query("""WITH e AS (SELECT p_partkey % 20 AS log, (p_partkey // 20) * 6 AS line, 'T' || p_size AS type_name, 'c' || p_partkey % 9 AS impl_crate FROM part WHERE p_partkey % 4 <> 1),
defs AS (SELECT 'T' || s_suppkey AS type_name, min('c' || s_nationkey % 9) AS crate FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1)
SELECT log, line, type_name, crate AS from_crate, impl_crate AS to_crate FROM e JOIN defs USING (type_name) WHERE crate <> impl_crate""")
def type_relocations(spark, d):
    """Logs of errors about parts' types, which suppliers' files define; some errors name no type."""
    k = F.col("p_partkey")
    line = lambda i, text: F.struct((F.floor(k / 20) * 6 + i).alias("line"), text.alias("text"))
    texts = F.array(
        line(0, F.lit("error[E0116]: cannot define inherent `impl`")), line(1, F.concat(F.lit("  --> c"), (k % 9).cast("string"), F.lit("/src/lib.rs:7:1"))),
        line(2, F.when(k % 4 == 1, F.lit("7 | fn x()")).otherwise(F.concat(F.lit("7 | impl T"), F.col("p_size").cast("string"), F.lit(" {")))),
        line(3, F.lit("  | ^^^^")), line(4, F.lit("  = note")), line(5, F.lit("")),
    )
    logs = table(spark, d, "part").select((k % 20).alias("log"), F.explode(texts).alias("x")).select("log", "x.*")
    # lines further off than a next error's head belong to it as well, so errors are cut apart by distance first
    near = orphan_errors(logs.withColumn("log", F.struct("log", F.floor(F.col("line") / 6).alias("part"))))
    key = F.col("s_suppkey").cast("string")
    crate = F.concat(F.lit("c"), (F.col("s_nationkey") % 9).cast("string"))
    files = table(spark, d, "supplier").select(crate.alias("crate"), F.concat(crate, F.lit("/src/s"), key, F.lit(".rs")).alias("path"), F.concat(F.when(F.col("s_suppkey") % 3 > 0, "// type\n  pub struct T").otherwise("// pub struct T"), key, F.lit(" {}")).alias("text"))
    return relocations(near, type_definitions(files)).select(F.col("log.log").alias("log"), "line", "type_name", "from_crate", "to_crate")


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'adler32' ELSE 'crc32' END AS algorithm, p_size FROM part),
c AS (SELECT id, algorithm, 'BASE' AS name, CASE p_size % 3 WHEN 0 THEN 65521 WHEN 1 THEN 255 ELSE 65521 END AS v FROM t UNION ALL SELECT id, algorithm, 'NMAX', p_size * 100 FROM t UNION ALL SELECT id, algorithm, 'POLY', CASE WHEN p_size % 5 = 0 THEN 3988292384 ELSE 79764919 END FROM t)
SELECT id, algorithm, c.name, v::BIGINT AS stated, k.v2::BIGINT AS required FROM c JOIN (VALUES ('adler32', 'BASE', 65521), ('adler32', 'NMAX', 5552), ('crc32', 'POLY', 3988292384)) k(a, n, v2) ON a = algorithm AND n = c.name WHERE v <> v2""")
def wrong_standard_constants(spark, d):
    """Descriptions that state a constant twice, in hexadecimal or decimal, some of them wrong."""
    from brindle.operators.specs import standard_constants

    n = F.col("p_size")
    text = F.concat(
        F.lit("mod BASE = 7; BASE = "), F.when(n % 3 == 1, "0xff").otherwise("65521"), F.lit(", NMAX="), (n * 100).cast("string"), F.lit(" with POLY = "), F.when(n % 5 == 0, "0xEDB88320").otherwise("0x04C11DB7"), F.lit(" and b = 3")
    )
    stated = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(n % 2 == 0, "adler32").otherwise("crc32").alias("algorithm"), text.alias("text"))
    return wrong_constants(stated, spark.createDataFrame(standard_constants(), "algorithm string, name string, value long"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 60 AS v FROM lineitem), s AS (SELECT DISTINCT n_regionkey::VARCHAR || '/' || n_nationkey // 10 AS standard, n_nationkey AS v FROM nation), z AS (SELECT standard, count(*) AS size FROM s GROUP BY 1)
SELECT id, standard FROM n JOIN s USING (v) JOIN z USING (standard) GROUP BY id, standard, size HAVING count(*) = size""")
def contained_standards(spark, d):
    """Orders as texts of numbers, and the sets of nations' keys that they hold whole."""
    texts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat_ws(", ", F.collect_list(F.concat(F.lit("n="), (F.col("l_partkey") % 60).cast("string")))).alias("text"))
    sets = table(spark, d, "nation").select(F.concat_ws("/", F.col("n_regionkey").cast("string"), F.floor(F.col("n_nationkey") / 10).cast("string")).alias("standard"), F.col("n_nationkey").cast("bigint").alias("value"))
    return matching_standards(texts, sets)


@query("""WITH f AS (SELECT lang AS kind, source AS crate, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), m AS (SELECT kind, crate, len(l) AS n, len(list_filter(l, lambda x: trim(x, ' ') <> '' AND NOT starts_with(ltrim(x, ' '), '//'))) AS c FROM f)
SELECT kind, crate, grouping(kind)::INT AS kind_level, grouping(crate)::INT AS crate_level, count(*) AS files, sum(n)::BIGINT AS n_lines, sum(c)::BIGINT AS code_lines FROM m GROUP BY GROUPING SETS ((kind, crate), (kind), ())""")
def metrics_by_crate(spark, d):
    """Documents as files: languages are kinds, sources crates."""
    files = table(spark, d, "documents").select(F.col("lang").alias("kind"), F.col("source").alias("crate"), F.col("doc_id").cast("string").alias("path"), "text")
    return collect_metrics(files).select("kind", "crate", "kind_level", "crate_level", "files", "n_lines", "code_lines")


@query("""WITH h AS (SELECT p_partkey AS k, md5('7:size:' || p_partkey || ':0') AS a, md5('7:flag:' || p_partkey || ':0') AS b, md5('7:shift:' || p_partkey || ':0') AS c, md5('7:data:' || p_partkey || ':0') AS e FROM part),
z AS (SELECT *, coalesce(CASE WHEN k < 10 THEN [0, 1, 2, 3, 7, 8, 16, 64, 255, 256][(k + 1)::INT] END, ('0x' || substr(e, 1, 8))::BIGINT % 41) AS n FROM h)
SELECT k AS p_partkey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 4294967295 WHEN 2 THEN 1 ELSE ('0x' || substr(a, 1, 15))::BIGINT % 4294967296 END AS size, CASE WHEN k < 2 THEN k = 1 ELSE ('0x' || substr(b, 1, 1))::INT % 2 = 1 END AS flag,
 CASE k WHEN 0 THEN -128 WHEN 1 THEN 127 WHEN 2 THEN 1 ELSE ('0x' || substr(c, 1, 15))::BIGINT % 256 - 128 END AS shift, substr(array_to_string(list_transform(range(1, 18), lambda i: md5('7:data:' || k || ':' || i)), ''), 1, 2 * n::INT) AS data FROM z""")
def fuzzed_inputs(spark, d):
    """Typed inputs for each part from a seed."""
    rows = table(spark, d, "part").select("p_partkey")
    made = fuzz_inputs(rows, [("size", "u32"), ("flag", "bool"), ("shift", "i8"), ("data", "&[u8]")], row="p_partkey", seed=7, longest=40)
    return made.withColumn("data", F.lower(F.hex("data")))


@query()
def vector_records(spark, d):
    """Orders as records of `name = value` lines in files by customer segment and splits of 500 orders; held against a plain reader."""
    return cavp_records(vector_lines(spark, d)).withColumn("fields", F.to_json("fields"))


def vector_lines(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    field = lambda i, text: F.struct(F.lit(i).alias("n"), text.alias("value"))
    texts = F.array(
        field(0, F.when(k % 40 < 3, F.concat(F.lit("[L = "), (k % 7).cast("string"), F.lit("]")))), field(1, F.concat(F.lit("Len = "), k.cast("string"))), field(2, F.concat(F.lit("MD = "), F.md5(k.cast("string")))), field(3, F.when(k % 3 > 0, "")),
        field(4, F.when(k % 10 == 0, "# a = comment")),
    )
    lines = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")).alias("file"), F.floor(k / 500).alias("split"), k, F.explode(texts).alias("x"))
    return lines.where("x.value is not null").select("file", "split", (k * 8 + F.col("x.n")).alias("i"), F.col("x.value").alias("value"))


@query("""SELECT 'z_fnKey' || p_partkey AS name FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1""")
def missing_variants(spark, d):
    """Every third part's name is expected in another spelling than even numbers' names are found in."""
    key = F.col("p_partkey")
    expected = table(spark, d, "part").where(key % 3 == 0).select(F.concat(F.lit("z_fnKey"), key.cast("string")).alias("name"))
    return missing_names(expected, table(spark, d, "part").select(F.concat(F.lit("fn_key"), (key * 2).cast("string")).alias("name")))


@query("""SELECT 'p' || p_partkey AS name, CASE p_size % 5 WHEN 0 THEN 'crc32_traversal_direction_mismatch' WHEN 1 THEN 'adler32_s1_zero_init' WHEN 2 THEN 'sha256_le_length_padding' WHEN 3 THEN 'md5_be_length_padding' ELSE 'crc32_polynomial_mixed' END AS rule FROM part WHERE p_size % 2 = 0""")
def lint_other_rules(spark, d):
    """The rules of direction, seed, padding and mixed polynomials: wrong where the size is even."""
    n, odd = F.col("p_size") % 5, F.col("p_size") % 2 == 1
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    wrong = ["0xEDB88320; c << 1; buf", "let BASE = 65521; s1 = 0; buf", "0x6a09e667; bit_len.to_le_bytes(); buf", "bit_len.to_be_bytes(); buf", "0xEDB88320; 0x04C11DB7; c >> 1; buf"]
    right = ["0xEDB88320; c >> 8; buf", "let BASE = 65521; s1 = 1; buf", "0x6a09e667; bit_len.to_be_bytes(); buf", "bit_len.to_le_bytes(); buf", "0xEDB88320; c >> 1; buf"]
    source = F.concat(F.lit("pub fn f(buf: &[u8]) -> u32 { "), F.when(odd, pick(right)).otherwise(pick(wrong)), F.lit(" }"))
    rows = table(spark, d, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("name"), pick(["crc32", "adler32", "sha256", "md5", "crc32"]).alias("family"), pick(["ieee_reflected", "", "", "", "ieee_reflected"]).alias("variant"), source.alias("source"),
        F.array(F.struct(F.lit("buf").alias("name"), F.lit("&[u8]").alias("type"))).alias("inputs"),
    )
    return lint_functions(rows).select("name", "rule")


#: A file for each part, with a finding of each kind in turn or none.
STUB_LINES = ("    todo!()", "    // Conceptually we go on", "    panic!(\"not yet there\")", "    buf.len()", "    /* simple\n heuristic */ buf")


@query("""SELECT p_partkey, 2 AS line, CASE p_size % 5 WHEN 0 THEN 'todo_macro' WHEN 1 THEN 'comment_conceptually' WHEN 2 THEN 'panic_not_impl' ELSE 'comment_simple_heuristic' END AS pattern, 'f' || p_partkey AS fn_name FROM part WHERE p_size % 5 <> 3""")
def stubs_of_parts(spark, d):
    """A source file for each part, most of them with a stub."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("pub fn f"), k, F.lit("(buf: &[u8]) -> usize {\n"), F.get(F.array(*[F.lit(x) for x in STUB_LINES]), (F.col("p_size") % 5).cast("int")), F.lit("\n}\nfn g() -> &str { \"todo!()\" }\n"))
    return find_stubs(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text").select("p_partkey", "line", "pattern", "fn_name")
