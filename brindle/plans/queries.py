"""Registered queries over the driver's tables, with the SQL that must give the same rows.

Every query applies one operator of the library to whole tables; the SQL is DuckDB's.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import bytes as B
from brindle.functions import checksums as C
from brindle.operators import ffi as X
from brindle.operators import graph as G
from brindle.operators import relational as R
from brindle.operators import scoring as S
from brindle.operators import textscan as T
from brindle.operators.differential import byte_inputs, round_trip
from brindle.operators.lints import lint_functions
from brindle.operators.stubs import find_stubs
from brindle.streaming.events import rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: The bytes of part names, i from 0, for oracles.
_BYTES = """bytes AS (SELECT p_partkey, i, n, ('0x' || substr(h, 2 * i + 1, 2))::INT AS v FROM (
  SELECT p_partkey, hex(encode(p_name)) AS h, octet_length(encode(p_name)) AS n, unnest(range(octet_length(encode(p_name)))) AS i FROM part))"""
_CRC_TABLE = """tab AS (SELECT list(c ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k)))"""


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digest_md5_sha256(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", C.digest(t, "md5").alias("md5"), C.digest(t, "sha1").alias("sha1"), C.digest(t, "sha256").alias("sha256"))


@query(f"""WITH {_BYTES}, {_CRC_TABLE}, lists AS (SELECT p_partkey, list(v::BIGINT ORDER BY i) AS b FROM bytes GROUP BY 1)
SELECT p_partkey, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc32 FROM lists, tab""")
def digest_crc32(spark, d):
    return table(spark, d, "part").select("p_partkey", C.crc32(F.col("p_name")).alias("crc32"))


@query(f"""WITH {_BYTES} SELECT p_partkey, (((n + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler32 FROM bytes GROUP BY p_partkey, n""")
def digest_adler32(spark, d):
    return table(spark, d, "part").select("p_partkey", C.adler32(F.col("p_name")).alias("adler32"))


@query(f"""WITH {_BYTES} SELECT p_partkey, ((sum((n - i) * v) % 255) * 256 + sum(v) % 255)::BIGINT AS fletcher16 FROM bytes GROUP BY p_partkey, n""")
def digest_fletcher16(spark, d):
    return table(spark, d, "part").select("p_partkey", C.fletcher16(F.col("p_name")).alias("fletcher16"))


@query()
def digest_documents(spark, d):
    """Checksums of whole document texts; held against zlib in the tests."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", C.crc32(t).alias("crc32"), C.digest(t, "sha512").alias("sha512"), F.octet_length(t).alias("n_bytes"))


@query(f"""WITH {_BYTES} SELECT p_partkey, (((n + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT AS combined FROM bytes GROUP BY p_partkey, n""")
def adler_combine(spark, d):
    """Halves of part names summed apart and combined; the sum of the whole is the oracle."""
    p = table(spark, d, "part")
    name, half = F.encode("p_name", "UTF-8"), F.floor(F.octet_length("p_name") / 2).cast("int")
    a, b = F.substr(name, F.lit(1), half), F.substr(name, half + 1)
    return p.select("p_partkey", C.adler32_combine(C.adler32(a), C.adler32(b), F.octet_length(b)).alias("combined"))


@query(f"""WITH {_BYTES}, {_CRC_TABLE}, lists AS (SELECT p_partkey, list(v::BIGINT ORDER BY i) AS b FROM bytes GROUP BY 1)
SELECT p_partkey, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS combined FROM lists, tab""")
def crc_combine(spark, d):
    p = table(spark, d, "part")
    name, half = F.encode("p_name", "UTF-8"), F.floor(F.octet_length("p_name") / 2).cast("int")
    a, b = F.substr(name, F.lit(1), half), F.substr(name, half + 1)
    return p.select("p_partkey", C.crc32_combine(C.crc32(a), C.crc32(b), F.octet_length(b).cast("bigint")).alias("combined"))


@query("""SELECT o_orderkey, o_orderkey % 32 AS len, CASE WHEN o_orderkey % 32 = 0 THEN 0 ELSE
  list_sum(list_transform(range(o_orderkey % 32), lambda i: ((o_orderkey >> i) & 1) << (o_orderkey % 32 - 1 - i)))::BIGINT END AS reversed FROM orders""")
def bit_reverse(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (k % 32).alias("len"), B.bit_reverse(k, k % 32).alias("reversed"))


@query("""SELECT o_orderkey, array_to_string(list_transform(range(8), lambda i: substr(lpad(hex(o_orderkey), 16, '0'), 15 - 2 * i, 2)), '') AS swapped FROM orders""")
def byte_swap(spark, d):
    return table(spark, d, "orders").select("o_orderkey", B.byte_swap(F.col("o_orderkey")).alias("swapped"))


@query("""SELECT o_orderkey, list_reduce(list_prepend({'p': 0::BIGINT, 'b': o_custkey * 2654435 % 4294967296}, list_transform(range(31, -1, -1), lambda i: {'p': i::BIGINT, 'b': 0::BIGINT})),
  lambda s, x: {'p': CASE WHEN ((o_orderkey * 7919 % 4294967296) >> x.p::INT) & 1 = 1 THEN xor(s.p, s.b) ELSE s.p END,
                'b': CASE WHEN s.b % 2 = 1 THEN xor(s.b >> 1, 3988292384) ELSE s.b >> 1 END}).p AS product FROM orders""")
def multmodp(spark, d):
    a, b = F.col("o_orderkey") * 7919 % 4294967296, F.col("o_custkey") * 2654435 % 4294967296
    return table(spark, d, "orders").select("o_orderkey", C.multmodp(a, b).alias("product"))


@query("""SELECT doc_id, n + n // 1000 + 18 AS simple, n + (n >> 12) + (n >> 14) + (n >> 25) + 13 AS deflate, 169 AS flags
FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents)""")
def compress_bound(spark, d):
    n = F.octet_length("text").cast("bigint")
    return table(spark, d, "documents").select("doc_id", B.compress_bound_simple(n).alias("simple"), B.compress_bound_deflate(n).alias("deflate"), B.compile_flags().alias("flags"))


@query("""SELECT l_orderkey, array_to_string(list_transform(list_sort(list(l_partkey)), lambda h: greatest(h - 500, 0)), ',') AS slid FROM lineitem GROUP BY 1""")
def slide_hash(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("h"))
    return g.select("l_orderkey", F.array_join(B.slide(F.col("h"), F.lit(500)), ",").alias("slid"))


@query("""SELECT o_orderkey, v, n, CASE WHEN 5 + n > 16 THEN (v >> 11)::BIGINT ELSE (m & 65535)::BIGINT END AS bi_buf, CASE WHEN 5 + n > 16 THEN 5 + n - 16 ELSE 5 + n END AS bi_valid,
  CASE WHEN 5 + n > 16 THEN (m & 255)::VARCHAR || ',' || ((m & 65535) >> 8)::VARCHAR ELSE '' END AS pending
FROM (SELECT o_orderkey, v, n, 21 | (v << 5) AS m FROM (SELECT o_orderkey, o_orderkey % 16 + 1 AS n, o_custkey % (1 << (o_orderkey % 16 + 1)::INT) AS v FROM orders))""")
def send_bits(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 16 + 1).alias("n"), "o_custkey")
    o = o.select("o_orderkey", (F.col("o_custkey") % F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n").cast("int"))).alias("v"), "n")
    s = B.send_bits(B.bit_buffer(F.lit(21), F.lit(5), F.array().cast("array<int>")), F.col("v"), F.col("n").cast("int"))
    return o.withColumn("s", s).select("o_orderkey", "v", "n", "s.bi_buf", F.col("s.bi_valid").cast("bigint").alias("bi_valid"), F.array_join("s.pending", ",").alias("pending"))


@query("""SELECT a.p_partkey, coalesce((SELECT arg_min(x.v - y.v, x.i) FROM bytes x JOIN bytes y ON y.p_partkey = b.p_partkey AND y.i = x.i AND x.p_partkey = a.p_partkey WHERE x.v <> y.v AND x.i < 12), 0) AS diff
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""".replace("SELECT a.p_partkey", f"WITH {_BYTES} SELECT a.p_partkey", 1))
def compare_bytes(spark, d):
    """Each part name with the next one's, first twelve bytes."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return both.select("p_partkey", B.compare_bytes(F.col("p_name"), F.col("other"), F.lit(12)).alias("diff"))


@query("""WITH old AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 10 <> 1),
new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS s FROM documents WHERE doc_id % 10 <> 2)
SELECT change, count(*) AS n, min(path) AS first FROM (SELECT coalesce(old.doc_id, new.doc_id) AS path,
 CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'deleted' WHEN old.s <> new.s THEN 'modified' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id)
WHERE change IS NOT NULL GROUP BY 1""")
def snapshot_diff(spark, d):
    """Two snapshots of documents made by rules on the id: without tenth ids, and with some texts changed."""
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 10 <> 2").select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("sha256"))
    return R.snapshot_diff(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def coverage_anti(spark, d):
    return R.missing(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("SELECT digest, min(doc_id) AS doc_id FROM (SELECT doc_id, md5(text) AS digest FROM documents) GROUP BY 1")
def dedupe_first(spark, d):
    rows = table(spark, d, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return R.keep_first(rows, ["digest"], ["doc_id"])


@query("SELECT l_orderkey, max(l_partkey * 100000 + l_suppkey) // 100000 AS l_partkey, max(l_partkey * 100000 + l_suppkey) % 100000 AS l_suppkey FROM lineitem GROUP BY 1")
def dedupe_last(spark, d):
    return R.keep_last(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey"], "l_partkey")


_ALIASES = [("econ", "economy"), ("standard", "standard"), ("promo", "promotion"), ("promobr", "promotion-brushed"), ("smallplated", "small-plated"), ("small", "small"), ("largebrass", "large-brass"), ("medium", "medium")]
_SQUASH = "regexp_replace(lower(p_type), '[\\s_\\-/]', '', 'g')"


@query(f"""WITH a(alias, canonical) AS (VALUES {", ".join(f"('{a}', '{c}')" for a, c in _ALIASES)}), t AS (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL),
m AS (SELECT p_type, canonical, CASE WHEN alias = lower(p_type) THEN 0 WHEN alias = {_SQUASH} THEN 1 ELSE 2 END AS r, length(alias) AS n FROM t JOIN a ON alias = lower(p_type) OR starts_with({_SQUASH}, alias)),
b AS (SELECT p_type, arg_min(canonical, r * 1000 - n) AS canonical FROM m GROUP BY 1) SELECT part.p_partkey, part.p_type, b.canonical FROM part LEFT JOIN b ON b.p_type = part.p_type""")
def alias_lookup(spark, d):
    aliases = spark.createDataFrame(_ALIASES, "alias string, canonical string")
    return R.alias_lookup(table(spark, d, "part").select("p_partkey", "p_type"), aliases, "p_type").select("p_partkey", "p_type", "canonical")


_MONEY = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, a, b FROM (SELECT *, x * (100 - y) // 100 AS a, x - (x * y) // 100 AS b FROM (SELECT *, {_MONEY} AS x, CAST(round(l_discount * 100) AS BIGINT) AS y FROM lineitem)) WHERE a <> b""")
def differential_mismatch(spark, d):
    """Two ways to take off a discount in whole cents, and where they differ."""
    x, y = F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    rows = table(spark, d, "lineitem").withColumn("x", x).withColumn("y", y)
    rows = rows.withColumn("a", F.expr("x * (100 - y) div 100")).withColumn("b", F.expr("x - (x * y) div 100"))
    return R.differences(rows, "l_orderkey", "a", "b").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "a", "b")


@query(f"""SELECT count(*) AS compared, count(*) FILTER (WHERE a <> b) AS differing, count(*) > 0 AND count(*) FILTER (WHERE a <> b) = 0 AS ok FROM (SELECT x * (100 - y) // 100 AS a, x - (x * y) // 100 AS b FROM (SELECT {_MONEY} AS x, CAST(round(l_discount * 100) AS BIGINT) AS y FROM lineitem))""")
def comparison_gate(spark, d):
    rows = table(spark, d, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("x"), F.round(F.col("l_discount") * 100).cast("bigint").alias("y"))
    return R.comparison_gate(rows.selectExpr("x * (100 - y) div 100 a", "x - (x * y) div 100 b"), "a", "b")


@query("SELECT l_partkey, l_quantity, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def rank_best(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber")
    return R.best_of(rows, ["l_partkey"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber"])


#: Parts of lines that follow each other in an order: a graph of parts.
_EDGES = """edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""


def part_edges(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    a = l.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return a.join(l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def part_nodes(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


@query(f"""WITH {_EDGES}, o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1)
SELECT p_partkey AS node, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in, coalesce(i.n, 0) = 0 AS is_root, coalesce(o.n, 0) = 0 AS is_leaf, coalesce(i.n, 0) >= 3 AND coalesce(o.n, 0) >= 3 AS is_hub
FROM part LEFT JOIN o ON src = p_partkey LEFT JOIN i ON dst = p_partkey""")
def edges_fan(spark, d):
    return G.roles(part_nodes(spark, d), part_edges(spark, d))


@query(f"""WITH {_EDGES} SELECT src, dst, a.p_brand AS src_owner, b.p_brand AS dst_owner FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand""")
def cross_group_edges(spark, d):
    return G.cross_edges(part_edges(spark, d), table(spark, d, "part").select("p_partkey", "p_brand"))


@query(f"""WITH {_EDGES} SELECT least(a.p_brand, b.p_brand) AS a, greatest(a.p_brand, b.p_brand) AS b, count(*) AS n FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2 HAVING count(*) >= 5""")
def coupling_pairs(spark, d):
    return G.coupling(part_edges(spark, d), table(spark, d, "part").select("p_partkey", "p_brand"))


@query()
def scc(spark, d):
    """Recursive SQL is too slow on the whole graph: held against plain Python in the tests."""
    return G.strong_components(part_edges(spark, d))


@query()
def topo_levels(spark, d):
    """The whole graph has cycles, whose parts come last; held against plain Python in the tests."""
    return G.levels(part_nodes(spark, d), part_edges(spark, d))


@query("""WITH s AS (SELECT l_partkey, l_returnflag, sum(CAST(l_quantity AS BIGINT)) + max(CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END) AS w, min(l_orderkey) AS p, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, first(l_returnflag ORDER BY w DESC, p, l_returnflag DESC) AS l_returnflag, max(w)::BIGINT AS weight, least(round(max(w) / (sum(q) + 1), 9), 1.0) AS confidence FROM s GROUP BY 1""")
def weighted_vote(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", F.col("l_quantity").cast("bigint").alias("q"))
    voted = R.weighted_vote(rows, "l_partkey", "l_returnflag", F.col("q"), "l_orderkey", F.when(F.col("l_returnflag") == "R", 100).otherwise(0))
    return voted.withColumn("confidence", F.least(F.round("confidence", 9), F.lit(1.0)))


_PATTERNS = [
    S.Pattern("steel", "metal", 0.9, ("steel", "tin"), ("large",), ("promo", "burnished")),
    S.Pattern("copper", "metal", 0.8, ("copper", "brass"), ("small", "medium"), ("economy", "brushed")),
    S.Pattern("nickel", "alloy", 0.6, ("nickel",), ("economy",), ("standard", "plated")),
]


@query("""WITH p AS (SELECT p_partkey, lower(p_type) AS t, list_transform(string_split(p_type, ' '), lambda x: lower(x)) AS w FROM part),
s AS (SELECT p_partkey,
 CASE WHEN regexp_matches(t, 'steel|tin') THEN 0.9 ELSE 0 END + CASE WHEN regexp_matches(t, 'large') THEN 0.15 ELSE 0 END + CASE len(list_filter(w, lambda x: x IN ('promo', 'burnished'))) WHEN 0 THEN 0 WHEN 1 THEN 0.1 ELSE 0.2 END AS a,
 CASE WHEN regexp_matches(t, 'copper|brass') THEN 0.8 ELSE 0 END + CASE WHEN regexp_matches(t, 'small|medium') THEN 0.15 ELSE 0 END + CASE len(list_filter(w, lambda x: x IN ('economy', 'brushed'))) WHEN 0 THEN 0 WHEN 1 THEN 0.1 ELSE 0.2 END AS b,
 CASE WHEN regexp_matches(t, 'nickel') THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(t, 'economy') THEN 0.15 ELSE 0 END + CASE len(list_filter(w, lambda x: x IN ('standard', 'plated'))) WHEN 0 THEN 0 WHEN 1 THEN 0.1 ELSE 0.2 END AS c FROM p)
SELECT p_partkey, CASE WHEN greatest(a, b, c) < 0.3 THEN NULL WHEN a >= b AND a >= c THEN 'steel' WHEN b >= c THEN 'copper' ELSE 'nickel' END AS pattern,
 CASE WHEN greatest(a, b, c) < 0.3 THEN 'glue' WHEN a >= b AND a >= c THEN 'metal' WHEN b >= c THEN 'metal' ELSE 'alloy' END AS category, CASE WHEN greatest(a, b, c) < 0.3 THEN 0.1 ELSE greatest(a, b, c) END::DOUBLE AS score FROM s""")
def keyword_score(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type", F.array("p_type").alias("calls"), F.split("p_type", " ").alias("vars"))
    return S.keyword_score(parts, _PATTERNS, "p_type", "calls", "vars").select("p_partkey", "pattern", "category", "score")


_RULES = "CASE WHEN p_name = 'main' THEN 'main' WHEN starts_with(lower(p_type), 'promo') THEN 'build_utility' WHEN regexp_matches(lower(p_type), '^standard') THEN 'test_harness' ELSE 'algorithm' END"


@query(f"SELECT p_partkey, {_RULES} AS kind FROM part")
def classify_rules(spark, d):
    t = F.lower("p_type")
    rules = [(F.col("p_name") == "main", "main"), (F.startswith(t, F.lit("promo")), "build_utility"), (t.rlike("^standard"), "test_harness")]
    return table(spark, d, "part").select("p_partkey", S.first_rule(rules, "algorithm").alias("kind"))


@query("""SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: trim(x, ' ') <> '')) AS n_filled, len(list_filter(l, lambda x: trim(x, ' ') <> '' AND NOT starts_with(trim(x, ' '), '//'))) AS n_code, len(list_distinct(l)) AS n_distinct
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)""")
def line_metrics(spark, d):
    return S.line_metrics(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT doc_id, max(n) AS top, sum(n)::BIGINT AS filled FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS l FROM documents WHERE length(text) >= 500) WHERE l <> '' GROUP BY 1, 2)
GROUP BY 1 HAVING max(n) >= 10 AND max(n) > sum(n) * 0.3""")
def degenerate_docs(spark, d):
    return S.degenerate(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a\\s')) AS links, len(regexp_extract_all(html, '&[a-z]+;')) AS entities FROM pages""")
def pattern_counts(spark, d):
    return table(spark, d, "pages").select("page_id", *T.pattern_counts(F.col("html"), {"paragraphs": "<p>", "links": r"<a\s", "entities": "&[a-z]+;"}))


@query("""SELECT page_id, t.name, t.value FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '([a-z-]+)="([^"<>]*)"', 1), regexp_extract_all(html, '([a-z-]+)="([^"<>]*)"', 2))) AS z FROM pages), LATERAL (SELECT z[1] AS name, z[2] AS value) t""")
def literal_extract(spark, d):
    """name="value" pairs of pages."""
    pattern = F.lit('([a-z-]+)="([^"<>]*)"')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("name"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("value"))
    return table(spark, d, "pages").select("page_id", F.explode(both).alias("z")).select("page_id", "z.name", "z.value")


@query("""SELECT p_type, p_size, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS members FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) >= 2""")
def trait_families(spark, d):
    return R.families(table(spark, d, "part"), ["p_type", "p_size"], "p_partkey").withColumn("members", F.array_join("members", ","))


@query("""SELECT user_id, bool_and(coalesce(value, 0) >= 5) AS ok, first(event_type ORDER BY event_id) FILTER (WHERE coalesce(value, 0) < 5) AS first_failure FROM events GROUP BY 1""")
def stage_gates(spark, d):
    gates = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.coalesce("value", F.lit(0.0)) >= 5).alias("ok"))
    return R.gate_report(gates, ["user_id"], "event_type", "ok", "event_id")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_rollup(spark, d):
    out = rollup(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k FROM events""")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS asked, sum(length(text))::BIGINT AS chars, bool_and(length(text) > 0) AS filled FROM conversations GROUP BY 1""")
def conversation_rollup(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"), F.bool_and(F.length("text") > 0).alias("filled"))


@query("""WITH s AS (SELECT n_name, r_name, count(*) AS customers, CAST(sum(round(c_acctbal * 100)) AS BIGINT) AS cents FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)
SELECT n_name, r_name, customers, cents FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY customers DESC, n_name) AS k FROM s) WHERE k = 1""")
def owner_majority(spark, d):
    """The nation with most customers of each region."""
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    sums = joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100)).cast("bigint").alias("cents"))
    return R.keep_first(sums, ["r_name"], [F.desc("customers"), "n_name"])


@query("""WITH e AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(source, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_+', '_', 'g'), '_') AS name FROM documents) SELECT name, count(*) AS n FROM e GROUP BY 1""")
def snake_names(spark, d):
    return table(spark, d, "documents").select(R.snake(F.col("source")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos, CASE l_returnflag WHEN 'R' THEN 'error: ' WHEN 'A' THEN 'warning: ' ELSE ' at ' END || l_partkey AS t FROM lineitem),
b AS (SELECT *, sum(CASE WHEN t LIKE 'error%' OR t LIKE 'warning%' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT l_orderkey, block::BIGINT AS block, string_agg(t, chr(10) ORDER BY pos) AS message FROM b WHERE block > 0 GROUP BY 1, 2 HAVING first(t ORDER BY pos) LIKE 'error%'""")
def error_blocks(spark, d):
    """An order as a log: returned lines start errors, accepted ones warnings."""
    kind = F.when(F.col("l_returnflag") == "R", "error: ").when(F.col("l_returnflag") == "A", "warning: ").otherwise(" at ")
    logs = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("at"), F.concat(kind, F.col("l_partkey").cast("string")).alias("t"))
    return T.error_blocks(logs, "l_orderkey", "at", "t").select("l_orderkey", "block", "message")


@query("""SELECT part.p_partkey, regexp_matches(p_brand || '/' || replace(p_type, ' ', '/'), '^Brand#[^/]*/(?:.*/)?[^/]*BRASS$') AS allowed FROM part""")
def glob_allowed(spark, d):
    path = F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit("/")))
    return table(spark, d, "part").select("p_partkey", T.allowed(path, ["Brand#*/**/*BRASS"]).alias("allowed"))


@query()
def fuzz_digests(spark, d):
    """Seeded inputs, one for each part, and their digests; held against hashlib and zlib in the tests."""
    n = table(spark, d, "part").count()
    x = F.col("input")
    return byte_inputs(spark, n, seed=7).select("idx", F.hex("input").alias("input"), C.crc32(x).alias("crc32"), C.adler32(x).alias("adler32"), C.crc32c(x).alias("crc32c"), F.md5(x).alias("md5"))


@query("SELECT doc_id, true AS same FROM documents")
def deflate_round_trip(spark, d):
    return table(spark, d, "documents").select("doc_id", round_trip(F.col("text")).alias("same"))


@query()
def stub_findings(spark, d):
    """Stub macros and comments that give up, in pages; the tests hold the operator against sources that have them."""
    return find_stubs(table(spark, d, "pages"), "page_id", "html")


@query(f"""WITH {_CRC_TABLE}, big AS (SELECT list_transform(t, lambda x: ((x & 255) << 24) | ((x & 65280) << 8) | ((x >> 8) & 65280) | (x >> 24)) AS g FROM tab), w AS (SELECT p_partkey, p_partkey::BIGINT * 1000003000007 AS w FROM part)
SELECT p_partkey, list_reduce(list_prepend(w, range(8)), lambda a, x: xor(a >> 8, t[(a & 255) + 1])) & 4294967295 AS little,
 lpad(hex(list_reduce(list_prepend(w::UBIGINT, list_transform(range(8), lambda x: x::UBIGINT)), lambda a, x: xor((a & 72057594037927935::UBIGINT) << 8, g[(a >> 56)::INT + 1]::UBIGINT))), 16, '0') AS big FROM w, tab, big""")
def crc_words(spark, d):
    w = F.col("p_partkey").cast("bigint") * 1000003000007
    return table(spark, d, "part").select("p_partkey", B.crc_word(w).alias("little"), B.crc_word_big(w).alias("big"))


@query("""WITH w AS (SELECT p_partkey, list_transform(range(1, p_size::BIGINT + 1), lambda i: (p_partkey * 31 + i * 7919) % 65536) AS w FROM part)
SELECT p_partkey, (list_sum(list_transform(range(1, len(w) + 1), lambda i: (len(w) - i + 1) * w[i]))::BIGINT % 65535) * 65536 + list_sum(w)::BIGINT % 65535 AS sum FROM w""")
def fletcher32_words(spark, d):
    words = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: (F.col("p_partkey").cast("bigint") * 31 + i * 7919) % 65536)
    return table(spark, d, "part").select("p_partkey", C.fletcher32(words).alias("sum"))


@query("""WITH l AS (SELECT l_orderkey, list(l_quantity::BIGINT % 8 ORDER BY l_linenumber, l_quantity::BIGINT % 8) AS s FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey, s, unnest(range(1, len(s) + 1)) AS i FROM l),
c AS (SELECT l_orderkey, i, s[i] AS n, coalesce(list_sum(list_transform(list_filter(s, lambda m: m > 0 AND m < s[i]), lambda m: 1 << (s[i] - m))), 0)::BIGINT + len(list_filter(s[1:i - 1], lambda m: m = s[i])) AS code FROM e)
SELECT l_orderkey, array_to_string(list(CASE WHEN n > 0 THEN list_sum(list_transform(range(n), lambda b: ((code >> b) & 1) << (n - 1 - b)))::BIGINT::VARCHAR ELSE '-' END ORDER BY i), ',') AS codes FROM c GROUP BY 1""")
def huffman_codes(spark, d):
    """Code lengths from the quantities of an order's lines."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("bigint") % 8).alias("n"))))
    lengths = table(spark, d, "lineitem").groupBy("l_orderkey").agg(line.alias("l")).select("l_orderkey", F.col("l.n").alias("lengths"))
    return lengths.select("l_orderkey", F.array_join(F.transform(B.gen_codes(F.col("lengths")), lambda c: c.cast("string")), ",", "-").alias("codes"))


@query("""WITH b AS (SELECT p_partkey, p_partkey::BIGINT * 40503 % 65536 AS buf, p_size % 17 AS v FROM part)
SELECT p_partkey, array_to_string(CASE WHEN v = 16 THEN [7, buf & 255, buf >> 8] WHEN v >= 8 THEN [7, buf & 255] ELSE [7] END, ',') AS flushed, CASE WHEN v = 16 THEN 0 WHEN v >= 8 THEN v - 8 ELSE v END::INT AS valid,
 array_to_string(CASE WHEN v > 8 THEN [7, buf & 255, buf >> 8] WHEN v > 0 THEN [7, buf & 255] ELSE [7] END, ',') AS wound FROM b""")
def bit_buffer_steps(spark, d):
    s = B.bit_buffer(F.col("p_partkey").cast("bigint") * 40503 % 65536, F.col("p_size").cast("int") % 17, F.array(F.lit(7)))
    flushed, wound = B.bi_flush(s), B.bi_windup(s)
    joined = lambda x: F.array_join(F.transform(x["pending"], lambda v: v.cast("string")), ",")
    return table(spark, d, "part").select("p_partkey", joined(flushed).alias("flushed"), flushed["bi_valid"].alias("valid"), joined(wound).alias("wound"))


@query("""SELECT p_partkey, hex(encode(p_name[1:p_size % 9])) AS head, repeat('00', p_size % 9) AS zeros, CASE WHEN 1 + p_size % 31 IN (1, 2, 3, 4, 5, 6, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 28, 29, 30, 31) THEN 0 ELSE 1 END AS kind FROM part""")
def byte_helpers(spark, d):
    n = F.col("p_size").cast("int") % 9
    return table(spark, d, "part").select("p_partkey", F.hex(B.first_bytes(F.col("p_name"), n)).alias("head"), F.hex(B.zero_bytes(n)).alias("zeros"), B.data_type(F.concat(F.char(F.lit(1) + F.col("p_size") % 31), "p_name")).alias("kind"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS md5 FROM documents""")
def canonical_bodies(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.canonical_body(F.col("text"))).alias("md5"))


@query("""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(x, '# ') AND contains(x, '"'))), chr(10))) AS md5 FROM documents""")
def line_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_line_markers(F.col("text"))).alias("md5"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN -p_partkey WHEN 3 THEN NULL ELSE p_partkey END::BIGINT AS number, CASE p_partkey % 5 WHEN 0 THEN 'u32' WHEN 1 THEN 'u64' WHEN 2 THEN 'i32' WHEN 3 THEN '&''static [u8]' ELSE 'i64' END AS type,
 [p_name] AS names FROM (SELECT p_partkey, 'f_' || replace(p_name, ' ', '_') AS p_name FROM part)""")
def c_literals(spark, d):
    """Literals of each part's key in hex, unsigned, negative, quoted and long form; functions of its name."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("0x"), F.hex(k))).when(k % 5 == 1, F.concat(k.cast("string"), F.lit("UL"))).when(k % 5 == 2, F.concat(F.lit("-"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise(F.concat(k.cast("string"), F.lit("ll")))
    name = F.concat(F.lit("f_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    source = F.concat(F.lit("// pub fn no() {}\npub fn "), name, F.lit("() {}\nfn own() {} /* pub fn no() */ pub const fn "), name, F.lit("() {}"))
    return table(spark, d, "part").select("p_partkey", T.c_literal(text).alias("number"), T.literal_type(text).alias("type"), T.public_functions(source).alias("names"))


_C_TYPES = [("const char *", "*mut i8"), ("unsigned  long", "u64"), ("static const uint8_t **", "*mut *mut u8"), ("struct node *", "*mut node"), ("size_t", "usize"), ("void", "()"), ("volatile unsigned int", "u32")]


@query("SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_C_TYPES)) + " END AS rust FROM part")
def c_types(spark, d):
    text = F.get(F.array(*[F.lit(c) for c, _ in _C_TYPES]), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.c_type_to_rust(text).alias("rust"))


_FFI_TYPES = [
    ("const char *", "char", True, 1, "*const c_char"), ("unsigned  long", "unsigned long", False, 0, "c_ulong"), ("const Bytef **", "Bytef", True, 2, "*mut *const c_uchar"), ("void *", "void", False, 1, "*mut c_void"),
    ("struct part_t *", "struct part_t", False, 1, "*mut part_t"), ("size_id", "size_id", False, 0, "c_int"), ("other *", "other", False, 1, "*mut c_void"), ("uint32_t [8]", "uint32_t", False, 1, "*mut u32"), ("void", "void", False, 0, "()"),
]


@query("SELECT p_partkey, t.* FROM part JOIN (VALUES " + ", ".join(f"({i}, '{b}', {c}, {n}, '{r}')" for i, (_, b, c, n, r) in enumerate(_FFI_TYPES)) + ") AS t(k, base, is_const, depth, rust) ON p_partkey % 9 = k")
def ffi_types(spark, d):
    """C types as those of a foreign function interface, with a typedef and an opaque type."""
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 9).cast("int").alias("k"))
    rows = rows.withColumn("c", F.get(F.array(*[F.lit(x[0]) for x in _FFI_TYPES]), F.col("k")))
    return rows.select("p_partkey", "k", X.c_type(F.col("c")).alias("t"), X.ffi_type(F.col("c"), {"size_id": "c_int"}, ["part_t"]).alias("rust")).select("p_partkey", "k", "t.base", "t.is_const", "t.depth", "rust")


@query("""SELECT 'p' || p_partkey AS name, CASE p_size % 5 WHEN 0 THEN 'crc32_wrong_polynomial' WHEN 1 THEN 'adler32_wrong_base' WHEN 2 THEN 'sha256_missing_h0' WHEN 3 THEN 'aes_wrong_round_count' ELSE 'unused_input' END AS rule FROM part WHERE p_size % 2 = 0""")
def lint_findings(spark, d):
    """A function for each part, of one of five families by its size: wrong where the size is even."""
    n, odd = F.col("p_size") % 5, F.col("p_size") % 2 == 1
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    wrong = ["let p = 0x82f6_3b78; c >> 1; buf", "let base: u32 = 65_520;", "let h = [0x6a09_e668u32];", "const ROUNDS: u32 = 12;", "0"]
    right = ["let p = 0xEDB8_8320; c >> 1; buf", "let base: u32 = 65_521;", "let h = [0x6a09_e667u32];", "const ROUNDS: u32 = 10;", "data.len()"]
    source = F.concat(F.lit("pub fn f(buf: &[u8]) -> u32 { "), F.when(odd, pick(right)).otherwise(pick(wrong)), F.lit(" }"))
    name = F.when(n == 0, "buf").when(n == 4, "data").otherwise("x")
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), pick(["crc32", "adler32", "sha256", "aes", "other"]).alias("family"), pick(["ieee_reflected", "", "", "aes128_ecb", ""]).alias("variant"), source.alias("source"), F.array(F.struct(name.alias("name"), F.lit("&[u8]").alias("type"))).alias("inputs"))
    return lint_functions(rows).select("name", "rule")


@query("""SELECT p_name AS name FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 EXCEPT SELECT p_name FROM part WHERE p_partkey % 3 <> 0""")
def missing_functions(spark, d):
    """Names expected of every third part that no variant of the others' names covers."""
    parts = table(spark, d, "part")
    expected = parts.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name")).distinct()
    return R.missing_names(expected, parts.where("p_partkey % 3 <> 0").select(F.col("p_name").alias("name")))

from brindle.plans import structures  # noqa: E402, F401  registers its queries
