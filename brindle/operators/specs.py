"""Specifications as nested rows: parameter types normalized in place, stated constants held against standards, references resolved."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.staging import staged

#: The nested columns of a specification that the operators here read; rows may have more.
PARAMETER = "name: string, rust_type: string, description: string, direction: string, constraints: string"
ALGORITHM = f"name: string, category: string, mathematical_description: string, return_type: string, referenced_standards: array<string>, inputs: array<struct<{PARAMETER}>>"

#: C names that extraction leaks, with their Rust types; names of output lengths; numeric types that stand for
#: one; types of single parameters; names of modules that tell which state their functions work on.
TYPE_NAMES = {
    "z_stream": "DeflateStream", "z_streamp": "&mut DeflateStream", "Bytef": "u8", "uchf": "u8", "uInt": "u32", "uLong": "u64", "voidpf": "*mut u8", "voidp": "*mut u8",
    "ZlibStream": "DeflateStream", "ZStream": "DeflateStream", "ZStreamP": "&mut DeflateStream",
}
LENGTH_NAMES = ("destLen", "dest_Len", "destlen", "dest_len", "outlen", "out_len", "out__len", "total_out", "have", "avail_out")
LENGTH_TYPES = ("u32", "u64", "usize", "i32", "i64")
PARAMETER_TYPES = {("compress_block", "state"): "&mut DeflateState", ("compress_block", "s"): "&mut DeflateState"}
INFLATE_MODULES, DEFLATE_MODULES = ("inffast", "inftrees", "inflat"), ("trees", "deflat")
STANDARD_CONSTANTS = {"adler32": (("BASE", 65521), ("NMAX", 5552)), "crc32": (("POLY", 0xEDB88320),)}


def module_state(module: Column) -> Column:
    """The state type that a module's name tells; null for others."""
    m = F.lower(module)
    has = lambda names: m.rlike("|".join(names))
    return F.when(has(INFLATE_MODULES), "InflateState").when(has(DEFLATE_MODULES), "DeflateState")


def _without_union(t: Column) -> Column:
    """The last alternative of `a | b`."""
    parts = F.filter(F.transform(F.split(t, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.contains(t, F.lit("|")) & (F.size(parts) > 0), F.get(parts, F.size(parts) - 1)).otherwise(t)


#: Texts of which each of TYPE_NAMES contains one.
NAME_PARTS = [n for n in TYPE_NAMES if not any(o != n and o in n for o in TYPE_NAMES)]


def _renamed(t: Column) -> Column:
    out = t
    for name, rust in TYPE_NAMES.items():
        out = F.regexp_replace(out, rf"\b{name}\b", rust)
    # most types hold none of the names: plain searches of bytes spare them eleven patterns
    return F.when(reduce(Column.__or__, [F.contains(t, F.lit(n)) for n in NAME_PARTS]), out).otherwise(t)


def _own_state(t: Column, state: Column) -> Column:
    other = F.when(state == "DeflateState", "InflateState").when(state == "InflateState", "DeflateState")
    return F.when(state.isNotNull(), F.replace(t, other, state)).otherwise(t)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value under a name, so that it is evaluated once: a transform over one element. element_at, as
    [0] would work out the type of all that is nested in it again for every row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _steps(first: Column, rules: list) -> Column:
    """array<string>: first, then each rule's result from the last one's; each is bound to a name once, the array is made once."""

    def after(done: list[Column]):
        if len(done) > len(rules):
            return F.array(*done)
        return _bound(rules[len(done) - 1](done[-1]), lambda t: after([*done, t]))

    return _bound(first, lambda t: after([t]))


def _last(steps: Column) -> Column:
    return F.get(steps, F.size(steps) - 1)


def _changes(steps: Column, rules: tuple[str, ...], owner: Column, name: Column) -> Column:
    pairs = [(rule, F.get(steps, F.lit(i)), F.get(steps, F.lit(i + 1))) for i, rule in enumerate(rules)]
    real = [F.when(~before.eqNullSafe(after), F.struct(owner.alias("algorithm"), name.alias("parameter"), F.lit(rule).alias("rule"), before.alias("before"), after.alias("after"))) for rule, before, after in pairs]
    return F.array_compact(F.array(*real))


#: The rules of parameters and of results.
RULES, RESULT_RULES = ("union", "alias", "module state", "state correction", "direction"), ("union", "alias", "module state", "length")


def _parameter_steps(algorithm: Column, p: Column, state: Column) -> Column:
    d, name = p["direction"], p["name"]

    def fixed(t: Column) -> Column:
        for (fn, arg), rust in PARAMETER_TYPES.items():
            t = F.when((algorithm == fn) & (name == arg), rust).otherwise(t)
        return t

    def by_direction(t: Column) -> Column:
        vector = F.startswith(t, F.lit("Vec")) & t.rlike(r"^Vec\s*<\s*u8\s*>$")
        length = name.isin(*LENGTH_NAMES) & (t.isin(*LENGTH_TYPES) & d.isin("inout", "output") | (t == "Option<usize>") & (d == "inout"))
        return F.when(vector & d.isin("inout", "output"), "&mut [u8]").when(vector & (d == "input"), "&[u8]").when(length, "&mut usize").otherwise(t)

    return _steps(F.trim(F.coalesce(p["rust_type"], F.lit(""))), [_without_union, _renamed, lambda t: _own_state(t, state), fixed, by_direction])


def normalize_specs(specs: DataFrame, changes: str = "changes") -> DataFrame:
    """specs (name, algorithms array<struct<...>>, ...) with the types of their parameters and results rewritten in place,
    and a column of changes array<struct<algorithm, parameter, rule, before, after>>; parameter is null for a result.

    In order: the last of alternatives `a | b`; C names by TYPE_NAMES; the other coder's state by the module's own; types of
    single parameters; then byte vectors and output lengths by direction: borrowed slices and &mut usize. A result
    `Result<u64` turns to `Result<usize` where a parameter is &mut usize. Types are trimmed; null types become empty.

    Nothing is exploded or grouped: the arrays are rewritten by transform and withField, whatever other fields they have,
    in their order, so a row stays a row and no shuffle is made. Applied twice, it changes nothing more.
    """
    held = "_state" + "_" * max(map(len, specs.columns))  # a column, so that a row finds it once, of a name that no other has
    state = F.col(held)
    kind = "array<struct<algorithm:string,parameter:string,rule:string,before:string,after:string>>"

    def one(a: Column) -> Column:
        """struct<spec, changes> of an algorithm."""
        steps = F.transform(a["inputs"], lambda p: F.struct(p.alias("p"), _parameter_steps(a["name"], p, state).alias("s")))

        def with_inputs(done: Column) -> Column:
            inputs = F.transform(done, lambda x: x["p"].withField("rust_type", _last(x["s"])))
            length = F.coalesce(F.exists(inputs, lambda p: p["rust_type"] == "&mut usize"), F.lit(False))
            sized = lambda t: F.when(length, F.regexp_replace(t, r"\bResult\s*<\s*u64\b", "Result<usize")).otherwise(t)
            back = _steps(F.coalesce(a["return_type"], F.lit("")), [_without_union, _renamed, lambda t: _own_state(t, state), sized])

            def whole(r: Column) -> Column:
                of_inputs = F.flatten(F.transform(done, lambda x: _changes(x["s"], RULES, a["name"], x["p"]["name"])))
                changed = F.concat(F.coalesce(of_inputs, F.array().cast(kind)), _changes(r, RESULT_RULES, a["name"], F.lit(None).cast("string")))
                # a null result stays null where nothing rewrites it
                result = F.when(a["return_type"].isNull() & (_last(r) == ""), a["return_type"]).otherwise(_last(r))
                return F.struct(a.withField("inputs", inputs).withField("return_type", result).alias("spec"), changed.cast(kind).alias("changes"))

            return _bound(back, whole)

        return _bound(steps, with_inputs)

    done = specs.withColumn(held, module_state(F.col("name"))).withColumn("_done", F.transform("algorithms", one))
    return done.select(
        *[F.transform("_done", lambda x: x["spec"]).alias("algorithms") if c == "algorithms" else F.col(c) for c in specs.columns if c != changes],
        F.coalesce(F.flatten(F.transform("_done", lambda x: x["changes"])), F.array().cast(kind)).alias(changes),
    )


def constants_in(text: Column) -> Column:
    """array<struct<name, value>>: NAME = number in a text, names of two or more large letters or underscores, decimal or 0x.

    Numbers beyond 63 bits are left out.
    """
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z_]{2,}\s*=\s*(?:0x[0-9a-fA-F]+|[0-9]+))"), F.lit(1))

    def pair(x: Column) -> Column:
        raw = F.regexp_extract(x, r"=\s*(\S+)$", 1)
        digits = F.regexp_replace(F.regexp_replace(raw, "^0x", ""), "^0+(?=.)", "")
        value = F.when(F.startswith(raw, F.lit("0x")), F.when(F.length(digits) <= 15, F.conv(digits, 16, 10))).otherwise(F.when(F.length(digits) <= 18, digits))
        return F.struct(F.regexp_extract(x, r"^([A-Z_]+)", 1).alias("name"), value.cast("bigint").alias("value"))

    return F.filter(F.transform(found, pair), lambda p: p["value"].isNotNull())


def wrong_constants(stated: DataFrame, known: DataFrame) -> DataFrame:
    """(id, algorithm, name, stated, required) of stated (id, algorithm, text): constants that the text gives another value
    than known (algorithm, name, value) requires. What a text states twice counts as it states it last.

    Constants meet by an equi-join on algorithm and name, so that a text costs as many rows as it states constants.
    """
    found = stated.select("id", "algorithm", F.posexplode(constants_in(F.col("text"))).alias("i", "c")).groupBy("id", "algorithm", F.col("c.name").alias("name")).agg(F.max_by("c.value", "i").alias("stated"))
    wanted = known.select("algorithm", "name", F.col("value").cast("bigint").alias("required"))
    return found.join(wanted, ["algorithm", "name"]).where("stated <> required").select("id", "algorithm", "name", "stated", "required")


def matching_standards(texts: DataFrame, standards: DataFrame) -> DataFrame:
    """(id, standard): standards (standard, value), each a set of numbers, all of which stand in a text of texts (id, text).

    Numbers have posting lists: a text holds a set if it shares as many different numbers with it as the set has. A
    number in a third of all texts meets only the sets that hold it.
    """
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(0x[0-9a-fA-F]{1,15}|[0-9]{1,18})\b"), F.lit(1)))
    value = lambda x: F.when(F.startswith(x, F.lit("0x")), F.conv(F.substring(x, 3, 15), 16, 10)).otherwise(x).cast("bigint")
    posted = texts.select("id", F.explode(F.array_distinct(F.transform(numbers, value))).alias("value"))
    sets = standards.select("standard", "value").distinct()
    sizes = sets.groupBy("standard").agg(F.count(F.lit(1)).alias("size"))
    return posted.join(sets, "value").groupBy("id", "standard").agg(F.count(F.lit(1)).alias("n")).join(sizes, "standard").where("n = size").select("id", "standard")


def standard_constants() -> list[tuple[str, str, int]]:
    return [(a, n, v) for a, pairs in STANDARD_CONSTANTS.items() for n, v in pairs]


def schema_nodes(schema: str | dict) -> list[tuple[str, str, str | None]]:
    """A JSON schema as rows (path, json of what stands there but for its children, name of the definition it refers to)."""
    out = []

    def walk(x, path):
        if isinstance(x, dict):
            ref = x.get("$ref")
            name = ref.rsplit("/", 1)[-1] if isinstance(ref, str) and ref.startswith("#/$defs/") else None
            out.append((path, "{}", name))
            for k, v in x.items():
                if not (name and k == "$ref"):
                    walk(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")
        elif isinstance(x, list):
            out.append((path, "[]", None))
            for i, v in enumerate(x):
                walk(v, f"{path}/{i}")
        else:
            out.append((path, json.dumps(x), None))

    walk(json.loads(schema) if isinstance(schema, str) else schema, "")
    return out


def resolve_references(nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, path, value, cyclic): schemas as rows, with every reference replaced by what it refers to.

    nodes: (id, path, value, ref), see schema_nodes; definitions of an id lie under /$defs/<name>. A row that refers to a
    definition gets the definition's rows under its own path; a key that stands beside the reference hides the whole key
    of that name in the definition. That is repeated, a join each round of the rows that still refer with the
    definitions, so the rounds are the depth of references in references. A reference to a definition that it lies in
    already is a cycle: the row stays, marked, and ends there. References to what isn't defined stay. /$defs drops out.
    """
    all_ = staged(nodes.select("id", "path", "value", "ref"), "nodes")
    defs = all_.where("path like '/$defs/%'")
    name = F.element_at(F.split("path", "/"), 3)
    defs = staged(defs.select("id", name.alias("name"), F.expr("substring(path, length(element_at(split(path, '/'), 3)) + 8)").alias("below"), "value", F.col("ref").alias("inner")), "definitions")
    defined = defs.where("below = ''").select("id", F.col("name").alias("ref"), F.lit(True).alias("known"))
    none = F.array().cast("array<string>")
    outer = all_.where("path <> '/$defs' and path not like '/$defs/%'").select("*", none.alias("seen"))
    done = None
    for _ in range(most_rounds):
        here = staged(outer.join(defined, ["id", "ref"], "left").select("id", "path", "value", "ref", "seen", F.coalesce("known", F.lit(False)).alias("known")), "resolved")
        again = F.coalesce(F.array_contains("seen", F.col("ref")), F.lit(False))
        left = here.where(F.col("known") & ~again)
        ended = here.where(~(F.col("known") & ~again)).select("id", "path", "value", "ref", again.alias("cyclic"))
        done = ended if done is None else done.unionByName(ended)
        if left.isEmpty():
            break
        grown = left.select("id", "path", F.col("ref").alias("name"), F.array_append("seen", F.col("ref")).alias("seen")).join(defs, ["id", "name"])
        beside = here.select("id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"), F.element_at(F.split("path", "/"), -1).alias("key")).where("key <> ''")
        grown = grown.withColumn("key", F.get(F.split("below", "/"), F.lit(1))).join(beside, ["id", "path", "key"], "left_anti")
        outer = grown.select("id", F.concat("path", "below").alias("path"), "value", F.col("inner").alias("ref"), "seen")
    else:
        raise ValueError(f"references lie more than {most_rounds} deep in each other")
    back = F.concat(F.lit('{"$ref": "#/$defs/'), "ref", F.lit('"}'))
    return done.select("id", "path", F.when(F.col("ref").isNotNull(), back).otherwise(F.col("value")).alias("value"), "cyclic")


def schema_of(rows: list[tuple[str, str]]) -> object:
    """What schema_nodes took apart, from its (path, value) rows; a reference's children stand beside it."""
    root: dict = {}
    for path, value in sorted(rows, key=lambda r: [(0, int(k), "") if k.isdigit() else (1, 0, k) for k in r[0].split("/")]):
        keys = [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]]
        at, where = root, ""
        for k in keys:
            at, where = at[where], int(k) if isinstance(at[where], list) else k
        if isinstance(at, list):
            at.append(json.loads(value))
        else:
            at[where] = json.loads(value)
    return root.get("")
