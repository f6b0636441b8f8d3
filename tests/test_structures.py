"""Modules, fields, references, specifications, globals, spans, vectors, metrics and inputs against plain Python."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from brindle.operators import fields as FD
from brindle.operators import fuzz as Z
from brindle.operators import globals as GL
from brindle.operators import modules as M
from brindle.operators import references as RF
from brindle.operators import refactor as RE
from brindle.operators import specs as SP
from brindle.operators import workspace as W
from brindle.operators.code import code_tokens
from brindle.operators.intervals import enclosing, pieces
from brindle.operators.metrics import collect_metrics, summarize
from brindle.plans.queries import QUERIES, part_edges
from brindle.plans.structures import part_functions, vector_lines
from brindle.streaming.events import console_sink, fan_out
from brindle.sources.cavp import augment_vectors, cavp_records, read_lines


def greedy(pairs):
    taken, out = set(), []
    for n, a, b in sorted((-n, a, b) for (a, b), n in pairs.items()):
        if a not in taken and b not in taken:
            taken |= {a, b}
            out.append((a, b, -n))
    return sorted(out)


@pytest.mark.parametrize("nodes", [2, 12, 60])
def test_greedy_matching(spark, nodes):
    rng = random.Random(nodes)
    pairs = {}
    for _ in range(nodes * 4):
        a, b = sorted(rng.sample(range(nodes), 2))
        pairs[a, b] = max(rng.randint(1, 6), pairs.get((a, b), 0))
    rows = [(b, a, n) if rng.random() < 0.5 else (a, b, n) for (a, b), n in pairs.items()]
    got = M.greedy_matching(spark.createDataFrame([*rows, rows[0], (None, 1, 9), (1, 1, 9)], "a long, b long, n long"))
    assert sorted(tuple(r) for r in got.collect()) == greedy(pairs)
    assert M.greedy_matching(spark.createDataFrame([], "a long, b long, n long")).count() == 0


def plain_modules(functions, calls, least=5):
    """One after the other, as a list of modules."""
    files = defaultdict(list)
    for r in sorted(functions, key=lambda r: r.at):
        if not r.path.endswith(".h"):
            files[r.path].append(r)
    modules = {}
    for path, rows in files.items():
        name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[1]).lower()
        weight, seen = {}, set()
        for r in rows:
            if r.name not in seen and r.category is not None:
                weight[r.category] = weight.get(r.category, 0) + r.line_count * r.confidence
            seen.add(r.name)
        told = "algorithm" if name in M.ALGORITHM_NAMES else "glue" if name in M.GLUE_NAMES else "api" if name in M.API_NAMES else "algorithm" if any(a in name for a in M.ALGORITHM_NAMES) else None
        if told:
            weight[told] = weight.get(told, 0) + 100
        lines = sum(r.line_count for r in rows)
        best = max(weight, key=weight.get) if weight else "glue"
        modules[path] = (name, best, min(weight.get(best, 0) / (lines + 1), 1.0), lines, [r.name for r in rows])
    groups = [sorted(p for p in modules if modules[p][0] in g) for g in M.KNOWN_GROUPS]
    groups = [g for g in groups if len(g) > 1]
    used = {p for g in groups for p in g}
    owner = {}
    for path in sorted(modules):
        owner |= dict.fromkeys(modules[path][4], path)
    pairs = Counter()
    for a, b in calls:
        if a in owner and b in owner and owner[a] != owner[b] and not {owner[a], owner[b]} & used:
            pairs[tuple(sorted((owner[a], owner[b])))] += 1
    merged = greedy({k: n for k, n in pairs.items() if n >= least})
    groups += [[a, b] for a, b, _ in merged]
    used = {p for g in groups for p in g}
    out = []
    for g in groups + [[p] for p in modules if p not in used]:
        lead = max(g, key=lambda p: (modules[p][0] in M.PREFERRED, modules[p][3], -g.index(p)))
        out.append((modules[lead][0], modules[lead][1], round(modules[lead][2], 9), sum(modules[p][3] for p in g), tuple(sorted(f for p in g for f in modules[p][4])), tuple(sorted(g))))
    return sorted(out)


def test_modules(spark, sf_dir):
    calls = [(f"f{r.src}", f"f{r.dst}") for r in part_edges(spark, sf_dir).collect()]
    got = sorted((r.name, r.category, round(r.confidence, 9), r.total_lines, tuple(sorted(r.functions)), tuple(r.members)) for r in QUERIES["modules"](spark, sf_dir).collect())
    want = plain_modules(part_functions(spark, sf_dir).collect(), calls)
    assert got == want and any(len(x[5]) == 2 for x in want)


def test_known_groups_headers_and_reports(spark):
    kind = "path string, name string, line_count long, category string, confidence double, at long"
    rows = [("z/inflate.c", "a", 10, "glue", 0.5, 0), ("z/inftrees.c", "b", 90, None, None, 1), ("y/inffast.c", "c", 5, "api", 1.0, 2), ("q.c", "d", 3, None, None, 3), ("q.h", "e", 3, "api", 1.0, 4), ("q.c", "d", 4, "api", 1.0, 5)]
    calls = spark.createDataFrame([("d", "a"), (None, "a")], "src string, dst string")
    headers = spark.createDataFrame([("x/q.h",), ("qs.h",), ("inflate_internal.h",)], "path string")
    got = M.detect_modules(spark.createDataFrame(rows, kind), calls, headers)
    top, last = M.by_importance(got).collect()
    assert (top.name, top.category, top.total_lines, top.members) == ("inflate", "algorithm", 105, ["y/inffast.c", "z/inflate.c", "z/inftrees.c"])
    assert top.description == "Merged module: inflate + inffast, inftrees" and "inflate_internal.h" in top.files
    assert (last.name, last.category, last.total_lines, last.files, last.functions) == ("q", "glue", 7, ["q.c", "qs.h", "x/q.h"], ["d", "d"])
    assert M.detect_modules(spark.createDataFrame([], kind), calls).count() == 0


SPEC = "at long, name string, shared_types array<struct<name:string,fields:array<struct<name:string,rust_type:string>>>>, algorithms array<struct<name:string,state:array<struct<name:string,rust_type:string>>>>"


def test_fields_of_specs_and_code(spark):
    specs = [
        (0, "m", [("Z", [("a", None), ("b", "u8")])], [("inflate", [("hold", "u32"), ("a", "?")])]), (1, "n", [("Z", [("a", "u16"), ("b", "u32")]), ("inflate_state", [("hold", "u64")])], None), (2, "o", None, []),
    ]
    merged = FD.merge_fields(FD.spec_fields(spark.createDataFrame(specs, SPEC)))
    got = {(r.type_name, r.field): (r.rust_type, r.sources, r.kinds) for r in merged.collect()}
    assert got == {
        ("Z", "a"): ("u16", ["shared_types[m]", "shared_types[n]"], ["u16"]), ("Z", "b"): ("u8", ["shared_types[m]", "shared_types[n]"], ["u32", "u8"]),
        ("inflate_state", "hold"): ("u64", ["shared_types[n]", "state[inflate]"], ["u32", "u64"]), ("inflate_state", "a"): ("?", ["state[inflate]"], []),
    }
    assert {r.type_name: r.code for r in FD.render_structs(merged).collect()}["Z"] == "#[derive(Debug, Default)]\npub struct Z {\n    pub a: u16,\n    pub b: u8,\n}"
    code = spark.createDataFrame([("a.rs", "state.hold += s.window.len(); self.foo(strm.as_mut().unwrap().msg); state.len(); x.bar"), ("b.rs", None)], "path string, text string")
    assert {(r.field, r.rust_type) for r in FD.code_fields(code, "path", "text").collect()} == {("hold", "u32"), ("window", "alloc::vec::Vec<u8>"), ("foo", "u32"), ("msg", "Option<&'static str>")}


def test_field_merge_is_associative(spark):
    """Any split of the rows, merged in parts and then together, gives what all rows give at once."""
    rng = random.Random(1)
    rows = [(f"T{rng.randint(0, 3)}", f"f{rng.randint(0, 5)}", rng.choice(["?", "u8", "u16", "Vec<u8>"]), f"s{rng.randint(0, 9)}", (rng.randint(0, 2), i)) for i in range(300)]
    whole = sorted(tuple(r) for r in FD.merge_fields(spark.createDataFrame(rows, FD.FIELDS)).collect())
    for parts in (2, 3):
        cut = defaultdict(list)
        for r in rows:
            cut[rng.randrange(parts)].append(r)
        merged = [FD.merge_fields(spark.createDataFrame(p, FD.FIELDS)) for p in cut.values()]
        together = merged[0]
        for m in merged[1:]:
            together = FD.merge_fields(together.unionByName(m))
        assert sorted(tuple(r) for r in together.collect()) == whole


def test_references(spark):
    aliases = spark.createDataFrame([("crc", "crc32_ieee"), ("crc32", "crc32_ieee"), ("sha_1", "sha1"), ("castagnoli", "crc32c")], "alias string, canonical string")
    refs = spark.createDataFrame([("crc32_ieee", "table", 1, 0), ("crc32_ieee", "slow", 1, 1), ("crc32_ieee", "mine", 0, 9), ("sha1", "plain", 1, 2), ("My_Hash", "x", 1, 3)], "algorithm string, variant string, layer int, at long")
    asked = ["CRC-32", "crc", "Sha1", " SHA-1 ", "my hash", "My_Hash", "castagnoli", "", None, "zip"]
    names = spark.createDataFrame([(a,) for a in asked], "name string")
    got = {r.name: r.algorithm for r in RF.canonical_names(names, aliases, refs).collect()}
    assert got == {"CRC-32": "crc32_ieee", "crc": "crc32_ieee", "Sha1": "sha1", " SHA-1 ": "sha1", "my hash": "My_Hash", "My_Hash": "My_Hash", "castagnoli": "crc32c"}
    found = RF.find_references(names, aliases, refs)
    assert [r.variant for r in sorted(found.where("name = 'crc'").collect(), key=lambda r: r.place)] == ["mine", "table", "slow"]
    hints = spark.createDataFrame([("crc", "slow"), ("CRC-32", "none")], "name string, variant string")
    best = {r.name: r.variant for r in RF.best_references(found, hints).collect()}
    assert (best["crc"], best["CRC-32"], best["Sha1"]) == ("slow", "mine", "plain")
    assert {r.name: r.variant for r in RF.best_references(found).collect()}["crc"] == "mine"


def test_citations_against_brute_force(spark):
    rng = random.Random(4)
    words = ["adler", "32", "rfc", "1950", "x", "checksum", "zlib", "Crc", "ab"]
    text = lambda n: rng.choice([" ", "-", ""]).join(rng.choice(words) for _ in range(rng.randint(1, n)))
    refs = [(f"a{i}", f"v{i % 3}", [text(3) for _ in range(rng.randint(0, 3))]) for i in range(40)]
    wanted = sorted({text(6) for _ in range(60)}) + [None, "", " "]
    got = {tuple(r) for r in RF.citing_references(spark.createDataFrame([(w,) for w in wanted], "wanted string"), spark.createDataFrame(refs, "algorithm string, variant string, standards array<string>")).collect()}
    want = {}
    for w in filter(None, wanted):
        t = w.strip().lower()
        for a, v, standards in refs:
            for c in map(str.lower, standards):
                long = [x for x in c.split() if len(x) > 2]
                if t and (c in t or t in c or (long and all(x in t for x in long))):
                    want[w, a, v] = max(want.get((w, a, v), 0), len(c))
    assert got == {(*k, n) for k, n in want.items()}
    plan = RF.citing_references(spark.createDataFrame([("a",)], "wanted string"), spark.createDataFrame(refs, "algorithm string, variant string, standards array<string>"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


SPECS = "name string, algorithms array<struct<name:string,category:string,inputs:array<struct<name:string,rust_type:string,direction:string,note:int>>,return_type:string,extra:map<string,int>>>"


def test_normalized_specs(spark):
    rows = [
        ("inflate", [("f", "c", [("dest", "Vec<u8>", "inout", 1), ("destLen", "u64", "inout", 2), ("src", " Vec < u8 > ", "input", 3), ("s", "&mut DeflateState", "input", 4), ("w", "u32 | u64", "input", 5)], "Result<u64, E>", {"k": 1})]),
        ("trees", [("compress_block", None, [("s", "z_streamp", "inout", 1), ("have", "Option<usize>", "output", 2), ("z", "z_streamp_foo", "input", 3)], "uLong", None), ("g", None, None, None, None)]),
        ("x", None),
    ]
    out = SP.normalize_specs(spark.createDataFrame(rows, SPECS))
    got = {r.name: r for r in out.collect()}
    f = got["inflate"].algorithms[0]
    assert [(p.rust_type, p.note) for p in f.inputs] == [("&mut [u8]", 1), ("&mut usize", 2), ("&[u8]", 3), ("&mut InflateState", 4), ("u64", 5)]
    assert (f.return_type, f.extra) == ("Result<usize, E>", {"k": 1})
    assert {(c.parameter, c.rule) for c in got["inflate"].changes} == {("dest", "direction"), ("destLen", "direction"), ("src", "direction"), ("s", "module state"), ("w", "union"), (None, "length")}
    c, g = got["trees"].algorithms
    assert [p.rust_type for p in c.inputs] == ["&mut DeflateState", "Option<usize>", "z_streamp_foo"] and c.return_type == "u64"
    assert g.inputs is None and g.return_type is None and got["x"].algorithms is None and got["x"].changes == []
    again = SP.normalize_specs(out)
    assert all(r.changes == [] for r in again.collect()) and [r.algorithms for r in again.orderBy("name").collect()] == [r.algorithms for r in out.orderBy("name").collect()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_normalized_specs_bind_by_element_at(spark):
    plan = SP.normalize_specs(spark.createDataFrame([], SPECS))._jdf.queryExecution().optimizedPlan().toString()
    # [0] on a nested transform works out its type for every row; a row finds its module's state once
    assert plan.count("element_at(transform(") >= 10 and "transform(array(" in plan and ", false))[0]" not in plan
    assert plan.count("RLIKE(lower(") == 2
    names = list(SP.TYPE_NAMES) + [f"*{n}" for n in SP.TYPE_NAMES] + ["u8", "", "x_z_stream", "Zlib", "Option<ZStreamP>"]
    rows = [("m", [("f", None, [("p", t, "input", 0) for t in names], None, None)])]
    got = [p.rust_type for p in SP.normalize_specs(spark.createDataFrame(rows, SPECS)).first().algorithms[0].inputs]
    want = []
    for t in names:
        for n, rust in SP.TYPE_NAMES.items():
            t = re.sub(rf"\b{n}\b", rust, t)
        want.append(t)
    assert got == want
    assert SP.normalize_specs(spark.createDataFrame(rows, SPECS).withColumn("_state", F.lit(7))).first()["_state"] == 7


def test_constants(spark):
    text = "BASE = 255 and POLY=0xEDB88320; N = 3; NM_AX = 99999999999999999999; base = 1; BASE =65521"
    got = spark.range(1).select(SP.constants_in(F.lit(text)).alias("c")).first().c
    assert [(c.name, c.value) for c in got] == [("BASE", 255), ("POLY", 0xEDB88320), ("BASE", 65521)]
    known = spark.createDataFrame(SP.standard_constants(), "algorithm string, name string, value long")
    stated = spark.createDataFrame([(1, "adler32", "BASE = 255"), (2, "adler32", text), (3, "crc32", "POLY = 0x04C11DB7, BASE = 1"), (4, "md5", "BASE = 1"), (5, "adler32", None)], "id long, algorithm string, text string")
    assert sorted(tuple(r) for r in SP.wrong_constants(stated, known).collect()) == [(1, "adler32", "BASE", 255, 65521), (3, "crc32", "POLY", 0x04C11DB7, 0xEDB88320)]
    sets = spark.createDataFrame([("a", 1), ("a", 16), ("b", 1), ("c", 5), ("c", 1)], "standard string, value long")
    texts = spark.createDataFrame([(1, "1 and 0x10 and 1"), (2, "x1 5"), (3, None), (4, "5, 1")], "id long, text string")
    assert sorted(tuple(r) for r in SP.matching_standards(texts, sets).collect()) == [(1, "a"), (1, "b"), (4, "b"), (4, "c")]


def plain_resolve(x, defs, seen=()):
    if isinstance(x, dict):
        ref = x.get("$ref", "")
        name = ref.rsplit("/", 1)[-1] if isinstance(ref, str) and ref.startswith("#/$defs/") else None
        if name in defs:
            if name in seen:
                return {"$ref": ref} | {k: plain_resolve(v, defs, seen) for k, v in x.items() if k != "$ref"}
            inner, outer = plain_resolve(defs[name], defs, (*seen, name)), {k: plain_resolve(v, defs, seen) for k, v in x.items() if k != "$ref"}
            return {**inner, **outer}
        return {k: plain_resolve(v, defs, seen) for k, v in x.items()}
    return [plain_resolve(v, defs, seen) for v in x] if isinstance(x, list) else x


def test_references_of_schemas(spark):
    schemas = {
        1: {"type": "object", "properties": {"a": {"$ref": "#/$defs/A", "description": "mine"}, "b": [1, {"$ref": "#/$defs/B"}, "x"]}, "$defs": {"A": {"title": "A", "description": "theirs", "items": {"$ref": "#/$defs/B"}}, "B": {"n": 1.5, "none": None}}},
        2: {"$ref": "#/$defs/L", "$defs": {"L": {"value": {"type": "int"}, "next": {"$ref": "#/$defs/L"}, "other": {"$ref": "#/$defs/M"}}, "M": {"back": {"$ref": "#/$defs/L", "k/~": True}}}},
        3: {"x": {"$ref": "#/$defs/none"}, "y": {}},
        4: {"p": {"$ref": "#/$defs/A", "items": {"z": 0}}, "$defs": {"A": {"items": {"deep": [1, 2]}, "q": "w"}}},
    }
    rows = [(i, *n) for i, s in schemas.items() for n in SP.schema_nodes(json.dumps(s))]
    found = defaultdict(list)
    for r in SP.resolve_references(spark.createDataFrame(rows, "id long, path string, value string, ref string")).collect():
        found[r.id].append((r.path, r.value))
    for i, s in schemas.items():
        body = {k: v for k, v in s.items() if k != "$defs"}
        assert SP.schema_of(found[i]) == plain_resolve(body, s.get("$defs", {})), i


def test_constant_names(spark, sf_dir):
    got = {r.name: r.depth for r in QUERIES["constant_chain"](spark, sf_dir).collect()}
    keys = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect()]
    uses = {k: ({k // 2, k // 3} | ({k + 1} if k % 101 == 0 else set())) - {k} for k in keys}
    depth, grown = {}, True
    while grown:
        new = {k: 1 + max((depth[u] for u in uses[k] if u in uses), default=-1) for k in keys if k not in depth and k % 37 != 5 and all(u in depth for u in uses[k] if u in uses)}
        depth |= new
        grown = bool(new)
    assert got == {f"n{k}": d for k, d in depth.items()}
    rows = [("a", "b + 1", False), ("b", "a", False), ("c", "a", False), ("d", "7 + d", False), ("e", "d * zz", None), ("f", None, False), ("f", "e", True), (None, "x", False)]
    assert {(r.name, r.depth) for r in GL.constant_names(spark.createDataFrame(rows, "name string, code string, fixed boolean")).collect()} == {("d", 0), ("e", 1)}


def test_globals(spark):
    kind = "name string, c_type string, is_const boolean, is_extern boolean, init_code string, has_init_function boolean, is_mutated_after_init boolean"
    rows = [
        ("tab", "unsigned long[256]", False, False, "tab(n) ^= 0x1; {min(a, 2)}", False, False), ("t2", "int [4]", None, None, "{K, 2}", False, False), ("lazy", "float", False, False, "", True, False), ("n", "unsigned int", False, False, None, False, True),
        ("buf", "uint8_t[16]", False, False, None, False, True), ("e", None, False, True, None, False, False), ("s", "short", False, False, None, False, False), ("call", "char[2]", False, False, "{make(1)}", False, False),
    ]
    got = {r.name: (r.strategy, r.rust_type, r.rust_init) for r in GL.classify_globals(spark.createDataFrame(rows, kind)).collect()}
    assert got["tab"] == ("const_table", "[u64; 256]", "const TAB: [u64; 256] = { /* computed at compile time */ };")
    assert got["lazy"] == ("lazy_init", "std::sync::LazyLock<f32>", "static LAZY: LazyLock<f32> = LazyLock::new(|| init_lazy());")
    assert (got["n"][:2], got["buf"][:2], got["e"][0], got["s"]) == (("atomic", "AtomicU32"), ("arc_mutex", "Arc<Mutex<[u8; 16]>>"), "opaque_extern", ("const_table", "i16", "const S: i16 = 0;"))
    assert got["call"][2] == "const CALL: [i8; 2] = 0;"
    with_names = GL.classify_globals(spark.createDataFrame(rows, kind), spark.createDataFrame([("call",)], "name string"))
    assert {r.name: r.rust_init for r in with_names.collect()}["call"] == "const CALL: [i8; 2] = { /* computed at compile time */ };"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70)), min_size=1, max_size=20))
def test_pieces_cover_their_span(spark, spans):
    rows = spark.createDataFrame(spans, "s long, e long").select("s", "e", pieces(F.col("s"), F.col("e")).alias("p")).collect()
    for r in rows:
        covered = sorted(x for p in r.p for x in range(p.piece << p.level, (p.piece + 1) << p.level))
        assert covered == list(range(r.s, r.e)) and len(r.p) <= 14


def test_enclosing(spark):
    rng = random.Random(2)
    spans = [(rng.randint(0, 3), s := rng.randint(0, 3000), s + rng.choice([0, 1, 7, 100, 5000]), f"n{i}") for i in range(200)] + [(1, 0, 2**40, "all"), (None, 0, 9, "x"), (2, None, 5, "y")]
    points = [(rng.randint(0, 4), rng.randint(0, 4000)) for _ in range(300)] + [(1, 2**39), (1, None)]
    got = enclosing(spark.createDataFrame(points, "f long, at long"), spark.createDataFrame(spans, "f long, start long, end long, name string"), ["f"], "at").collect()
    assert len(got) == len(points)
    for r in got:
        held = [(s, -e) for f, s, e, _ in spans if f == r.f and s is not None and r.at is not None and s <= r.at < e]
        assert (r.start, r.end) == ((max(held)[0], -max(held)[1]) if held else (None, None))
    assert enclosing(spark.createDataFrame(points, "f long, at long"), spark.createDataFrame([], "f long, start long, end long, name string"), ["f"], "at").where("name is not null").count() == 0


def test_enclosing_short_spans(spark):
    """A point is one row where no span reaches over a whole block, whatever the places; results are those of brute force."""
    rng = random.Random(5)
    points = [(rng.randint(0, 2), rng.randint(0, 5000)) for _ in range(400)]
    for lengths in ((1, 2, 3), (97, 40, 60), (1, 1, 3000), (1, 900, 900)):
        spans = [(rng.randint(0, 2), s := rng.randint(0, 5000), s + rng.choice(lengths), i) for i in range(500)]
        found = enclosing(spark.createDataFrame(points, "f long, at long"), spark.createDataFrame(spans, "f long, start long, end long, k long"), ["f"], "at")
        if max(lengths) < 100:
            assert "explode([0" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = found.collect()
        assert len(got) == len(points)
        for r in got:
            held = [(s, -e) for f, s, e, _ in spans if f == r.f and s <= r.at < e]
            assert (r.start, r.end) == ((max(held)[0], -max(held)[1]) if held else (None, None))
            assert not held or (r.f, r.start, r.end) == spans[r.k][:3]


def test_relocations(spark):
    log = ["error[E0116]: cannot", "  --> zlib-a/src/x.rs:3:1", "   |", "3  | impl <T> Foo {", "", "error[E0308]: other", "error[E0116]: again", " --> /w/b/src/y.rs:1:2", "impl Gone"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(log)], "log string, line long, text string")
    errors = sorted(tuple(r) for r in RE.orphan_errors(lines, "/w").collect())
    assert errors == [("l", 0, "Foo", "zlib-a/src/x.rs", "zlib-a"), ("l", 6, "Gone", "/w/b/src/y.rs", "b")]
    files = spark.createDataFrame([("b", "b/src/l.rs", "// pub struct Gone\n pub enum Foo {"), ("c", "c/src/l.rs", "pub type Foo = u8;\npub union Gone {"), ("target", "t.rs", "pub struct Gone")], "crate string, path string, text string")
    defs = RE.type_definitions(files)
    assert sorted(tuple(r) for r in defs.collect()) == [("Foo", "b", "b/src/l.rs", 2), ("Gone", "c", "c/src/l.rs", 2)]
    moved = {(r.type_name, r.from_crate, r.to_crate) for r in RE.relocations(RE.orphan_errors(lines, "/w"), defs).collect()}
    assert ("Gone", "c", "b") in moved
    named = spark.createDataFrame([("p", 1, 50, "outer"), ("p", 10, 20, "inner")], "path string, start long, end long, name string")
    places = spark.createDataFrame([("p", 15), ("p", 30), ("p", 60), ("q", 15)], "path string, line long")
    assert {(r.path, r.line): r.name for r in RE.places_in_definitions(places, named).collect()} == {("p", 15): "inner", ("p", 30): "outer", ("p", 60): None, ("q", 15): None}


def test_relocations_send_no_exploded_rows(spark):
    """Errors and lines of a small table are many once exploded: neither goes whole to the driver and all executors."""
    text = F.array(*[F.lit(x) for x in ("error[E0116]: x", " --> c1/src/x.rs:3:1", "impl Foo {", "", "note", "")])
    lines = spark.range(300).select((F.col("id") % 7).alias("log"), F.posexplode(text).alias("i", "text"), F.floor(F.col("id") / 7).alias("k")).select("log", (F.col("k") * 10 + F.col("i")).alias("line"), "text")
    errors = RE.orphan_errors(lines)
    assert "Broadcast" not in errors._jdf.queryExecution().executedPlan().toString()
    assert {(r.log, r.line, r.type_name, r.impl_crate) for r in errors.collect()} == {(i % 7, i // 7 * 10, "Foo", "c1") for i in range(300)}


def plain_records(lines):
    """(section, fields) of one file's lines in order."""
    out, section, fields, first = [], None, {}, None
    for v in lines:
        if m := re.match(r"^\s*\[(.*)\]\s*$", v):
            section = m[1]
        m2 = None if m or v.lstrip().startswith("#") else re.match(r"^\s*([^=#\[\]\s][^=]*?)\s*=\s*(.*?)\s*$", v)
        if m or not v.strip():
            first = None
        if m2:
            if first is None or m2[1] == first:
                first = m2[1]
                out.append((section, {}))
            out[-1][1][m2[1]] = m2[2]
    return out


CAVP = "# CAVS 11.1\n[L = 32]\n\nLen = 0\nMsg = 00\nMD = e3b0\n\nLen = 8\nMsg = d3\n# note = x\nMD = 28\nLen = 16\nMD = 1=2\n[ENCRYPT]\n[L = 20]\nKEY = a b\n\n\nKEY = c\nKEY = d\nIV =\nIV = 5\n"


def test_vectors_at_any_split_size(spark, tmp_path):
    (tmp_path / "a.rsp").write_text(CAVP * 30)
    (tmp_path / "b.rsp").write_text("X = 1\n" + CAVP)
    seen, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            lines = read_lines(spark, str(tmp_path))
            rows = sorted((r.file[-5:], r.record, r.section, tuple(sorted(r.fields.items()))) for r in cavp_records(lines).collect())
            seen.append(rows)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        assert read_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(f, i, s, tuple(sorted(x.items()))) for f, t in (("a.rsp", CAVP * 30), ("b.rsp", "X = 1\n" + CAVP)) for i, (s, x) in enumerate(plain_records(t.split("\n")))]
    assert seen[0] == seen[1] == seen[2] == sorted(want)


def test_vector_query(spark, sf_dir):
    files = defaultdict(list)
    for r in sorted(vector_lines(spark, sf_dir).collect(), key=lambda r: (r.file, r.split, r.i)):
        files[r.file].append(r.value)
    want = sorted((f, i, s, json.dumps(x, sort_keys=True)) for f, v in files.items() for i, (s, x) in enumerate(plain_records(v)))
    got = sorted((r.file, r.record, r.section, json.dumps(json.loads(r.fields), sort_keys=True)) for r in QUERIES["vector_records"](spark, sf_dir).collect())
    assert got == want


def test_augmented_vectors(spark):
    kind = "name string, category string, canonical string, test_vectors array<struct<description:string,expected_output:string>>"
    algs = spark.createDataFrame([("a", "hash", "md5", [("x", "1")]), ("b", "hash", "md5", None), ("c", "glue", "md5", None), ("d", "cipher", "aes", [("y", "2")])], kind)
    catalog = spark.createDataFrame([("md5", ("x", "1")), ("md5", ("z", "3"))], "canonical string, vector struct<description:string,expected_output:string>")
    got = {r.name: ([tuple(v) for v in r.test_vectors], r.n_added) for r in augment_vectors(algs, catalog).collect()}
    assert got == {"a": ([("x", "1"), ("z", "3")], 1), "b": ([("x", "1"), ("z", "3")], 2), "c": ([], 0), "d": ([("y", "2")], 0)}


def test_metrics(spark, tmp_path):
    rows = [("rust", "a", "a/x.rs", "fn f() {\n  // c\n\n  unsafe { g() }\n}"), ("rust", "b", "b/y.rs", "unsafe impl T {}\nunsafe fn h() {}"), ("rust", None, "z.rs", None), ("c", "s", "m.c", "int x;\nint y;")]
    path = str(tmp_path / "files")
    spark.createDataFrame(rows, "kind string, crate string, path string, text string").write.parquet(path)
    seen = Observation()
    df = collect_metrics(spark.read.parquet(path), seen)
    got = {(r.kind, r.crate, r.kind_level, r.crate_level): (r.files, r.n_lines, r.code_lines, r.unsafe_blocks, r.files_with_unsafe) for r in df.collect()}
    assert got[(None, None, 1, 1)] == (4, 10, 7, 3, 2) and got[("rust", None, 0, 1)] == (3, 8, 5, 3, 2) and got[("rust", None, 0, 0)] == (1, 1, 0, 0, 0)
    assert seen.get == {"files": 4, "n_lines": 10, "unsafe_blocks": 3}
    assert collect_metrics(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [tuple(r) for r in summarize(df).collect()] == [(3, 3, 8, 2, 2, 4.0)]


def test_inputs_at_any_partitioning(spark):
    kinds = [("a", "u8"), ("b", "i64"), ("c", "u64"), ("d", "bool"), ("e", "f64"), ("f", "&[u8]"), ("g", "String"), ("h", "usize")]
    made = [sorted(map(str, Z.fuzz_inputs(spark.range(200, numPartitions=n).withColumnRenamed("id", "idx"), kinds, seed=3).collect())) for n in (1, 7)]
    assert made[0] == made[1]
    other = sorted(map(str, Z.fuzz_inputs(spark.range(200).withColumnRenamed("id", "idx"), kinds, seed=4).collect()))
    assert other != made[0]
    rows = {r.idx: r for r in Z.fuzz_inputs(spark.range(2000).withColumnRenamed("id", "idx"), kinds).collect()}
    assert [rows[i].a for i in range(3)] == [0, 255, 1] and (rows[0].b, rows[1].b) == (-(2**63), 2**63 - 1) and [len(rows[i].f) for i in range(10)] == list(Z.LENGTHS)
    assert all(0 <= r.a < 256 and 0 <= r.c and len(r.f) <= 256 for r in rows.values()) and len({r.b for r in rows.values()}) > 1990 and min(r.b for r in rows.values() if r.idx > 2) < 0
    pairs = Z.transform_inputs(spark.range(30).withColumnRenamed("id", "idx"), [("buf", "&[u8]"), ("buf_len", "usize"), ("n", "u8")]).collect()
    assert all(r.buf_len == len(r.buf) for r in pairs)


def test_state_vectors(spark):
    after = lambda c: {"bi_buf": c["bi_buf"] * 0, "bi_valid": c["bi_valid"] + c["length"]}
    rows = Z.fuzz_state(spark.range(5).withColumnRenamed("id", "idx"), [("bi_buf", "u16"), ("bi_valid", "i32"), ("pending", "Vec<u8>")], [("length", "u8")], after).collect()
    assert [r.expected for r in rows][:3] == ["bi_buf:u16=0u16\nbi_valid:i32=(-2147483648i32)", "bi_buf:u16=0u16\nbi_valid:i32=2147483902i32", "bi_buf:u16=0u16\nbi_valid:i32=2i32"]
    assert rows[0].inputs["state.pending"] == "vec![]" and rows[1].inputs["length"] == "255u8" and len(rows) == 5


def test_tokens(spark):
    code = 'fn f(x: &[u8]) { // a "b"\n let s = r#"}"#; let c = \'{\'; /* { \n */ g("\\"}", 0x1F_u8) }\n\'a'
    rows = code_tokens(spark.createDataFrame([(1, code), (2, None), (3, "")], "id long, text string"), "id", "text").orderBy("i").collect()
    assert all(code[r.pos : r.pos + len(r.token)] == r.token and code[: r.pos].count("\n") + 1 == r.line for r in rows)
    assert [r.token for r in rows if r.kind in ("comment", "string")] == ['// a "b"', 'r#"}"#', "'{'", "/* { \n */", '"\\"}"']
    assert [(r.brace, r.paren) for r in rows if r.token in "{}()"] == [(0, 1), (0, 0), (1, 0), (1, 1), (1, 0), (0, 0)] and {r.id for r in rows} == {1}
    long = '"' + "\\n" * 200_000 + '" /*' + "*" * 200_000 + "*/ x"
    assert [len(r.token) for r in code_tokens(spark.createDataFrame([(1, long)], "id long, text string"), "id", "text").orderBy("i").collect()] == [400_002, 200_004, 1]


def test_workspace(spark):
    kind = "crate string, module string, algorithm string, name string"
    expected = spark.createDataFrame([("a", "m", "x", "z_openFile"), ("a", "m", "y", "close"), ("b", "m", "z", "close"), ("c", "m", "w", "gone")], kind)
    files = spark.createDataFrame([("a", "pub(crate) fn open_file() {}\nfn close() {}"), ("b", "pub fn close() {}"), ("c", None)], "crate string, text string")
    checked = W.check_workspace(expected, files)
    assert {(r.crate, r.name): r.found for r in checked.collect()} == {("a", "z_openFile"): True, ("a", "close"): False, ("b", "close"): True, ("c", "gone"): False}
    assert {r.crate: (r.expected, r.found) for r in W.workspace_summary(checked).collect()} == {"a": (2, 1), "b": (1, 1), "c": (1, 0), None: (4, 2)}
    log = ["note", "error[E1]: a", " --> /w/src/x.rs:1:2", "  |", "warning: b", " --> src\\y.rs:3:4", "error: lost", "error: c", " --> src/x.rs:9:9"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(log)], "log string, line long, text string")
    for chunk in (2, 100_000):
        got = {r.file: (r.n, r.message) for r in W.errors_by_file(lines, "/w", chunk).collect()}
        assert got == {"src/x.rs": (2, "error[E1]: a\n --> /w/src/x.rs:1:2\n  |\n\nerror: c\n --> src/x.rs:9:9"), "src/y.rs": (1, "warning: b\n --> src\\y.rs:3:4")}


def test_rewrite_rules(spark):
    types = [("&mut S", "&S", True), ("&S", "&S", False), ("S", "&mut S", True), ("&T", "&S", False)]
    df = spark.createDataFrame(types, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", W.only_mutability_differs(F.col("a"), F.col("b")).alias("got")).collect())
    fixes = [("bool", "i32", None, True), (" u16", "i32", "", True), ("u32", "u64", None, False), ("u32", "u64", "z_word_t", True), ("Result<u32>", "()", None, False), ("i64", "()", None, True), ("i32", "i64", None, False), ("&u8", "i32", None, False)]
    df = spark.createDataFrame(fixes, "a string, b string, c string, want boolean")
    assert all(r.got == r.want for r in df.select("want", W.safe_return_fix(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect())
    exprs = [("(1 << 15) - 1", True), ("0x1Fu | N", True), ("foo(42)", False), ("'a' + 1", True), ("a.b", False), ("", True), ('"s"', False), ("~0UL", True), ("f (1)", False)]
    df = spark.createDataFrame(exprs, "a string, want boolean")
    assert all(r.got == r.want for r in df.select("want", W.safe_constant(F.col("a")).alias("got")).collect())
    specs = [("m", [("main", "x"), ("gen_trees_header", None), ("my_Test", None), ("emit", "Generates  C source"), ("adler32", None)]), ("n", [("example", None)]), ("o", None)]
    out = W.without_build_utilities(spark.createDataFrame(specs, "name string, algorithms array<struct<name:string,description:string>>"))
    assert [(r.name, [a.name for a in r.algorithms]) for r in out.collect()] == [("m", ["adler32"])]


def test_console_sink(spark, capsys):
    fan_out([console_sink(2)])(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, s string").coalesce(1), 0)
    assert capsys.readouterr().out.splitlines() == ['{"n":1,"s":"a"}', '{"n":2,"s":"b"}']
