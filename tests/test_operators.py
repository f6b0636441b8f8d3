import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators import relational as R
from brindle.operators import scoring as S
from brindle.operators.modules import greedy_matching
from brindle.operators.references import titled_references
from brindle.plans.registry import Plugin, Registry
from brindle.sources import corpus
from brindle.streaming import events as E


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    while True:
        grown = {n: set().union(*(out[d] for s, d in edges if s == n), out[n]) for n in nodes}
        if grown == out:
            return out
        out = grown


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rnd = random.Random(seed)
    nodes = range(14)
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(20)}
    r = reach(edges, nodes)
    want = {(n, max(m for m in nodes if m in r[n] and n in r[m])) for n in nodes if any(m != n and m in r[n] and n in r[m] for m in nodes)}
    got = G.strong_components(spark.createDataFrame(list(edges), "src int, dst int"))
    assert {tuple(x) for x in got.collect()} == want


def test_levels(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "x")], "src string, dst string")
    assert {tuple(r) for r in G.levels(nodes, edges).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", 0)}
    ring = edges.unionByName(spark.createDataFrame([("c", "b")], "src string, dst string"))
    assert {tuple(r) for r in G.levels(nodes, ring).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 0), ("e", 0)}
    with pytest.raises(ValueError):
        G.topological_order(nodes, ring)


def test_greedy_merge(spark):
    pairs = spark.createDataFrame([("a", "b", 9), ("b", "c", 8), ("c", "d", 7)], "a string, b string, n int")
    assert sorted((r.a, r.b) for r in greedy_matching(pairs).collect()) == [("a", "b"), ("c", "d")]


def test_relational(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "path string, sha256 string")
    change = R.snapshot_diff(old, new)
    assert {tuple(r) for r in change.collect()} == {("a", "deleted"), ("c", "modified"), ("d", "added")}
    assert {r.path for r in R.snapshot_diff(old.limit(0), new).collect()} == {"b", "c", "d"}
    assert [r.path for r in R.invalidated(change, old).orderBy("path").collect()] == ["a", "c"]
    want = spark.createDataFrame([("z_openFile",), ("close",)], "name string")
    have = spark.createDataFrame([("open_file",)], "name string")
    assert [r.name for r in R.missing_names(want, have).collect()] == ["close"]
    aliases = spark.createDataFrame([("sha256", "sha256"), ("sha", "sha1"), ("crc-32", "crc32")], "alias string, canonical string")
    names = spark.createDataFrame([("SHA-256",), ("sha_1x",), ("CRC-32",), ("nope",), (None,)], "name string")
    assert {r.name: r.canonical for r in R.alias_lookup(names, aliases).collect()} == {"SHA-256": "sha256", "sha_1x": "sha1", "CRC-32": "crc32", "nope": None, None: None}
    assert not R.comparison_gate(spark.createDataFrame([], "a int, b int"), "a", "b").first().ok
    vectors = spark.createDataFrame([(0, "x")], "idx int, input string")
    more = spark.createDataFrame([(i, c) for i, c in enumerate("xabcdefg")], "idx int, input string")
    assert sorted(r.input for r in R.fold_mismatches(vectors, more, "input").collect()) == list("abcdex")
    src = spark.createDataFrame([("t.c", "t"), ("u.c", "u")], "path string, stem string")
    head = spark.createDataFrame([("t.h", "t"), ("ts.h", "ts"), ("t_internal.h", "t_internal")], "path string, stem string")
    assert {r.path: r.headers for r in R.coupled_by_stem(src, head).collect()} == {"t.c": ["t.h", "t_internal.h", "ts.h"], "u.c": None}
    refs = spark.createDataFrame([("md5", "a", "RFC 1321 message digest"), ("crc", "b", "RFC 1952")], "algorithm string, variant string, title string")
    assert [r.algorithm for r in titled_references(spark.createDataFrame([("RFC 1321",)], "name string"), refs).collect()] == ["md5"]


def test_scoring(spark):
    assert spark.range(1).select(S.test_counts(F.lit("3 passed; 1 failed\n4 passed; 0 failed")).alias("x")).first().x == (7, 1)
    g = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)], "e int, w int, u int")
    assert [r.x for r in g.select(S.grade(F.col("e"), F.col("w"), F.col("u")).alias("x")).collect()] == ["A", "B", "C", "D"]


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "sub").mkdir(parents=True)
    (tmp_path / "src" / "a.c").write_text("int a;\nint b;\n")
    (tmp_path / "src" / "sub" / "b.h").write_text("x")
    (tmp_path / "src" / "test_a.c").write_text("x")
    root = str(tmp_path / "src")
    assert [(r.path, r.line_count) for r in corpus.scan_files(spark, root).collect()] == [("a.c", 3)]
    every = corpus.scan_files(spark, root, root_wins=False)
    assert {r.path for r in every.collect()} == {"a.c", "sub/b.h"}
    corpus.save_snapshot(corpus.snapshot(every), str(tmp_path / "snap"))
    assert corpus.load_snapshot(spark, str(tmp_path / "snap")).count() == 2
    assert corpus.load_snapshot(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "cat.json").write_text('{"algorithm": "md5", "vectors": [{"name": "abc", "input_hex": "616263", "expected_hex": "900150983cd24fb0d6963f7d28e17f72"}, {"name": "bad", "input_hex": "", "expected_hex": "00"}]}')
    assert {(r.name, r.ok) for r in corpus.check_vectors(corpus.load_catalog(spark, str(tmp_path / "cat.json"))).collect()} == {("abc", True), ("bad", False)}


def test_event_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = E.rollup_stream(spark, str(tmp_path / "in"), events.schema, "hourly")
    q.processAllAvailable()
    q.stop()
    batch = {(r.start, r.event_type): r.n for r in E.rollup(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.sql("select * from hourly").collect()} == batch


def test_fan_out(spark, tmp_path):
    seen, failed = [], []

    def broken(batch, epoch):
        raise RuntimeError("no")

    write = E.fan_out([broken, E.json_sink(str(tmp_path / "log")), E.null_sink, E.callback_sink(lambda b: seen.append(b.count()))], lambda i, e: failed.append(i))
    gates = spark.createDataFrame([("compile", True, "fine"), ("test", False, "1 failed")], "gate string, ok boolean, summary string").withColumn("timestamp", F.current_timestamp())
    write(E.gate_results(gates), 0)
    assert failed == [0] and seen == [2] and spark.read.json(str(tmp_path / "log")).count() == 2


def test_registry(spark):
    reg = Registry()
    good = lambda t: t.select(F.lit("r").alias("rule"), F.lit("error").alias("severity"), "location", F.lit(1).alias("line"), F.lit("m").alias("message"))
    reg.register(Plugin("p", lambda t: t.where("location <> 'x'"), [good, lambda t: t.select("nope")]))
    table = reg.extract(spark.createDataFrame([("a",), ("x",)], "location string"))
    assert sorted(r.rule for r in reg.lint(table).collect()) == ["lint-crash", "r"]
