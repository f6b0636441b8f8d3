"""op5, op9, components and the whole pipeline against plain Python."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm._graph import connected_components
from brindle.llm.decontaminate import find_leaks, simhash, simhash_between, tallies, weighted_similarity
from brindle.llm.queries import MIX, QUERIES
from brindle.llm.source_mix import apportion, mix_sources


def targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def check_mix(rows, block=64):
    sizes, taken, got = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        got[r.source] = (r.source_size, r.target)
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for s in sizes:
        assert got[s][0] == sizes[s] and abs(got[s][1] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= block + 0.02 * want[s]


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix_sources(docs, **MIX).collect()
    check_mix(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode().split()) for r in rows)
    again = {r.doc_id: r.taken for r in mix_sources(docs.repartition(3, "text"), **MIX).collect()}
    assert again == {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in QUERIES["op5_source_mix"](spark, sf_dir).collect()}


def test_mix_edges(spark):
    kind = "doc_id long, source string, text string, size string"
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot", "hot", "b", None, "ä", "Z"]), "w " * rnd.randint(0, 300), "x") for i in range(200)] + [(300, "empty", None, "x"), (7, "hot", "a b", "x"), (7, "hot", "a b", "x"), (None, "b", "x y z", "x"), (301, "b", "w " * 20_000, "x")]
    check_mix(mix_sources(spark.createDataFrame(rows, kind), **MIX, docs_per_shard=16).collect())
    assert mix_sources(spark.createDataFrame([], kind), **MIX).count() == 0
    assert [r.taken for r in mix_sources(spark.createDataFrame([(1, "a", None, "x")], kind), **MIX).collect()] == [0]


@pytest.mark.parametrize("seats", [0, 1, 7, 100])
def test_sainte_lague(spark, seats):
    rnd = random.Random(seats)
    votes = [(k, float(rnd.randint(0, 1000)), seats) for k in range(12)]
    got = {r.k: r.quota for r in apportion(spark.createDataFrame(votes, "k int, v double, s int"), [], "k", "v", "s").collect()}
    best = sorted(((-v / (2 * n + 1), k) for k, v, _ in votes for n in range(seats) if v), key=lambda x: x)[:seats]
    assert got == {k: Counter(k for _, k in best)[k] for k, _, _ in votes}


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 201 + i) for i in range(25)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def leaks(docs, items, num=80, den=100):
    """Every window of every text with every item."""
    weigh = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
    out = set()
    for i, t in docs:
        w = words(t)
        for j, item in items:
            v = words(item)
            want = Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
            for at in range(max(1, len(w) - 4)) if want else ():
                part = w[at : at + len(v)]
                have = Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
                if have & want and weigh(have & want) * den >= weigh(have | want) * num:
                    out.add((i, j))
                    break
    return out


def test_leaks(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    items = [(k, text(rnd.randint(20, 60)).capitalize() + ".") for k in range(8)] + [(20, "too short"), (21, None), (22, "same words again and again same words again and again")]
    docs = []
    for i in range(60):
        item = rnd.choice(items[:8])[1].split()
        for _ in range(rnd.randint(0, 3)):
            item[rnd.randrange(len(item))] = f"x{rnd.randrange(99)}"
        docs.append((i, text(rnd.randint(0, 40)) + " " + " ".join(item[rnd.randint(0, 3) :]).upper() + ", " + text(rnd.randint(0, 40))))
    docs += [(100, None), (101, ""), (102, items[2][1]), (103, "same words again and again " * 400), (None, items[1][1]), (104, text(30_000) + " " + items[3][1])]
    got = find_leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks([d for d in docs if d[0] is not None and d[0] != 104], items) | {(104, 3)}
    assert all(0.8 <= r.similarity <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find_leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_edited(spark):
    """Words inserted, deleted and blocks moved: every window at the threshold is found."""
    rnd = random.Random(12)
    text = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    items = [(k, " ".join(text(rnd.randint(30, 90)))) for k in range(12)]
    docs = []
    for i in range(240):
        item = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(1, 2)):
            at, n = rnd.randrange(len(item)), rnd.randint(1, 6)
            item[at:at] = text(n) if rnd.random() < 0.5 else []
            if rnd.random() < 0.5:
                del item[at : at + n]
        if i % 10 == 0:
            at = rnd.randrange(len(item))
            item = item[at:] + item[:at]
        docs.append((i, " ".join(text(rnd.randint(0, 30)) + item + text(rnd.randint(0, 30)))))
    want = leaks(docs, items)
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert 60 < len(want) < 240
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_leaks_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    shingle = lambda t: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
    wanted = defaultdict(set)
    for j, t in items:
        for s in shingle(t):
            wanted[s].add(j)
    near = [(i, t) for i, t in docs if any(s in wanted for s in shingle(t))]
    assert {(r.doc_id, r.item_id) for r in QUERIES["op9_decontaminate"](spark, sf_dir).collect()} == leaks(near, items)


def test_long_items(spark):
    """An item of 5,000 words, whole and edited, in texts of more: a step a window, not a step a word of each."""
    rnd = random.Random(31)
    text = lambda n: [f"u{rnd.randrange(20_000)}" for _ in range(n)]
    item = text(5_000)
    cut = item[:2_000] + text(300) + item[2_100:]
    far = [w if rnd.random() < 0.9 else "x" for w in item]
    docs = [(1, " ".join(text(700) + item + text(900))), (2, " ".join(text(50) + cut + text(50))), (3, " ".join(far)), (4, " ".join(text(8_000))), (5, " ".join(item[:2_500]))]
    items = [(7, " ".join(item)), (8, " ".join(text(1_500)))]
    began = time.time()
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == (700, 5_000, 1.0) and 0.8 < got[2, 7][2] < 1
    assert time.time() - began < 60


def test_short_items(spark):
    """Items of fewer than five words are found where they stand whole."""
    docs = [(1, "a Fine, red house!"), (2, "fine red"), (3, "red fine house"), (4, "house"), (5, None), (6, ""), (7, "the red house; fine red house"), (7, "red house")]
    items = [(1, "fine red"), (2, "House"), (3, "fine red house here"), (4, "..."), (5, None), (6, "red house")]
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, start int, doc_id int")).collect()}
    assert got == {
        (1, 1): (1, 2, 1.0), (1, 2): (3, 1, 1.0), (1, 6): (2, 2, 1.0), (2, 1): (0, 2, 1.0), (3, 2): (2, 1, 1.0), (4, 2): (0, 1, 1.0), (7, 1): (3, 2, 1.0), (7, 2): (1, 1, 1.0), (7, 6): (0, 2, 1.0),
    }


def test_tallied_fingerprints(spark):
    """SimHash from tallies is that of the shingles themselves, and repeats count in similarities."""
    rnd = random.Random(17)
    lists = [[(rnd.choice([-1, 1]) * rnd.randrange(2**62), rnd.randint(1, 60)) for _ in range(40)] for _ in range(4)]
    df = spark.createDataFrame([(x, a, b) for x in lists for a, b in ((0, 40), (0, 1), (7, 30), (39, 40), (12, 25))], "s array<struct<h:bigint,w:int>>, a int, b int")
    got = df.select(simhash_between(tallies(F.col("s")), F.col("a"), F.col("b")).alias("x"), simhash(F.slice("s", F.col("a") + 1, F.col("b") - F.col("a"))).alias("y")).collect()
    assert all(r.x == r.y for r in got)
    multi = [([(1, 5), (1, 5), (2, 7), (3, 1)], [(1, 5), (2, 7), (2, 7), (1, 5), (1, 5)])]
    shared, whole = weighted_similarity(F.col("x"), F.col("y"))
    kind = "array<struct<h:bigint,w:int>>"
    assert tuple(spark.createDataFrame(multi, f"x {kind}, y {kind}").select(shared, whole).first()) == (17, 30)
