"""op4 and the pipeline's stage 3 against all pairs."""

import random

import pytest

from brindle.llm.near_dedup import NearDup, least_matches, near_duplicates
from brindle.llm.queries import QUERIES


def brute(docs, width, num=80, den=100):
    sets, comp = [], {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    for k, (i, _) in enumerate(docs):
        comp.setdefault(find(k), []).append(i)
    return {i: (len(sets[k]), min(comp[find(k)])) for k, (i, _) in enumerate(docs)}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(999)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    out = [(i, edited(rnd, base, rnd.randint(0, 9))) for i in range(70)]
    out += [(100 + i, " ".join(f"x{rnd.randrange(400)}" for _ in range(rnd.randint(1, 30)))) for i in range(40)]
    out += [(200, out[0][1].upper()), (201, None), (202, ""), (203, "  \n"), (204, "one two"), (205, "ONE two"), (206, "long " * 20_000), (207, "long " * 19_000)]
    return out


def test_components(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", i) for i, t in texts], "doc_id long, text string, component_id string, sig long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, NearDup(width=4, block=8)).collect()}
    assert got == brute(texts, 4)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op4_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    kind = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")], kind)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_repeated_ids(spark):
    a, b, c = ("".join(f"{x}{k} " for k in range(20)) for x in "abc")
    docs = [(5, a), (5, b), (5, b), (9, a + "more"), (10, b + "more"), (3, c), (7, c + "more"), (7, b), (11, "one two"), (11, "")]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), NearDup(width=4)).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (9, 3), (10, 3), (3, 3), (7, 3), (11, 11)}
    rows = near_duplicates(spark.createDataFrame([(5, a), (5, b), (9, a + "more"), (10, b + "more"), (12, c)], "doc_id long, text string"), NearDup(width=4)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(5, 5, True), (9, 5, False), (10, 5, False), (12, 12, True)}


def test_bounds():
    few = least_matches(128, 16, 0.8, 1e-6)
    assert list(few) == sorted(few) and few[-1] < 0.8 * 128
