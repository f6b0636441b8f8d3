"""op6 against plain Python, and the search against all pairs."""

import hashlib
import math
import random
from collections import Counter

import xxhash

from brindle.llm.fingerprint import Signer, SimHash, edited_fingerprints, fingerprints, near_fingerprints
from brindle.llm.queries import QUERIES


def check(rows, docs):
    docs = sorted(docs, key=lambda r: -r[0])
    after = {i: (docs[(k + 1) % len(docs)][1] or "") for k, (i, _) in enumerate(docs)}
    by_text = {}
    for r in rows:
        text = dict(docs)[r.doc_id] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[r.doc_id][:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert len(rows) == len(docs)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op6_fingerprint"](spark, sf_dir).collect()
    check(rows, docs)
    assert sum(r.near_edited for r in rows) > 3 * sum(r.near_next for r in rows)


def test_ranges_and_edges(spark):
    rnd = random.Random(1)
    docs = [(rnd.randrange(10**6) - 5 * 10**5, "é😀 word " * rnd.randint(0, 5) + str(i)) for i in range(60)]
    docs = list(dict(docs).items()) + [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "long text " * 20_000)]
    kind = "doc_id long, text string"
    check(edited_fingerprints(spark.createDataFrame([(*d, 1) for d in docs], kind + ", n_chars int"), rows_per_range=4).collect(), docs)
    assert edited_fingerprints(spark.createDataFrame([], kind)).count() == 0
    check(edited_fingerprints(spark.createDataFrame([(1, "a b c d")], kind)).collect(), [(1, "a b c d")])
    odd = edited_fingerprints(spark.createDataFrame([(None, "x y z"), (None, "p q"), (4, "a"), (4, "a")], kind)).collect()
    assert sorted(str(r.doc_id) for r in odd) == ["4", "4", "None", "None"]


def test_search(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(80)]

    def text():
        words = list(base)
        for _ in range(rnd.randint(0, 60)):
            words[rnd.randrange(80)] = f"v{rnd.randrange(500)}"
        return " ".join(words)

    docs = [(i, text()) for i in range(60)] + [(90, " ".join(base)), (91, " ".join(base)), (92, None)]
    how = SimHash(bits=64)
    prints = fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), how)
    sign = Signer(how).fingerprint
    marks = {i: int.from_bytes(sign(t), "big") for i, t in docs}
    for radius, together in ((3, 1), (6, 2)):
        blocks = 8 if together == 2 else None
        got = {r.query_id: r.n_near for r in near_fingerprints(prints, prints.where("doc_id % 3 = 0"), radius, blocks, together, salt=7).collect()}
        assert got == {i: sum(j != i and bin(marks[i] ^ m).count("1") <= radius for j, m in marks.items()) for i in marks if i % 3 == 0}


def plain_simhash(text, how):
    """One vote after the other, in Python integers."""
    whole = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
        return x ^ (x >> 31)

    words = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    runs = []
    for i in range(len(words) - how.width + 1):
        x = how.width
        for w in words[i : i + how.width]:
            x = mix((x * 0x9E3779B97F4A7C15 + w) & whole)
        runs.append(x)
    terms = [(t, 1 + math.log(n)) for t, n in Counter(words).items()] + [(t, how.run_weight * (1 + math.log(n))) for t, n in Counter(runs).items()]
    out = []
    for block in range(how.bits // 64):
        seed = ((block + 1) * 0xD1342543DE82EF95) & whole
        votes = [0.0] * 64
        for t, weight in terms:
            mark = mix(t ^ seed).to_bytes(8, "little")
            for b in range(64):
                votes[b] += weight if mark[b // 8] >> (7 - b % 8) & 1 else -weight
        out.append(sum((votes[b] > 0) << (63 - b) for b in range(64)).to_bytes(8, "big"))
    return b"".join(out)


def test_fingerprints_against_plain_votes(spark):
    rnd = random.Random(3)
    texts = [None, "", "one", "one One ONE", "a b a b a b c"] + [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randint(2, 90))) for _ in range(20)]
    for how in (SimHash(), SimHash(bits=64, width=3, run_weight=0.5)):
        rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), how).collect()
        assert all(bytes(r.fingerprint) == plain_simhash(texts[r.doc_id], how) for r in rows)


def test_search_fingerprints_each_text_once(spark, sf_dir):
    """Queries and entries come from one staged table: no text is fingerprinted again for them."""
    found = QUERIES["fingerprint_search"](spark, sf_dir)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
