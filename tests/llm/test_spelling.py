import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm.spelling import Spelling, count_words, deletion_keys, one_edit_apart, spelling_variants

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, misspell=None):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if misspell and h % misspell == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return out


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def brute(counts, ratio=2):
    letters = {c for w in counts for c in w}
    form, out = {}, {}
    for w, n in counts.items():
        near = edits(w, letters) & counts.keys()
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
        out[w] = (n, len(near))
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], counts.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = {w: n for w, n in brute_counts(docs.collect(), 97).items() if len(w) >= 5 and n >= 3}
    assert found(spelling_variants(count_words(docs, misspell=97))) == brute(counts)


def test_dense_neighbourhoods(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abà") for _ in range(rng.randint(1, 6))): rng.randint(1, 40) for _ in range(500)}
    assert found(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "zzzzy": 6, "zzzza": 6, "zzzzzz": 6, "zzzzz": 3, "alone": 9}
    got = found(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert got["aaaaa"][1] == "bbbbb" and got["zzzzz"][0] == "zzzza" and got["alone"] == (None, "alone", 9, 0, None)


def test_counting_of_nulls_case_and_repeated_rows(spark):
    rows = [(1, "Straße STRASSE straßeİstraße"), (1, "Straße STRASSE straßeİstraße"), (None, "ÀÉ àé AÀ"), (2, None), (3, ""), (4, "x×y÷z a1b")]
    docs = spark.createDataFrame([(i, t, 7, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    how = Spelling(min_length=1, min_count=1)
    got = {r.word: r.n for r in count_words(docs, how).collect()}
    assert got == dict(brute_counts(rows)) and got["straße"] == 6 and got["x×y÷z"] == 1 and got["ÀÉ"] == 1
    assert {r.word: r.n for r in count_words(docs, how, misspell=3).collect() if r.word} == {w: n for w, n in brute_counts(rows, 3).items() if w}


def test_empty_tables_null_words_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_words(none).count() == 0 and spelling_variants(count_words(none)).count() == 0
    words = spark.createDataFrame([("house", 9, "f", 1), ("huose", 2, "g", 2), ("housse", 2, "h", 3), (None, 4, "i", 4)], "word string, n long, form string, id long")
    assert found(spelling_variants(words)) == brute({"house": 9, "huose": 2, "housse": 2})


def test_very_long_words(spark):
    long = "".join(random.Random(1).choice("abcde") for _ in range(300_000))
    texts = [(i, t) for i, t in enumerate([long, long, long, long[:150_000] + "x" + long[150_000:], long[:-1] + "y", "q" * 200_000, "q" * 200_001])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = found(spelling_variants(count_words(docs, Spelling(min_count=1)), Spelling(min_count=1)))
    assert got[long] == (None, long, 3, 2, None)
    assert got[texts[3][1]] == (long, long, 1, 1, 3) and got[texts[4][1]][0] == long
    assert got["q" * 200_000][3] == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abÿ", min_size=1, max_size=7), min_size=1, max_size=5))
def test_keys_are_those_of_distinct_deletions(words):
    of, key, first, last = deletion_keys(words)
    name, seen = {}, {}
    for w, k, a, b in zip(of, key, first, last, strict=True):
        text = words[w] if a < 0 else words[w][:a] + words[w][a + 1 :]
        assert a < 0 or {words[w][:i] + words[w][i + 1 :] for i in range(a, b + 1)} == {text}
        assert name.setdefault(text, k) == k
        seen.setdefault(w, []).append((a < 0, text))
    assert len(set(name.values())) == len(name)
    for w, text in enumerate(words):
        assert sorted(seen[w]) == sorted([(True, text), *((False, t) for t in {text[:i] + text[i + 1 :] for i in range(len(text))})])


def test_one_edit(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé"), size=rng.integers(1, 6))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select(one_edit_apart(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [b in edits(a, "abé") for a, b in pairs]
