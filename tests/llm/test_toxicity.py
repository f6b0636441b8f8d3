import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm.queries import QUERIES
from brindle.llm.toxicity import LabelModel, Toxicity, fit_label_model, fit_linear, learn_lexicon, read_marks, score_toxicity

SMALL = Toxicity(prefixes=(3, 4), suffixes=(3,), splits=1)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def invented(seed, n, toxic_stem="grolv", rate=0.15):
    """(doc_id, text, toxic): toxic texts have three to eight words of one stem, clean ones now and then one."""
    rng = random.Random(seed)
    parts = ["la", "mer", "sto", "vin", "tek", "ora", "ul", "ben"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        toxic = rng.random() < rate
        words = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(3, 8) if toxic else rng.random() < 0.1):
            words.insert(rng.randrange(len(words)), toxic_stem + rng.choice(parts))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_documents(spark, sf_dir):
    """On the given tables: well-formed toxic documents that weren't learnt from are found, clean ones left alone."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    known = [(got[r.doc_id], r.toxic, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(r.predicted for r, t, _ in known if not t) <= 0.01 * len(known)
    found = [r.predicted for r, t, q in known if t and q]
    assert sum(found) >= 0.9 * len(found) > 0


def test_a_stem_that_only_labels_tell(spark):
    rows = invented(1, 1500)
    docs = spark.createDataFrame([(i, t, 0.5, "z") for i, t, _ in rows], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    unseen = [(got[i], t) for i, _, t in rows if held_out(i) or not i % 3]
    assert sum(p != t for p, t in unseen) <= 0.02 * len(unseen)


def test_held_out_rows_teach_nothing(spark):
    """Texts and labels of held-out rows change no other row's score."""
    rows = invented(2, 400)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, 1 - t if held_out(i) else t) for i, _, t in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    other = spark.createDataFrame([(i, "grolvla " * 5 if held_out(i) else x) for i, x, _ in rows], "doc_id long, text string")
    first = {r.doc_id: r.score for r in score_toxicity(docs, labels, SMALL).collect()}
    second = {r.doc_id: r.score for r in score_toxicity(other, turned, SMALL).collect()}
    assert all(abs(first[i] - second[i]) < 1e-4 for i in first if not held_out(i))


def test_copies_count_once(spark):
    """A toxic text with 60 copies teaches its stem, not all its harmless words."""
    copied = "quiet harbour lanterns drifting slowly past grolvla grolvmer wooden bridges"
    rows = [*invented(3, 500), *((10_000 + i, copied, 1) for i in range(60))]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "id long, toxic int")
    parts = {r.part for r in learn_lexicon(docs, labels, SMALL).collect()}
    assert "gro" in parts and not {"harbour", "lanterns", "har", "lan", "bridges"} & parts


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [*((i, x) for i, x, _ in invented(4, 200)), (None, "grolvla grolvmer grolvsto"), (900, None), (901, ""), (902, "you are an idiot, a stupid idiot"), (902, "fine words"), (902, "fine words"), (903, "la mer " * 40_000 + "grolvla")]
    docs = spark.createDataFrame([(i, x, 1, "k") for i, x in rows], "doc_id long, text string, predicted int, toxic string")
    labels = spark.createDataFrame([*((i, t) for i, _, t in invented(4, 200)), (None, 1), (5, None), (6, 0), (6, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels, SMALL).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 902 for r in got) == 3
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    blank = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert score_toxicity(docs.limit(0), labels, SMALL).count() == 0


@pytest.mark.parametrize("given", [[], [(i, 0) for i in range(50)]])
def test_without_toxic_labels_insults_vote(spark, given):
    rows = [(i, x + (" you idiot, stupid scum of a loser" if t else "")) for i, x, t in invented(5, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, spark.createDataFrame(given, "doc_id long, toxic int"), SMALL).collect()}
    assert sum(got[i] != t for i, _, t in invented(5, 300)) <= 6


def test_label_model_finds_accuracies_and_correlations(spark):
    """Two voters that copy each other count as one; a voter that knows nothing gets none. Sums are those of all rows."""
    rng = np.random.default_rng(0)
    how = SMALL
    n, m = 4000, how.voters
    y = rng.random(n) < 0.3
    votes = rng.choice([-1, 1], (n, m))
    good = np.where(y, 1, -1)
    for j, right in ((0, 0.9), (1, 0.8), (2, 0.7)):
        votes[:, j] = np.where(rng.random(n) < right, good, -good)
    votes[:, 3] = np.where(rng.random(n) < 0.97, votes[:, 2], -votes[:, 2])
    votes = votes.astype(np.int8)
    known = rng.random(n) < 0.2
    rows = [(bytearray(v.tobytes()), int(t) if k else None, 1) for v, t, k in zip(votes, y, known, strict=True)]
    model = fit_label_model(spark.createDataFrame(rows, "votes binary, label int, n long").repartition(3), how)
    assert np.allclose(model.accuracy[[0, 1, 2, 5]], [0.9, 0.8, 0.7, 0.5], atol=0.05)
    assert model.correlation[2, 3] > 0.8 and abs(model.correlation[0, 1]) < 0.1
    assert ((model.posterior(votes.astype(float)) >= 0.5) == y).mean() > 0.9

    brute = None
    label = np.where(known, y.astype(float), np.nan)
    for _ in range(how.rounds):
        p = brute.posterior(votes.astype(float)) if brute else np.full(n, np.nan)
        w1 = np.where(known, label, p)
        use = ~np.isnan(w1)
        w = np.stack([1 - w1[use], w1[use]]) * np.where(known[use], 1.0, min(1.0, how.unlabelled * known.sum() / (~known).sum()))
        v = votes[use].astype(float)
        size = w.sum(axis=1) + 1
        mean = (w @ v + np.array([[-0.5], [0.0]])) / size[:, None]
        within = sum((v.T * w[c]) @ v - w[c].sum() * np.outer(mean[c], mean[c]) for c in (0, 1)) / size.sum()
        brute = LabelModel(mean, within + 0.02 * np.eye(m), size[1] / size.sum())
    assert np.allclose(model.mean, brute.mean) and np.allclose(model.cov, brute.cov) and np.isclose(model.prior, brute.prior)


def test_linear_fit_is_the_optimum():
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(300, 3))
    row, part = np.repeat(np.arange(300), 2), rng.integers(0, 5, 600)
    value = np.ones(600)
    target = 1 / (1 + np.exp(-(dense @ [1.0, -2.0, 0.0] + np.bincount(row, weights=np.array([0, 1, -1, 2, 0.0])[part]))))
    got = fit_linear(dense, row, part, value, target, 5, 1e-6, steps=3000)
    assert np.allclose(got.score(dense, row, part, value), target, atol=0.02)


def test_marks_of_a_text():
    how = SMALL
    lexicon = {(0, "grolv"): 0, (1, "gro"): 1}
    n, found, hits, votes = read_marks("GROLV, grolvs! an Idiot", lexicon, [how.voter(*p) for p in lexicon], how, {})
    assert (n, dict(found)) == (4, {0: 1, 1: 2})
    assert hits[how.voter(1, "gro")] == 2 and votes[how.voter(1, "gro")] == 1 and votes[how.voter(0, "grolv")] == 0
    assert read_marks(None, lexicon, [0, 1], how, {})[0] == 0


def test_query(spark, sf_dir):
    df = QUERIES["op12_toxicity"](spark, sf_dir)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and dict(df.dtypes)["held_out"] == "boolean"
    assert df.where(F.col("predicted") != (F.col("score") >= 0.5).cast("int")).isEmpty()
