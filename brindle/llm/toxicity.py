"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model of their votes, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._staging import bound_batches, staged
from ._words import WordHash, rows, shingles

WORD = re.compile(r"[^\W\d_]+")
LONG_DRAWN = re.compile(r"([^\W\d_])\1{3}")

#: Mild insults of four languages, the one voter that isn't learnt.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown clowns coward liar vermin "
    "idioten trottel dumm dummkopf abschaum versager widerlich erbärmlich wertlos feigling "
    "idiote stupide imbécile crétin minable dégoûtant ordure lâche "
    "idiota estúpido estúpida imbécil basura patético asqueroso inútil cobarde".split()
)
#: Words that address a reader.
ADDRESS = frozenset("you your yours yourself du dein deine dich dir tu toi ton ta tú ti usted ustedes vosotros vous votre".split())


@dataclass(frozen=True)
class Toxicity:
    """Rows whose crc32 of the id is divisible by `folds` are never learnt from. labelled, fitted: how many labelled rows
    the lexicons, and how many documents the classifier, are fitted on at most, taken by a hash of id or row. lexicon: how
    many word parts are kept. A part is kept if it stands `ratio` times as often in toxic documents and in `least` of
    them, groups of copies counting once. rounds: of the label model. unlabelled: what all unlabelled documents weigh in
    it at most, as a share of the labelled ones, lest they pull the classes to where the votes alone part best. ridge:
    of the classifier."""

    folds: int = 5
    labelled: int = 50_000
    fitted: int = 50_000
    lexicon: int = 4_000
    ratio: float = 4.0
    least: float = 2.5
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    suffixes: tuple[int, ...] = (3, 4, 5, 6)
    splits: int = 2
    rounds: int = 4
    unlabelled: float = 0.25
    ridge: float = 2e-4

    @property
    def families(self) -> int:
        return 1 + len(self.prefixes) + len(self.suffixes)

    @property
    def voters(self) -> int:
        """Lexicons by family and split, the insults, four patterns."""
        return self.families * self.splits + 5

    def parts(self, word: str) -> list[tuple[int, str]]:
        """(family, part) of a lower-cased word: itself, its proper prefixes and suffixes of the given lengths."""
        n, at = len(word), len(self.prefixes)
        out = [(0, word)]
        out += [(1 + i, word[:k]) for i, k in enumerate(self.prefixes) if k < n]
        out += [(1 + at + i, word[-k:]) for i, k in enumerate(self.suffixes) if k < n]
        return out

    def voter(self, family: int, part: str) -> int:
        return family * self.splits + zlib.crc32(part.encode()) % self.splits


def learnt_from(doc_id: Column, how: Toxicity) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % how.folds != 0, F.lit(True))


def _at_most(df: DataFrame, most: int, n: int, by: str) -> DataFrame:
    """df's n rows or, where they are more than `most`, a share by hash that is below it by a twentieth on average."""
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(20240601), by), F.lit(1 << 32)) < int(0.95 * most / n * (1 << 32)))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, toxic, words): near copies mostly share their least three-word shingle."""
    memo = WordHash()
    for part in rows(batches, "text", "toxic", size=64):
        out = []
        for text, toxic in part:
            words = [w.lower() for w in WORD.findall(text or "")]
            found = shingles(memo.of([w.encode() for w in words]), 3)
            out.append((int(found.min().view(np.int64)) if len(found) else 0, toxic, list(set(words))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.string()))], ["group", "toxic", "words"])


def _split_words(how: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches, "word", "clean", "toxic", size=20_000):
            out = [(f, p, c, t) for word, c, t in part for f, p in how.parts(word)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["family", "part", "clean", "toxic"])

    return run


def learn_lexicon(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> DataFrame:
    """(family, part, clean, toxic, weight) of the word parts of labelled docs (id, text) that stand out in toxic ones.

    clean and toxic count the words with that part, once for each document that has them, and a document counts one
    over the number of its copies. weight is the log-likelihood ratio. At most how.lexicon parts.
    """
    rows_ = staged(docs.join(F.broadcast(labels), "id").select("text", "toxic").mapInArrow(_fit_rows, "group long, toxic int, words array<string>"), "fit", "zstd")
    sizes = rows_.groupBy("group", "toxic").agg(F.count(F.lit(1)).alias("n"))
    weighed = rows_.join(sizes, ["group", "toxic"]).select("toxic", (1 / F.col("n")).alias("w"), "words")
    total = {r.toxic: r.n for r in sizes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda t: F.sum(F.when(F.col("_t") == t, F.col("w")).otherwise(0.0))
    words = weighed.select(F.col("toxic").alias("_t"), "w", F.explode("words").alias("word")).groupBy("word").agg(of(0).alias("clean"), of(1).alias("toxic"))
    parts = words.mapInArrow(_split_words(how), "family int, part string, clean double, toxic double").groupBy("family", "part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = float(total.get(0, 0) or 1), float(total.get(1, 0) or 1)
    rate0, rate1 = (F.col("clean") + 0.5) / n0, F.col("toxic") / n1
    all_ = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    gain = F.col("toxic") * F.ln(rate1 / all_) + F.when(F.col("clean") > 0, F.col("clean") * F.ln(F.col("clean") / n0 / all_)).otherwise(0.0)
    good = parts.where((F.col("toxic") >= how.least) & (rate1 >= how.ratio * rate0)).withColumn("weight", F.round(2 * gain, 6))
    return good.orderBy(F.desc("weight"), "family", "part").limit(how.lexicon)


def _vote(hits: np.ndarray | int, n: int) -> np.ndarray:
    """1: at least two hits and one in 400 words; -1: none; 0, no opinion: between."""
    hits = np.asarray(hits)
    return np.where(hits == 0, -1, np.where((hits >= 2) & (400 * hits >= n), 1, 0))


def read_marks(text: str | None, lexicon: dict[tuple[int, str], int], voter_of: list[int], how: Toxicity, memo: dict[str, tuple[int, ...]]) -> tuple[int, Counter, np.ndarray, np.ndarray]:
    """How many words a text has, how often each part of the lexicon stands, hits by voter and votes."""
    words = WORD.findall(text or "")
    n, found, hits = len(words), Counter(), np.zeros(how.voters, np.int64)
    insults = address = upper = 0
    for word, times in Counter(words).items():
        at = memo.get(word)
        if at is None:
            low = word.lower()
            at = tuple(x for p in how.parts(low) if (x := lexicon.get(p)) is not None) + (-1,) * (low in INSULTS) + (-2,) * (low in ADDRESS) + (-3,) * (len(word) > 1 and word.isupper())
            if len(memo) < 500_000:
                memo[word] = at
        for x in at:
            if x >= 0:
                found[x] += times
                hits[voter_of[x]] += times
            elif x == -1:
                insults += times
            elif x == -2:
                address += times
            else:
                upper += times
    shouts = (text or "").count("!")
    k = how.families * how.splits
    hits[k:] = insults, address, upper, shouts, len(LONG_DRAWN.findall(text or ""))
    votes = _vote(hits, n)
    votes[k + 1] = 1 if address * 30 >= n > 0 and address >= 2 else -1 if not address else 0
    votes[k + 2] = 1 if upper * 4 >= n > 0 and upper >= 4 else -1 if not upper else 0
    votes[k + 3] = 1 if shouts * 20 >= n > 0 and shouts >= 3 else -1 if not shouts else 0
    votes[k + 4] = 1 if hits[k + 4] else 0
    return n, found, hits, votes.astype(np.int8)


MARKS = "row long, doc_id long, learn boolean, label int, n_words long, hits array<int>, votes binary, parts array<int>, counts array<int>"


def _mark(lexicon, how: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = lexicon.value
        at, voter_of, memo = {p: i for i, p in enumerate(parts)}, [how.voter(*p) for p in parts], {}
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for part in rows(batches, "row", "doc_id", "learn", "label", "text", size=128):
            out = []
            for row, doc_id, learn, label, text in part:
                n, found, hits, votes = read_marks(text, at, voter_of, how, memo)
                out.append((row, doc_id, learn, label, n, np.minimum(hits, 2**31 - 1), votes.tobytes(), list(found), [min(c, 2**31 - 1) for c in found.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in MARKS.split(", ")])

    return run


@dataclass(frozen=True)
class LabelModel:
    """Votes of a class are normal about the class's means, with one covariance within classes: the means say how
    accurate each voter is, the covariance which voters agree beyond that and so count less."""

    mean: np.ndarray  # by class and voter
    cov: np.ndarray
    prior: float

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        lean = np.linalg.solve(self.cov, self.mean[1] - self.mean[0])
        return (votes - self.mean.mean(axis=0)) @ lean + np.log(self.prior / (1 - self.prior))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -30, 30)))

    @property
    def accuracy(self) -> np.ndarray:
        """By voter: the chance, were its opinions on both classes equally frequent, that it leans the right way."""
        return 0.5 + (self.mean[1] - self.mean[0]) / 4

    @property
    def correlation(self) -> np.ndarray:
        s = np.sqrt(np.diag(self.cov))
        return self.cov / np.outer(s, s)


def _sums(model: LabelModel | None, voters: int, unlabelled: float):
    """(at, value): sums over a task's rows of class weight, votes and products of votes, for both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + voters + voters * voters))
        for batch in batches:
            if not batch.num_rows:
                continue
            votes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int8).reshape(-1, voters).astype(np.float64)
            label = np.array([np.nan if x is None else x for x in batch.column(1).to_pylist()])
            n = np.array(batch.column(2).to_pylist(), np.float64)
            toxic = model.posterior(votes) if model else np.full(len(votes), np.nan)
            n = np.where(np.isnan(label), n * unlabelled, n)
            toxic = np.where(np.isnan(label), toxic, label)
            for c, w in ((0, (1 - toxic) * n), (1, toxic * n)):
                w = np.where(np.isnan(w), 0, w)
                total[c] += np.concatenate(([w.sum()], w @ votes, ((votes * w[:, None]).T @ votes).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "value"])

    return run


def fit_label_model(votes: DataFrame, how: Toxicity = Toxicity()) -> LabelModel:
    """From (votes, label, n): vote patterns, a label where it is known, and in how many documents.

    Expectation maximization over all of them: known labels stay, the others get the model's posterior. Each round
    sums voters ** 2 products over the tasks. Before the first round unlabelled rows have no weight.
    """
    model, m = None, how.voters
    known, unknown = (x or 0 for x in votes.agg(*[F.sum(F.when(F.col("label").isNull() == b, F.col("n"))) for b in (False, True)]).first())
    weight = min(1.0, how.unlabelled * known / unknown) if unknown else 1.0
    for _ in range(how.rounds):
        found = votes.select("votes", "label", "n").mapInArrow(_sums(model, m, weight), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(2 * (1 + m + m * m))
        total[found.column("at").to_numpy()] = found.column("value").to_numpy()
        total = total.reshape(2, -1)
        n = total[:, 0] + 1.0
        mean = (total[:, 1 : 1 + m] + np.array([[-0.5], [0.0]])) / n[:, None]  # as if each class had one more, almost mute, document
        square = total[:, 1 + m :].reshape(2, m, m)
        within = sum(square[c] - total[c, 0] * np.outer(mean[c], mean[c]) for c in (0, 1)) / n.sum()
        model = LabelModel(mean, (within + within.T) / 2 + 0.02 * np.eye(m), float(n[1] / n.sum()))
    return model


def features(n_words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """By voter: how often it was hit, and how often in 1,000 words."""
    return np.concatenate((np.log1p(hits), np.log1p(1000 * hits / np.maximum(n_words, 20)[:, None])), axis=1)


@dataclass(frozen=True)
class Linear:
    """Weights of the voters' features, of the lexicon's parts, and a bias."""

    dense: np.ndarray
    sparse: np.ndarray
    bias: float

    def score(self, dense: np.ndarray, row: np.ndarray, part: np.ndarray, value: np.ndarray) -> np.ndarray:
        z = dense @ self.dense + self.bias + np.bincount(row, weights=value * self.sparse[part], minlength=len(dense))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(dense: np.ndarray, row: np.ndarray, part: np.ndarray, value: np.ndarray, target: np.ndarray, parts: int, ridge: float, steps: int = 300) -> Linear:
    """Logistic regression on probabilities, by accelerated gradient steps. Dense features are scaled to unit variance."""
    n, scale = len(dense), np.maximum(dense.std(axis=0), 0.1)
    x = dense / scale
    w, v, b = np.zeros(x.shape[1]), np.zeros(parts), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    # a bound of the curvature: a quarter of the greatest mean square, found by power iteration
    p, q, c, curve = np.ones(x.shape[1]), np.ones(parts), 1.0, 1.0
    for _ in range(30):
        z = x @ p + c + np.bincount(row, weights=value * q[part], minlength=n)
        p, q, c = x.T @ z / n, np.bincount(part, weights=value * z[row], minlength=parts) / n, z.mean()
        curve = float(np.sqrt((p**2).sum() + (q**2).sum() + c**2)) or 1.0
        p, q, c = p / curve, q / curve, c / curve
    rate, last, look = 1 / (0.25 * curve * 1.1 + ridge), (w, v, b), (w, v, b)
    for k in range(1, steps + 1):
        w, v, b = look
        z = x @ w + b + np.bincount(row, weights=value * v[part], minlength=n)
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        new = (w - rate * (x.T @ gap + ridge * w), v - rate * (np.bincount(part, weights=value * gap[row], minlength=parts) + ridge * v), b - rate * gap.sum())
        ahead = (k - 1) / (k + 2)
        look = tuple(a + ahead * (a - o) for a, o in zip(new, last, strict=True))
        last = new
    return Linear(last[0] / scale, last[1], float(last[2]))


def _spread(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense features, and row, part and value of the sparse ones."""
    n = table.column("n_words").to_numpy().astype(np.float64)
    hits = np.array(table.column("hits").to_pylist(), np.float64).reshape(len(n), -1)
    each = table.column("parts").to_pylist()
    row = np.repeat(np.arange(len(n)), [len(x) for x in each])
    part = np.array([i for x in each for i in x], np.int64)
    count = np.array([i for x in table.column("counts").to_pylist() for i in x], np.float64)
    return features(n, hits), row, part, np.log1p(count)


def _score(linear):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("learn"), pa.array(linear.value.score(*_spread(some)))], ["doc_id", "learn", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row of docs; labels (id, toxic 0 or 1) cover some of them.

    1. Lexicons: word parts that stand out in at most how.labelled labelled rows. Each family of parts is split into
    lexicons that vote apart, besides one of known insults and four patterns. 2. One pass over all texts counts hits
    and votes (1, -1 or no opinion). 3. A generative label model over the votes of every document that may be learnt
    from, labelled or not, estimates the voters' accuracies and correlations. 4. A linear classifier on hits is fitted on its
    posterior labels of at most how.fitted documents, taken by hash, and 5. scores every row. What goes to
    executors are how.lexicon parts and weights, to the driver how.fitted rows of counts.

    A score sees the text alone. Rows whose crc32(id) is divisible by how.folds are held out: neither their labels nor
    their texts are learnt from. A row with a null id has no label, is learnt from and isn't held out. Null and empty
    texts have no words and get the score of a text without hits. Ids labelled several times count as toxic if any
    label says so; null labels are none. Without a toxic label the insults' votes stand for labels. Each row of a
    repeated id is scored on its own text. An empty table gives no rows. Other columns are ignored. A text is worked
    on whole, its words in memory.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    given = staged(given.where(learnt_from(F.col("id"), how)).groupBy("id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")), "given")
    given = staged(_at_most(given, how.labelled, given.count(), "id"), "labelled")
    found = learn_lexicon(named, given, how).select("family", "part").collect()  # at most how.lexicon
    lexicon = spark.sparkContext.broadcast([(r.family, r.part) for r in found])

    texts = named.join(F.broadcast(given), "id", "left")
    texts = texts.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), learnt_from(F.col("id"), how).alias("learn"), F.col("toxic").alias("label"), "text")
    marks = staged(texts.mapInArrow(_mark(lexicon, how), MARKS), "marks", "zstd")
    seen = marks.where("learn")
    known = F.col("label")
    if given.where("toxic = 1").isEmpty():
        vote = F.substring(F.hex("votes"), 2 * how.families * how.splits + 1, 2)
        known = F.when(vote == "01", 1).when(vote == "FF", 0)
    patterns = staged(seen.groupBy("votes", known.alias("label")).agg(F.count(F.lit(1)).alias("n")), "patterns")
    model = fit_label_model(patterns, how)

    rows_ = _at_most(seen, how.fitted, seen.count(), "row").select("n_words", "hits", "parts", "counts", "votes").toArrow()
    if rows_.num_rows:
        votes = np.frombuffer(b"".join(rows_.column("votes").to_pylist()), np.int8).reshape(-1, how.voters)
        linear = fit_linear(*_spread(rows_), model.posterior(votes.astype(np.float64)), max(1, len(found)), how.ridge)
    else:
        linear = Linear(np.zeros(2 * how.voters), np.zeros(max(1, len(found))), -2.0)
    weights = spark.sparkContext.broadcast(linear)
    scored = marks.select("doc_id", "learn", "n_words", "hits", "parts", "counts").mapInArrow(_score(weights), "doc_id long, learn boolean, score double")
    score = F.round("score", 6)
    return scored.select(F.col("doc_id").alias(id_col), (~F.col("learn")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
