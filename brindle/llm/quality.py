"""Quality by the perplexity of an interpolated modified Kneser-Ney word model trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import Bitmap, bitmap
from ._staging import bound_batches, discard, reclaim, staged
from ._words import STEP, WordHash, mix, rows

START = np.uint64(1)
#: Words are told apart by six bytes of their hash.
SIX = np.uint64(2**48 - 1)


@dataclass(frozen=True)
class Quality:
    """calibration of the trusted documents are kept out of the counts, by a hash of their id, to find the thresholds:
    per language the quantile of their scores plus slack nats a word; languages with fewer than least_docs of them use
    all languages together. prior words of the language's usual score are added to every document, so that a few words
    decide nothing. least: word pairs and triples that stand fewer times in all counted text are pruned, their mass left
    to the lower order; they count in every total and discount. hot: so many of the commonest words and word pairs each
    are looked up where texts are read. most_bits: size of the bitmap of known grams that spares texts questions; a full one spares fewer.
    broadcast_ids: beyond so many trusted ids the choice of their texts is left to Spark's join.
    window: a document also goes if its worst run of so many words, measured with the hot words and pairs where it is read,
    is beyond the same quantile plus slack of its language's trusted documents. shard_chars: characters of text whose
    grams meet in one shard of the count tables."""

    calibration: float = 0.3
    quantile: float = 0.995
    slack: float = 0.25
    least_docs: int = 30
    prior: float = 12.0
    least: int = 2
    hot: int = 50_000
    most_bits: int = 1 << 28
    window: int = 16
    shard_chars: int = 64_000_000
    broadcast_ids: int = 2_000_000
    seed: int = 7


def _key(*hashes: np.ndarray) -> np.ndarray:
    out = np.full(len(hashes[0]), np.uint64(len(hashes)), dtype=np.uint64)
    for h in hashes:
        out = mix(out * STEP + h)
    return out


def _of(memo: WordHash, text: str | None) -> np.ndarray:
    return memo.of(text.encode().split()) & SIX if text else np.empty(0, np.uint64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the one before."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def _cuts(column: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    start = _runs(column)
    return list(zip(start.tolist(), [*start[1:].tolist(), len(column)][: len(start)], strict=True))


BLOCK = "shard int, words binary, at binary, n binary"


def _blocks(shards: int, chunk: int = 1_000_000):
    """The distinct triples of every `chunk` words with their counts, a row for each shard of the last two words: the
    words, the places in these of b, c and a, and the counts. Texts begin with START, START, START."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        p = np.concatenate(held)
        a, b, c = p[:-2], p[1:-1], p[2:]
        whole = (c != START) | (a == START)
        a, b, c = a[whole], b[whole], c[whole]
        shard = _shards(_key(b, c), shards)
        at = np.lexsort((a, c, b, shard))
        a, b, c, shard = a[at], b[at], c[at], shard[at]
        start = _runs(a, b, c)
        n = np.diff(np.append(start, len(a))).astype(np.uint32)
        a, b, c, shard = a[start], b[start], c[start], shard[start]
        out = []
        for i, j in _cuts(shard):
            words, place = np.unique(np.concatenate((b[i:j], c[i:j], a[i:j])), return_inverse=True)
            place = place.astype(np.uint32)
            place[1 : j - i] -= place[: j - i - 1].copy()  # b goes up by few
            out.append((int(shard[i]), _squeeze(np.diff(words, prepend=np.uint64(0))), _squeeze(place), _squeeze(n[i:j])))
        return _batch(out, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = WordHash(), [], 0
        with np.errstate(over="ignore"):
            for part in rows(batches, "text"):
                for (text,) in part:
                    h = _of(memo, text)
                    if len(h):
                        held.append(np.concatenate((np.full(3, START), h)))
                        n += len(h)
                    if n >= chunk:
                        yield pack(held)
                        held, n = [], 0
            if held:
                yield pack(held)

    return run


COUNTS = "ord int, a long, b long, c long, n long, m long"


def _counted(least: int):
    """Of one shard, (ord, a, b, c, n, m): 3: a triple and its count; 2: a pair b c, its distinct words before, its count;
    1: a word c, pairs that it ends, triples that it is the middle of; 0: how many (n) of order a have count c. Triples and pairs below `least` only count in the others."""

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for words, at, n in zip(*(group.column(c).to_pylist() for c in ("words", "at", "n")), strict=True):
            w, i = np.cumsum(_loose(words, np.uint64)), _loose(at, np.uint32).reshape(3, -1)
            parts.append((w[np.cumsum(i[0])], w[i[1]], w[i[2]], _loose(n, np.uint32).astype(np.int64)))
        b, c, a, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.lexsort((a, c, b))
        a, b, c, n = a[at], b[at], c[at], n[at]
        start = _runs(a, b, c)
        a, b, c, n = a[start], b[start], c[start], np.add.reduceat(n, start)
        pair = _runs(b, c)
        before, total = np.diff(np.append(pair, len(a))), np.add.reduceat(n, pair)
        pb, pc = b[pair], c[pair]
        # START START START is there for the count of its pair only: no text goes on with START
        real, word = c != START, pc != START
        before = np.where(word, before, 0)
        words, place = np.unique(np.concatenate((pb, pc)), return_inverse=True)
        ends = np.bincount(place[len(pb) :], weights=word, minlength=len(words)).astype(np.int64)
        middle = np.bincount(place[: len(pb)], weights=before, minlength=len(words)).astype(np.int64)
        often, known = real & (n >= least), total >= least
        none = lambda x: np.zeros(len(x), np.int64)
        of = [(3, a[often], b[often], c[often], n[often], none(a[often])), (2, none(pb[known]), pb[known], pc[known], before[known], total[known]), (1, none(words), none(words), words, ends, middle)]
        for order, counts in ((3, n[real]), (2, before[word])):
            k = np.arange(1, 5)
            of.append((0, np.full(4, order), none(k), k, np.array([(counts == x).sum() for x in k]), none(k)))
        columns = [np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in of]), *(np.concatenate([x[i].astype(np.int64) for x in of]) for i in range(1, 6))]
        return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in COUNTS.split(", ")])

    return run


def _discounts(counts: list[int]) -> list[float]:
    """D1, D2, D3+ from the counts of counts 1 to 4; 0.5, 1, 1.5 where these are too few to tell."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [max(0.05, min(k - 1e-3, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _less(n: str, d: list[float]) -> Column:
    """n less its discount."""
    return F.col(n) - F.when(F.col(n) == 0, 0.0).when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def _n_shards(texts: DataFrame, how: Quality) -> int:
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(1 << 16, max(32, chars // how.shard_chars))


def tables(texts: DataFrame, how: Quality, shards: int) -> tuple[float, dict[str, DataFrame]]:
    """log P of a word never seen, and the grams of the texts: words (c), pairs (b, c) and triples (a, b, c) with
    n, gain (log p less what the lower order gives) and gamma (log weight of the lower order after the gram).

    Every triple of every text is counted in a shard of its last two words, where the pairs and the parts of the words'
    sums come from it. Grams seen fewer than `least` times are pruned there. What a context's kept grams don't hold is
    its weight of the lower order, so every distribution sums to one. All tables grow with the texts and stay distributed.
    """
    counts = staged(texts.mapInArrow(_blocks(shards), BLOCK).groupBy("shard").applyInArrow(_counted(how.least), COUNTS), "counts", "zstd")
    sums = staged(counts.where("ord = 1").groupBy("c").agg(F.sum("n").alias("n"), F.sum("m").alias("total")), "words")
    reclaim(texts.sparkSession)
    told = {(r.a, r.c): r.n for r in counts.where("ord = 0").groupBy("a", "c").agg(F.sum("n").alias("n")).collect()}  # eight rows
    d3, d2 = (_discounts([told.get((order, k), 0) for k in (1, 2, 3, 4)]) for order in (3, 2))
    size, whole, *few = sums.agg(F.sum((F.col("n") > 0).cast("long")), F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    size, d1 = size or 0, _discounts(few)
    # the words seen and one for all others share what unigrams hold back
    floor = (d1[0] * few[0] + d1[1] * few[1] + d1[2] * (size - few[0] - few[1])) / whole / (size + 1) if whole else 1.0
    unseen = float(np.log(floor))

    pairs = counts.where("ord = 2").select("b", "c", "n", F.col("m").alias("times"), _less("n", d2).alias("own"))
    held = pairs.groupBy("b").agg(F.sum("own").alias("held")).withColumnRenamed("b", "c")
    p1 = _less("n", d1) / F.lit(float(whole or 1)) + F.lit(floor)
    words = sums.join(held, "c", "left").select("c", "n", "total", p1.alias("p"), F.coalesce(1 - F.try_divide("held", "total"), F.lit(1.0)).alias("rest"))
    words = staged(words, "words", "zstd")
    after = words.select(F.col("c").alias("b"), "total", F.col("rest").alias("rest_b"))
    p2 = F.coalesce(F.try_divide("own", "total"), F.lit(0.0)) + F.col("rest_b") * F.col("below")
    pairs = pairs.join(after, "b").join(words.select("c", F.col("p").alias("below")), "c").withColumn("p", p2)
    pairs = staged(pairs.select("b", "c", "n", F.col("times").cast("int").alias("times"), F.col("p").cast("float").alias("p"), (F.log("p") - F.log("rest_b") - F.log("below")).cast("float").alias("gain")), "pairs", "zstd")

    reclaim(texts.sparkSession)
    # two steps, so that neither join's shuffle nor the counts lie beside the other's
    triples = counts.where("ord = 3").select("a", "b", "c", _less("n", d3).alias("own"))
    triples = triples.join(pairs.select(F.col("b").alias("a"), F.col("c").alias("b"), "times"), ["a", "b"])
    shares = staged(triples.select("a", "b", "c", (F.col("own") / F.col("times")).alias("own")), "shares", "zstd")
    discard(counts, sums)
    triples = staged(shares.join(pairs.select("b", "c", F.col("p").alias("below")), ["b", "c"]).select("a", "b", "c", "own", "below"), "triples", "zstd")
    discard(shares)
    steps = [words, pairs, triples]
    rest = triples.groupBy("a", "b").agg((1 - F.sum("own")).alias("rest"))
    p3 = F.col("own") + F.col("rest") * F.col("below")
    triples = triples.join(rest, ["a", "b"]).select("a", "b", "c", (F.log(p3) - F.log("rest") - F.log("below")).alias("gain"), F.lit(0.0).alias("gamma"))
    pairs = pairs.join(rest.toDF("b", "c", "rest"), ["b", "c"], "left").select("b", "c", "n", "gain", F.coalesce(F.log("rest"), F.lit(0.0)).alias("gamma"))
    words = words.select("c", "n", (F.log("p") - unseen).alias("gain"), F.log("rest").alias("gamma"))
    # of 32 bits where they are kept and sent
    out = {name: staged(df.withColumn("gain", F.col("gain").cast("float")).withColumn("gamma", F.col("gamma").cast("float")), name, "zstd") for name, df in (("words", words), ("pairs", pairs), ("triples", triples))}
    discard(*steps)
    return unseen, out


GRAMS = {"words": ("c",), "pairs": ("b", "c"), "triples": ("a", "b", "c")}


def _arrays(found: pa.Table, grams: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, gain and gamma."""
    with np.errstate(over="ignore"):
        keys = _key(*(found.column(c).to_numpy().view(np.uint64) for c in grams)) if found.num_rows else np.empty(0, np.uint64)
    return keys, found.column("gain").to_numpy().astype(np.float32), found.column("gamma").to_numpy().astype(np.float32)


def train(texts: DataFrame, how: Quality = Quality()) -> tuple[float, dict[int, tuple[float, float]]]:
    """The tables of a few texts in memory: log P of a word never seen, and key: (gain, gamma) of each gram."""
    unseen, found = tables(texts, how, 4)
    model = {}
    for name, df in found.items():
        keys, *values = _arrays(df.toArrow(), GRAMS[name])
        model |= dict(zip(keys.tolist(), zip(*(v.tolist() for v in values), strict=True), strict=True))
    return unseen, model


def log_probabilities(model: tuple[float, dict[int, tuple[float, float]]], words: np.ndarray) -> np.ndarray:
    """log P of each word hash after the two before it: gains of the grams that end there, weights of those before."""
    unseen, known = model
    look = lambda keys, i: np.array([known.get(k, (0.0, 0.0))[i] for k in keys.tolist()])
    with np.errstate(over="ignore"):
        p = np.concatenate((np.full(2, START), words & SIX))
        a, b, c = p[:-2], p[1:-1], p[2:]
        return unseen + look(_key(c), 0) + look(_key(b, c), 0) + look(_key(a, b, c), 0) + look(_key(b), 1) + look(_key(a, b), 1)


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of their places, compressed."""
    return len(values).to_bytes(4, "little") + pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), "zstd", asbytes=True)


def _loose(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    whole = np.frombuffer(pa.decompress(raw[4:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(whole.reshape(size, n).T).view(kind).ravel()


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) * np.uint64(shards) >> np.uint64(16)).astype(np.int32)


TABLE = "shard int, keys binary, gain binary, gamma binary"
ENTRIES = "shard int, batch long, whole boolean, docs binary, sizes binary, keys binary, times binary"
#: What of a gram's key the shard doesn't say.
LOW = np.uint64(2**40 - 1)


def _table(grams: tuple[str, ...], shards: int):
    """Rows (words, gain, gamma) as one row for each shard and 500,000 grams."""

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, *values = _arrays(pa.Table.from_batches(batches), grams)
        with np.errstate(over="ignore"):
            shard = _shards(keys, shards)
        at = np.argsort(shard, kind="stable")
        keys, shard, values = keys[at], shard[at], [v[at] for v in values]
        return _batch([(int(shard[i]), (keys[i:j] & LOW).tobytes(), *(v[i:j].tobytes() for v in values)) for i, j in _cuts(shard)], TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 500_000:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


def _keys(grams: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(_key(*(batch.column(c).to_numpy().view(np.uint64) for c in grams)).view(np.int64))], ["key"])

    return run


def _entries(shared, shards: int, window: int):
    """Each text's distinct grams outside the hot ones that may be known, a row for each shard and batch of texts: keys
    the distinct grams, sizes how many texts have each; docs these texts' places in the batch, times 2 * occurrences, plus 1
    if one of them ends the text and so is no context. A row marked
    whole has the batch's ids and word counts, what hot grams and unseen words add, and the worst window's share of it a word."""

    def grams(h: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray], known: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What hot words and pairs add to each word's log probability, and pairs as contexts of a third; keys and times of the distinct other grams."""
        p = np.concatenate((np.full(2, START), h))
        keys = np.concatenate((_key(p[1:]), _key(p[:-1], p[1:]), _key(p[:-2], p[1:-1], p[2:])))
        m, add, weight = len(p) - 1, np.zeros(len(h)), np.zeros(len(h))
        maybe = known.has(keys)
        if len(hot[0]):
            two = np.flatnonzero(maybe[: 2 * m])
            at = np.minimum(np.searchsorted(hot[0], keys[two]), len(hot[0]) - 1)
            hit = hot[0][at] == keys[two]
            up, down = np.zeros(2 * m), np.zeros(2 * m)
            up[two[hit]], down[two[hit]] = hot[1][at[hit]], hot[2][at[hit]]
            maybe[two[hit]] = False
            add, weight = up[1:m] + up[m + 1 :] + down[: m - 1], down[m:-1]
        last = np.zeros(len(keys), np.int64)
        last[[m - 1, 2 * m - 1]] = 1
        keys, last = keys[maybe], last[maybe]
        at = np.argsort(keys)
        keys, last = keys[at], last[at]
        start = _runs(keys)
        return add, weight, keys[start], 2 * np.diff(np.append(start, len(keys))) + (np.add.reduceat(last, start) if len(start) else 0)

    def worst(loss: np.ndarray) -> float:
        if len(loss) < window:
            return np.nan
        total = np.concatenate(([0.0], np.cumsum(loss)))
        return float((total[window:] - total[:-window]).max()) / window

    def pack(batch: int, held: list[tuple]) -> pa.RecordBatch:
        rid, counts, base, local, keys, times = zip(*held, strict=True)
        doc = np.repeat(np.arange(len(rid), dtype=np.uint32), [len(k) for k in keys])
        k, t = np.concatenate(keys), np.concatenate(times).astype(np.uint32)
        shard, k = _shards(k, shards), k & LOW
        at = np.argsort((shard.astype(np.uint64) << np.uint64(40)) | k)
        shard, k, t, doc = shard[at], k[at], t[at], doc[at]
        out = [(batch % shards, batch, True, np.array(rid, np.int64).tobytes(), np.array(counts, np.int64).tobytes(), np.array(base).tobytes(), np.array(local).tobytes())]
        for i, j in _cuts(shard):
            first = _runs(k[i:j])
            sizes, step = np.diff(np.append(first, j - i)).astype(np.uint32), np.diff(k[i:j][first], prepend=np.uint64(0))
            out.append((int(shard[i]), batch, False, _squeeze(doc[i:j]), _squeeze(sizes), _squeeze(step), _squeeze(t[i:j])))
        return _batch(out, ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (unseen, hot, known) = WordHash(), shared.value
        batch, held, n = TaskContext.get().partitionId() << 32, [], 0
        for part in rows(batches, "rid", "text", size=64):
            with np.errstate(over="ignore"):
                for rid, text in part:
                    h = _of(memo, text)
                    if len(h):
                        add, weight, k, t = grams(h, hot, known)
                        loss = -(unseen + add)
                        held.append((rid, len(h), float((loss - weight).sum()), worst(loss), k, t))
                        n += len(k)
                if n >= 1_000_000:
                    yield pack(batch, held)
                    batch, held, n = batch + 1, [], 0
        if held:
            yield pack(batch, held)

    return run


SUMS = "batch long, whole boolean, docs binary, sizes binary, keys binary, times binary"


def _sums(entries: pa.Table, table: pa.Table) -> pa.Table:
    """Of one shard: for each text in it, what its grams add to the loss (as keys); whole rows go on as they are."""
    keys, gain, gamma = (np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in table.column(c).to_pylist())]) for c, kind in (("keys", np.uint64), ("gain", np.float32), ("gamma", np.float32)))
    at = np.argsort(keys, kind="stable")
    keys, gain, gamma = keys[at], gain[at], gamma[at]
    out = []
    for part in entries.to_batches(max_chunksize=64):
        for row in part.to_pylist():
            docs, sizes, k, t = (row[c] for c in ("docs", "sizes", "keys", "times"))
            if not row["whole"]:
                k, t, sizes = np.cumsum(_loose(k, np.uint64)), _loose(t, np.uint32).astype(np.int64), _loose(sizes, np.uint32)
                found = np.zeros(len(t))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    at, hit = np.repeat(at, sizes), np.repeat(keys[at] == k, sizes)
                    found = np.where(hit, (t >> 1) * gain[at] + ((t >> 1) - (t & 1)) * gamma[at], 0.0)
                docs, place = np.unique(_loose(docs, np.uint32), return_inverse=True)
                k, sizes, t = np.bincount(place, weights=found).astype(np.float32).tobytes(), None, None
                docs = _squeeze(np.diff(docs, prepend=np.uint32(0)))
            out.append({"batch": row["batch"], "whole": row["whole"], "docs": docs, "sizes": sizes, "keys": k, "times": t})
    kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 4]
    return pa.Table.from_pylist(out, schema=pa.schema([(c.split()[0], t) for c, t in zip(SUMS.split(", "), kinds, strict=True)]))


LOSSES = "rid long, n_words long, loss double, worst double"


def _added(batch: pa.Table) -> pa.Table:
    """The texts of a batch with their sums over all shards."""
    parts = batch.to_pylist()
    whole = next(row for row in parts if row["whole"])
    rid, words = np.frombuffer(whole["docs"], np.int64), np.frombuffer(whole["sizes"], np.int64)
    loss = np.frombuffer(whole["keys"], np.float64).copy()
    for row in parts:
        if not row["whole"]:
            loss[np.cumsum(_loose(row["docs"], np.uint32))] -= np.frombuffer(row["keys"], np.float32)
    return pa.table([pa.array(rid), pa.array(words), pa.array(loss), pa.array(np.frombuffer(whole["times"], np.float64), from_pandas=True)], names=[c.split()[0] for c in LOSSES.split(", ")])


def losses(texts: DataFrame, trusted: DataFrame, how: Quality) -> DataFrame:
    """rid, n_words, loss (nats), worst (window, a word; null if shorter) of texts (rid, text) that have words, under the model of the trusted (text).

    The log probability of a text is a sum over its 1-, 2- and 3-grams of the gain of the gram and the log weight of the
    context, nothing for grams that the model doesn't have. So the distinct grams of every text meet the count tables in
    shards by hash, each shard gives sums for its texts, and these are added up. Only the hot grams and a bitmap of all
    known ones, of bounded size, are sent to the executors; the bitmap may let grams pass that aren't known, never hold one back.
    """
    spark, shards = texts.sparkSession, _n_shards(texts, how)
    unseen, found = tables(trusted, how, shards)
    top = [_arrays(found[x].orderBy(F.desc("n"), *GRAMS[x]).limit(how.hot).toArrow(), GRAMS[x]) for x in ("words", "pairs")]
    hot = [np.concatenate(x) for x in zip(*top, strict=True)]
    at = np.argsort(hot[0])
    every = reduce(DataFrame.union, [df.select(*GRAMS[x]).mapInArrow(_keys(GRAMS[x]), "key long") for x, df in found.items()])
    shared = spark.sparkContext.broadcast((unseen, tuple(x[at] for x in hot), bitmap(every, how.most_bits)))
    table = reduce(DataFrame.union, [df.select(*GRAMS[x], "gain", "gamma").mapInArrow(_table(GRAMS[x], shards), TABLE) for x, df in found.items()])
    asked = texts.mapInArrow(_entries(shared, shards, how.window), ENTRIES)
    sums = asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(_sums, SUMS)
    every = sums.groupBy("batch").applyInArrow(_added, LOSSES)
    # rows that are the same in id and text have the same sums
    out = staged(every.groupBy("rid").agg(*[F.max(c).alias(c) for c in ("n_words", "loss", "worst")]), "losses")
    shared.destroy()
    discard(*found.values())
    return out


def trusted_documents(docs: DataFrame, labels: DataFrame, how: Quality) -> DataFrame:
    """doc_id, held of all labelled good, not toxic documents; held: kept out of the counts, for thresholds."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return good.withColumn("held", F.pmod(F.xxhash64(F.lit(how.seed + 2), "doc_id"), F.lit(1000)) < int(1000 * how.calibration))


def judge_quality(docs: DataFrame, labels: DataFrame, how: Quality = Quality()) -> DataFrame:
    """docs (doc_id, text, lang and others) with n_words, perplexity, score, threshold, kept.

    The model counts all trusted documents (quality 1, toxic 0 in labels) but those held out; its tables stay
    distributed and meet the grams of every document in shards. perplexity is exp(loss per word); score is
    (loss + prior * m) / (words + prior), m being the median of all the language's held-out trusted documents. A document
    is kept if its score is at most its language's threshold and its worst window within the same quantile of those. Medians and thresholds have a row per language.

    Null and empty texts have no words, a null perplexity, score m, and are kept. A null or rare language is measured
    against all languages together. Without trusted documents everything is kept. Repeated rows are scored each, and counted each where trusted; of
    a held-out id with several texts one, always the same, counts for medians and thresholds. Scores equal to a threshold are kept.
    Columns of docs that are named like the new ones are replaced. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_words", "loss", "perplexity", "score", "threshold", "kept").withColumn("text", F.col("text").cast("string")).withColumn("lang", F.col("lang").cast("string"))
    good = staged(trusted_documents(docs, labels, how), "trusted")
    known = docs.withColumn("_rid", F.xxhash64("doc_id", "text"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    ids = good.where("not held").select("doc_id")
    ids = F.broadcast(ids) if ids.count() <= how.broadcast_ids else ids
    counted = narrow.join(ids, "doc_id", "left_semi").select("text")
    found = losses(known.select(F.col("_rid").alias("rid"), "text"), counted, how).withColumnsRenamed({"rid": "_rid", "worst": "_worst"})
    # of rows that repeat an id the one of least digest stands for it
    usual = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "_rid").join(good.where("held"), "doc_id", "left_semi")
    usual = usual.groupBy("doc_id").agg(F.min(F.struct("_rid", "lang")).alias("_u")).select("doc_id", "_u.lang", "_u._rid")
    usual = staged(usual.join(found, "_rid").where("n_words > 0"), "usual")
    rate = F.col("loss") / F.col("n_words")
    blend = lambda m: (F.col("loss") + how.prior * m) / (F.col("n_words") + how.prior)

    whole = usual.agg(F.percentile(rate, 0.5)).first()[0]
    medians = usual.where("lang is not null").groupBy("lang").agg(F.percentile(rate, 0.5).alias("_m"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= how.least_docs)
    medians = staged(medians.select("lang", "_m"), "medians")
    middle = F.coalesce("_m", F.lit(whole), F.lit(0.0))
    rated = staged(usual.join(medians, "lang", "left").select("lang", "_m", "_worst", blend(middle).alias("score")), "rated")
    limit, local = (F.percentile(c, how.quantile) + how.slack for c in ("score", "_worst"))
    everywhere, anywhere = rated.agg(limit, local).first()
    limits = staged(rated.where("_m is not null").groupBy("lang").agg(F.first("_m").alias("_m"), limit.alias("_limit"), local.alias("_local")), "limits")
    out = known.join(found, "_rid", "left").join(limits, "lang", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long"))).withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    out = out.withColumn("score", blend(middle)).withColumn("threshold", F.coalesce("_limit", F.lit(everywhere).cast("double")))
    perplexity = F.when(F.col("n_words") > 0, F.exp(rate)).alias("perplexity")
    near = F.coalesce(F.col("_worst") <= F.coalesce("_local", F.lit(anywhere).cast("double")), F.lit(True))
    return out.select(*docs.columns, "n_words", perplexity, "score", "threshold", (F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)) & near).alias("kept"))
