"""Line dedup by a deletion-neighbourhood join: equal lines and lines one word edit apart keep their earliest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import Bitmap, bitmap
from ._staging import bound_batches, staged
from ._words import STEP, mix, rows

#: The inverse of STEP modulo 2 ** 64.
BACK = np.uint64(pow(int(STEP), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _chunks(batches: Iterator[pa.RecordBatch], chars: int = 500_000) -> Iterator[tuple[list[int], list[str | None]]]:
    """Ids and texts of consecutive rows, up to about so many characters or one text at a time."""
    ids, texts, size = [], [], 0
    for part in rows(batches, "doc_id", "text", size=64):
        for i, t in part:
            if texts and size + len(t or "") > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t or "")
    if texts:
        yield ids, texts


class Lines:
    """The lines of some texts that have at least `least` words, and hashes of any run of their words.

    Texts are worked on as one array of bytes. A word's hash is a polynomial sum of random values of its bytes, mixed;
    a run's hash the polynomial sum of its word hashes, so that of a line without one word comes from two prefixes.
    """

    #: A random value for each byte, with A-Z as a-z; blanks part words.
    VALUES = np.random.default_rng(20240301).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    VALUES[65:91] = VALUES[97:123]
    BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self, texts: list[str | None], least: int):
        parts = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        inside = np.concatenate(([False], ~self.BLANK[raw], [False]))
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turn[::2], turn[1::2]
        power, back = _powers(STEP, len(raw)), _powers(BACK, len(raw))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.VALUES[raw] * power[:-1])))
        hashes = mix((sums[end] - sums[start]) * back[start] ^ (end - start).astype(np.uint64))

        breaks = np.flatnonzero(raw == 10)
        line_of = np.searchsorted(breaks, start)
        counts = np.bincount(line_of, minlength=len(breaks) + 1)
        lines_in = np.array([p.count(b"\n") + 1 for p in parts], dtype=np.int64)
        doc_of = np.repeat(np.arange(len(parts)), lines_in)
        first = np.cumsum(lines_in) - lines_in
        kept = np.flatnonzero(counts >= least)
        self.n, self.doc = counts[kept].astype(np.int64), doc_of[kept]
        self.line = kept - first[self.doc]
        self.end = np.cumsum(counts)[kept]
        self.start = self.end - self.n
        self.hashes = hashes
        self.power, self.back = power, back  # at least as many bytes as words
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[1 : len(hashes) + 1])))

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def keys(self) -> np.ndarray:
        return mix(self.run(self.start, self.end) ^ self.n.astype(np.uint64))

    def halves(self) -> list[np.ndarray]:
        """Keys of which lines one word edit apart share one: the first and last n // 2 and (n - 1) // 2 words."""
        out = []
        for h in (self.n // 2, (self.n - 1) // 2):
            tag = h.astype(np.uint64) * np.uint64(2)
            out.append(mix(self.run(self.start, self.start + h) ^ tag))
            out.append(mix(self.run(self.end - h, self.end) ^ (tag + np.uint64(1))))
        return out

    def variants(self, i: int) -> np.ndarray:
        """Keys of line i whole and without each of its words; of equal neighbours the same."""
        a, b = self.start[i], self.end[i]
        whole = self.run(a, b)
        left = (self.sums[a:b] - self.sums[a]) * self.back[a]
        right = (self.sums[b] - self.sums[a + 1 : b + 1]) * self.back[a + 1]
        return np.concatenate((mix(np.array([whole ^ np.uint64(b - a)])), mix((left + right) ^ np.uint64(b - a - 1))))


def _probe(least: int):
    """A row per line: its place, its key and, for the first of equal ones in a chunk, the keys of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _chunks(batches):
            with np.errstate(over="ignore"):
                found = Lines(texts, least)
                halves = np.stack([h.view(np.int64) for h in found.halves()], axis=1)
                ids = pa.array(doc_ids, pa.int64()).take(pa.array(found.doc))
                keys = found.keys().view(np.int64)
                # equal lines have equal halves: the first of a chunk stands for them
                first = np.zeros(len(keys), bool)
                first[np.unique(keys, return_index=True)[1]] = True
                offsets = pa.array(np.concatenate(([0], np.cumsum(4 * first))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.line), pa.array(keys), pa.ListArray.from_arrays(offsets, pa.array(halves[first].ravel()))], ["doc_id", "line", "key", "halves"])

    return run


def _hopeful(found: Lines, halves: Bitmap, seen: set[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(line, key, its variants) of the lines that may share a half, each key once per task."""
    keys = found.keys().view(np.int64)
    hit = np.zeros(len(keys), bool)
    for h in found.halves():
        hit |= halves.has(h)
    for i in np.flatnonzero(hit).tolist():
        k = int(keys[i])
        if k not in seen:
            if len(seen) < 2_000_000:  # repeats beyond these only cost their variants again
                seen.add(k)
            yield i, k, found.variants(i).view(np.int64)


def _neighbours(least: int, halves):
    """(variant, key) of hopeful lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _chunks(batches):
            with np.errstate(over="ignore"):
                found = list(_hopeful(Lines(texts, least), halves.value, seen))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v for _, _, v in found])), pa.array(np.repeat(np.array([k for _, k, _ in found]), [len(v) for _, _, v in found]))], ["variant", "key"])

    return run


def _spell(least: int, halves, shared):
    """(key, variants array<struct<variant, at>>, words) of hopeful lines that may share a variant; at = -1: the whole line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _chunks(batches):
            out = []
            with np.errstate(over="ignore"):
                lines = Lines(texts, least)
                for i, k, variants in _hopeful(lines, halves.value, seen):
                    at = np.flatnonzero(shared.value.has(variants))
                    if len(at):
                        out.append((k, [{"variant": int(variants[p]), "at": int(p) - 1} for p in at], lines.hashes[lines.start[i] : lines.end[i]].tobytes()))
            kind = pa.list_(pa.struct([("variant", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], kind), pa.array([r[2] for r in out], pa.binary())], ["key", "variants", "words"])

    return run


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one insertion, deletion or substitution, or none, makes a from b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    m = len(b)
    differ = np.flatnonzero(a[:m] != b)
    if not len(differ):
        return True
    p = differ[0]
    return bool((a[p + 1 :] == b[p + (len(a) == m) :]).all())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows(batches, "key", "words", "other"):
        good = [k for k, a, b in part if within_one_edit(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))]
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], ["key"])


def _rewrite(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "_gone"))
            new = []
            for t, g in zip(text, gone, strict=True):
                drop = set(g or ())
                new.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop) if drop and t is not None else t)
            lines = pa.array([len(t.split("\n")) if t else 0 for t in text], pa.int64())
            dropped = pa.array([len(set(g or ())) for g in gone], pa.int64())
            columns = [pa.array(new, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, lines, dropped], [*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, least: int = 5, most_bits: int = 1 << 28) -> DataFrame:
    """docs (doc_id, text and others) with repeated lines taken out of text, and n_lines, n_dropped.

    Lines are what newlines part; their words are what blanks part, A-Z lower-cased. A line of at least `least` words
    goes if an earlier one (smaller doc_id, then place) has the same words or is one word edit away: a word
    inserted, deleted or substituted. Other lines, blank ones among them, stay as they are.

    1. Each line gives its key and four half keys; equal keys are equal lines, and the earliest place of each key comes
    from a grouped minimum, so a line in a third of all documents is one row per task. Lines one edit apart share a
    half. The halves that different lines share make a bitmap of at most most_bits, which is sent to executors.
    2. Lines with a half in it emit themselves and themselves without each word, hashed; variants that different lines
    share make a second bitmap, and only lines with such a variant go on, with their words. 3. Substitutes at
    place p are equal without word p; an insertion is a line without one word equal to a whole line. A grouped minimum
    over each variant gives every line its earliest neighbour: no pairs within a group are made. 4. The edit
    distance to that neighbour is verified on the word sequences. The bitmaps may let lines pass that needn't, and
    never hold one back, so a full bitmap costs work, not results.

    Null text stays null. Rows that repeat a doc_id count as one document and lose the same line numbers. Rows with a
    null doc_id keep all lines and take none from others. An empty table gives no rows. Columns named n_lines or
    n_dropped are replaced. A text is worked on whole, with about 60 bytes of memory for each of its own.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped", "_gone", "_doc")
    names, spark = docs.columns, docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    lines = staged(texts.mapInArrow(_probe(least), "doc_id long, line long, key long, halves array<long>"), "lines")
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(11,0)") + F.col("line").cast("decimal(10,0)")
    placed = lines.select("doc_id", "line", "key", place.cast("decimal(38,0)").alias("place"))
    first = staged(placed.groupBy("key").agg(F.min("place").alias("first")), "first")

    differ = lambda rows_, by: rows_.groupBy(by).agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select(F.col(by).alias("key"))
    halves = bitmap(staged(differ(lines.select("key", F.explode(F.array_distinct("halves")).alias("half")), "half"), "halves"), most_bits)
    halves = spark.sparkContext.broadcast(halves)
    shared = bitmap(staged(differ(texts.mapInArrow(_neighbours(least, halves), "variant long, key long"), "variant"), "shared"), most_bits)
    shared = spark.sparkContext.broadcast(shared)
    spelt = texts.mapInArrow(_spell(least, halves, shared), "key long, variants array<struct<variant:long,at:int>>, words binary").dropDuplicates(["key"])
    spelt = staged(spelt.join(first, "key"), "spelt")

    variants = spelt.select("key", "first", F.explode("variants").alias("v")).select("key", "first", "v.variant", "v.at")
    same_place = variants.where("at >= 0").groupBy("variant", "at").agg(F.min("first").alias("early"))
    either = variants.groupBy("variant").agg(F.min(F.when(F.col("at") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("part"))
    swapped = variants.where("at >= 0").join(same_place, ["variant", "at"]).where("early < first").select("key", "early")
    grown = variants.join(either.where("whole is not null and part is not null"), "variant")
    grown = grown.withColumn("early", F.when(F.col("at") < 0, F.col("part")).otherwise(F.col("whole"))).where("early < first").select("key", "early")
    early = swapped.unionByName(grown).groupBy("key").agg(F.min("early").alias("early"))
    other = spelt.select(F.col("first").alias("early"), F.col("words").alias("other"))
    near = staged(early.join(spelt.select("key", "words"), "key").join(other, "early").select("key", "words", "other").mapInArrow(_verified, "key long").distinct(), "near")

    judged = placed.join(first, "key").join(near.withColumn("_near", F.lit(True)), "key", "left").where("place > first or _near")
    gone = judged.groupBy("doc_id").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("doc_id", "_doc")
    kept = docs.withColumn("text", F.col("text").cast("string")).join(gone, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc")
    schema = docs.withColumn("text", F.col("text").cast("string")).schema.add("n_lines", "long").add("n_dropped", "long")
    return kept.mapInArrow(_rewrite(names), schema)
