"""SimHash fingerprints: weighted word hashes vote on bits; permuted block tables find all within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._staging import bound_batches, shuffle_partitions, staged
from ._words import WordHash, blank_words, mix, rows, shingles


@dataclass(frozen=True)
class SimHash:
    """Terms are words and runs of `width` words; a term that stands n times weighs `1 + log n`, runs `run_weight` times that."""

    bits: int = 256
    width: int = 2
    run_weight: float = 2.0


class Signer:
    """fingerprint(text): bits packed in bytes. Texts that are equal, or without words, have equal fingerprints."""

    def __init__(self, how: SimHash):
        self.how, self.memo = how, WordHash()
        self.seeds = (np.arange(1, how.bits // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None]

    def fingerprint(self, text: str | None) -> bytes:
        how = self.how
        words = self.memo.of(blank_words(text))
        if not len(words):
            return bytes(how.bits // 8)
        with np.errstate(over="ignore"):
            terms, counts = np.unique(words, return_counts=True)
            weights = 1 + np.log(counts)
            if len(words) >= how.width > 1:
                runs, n = np.unique(shingles(words, how.width), return_counts=True)
                terms, weights = np.concatenate((terms, runs)), np.concatenate((weights, how.run_weight * (1 + np.log(n))))
            votes = np.zeros(how.bits)
            for at in range(0, len(terms), 2048):  # terms x bits a piece
                marks = mix(terms[None, at : at + 2048] ^ self.seeds)
                signs = np.unpackbits(marks.view(np.uint8).reshape(len(marks), -1, 8), axis=2)
                votes += np.einsum("btk,t->bk", signs, weights[at : at + 2048]).ravel()
            return np.packbits(2 * votes > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the share of differing bits tells, from 0 (unrelated or worse) to 1."""
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    share = float(np.unpackbits(x).sum()) / (8 * len(a))
    return max(0.0, float(np.cos(np.pi * share))) if share else 1.0


def fingerprints(docs: DataFrame, how: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (binary) of each row; null and empty texts have all bits clear. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(how)
        for part in rows(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([signer.fingerprint(t) for _, t in part], pa.binary())], ["doc_id", "fingerprint"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fingerprint binary").withColumnRenamed("doc_id", id_col)


class _Edits:
    """Consecutive rows (range, ghost, doc_id, text) to the digest of each document and its edited text."""

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def __init__(self, how: SimHash):
        self.how = how

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(self.how).fingerprint
        held = None  # a row that waits for the next one, with its fingerprint
        for part in rows(batches, "_range", "_ghost", "doc_id", "text", size=64):
            out = []
            for range_, ghost, doc_id, text in part:
                if ghost and (held is None or held[0] != range_):
                    continue
                row = (range_, doc_id, text or "", sign(text))
                if held is not None:
                    out.append(self._digest(held, row if held[0] == range_ else held, sign))
                held = None if ghost else row
            yield self._batch(out)
        yield self._batch([self._digest(held, held, sign)] if held else [])

    def _digest(self, row: tuple, after: tuple, sign) -> tuple:
        _, doc_id, text, own = row
        third = len(text) // 3
        edited = text[: len(text) - third] + after[2][:third]
        new = sign(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, after[3])

    def _batch(self, out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in self.schema.split(", ")])


def edited_fingerprints(docs: DataFrame, how: SimHash = SimHash(), rows_per_range: int = 500) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of its code points (floor) replaced by as
    many first ones, or all, of the next document by descending doc_id; after the last comes the first.

    Ids alone are read first: they are cut into ranges of about equal numbers of rows (eight for each shuffle partition at
    most), and each range's greatest id is noted. Texts are then shuffled once, by range, that document once more as a ghost at
    the end of the range before, so that every task has its documents and their next ones in order: neither a
    global sort nor a task with all rows is needed, and a task holds one document and the next.

    Null texts are empty. Rows with a null doc_id come last, rows that repeat an id in the order of a hash of their
    texts. A single document is its own next; so is the last one where no id is set. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = picked.where("doc_id is not null").select("doc_id")
    n = max(1, min(-(-ids.count() // rows_per_range), 8 * shuffle_partitions(spark)))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(i: pd.Series) -> pd.Series:
        """Range 0 has the greatest ids."""
        return pd.Series(len(cuts) - np.searchsorted(cuts, i.to_numpy(), side="left")).astype("int32")

    tops = ids.select("doc_id", range_of("doc_id").alias("r")).groupBy("r").agg(F.max("doc_id").alias("top")).orderBy("r").collect()  # a row per range
    before = {tops[i]["top"]: tops[i - 1]["r"] for i in range(len(tops))}
    places = range_of(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min)))
    heads = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None).cast("map<bigint,int>")
    ghost = heads[F.col("doc_id")]
    to = F.array_compact(F.array(F.col("_own") * 2, ghost * 2 + 1))
    dealt = picked.withColumn("_own", places).withColumn("_to", F.explode(to))
    dealt = dealt.select("doc_id", "text", F.shiftright("_to", 1).alias("_range"), (F.col("_to") % 2 == 1).alias("_ghost"))
    dealt = dealt.repartition(shuffle_partitions(spark), "_range").sortWithinPartitions("_range", "_ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.mapInArrow(_Edits(how).__call__, _Edits.schema)


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int, blocks: int | None = None, together: int = 1, salt: int = 1024) -> DataFrame:
    """(query_id, n_near): for every row of queries (doc_id, fingerprint) the rows of prints, itself excepted, whose
    fingerprints differ in at most `radius` bits. All of them are found.

    Equal fingerprints are one entry with a count. Fingerprints are cut into `blocks` blocks (radius + together of
    them by default), of which at least `together` are equal within the radius; each choice of `together` blocks is a table, permuted to the
    front as its key. A pair counts in the first table that it shares only. Entries of a key are dealt into pieces of
    about `salt`; queries go to every piece of their key, in blocks, and only counts come out.

    Null fingerprints are near nothing. Repeated rows count each. A query without neighbours gives 0.
    """
    blocks = blocks or radius + together
    entries = staged(prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "entries")
    asked = queries.where("fingerprint is not null").select("fingerprint").distinct()
    size = len(entries.first()["fingerprint"]) if entries.take(1) else 8
    edges = np.linspace(0, size, blocks + 1).astype(int)
    if (np.diff(edges) < 1).any():
        raise ValueError(f"{blocks} blocks need fingerprints of as many bytes; they have {size}")
    tables = list(combinations(range(blocks), together))
    part = lambda b: F.substring("fingerprint", int(edges[b]) + 1, int(edges[b + 1] - edges[b]))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[part(b) for b in c]).alias("key")) for t, c in enumerate(tables)])
    held = entries.select("fingerprint", "n", F.explode(keys).alias("k")).select("fingerprint", "n", "k.t", "k.key")
    sought = asked.select(F.col("fingerprint").alias("q"), F.explode(keys).alias("k")).select("q", "k.t", "k.key")
    sizes = held.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / salt).alias("pieces"))
    sizes = staged(sizes.join(sought.select("t", "key").distinct(), ["t", "key"], "left_semi"), "sizes")
    held = held.join(sizes, ["t", "key"]).withColumn("piece", F.pmod(F.xxhash64("fingerprint"), "pieces"))
    sought = sought.join(sizes, ["t", "key"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    cols = ["t", "key", "piece", "f", "n", "asks"]
    both = held.select("t", "key", "piece", F.col("fingerprint").alias("f"), "n", F.lit(False).alias("asks")).unionByName(sought.select("t", "key", "piece", F.col("q").alias("f"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks")))

    def count(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy().astype(bool)
        f = np.frombuffer(b"".join(group.column("f").to_pylist()), np.uint8).reshape(-1, size)
        n, t = group.column("n").to_numpy(), group.column("t")[0].as_py()
        ours, q, total = f[~asks], np.flatnonzero(asks), []
        for i in q.tolist():
            differ = ours ^ f[i]
            near = np.unpackbits(differ, axis=1).sum(axis=1) <= radius
            differ, weight = differ[near], n[~asks][near]
            equal = np.stack([~differ[:, edges[b] : edges[b + 1]].any(axis=1) for b in range(blocks)], axis=1)
            before = np.zeros(len(differ), bool)
            for c in tables[:t]:
                before |= equal[:, list(c)].all(axis=1)
            total.append(int(weight[~before].sum()))
        return pa.table({"f": group.column("f").filter(pa.array(asks)), "n": pa.array(total, pa.int64())})

    found = both.select(*cols).groupBy("t", "key", "piece").applyInArrow(count, "f binary, n long").groupBy("f").agg(F.sum("n").alias("n"))
    return queries.join(found, F.col("fingerprint") == F.col("f"), "left").select(F.col("doc_id").alias("query_id"), F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0)).alias("n_near"))
