"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._staging import bound_batches, staged
from ._words import WordHash, blank_words, rows, shingles


@dataclass(frozen=True)
class NearDup:
    """bands x band_rows minima make a signature; a pair at the threshold shares no band with probability
    (1 - threshold ** band_rows) ** bands, here below 5e-8. miss is the greatest posterior probability of similarity
    at or above the threshold at which a candidate is given up after a batch of signature places.
    Links: den * |A and B| >= num * |A or B|, on the full sets."""

    width: int = 5
    num: int = 80
    den: int = 100
    bands: int = 32
    band_rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    block: int = 512

    @property
    def places(self) -> int:
        return self.bands * self.band_rows


def least_matches(places: int, batch: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For the first 1, 2, ... batches of places, the fewest matches at which a pair stays a candidate.

    Under a uniform prior the posterior of the similarity after m matches in n places is Beta(m + 1, n - m + 1);
    P(similarity >= t) is the chance of at most m successes in n + 1 draws of chance t.
    """
    out = []
    for n in range(batch, places + 1, batch):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def still_similar(left: np.ndarray, right: np.ndarray, how: NearDup, fewest: tuple[int, ...]) -> np.ndarray:
    """Places of the signature pairs (rows of two equal-shaped arrays) that no batch gives up; fewest: least_matches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int32)
    for k, least in enumerate(fewest):
        at = slice(k * how.batch, (k + 1) * how.batch)
        matches = matches + (left[alive, at] == right[alive, at]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _signer(how: NearDup):
    factors = (np.random.default_rng(20240229).integers(0, 2**31, how.places, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

    def sign(found: np.ndarray) -> bytes:
        x = (found >> np.uint64(32)).astype(np.uint32)[None, :]
        low = np.full((how.places, 1), np.uint32(0xFFFFFFFF))
        for at in range(0, x.shape[1], 1024):
            low = np.minimum(low, (factors * x[:, at : at + 1024]).min(axis=1, keepdims=True))
        low = low[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (low >> np.uint64(48)).astype("<u2").tobytes()

    return sign


def _digest(raw: bytes) -> list[int]:
    import xxhash

    return [int(np.uint64(xxhash.xxh3_64_intdigest(raw, seed)).astype(np.int64)) for seed in (1, 2)]


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary"


def _sign(how: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sign = WordHash(), _signer(how)
        for part in rows(batches, "doc_id", "text"):
            out = []
            for doc_id, text in part:
                found = np.unique(shingles(memo.of(blank_words(text)), how.width))
                out.append((doc_id, len(found), *_digest(found.tobytes()), sign(found) if len(found) else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return run


def _sets(how: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for part in rows(batches, "doc_id", "text"):
            found = [(i, np.unique(shingles(memo.of(blank_words(t)), how.width)).tobytes()) for i, t in part]
            digests = [_digest(s) for _, s in found]
            columns = [[i for i, _ in found], [a for a, _ in digests], [b for _, b in digests]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([s for _, s in found], pa.binary())], ["doc_id", "set_a", "set_b", "shingles"])

    return run


def _hopeful(how: NearDup):
    """Keeps the pairs whose sizes allow the threshold and whose signatures no batch gives up."""
    fewest = least_matches(how.places, how.batch, how.num / how.den, how.miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, how.places) for c in (2, 3))
            keep = pa.array(still_similar(left, right, how, fewest))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _linked(how: NearDup):
    """Keeps the pairs whose full sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches, "a", "b", "set_left", "set_right"):
            out = []
            for a, b, left, right in part:
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if how.den * both >= how.num * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["u", "v"])

    return run


def _pairs(group: pa.Table, how: NearDup, fewest: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """In one block, each member x of the lesser components with the others that may be linked to it across
    components, likeliest first. A pair that shares an earlier band is left to that band's bucket."""
    few = group.column("few").to_numpy().astype(bool)
    ids, comps, sizes = (group.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, how.places)
    band = group.column("band")[0].as_py()
    before = sigs[:, : band * how.band_rows].reshape(len(sigs), band, how.band_rows)
    ys = np.flatnonzero(~few)
    for x in np.flatnonzero(few):
        fits = (comps[ys] != comps[x]) & (np.minimum(sizes[ys], sizes[x]) * how.den >= np.maximum(sizes[ys], sizes[x]) * how.num)
        y = ys[fits]
        y = y[still_similar(np.broadcast_to(sigs[x], (len(y), how.places)), sigs[y], how, fewest)]
        if len(y) and band:
            y = y[~(before[y] == before[x]).all(axis=2).any(axis=1)]
        if len(y):
            yield x, y[np.argsort(-(sigs[y] == sigs[x]).sum(axis=1), kind="stable")]


def _involved(how: NearDup):
    """The rows of a block that any hopeful pair needs."""
    fewest = least_matches(how.places, how.batch, how.num / how.den, how.miss)

    def run(group: pa.Table) -> pa.Table:
        need = np.zeros(group.num_rows, dtype=bool)
        for x, y in _pairs(group, how, fewest):
            need[x] = need[y] = True
        return group.filter(pa.array(need))

    return run


def _across(how: NearDup):
    """One confirmed link for each member of a lesser component and each other component in the block.

    The components are connected by confirmed links already, so one link between a member and a component says as
    much as all of them.
    """
    fewest = least_matches(how.places, how.batch, how.num / how.den, how.miss)

    def run(group: pa.Table) -> pa.Table:
        ids, comps = (group.column(c).to_numpy() for c in ("doc_id", "component"))
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        u, v = [], []
        for x, ys in _pairs(group, how, fewest):
            done = set()
            for y in ys.tolist():
                if comps[y] not in done:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if how.den * both >= how.num * (len(sets[x]) + len(sets[y]) - both):
                        done.add(comps[y])
                        u.append(ids[x])
                        v.append(ids[y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """The pairs (a, b) that the full sets link, as (u, v)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_left", "set_right").mapInArrow(_linked(how), "u long, v long")


def near_duplicates(docs: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs.

    1. Every text becomes the set of its word shingles (64-bit hashes), a digest of the set and a MinHash signature.
    Texts with equal sets form a class; only its smallest id goes on. 2. Classes that share a band meet in a bucket.
    Each bucket first offers the pairs of its smallest id with the others, so a group of thousands of near copies
    costs as many pairs as it has members. Sequential Bayesian verification drops candidates batch by batch of
    signature places; survivors are confirmed on their full sets. 3. Buckets that still hold several components compare
    all pairs across them: members outside the bucket's largest component against all others, in blocks of bounded
    size dealt over all tasks. Signatures alone pass first; the sets of what they leave are joined and confirmed in
    the block, and only a link per member and component leaves it. Components are the closure of confirmed links.

    Null and empty texts have the empty set, are linked with nothing and kept. Rows that repeat an id with different
    texts are linked with each other: of such texts all but the first in order of digest go by a hash of id and digest
    until components are named by the smallest id again. Rows with a null id have a null component and are kept. An empty table gives no rows. Other columns
    are ignored. Two different texts are taken for equal only if 128 bits of digest agree.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(texts.mapInArrow(_sign(how), SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    several = full.groupBy("doc_id").agg(*[f(F.struct("set_a", "set_b")).alias(x) for f, x in ((F.min, "low"), (F.max, "high"))]).where("low <> high").select("doc_id", "low")
    several = staged(several, "several")
    repeated = not several.isEmpty()
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    node = F.col("class_id")
    if repeated:
        classes = classes.join(several.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
        node = F.when(F.col("low") != F.struct("set_a", "set_b"), F.xxhash64("class_id", "set_a", "set_b")).otherwise(F.col("class_id"))
    classes = staged(classes.select("set_a", "set_b", "class_id", node.alias("node")), "classes")
    reps = full.join(classes, ["set_a", "set_b"]).where("doc_id = class_id").dropDuplicates(["doc_id", "set_a", "set_b"]).select(F.col("node").alias("doc_id"), "n_shingles", "sig")
    reps = staged(reps, "reps")

    width = how.band_rows * 2
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("band"), F.xxhash64(F.expr(f"substring(sig, {i * width + 1}, {width})")).alias("key")) for i in range(how.bands)])
    members = reps.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.band", "k.key")
    buckets = members.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = staged(members.join(buckets, ["band", "key"]), "members")
    sides = reps.select("doc_id", "n_shingles", "sig")
    near = lambda pairs: (
        pairs.join(sides.toDF("a", "_na", "_sa"), "a")
        .join(sides.toDF("b", "_nb", "_sb"), "b")
        .where(f"least(_na, _nb) * {how.den} >= greatest(_na, _nb) * {how.num}")
        .select("a", "b", "_sa", "_sb")
        .mapInArrow(_hopeful(how), "a long, b long")
    )
    stars = staged(near(members.where("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()), "stars")
    # any document of a bucket may come up in step 3, so the sets of all of them are kept
    wanted = members.select("doc_id").distinct()
    found = "doc_id long, set_a long, set_b long, shingles binary"
    single = texts.join(several, "doc_id", "left_anti") if repeated else texts
    sets = single.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(how), found).select("doc_id", "shingles")
    if repeated:
        each = texts.join(several, "doc_id", "left_semi").mapInArrow(_sets(how), found).withColumnRenamed("doc_id", "class_id")
        each = each.join(classes, ["set_a", "set_b", "class_id"]).select(F.col("node").alias("doc_id"), "shingles").dropDuplicates(["doc_id"])
        sets = sets.unionByName(each.join(wanted, "doc_id", "left_semi"))
    sets = staged(sets, "sets")
    links = _confirmed(stars, sets, how)
    if repeated:
        own = full.join(several, "doc_id", "left_semi").join(classes, ["set_a", "set_b"]).select("doc_id", "node").distinct()
        ends = own.join(own.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").select(F.col("node").alias("u"), "v")
        links = links.unionByName(ends.where("u <> v"))
    links = staged(links, "links")
    links = staged(links.unionByName(_leftovers(reps, members, sets, links, how)), "links")

    class_of = _components(classes.select(F.col("node").alias("doc_id")).distinct(), links)
    named = classes.join(class_of.withColumnRenamed("doc_id", "node"), "node").select("set_a", "set_b", "class_id", F.col("component").alias("component_id"))
    if repeated:
        lowest = named.groupBy("component_id").agg(F.min("class_id").alias("lowest")).where("lowest <> component_id")
        named = named.join(lowest, "component_id", "left").withColumn("component_id", F.coalesce("lowest", "component_id"))
    named = named.select("set_a", "set_b", "component_id")
    out = signed.drop("sig").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _components(ids: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links).withColumnRenamed("node", "doc_id")
    return ids.join(found, "doc_id", "left").select(*ids.columns, F.coalesce("component", "doc_id").alias("component"))


def _leftovers(reps: DataFrame, members: DataFrame, sets: DataFrame, links: DataFrame, how: NearDup) -> DataFrame:
    """Confirmed links across components that the stars left apart."""
    labelled = staged(_components(members.select("doc_id").distinct(), links), "labels")
    here = members.select("band", "key", "doc_id").join(labelled, "doc_id")
    sized = here.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = sized.groupBy("band", "key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("top"), F.count(F.lit(1)).alias("parts")
    )
    mixed = staged(here.join(whole.where("parts > 1"), ["band", "key"]).join(reps, "doc_id"), "mixed")
    blocks, chunks = F.ceil(F.col("all") / how.block), F.ceil((F.col("all") - F.col("top")) / how.block)
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("long")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    every = mixed.withColumn("i", deal(blocks)).withColumn("j", upto(chunks)).withColumn("few", F.lit(False))
    some = mixed.where("component <> largest").withColumn("i", upto(blocks)).withColumn("j", deal(chunks)).withColumn("few", F.lit(True))
    cols = ["band", "key", "i", "j", "few", "doc_id", "component", "n_shingles", "sig"]
    at = cols[:4]
    dealt = every.select(*cols).unionByName(some.select(*cols))
    needed = staged(dealt.groupBy(*at).applyInArrow(_involved(how), dealt.schema), "needed")
    return needed.join(sets, "doc_id").groupBy(*at).applyInArrow(_across(how), "u long, v long")
