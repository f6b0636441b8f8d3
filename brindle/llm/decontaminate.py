"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.arrays import running

from ._staging import staged

BITS = 64


@dataclass(frozen=True)
class Leaks:
    """Shingles of `width` words. A window leaks an item at weighted similarity num / den or more. Fingerprints have
    64 bits; those of texts at 0.8 differ in about 10 +- 3, so the radius loses one in some 100,000 at the threshold.
    blocks parts of a fingerprint within the radius have one with at most radius // blocks differing bits.
    broadcast_rows: beyond so many seeds the join with all shingles is left to Spark instead of broadcast."""

    width: int = 5
    num: int = 80
    den: int = 100
    radius: int = 23
    blocks: int = 8
    broadcast_rows: int = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, width: int, weighted: bool) -> Column:
    """Hash of each run of `width` words; weighted: with its letters as weight, as long words say more."""
    none = F.array().cast("array<struct<h:bigint,w:int>>" if weighted else "array<bigint>")

    def every(own: Column) -> Column:
        run = lambda i: [F.get(own, i + k) for k in range(width)]
        one = (lambda i: F.struct(F.xxhash64(*run(i)).alias("h"), sum(F.length(w) for w in run(i)).alias("w"))) if weighted else (lambda i: F.xxhash64(*run(i)))
        return F.when(F.size(own) >= width, F.transform(F.sequence(F.lit(0), F.size(own) - width), one)).otherwise(none)

    # in an array of one, or Spark could put the split in the place of the words and make it again at every place
    return F.transform(F.array(words), every)[0]


def simhash(shingles: Column) -> Column:
    """64 signed votes of array<struct<h, w>> as a bigint."""
    vote = lambda b: F.aggregate(shingles, F.lit(0).cast("bigint"), lambda a, s: a + F.when(F.getbit(s["h"], b) == 1, s["w"]).otherwise(-s["w"]))
    bit = lambda a, b: F.when(vote(b) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), bit)


def tallies(shingles: Column) -> Column:
    """struct<lanes array<array<bigint>>, all array<bigint>>: of array<struct<h, w>>, up to each place, the weights of those
    with bit k and, 32 bits higher, with bit k + 32, for k below 32; and all weights."""
    up = lambda a, b: a + b
    has = lambda x, b: F.getbit(x["h"], b).cast("bigint") * x["w"]
    lane = lambda k: running(F.transform(shingles, lambda x: has(x, k) + F.call_function("shiftleft", has(x, k + 32), F.lit(32))), up, "bigint")
    lanes = F.transform(F.sequence(F.lit(0), F.lit(BITS // 2 - 1)), lane)
    return F.struct(lanes.alias("lanes"), running(F.transform(shingles, lambda x: x["w"].cast("bigint")), up, "bigint").alias("all"))


def simhash_between(sums: Column, start: Column, end: Column) -> Column:
    """simhash() of the shingles from start to end (exclusive) from the tallies of all: as many steps whatever lies between.

    A bit's vote is above zero if those with it weigh more than half. A lane holds weights below 2 ** 32.
    """
    within = lambda x: F.get(x, end - 1) - F.coalesce(F.get(x, start - 1), F.lit(0))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)

    def both(half: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            votes = F.transform(F.array(within(F.get(sums["lanes"], k))), lambda s: F.when(s.bitwiseAND(F.lit((1 << 32) - 1)) * 2 > half, one(k)).otherwise(0).bitwiseOR(F.when(F.call_function("shiftrightunsigned", s, F.lit(32)) * 2 > half, one(k + 32)).otherwise(0)))
            return acc.bitwiseOR(votes[0])

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS // 2 - 1)), F.lit(0).cast("bigint"), step)

    return F.transform(F.array(within(sums["all"])), both)[0]


def _blocks(print_: Column, n: int) -> list[Column]:
    size = BITS // n
    return [F.call_function("shiftrightunsigned", print_, F.lit(i * size)).bitwiseAND(F.lit((1 << size) - 1)) for i in range(n)]


def _flips(size: int, most: int) -> list[int]:
    """All masks of at most `most` bits."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(size), k)]


def weighted_similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """(shared, whole): the weights of the multisets' intersection and union, exact integers.

    Shingles are sorted and numbered by occurrence, so that a multiset is a set: of strings, as sets of those are told
    by hash. All steps are linear in the shingles but for the sort.
    """

    def numbered(s: Column) -> Column:
        def number(o: Column) -> Column:
            first = running(F.transform(o, lambda x, i: F.when((i > 0) & (F.get(o, i - 1) == x), 0).otherwise(i)), F.greatest)
            return F.transform(F.arrays_zip(o.alias("x"), first.alias("f")), lambda z, i: F.concat_ws(":", z["x"]["h"].cast("string"), (i - z["f"]).cast("string"), z["x"]["w"].cast("string")))

        return F.transform(F.array(F.array_sort(s)), number)[0]

    weigh = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda t, x: t + x["w"])
    shared = F.aggregate(F.array_intersect(numbered(a), numbered(b)), F.lit(0).cast("bigint"), lambda t, x: t + F.substring_index(x, ":", -1).cast("bigint"))
    return shared, weigh(a) + weigh(b) - shared


def _best_window(stretch: Column, item: Column, starts: Column, size: Column, first: int = 4) -> Column:
    """struct<start, shared, whole>: of the windows of `size` shingles at `starts` the most similar to the item, the first of equal ones.

    No window shares more than the weight of those of its shingles that the item has, which is a difference of two
    running sums. In order of that bound the first few are compared exactly, and of the others those whose bound reaches
    the best of these: in most texts none. So an item's thousands of windows cost a step each, and few comparisons.
    """
    up = lambda a, b: a + b
    sums = lambda weigh: running(F.transform(stretch, weigh), up, "bigint")
    weight = F.aggregate(item, F.lit(0).cast("bigint"), lambda t, x: t + x["w"])

    def measured(here: Column) -> Column:
        return F.struct(sums(lambda x: F.when(F.array_contains(here, x["h"]), x["w"]).otherwise(0).cast("bigint")).alias("in"), sums(lambda x: x["w"].cast("bigint")).alias("all"), weight.alias("item"))

    # arrays of one element bind what is used more than once to a name
    both = F.transform(F.array(F.transform(item, lambda x: x["h"])), measured)

    def ranked(own: Column) -> Column:
        def bound(at: Column) -> Column:
            end = F.least(at + size, F.size(stretch))
            within = lambda x: F.get(x, end - 1) - F.coalesce(F.get(x, at - 1), F.lit(0))
            return F.struct((-within(own["in"]) / (within(own["all"]) + own["item"] - within(own["in"]))).alias("least"), at.alias("start"))

        return F.array_sort(F.transform(starts, bound))

    def exact(z: Column) -> Column:
        shared, whole = weighted_similarity(F.slice(stretch, z["start"] + 1, size), item)
        return F.transform(F.array(F.struct(shared.alias("a"), whole.alias("b"))), lambda x: F.struct((-x["a"] / x["b"]).alias("least"), z["start"].alias("start"), x["a"].alias("shared"), x["b"].alias("whole")))[0]

    def chosen(order: Column) -> Column:
        def others(best: Column) -> Column:
            rest = F.filter(F.slice(order, first + 1, F.greatest(F.size(order), F.lit(1))), lambda z: z["least"] <= best["least"])
            return F.array_min(F.concat(F.array(best), F.transform(rest, exact)))

        return F.transform(F.array(F.array_min(F.transform(F.slice(order, 1, first), exact))), others)[0]

    return F.transform(F.transform(both, ranked), chosen)[0]


def _items(benchmark: DataFrame, how: Leaks) -> DataFrame:
    words = benchmark.select("item_id", words_of(F.col("text")).alias("_w"))
    some = words.select("item_id", F.size("_w").alias("m"), _shingles(F.col("_w"), how.width, True).alias("item")).where("item_id is not null and size(item) > 0")
    # in arrays of one: a lambda would cut the shingles again at every bit
    whole = lambda x: F.transform(F.array(tallies(x)), lambda t: simhash_between(t, F.lit(0), F.size(t["all"])))[0]
    return staged(some.select("*", F.transform(F.array(F.col("item")), whole)[0].alias("item_print")), "items")


def _seeds(items: DataFrame, how: Leaks) -> DataFrame:
    """Shingles (h, item_id, m: the item's words) of each item of which any window at the threshold has one: the heaviest,
    to more than the share of the item's weight that such a window may lack."""
    each = items.select("item_id", "m", F.posexplode("item").alias("place", "s")).select("item_id", "m", "place", "s.h", "s.w")
    line = Window.partitionBy("item_id").orderBy(F.desc("w"), "h", "place")
    each = each.withColumn("_over", F.sum("w").over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("w").over(Window.partitionBy("item_id")))
    return each.where(F.coalesce("_over", F.lit(0)) * how.den <= F.col("_all") * (how.den - how.num)).select("h", "item_id", "m").distinct()


def _short_leaks(texts: DataFrame, benchmark: DataFrame, how: Leaks) -> DataFrame:
    """(doc_id, item_id, start, m, similarity) of items of fewer words than a shingle: such an item is its whole sequence,
    and a window has it or not. The runs of as many words as any short item has meet the items by their hash."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("v")).select("item_id", "v", F.size("v").alias("m")).where(f"item_id is not null and m between 1 and {how.width - 1}")
    items = staged(items.select("item_id", "v", "m", F.xxhash64(F.array_join("v", " ")).alias("h")), "short")
    sizes = [r.m for r in items.select("m").distinct().collect()]  # below how.width
    if not sizes:
        return items.select(F.lit(None).cast("long").alias("doc_id"), "item_id", F.lit(0).alias("start"), "m", F.lit(1.0).alias("similarity")).limit(0)
    worded = texts.select("doc_id", words_of(F.col("text")).alias("w"))

    def runs(m: int) -> Column:
        at = F.sequence(F.lit(0), F.size("w") - m)
        every = F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(m).alias("m"), F.slice(F.col("w"), i + 1, m).alias("run")))
        return F.when(F.size("w") >= m, every).otherwise(F.array().cast("array<struct<start:int,m:int,run:array<string>>>"))

    placed = worded.select("doc_id", F.explode(F.concat(*[runs(m) for m in sizes])).alias("r")).select("doc_id", "r.*").withColumn("h", F.xxhash64(F.array_join("run", " ")))
    hit = placed.join(items.withColumnRenamed("m", "_m"), "h").where("run = v")
    return hit.groupBy("doc_id", "item_id", "m").agg(F.min("start").alias("start")).select("doc_id", "item_id", "start", "m", F.lit(1.0).alias("similarity"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, how: Leaks = Leaks()) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window for each document and item that it leaks.

    1. Of an item's shingles the heaviest fifth are seeds: a window at 0.8 has one of them. Every shingle of every
    whole text meets the seeds in a join; each meeting places every window of the item's size that holds it, so words inserted,
    deleted or moved before the seed hide no window. 2. Windows are fingerprinted by SimHash: the votes of a stretch are
    tallied once, and those of a window are a difference of two tallies, so an item of any length costs its windows one step
    each. They meet the item whose seed placed them in a multi-index: fingerprints within the radius agree in one of eight
    blocks up to radius // 8 bits, and each item stands under all such keys. 3. Pairs within the radius are confirmed
    by the exact similarity of their shingle multisets, weighted by letters.

    Only the seeds (a share of the benchmark; counted first) may be broadcast. A passage in a third of all documents
    is a window in each, and no documents are compared with each other. An item of fewer than five words is one
    sequence, which a document leaks if it has it whole; items and texts without words leak nothing. Null texts and ids
    match nothing. Rows that repeat a doc_id are searched each and reported once, with the best of all. Equal items are
    each reported; of equal windows the first counts. Other columns, of whatever name, are ignored. Empty tables give no rows.
    """
    items = _items(benchmark, how)
    seeds = staged(_seeds(items, how), "seeds")
    seeds = F.broadcast(seeds) if seeds.count() <= how.broadcast_rows else seeds
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    row = F.xxhash64("text").alias("row")
    # words are a column of their own: a lambda would split the text again at every place
    every = texts.select("doc_id", row, words_of(F.col("text")).alias("_w")).select("doc_id", "row", F.posexplode(_shingles(F.col("_w"), how.width, False)).alias("pos", "h"))
    met = every.join(seeds, "h").groupBy("doc_id", "row", "item_id", "m").agg(F.array_sort(F.collect_set("pos")).alias("met"))
    found = texts.withColumn("row", row).join(staged(met, "met"), ["doc_id", "row"])
    found = found.select("doc_id", "row", "item_id", "m", "met", words_of(F.col("text")).alias("_w")).select("doc_id", "row", "item_id", "m", "met", _shingles(F.col("_w"), how.width, True).alias("s"))
    # starts from the last meeting's on, so that each stands once; the stretch of shingles that any window covers
    size_ = F.col("m") - (how.width - 1)
    lowest = lambda p: F.greatest(p - (F.col("m") - how.width), F.lit(0))
    fresh = lambda p, i: F.when(i == 0, lowest(p)).otherwise(F.greatest(lowest(p), F.get("met", i - 1) + 1))
    starts = F.flatten(F.transform("met", lambda p, i: F.sequence(fresh(p, i), p)))
    found = found.withColumn("lo", lowest(F.col("met")[0])).withColumn("starts", starts).withColumn("s", F.slice("s", F.col("lo") + 1, F.element_at("met", -1) + size_ - F.col("lo")))
    found = staged(found.select("doc_id", "row", "item_id", "m", "lo", "starts", "s"), "found")
    upto = lambda at: F.least(at - F.col("lo") + size_, F.size("s"))
    print_ = lambda t: F.transform("starts", lambda at: F.struct(at.alias("start"), simhash_between(t, at - F.col("lo"), upto(at)).alias("print")))
    # in an array of one, so that a stretch is tallied once
    prints = found.select("doc_id", "row", "item_id", "m", F.explode(F.transform(F.array(tallies(F.col("s"))), print_)[0]).alias("w")).select("doc_id", "row", "item_id", "m", "w.start", "w.print")

    size = BITS // how.blocks
    flips = F.array(*[F.lit(x) for x in _flips(size, how.radius // how.blocks)])
    block = lambda p: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), b.alias("v")) for i, b in enumerate(_blocks(F.col(p), how.blocks))])).alias("b")
    index = items.select("item_id", "item_print", block("item_print")).select("item_id", "item_print", "b.i", "b.v")
    index = index.select("item_id", "i", "item_print", F.explode(F.transform(flips, lambda f: F.col("v").bitwiseXOR(f.cast("bigint")))).alias("v"))
    asked = prints.select("*", block("print")).select("doc_id", "row", "item_id", "start", "print", "b.i", "b.v")
    near = asked.join(index, ["item_id", "i", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= how.radius)
    near = staged(near.groupBy("doc_id", "row", "item_id").agg(F.collect_set("start").alias("near")), "near")
    pairs = found.join(near, ["doc_id", "row", "item_id"]).join(items.select("item_id", "item"), "item_id").select("doc_id", "item_id", "m", "lo", "s", "near", "item")
    sure = pairs.select("doc_id", "item_id", "m", _best_window(F.col("s"), F.col("item"), F.transform("near", lambda at: at - F.col("lo")), F.col("m") - (how.width - 1)).alias("b"), "lo")
    sure = sure.where(F.col("b.shared") * how.den >= F.col("b.whole") * how.num)
    sure = sure.select("doc_id", "item_id", (F.col("b.start") + F.col("lo")).alias("start"), "m", (F.col("b.shared") / F.col("b.whole")).alias("similarity")).unionByName(_short_leaks(texts, benchmark, how))
    best = sure.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("start", "m", "similarity"), F.struct(-F.col("similarity"), F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.m").cast("long").alias("n_words"), F.round("b.similarity", 6).alias("similarity"))
