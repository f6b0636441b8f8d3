"""A registry of reference implementations: names resolved by aliases, the best of each, and citations found by an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.staging import staged

#: Grams of the index. A text that stands in another has all its grams there.
GRAM = 3
#: Words up to this length say nothing about a citation.
SHORT_WORD = 2


def normal_name(name: Column) -> Column:
    """Trimmed, lower-cased, with underscores for hyphens and blanks; null for an empty name."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), "[- ]", "_"), F.lit(""))


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, "_", "")


def canonical_names(names: DataFrame, aliases: DataFrame, references: DataFrame) -> DataFrame:
    """(name, algorithm) of names (name) by aliases (alias, canonical) and references (algorithm): an alias as it is, then
    one without underscores, then a registered key as it is, then one without underscores. The first in order of alias
    or key wins a tie; names that nothing fits drop out. Equi-joins on normalized names, however many there are."""
    asked = names.select("name").distinct().select("name", normal_name(F.col("name")).alias("n")).where("n is not null")
    keys = references.select("algorithm").where("algorithm is not null").distinct()
    known = [
        aliases.select(F.col("alias").alias("k"), F.lit(0).alias("rank"), F.col("alias").alias("by"), F.col("canonical").alias("algorithm")),
        aliases.select(_bare(F.col("alias")).alias("k"), F.lit(1).alias("rank"), F.col("alias").alias("by"), F.col("canonical").alias("algorithm")),
        keys.select(F.col("algorithm").alias("k"), F.lit(2).alias("rank"), F.col("algorithm").alias("by"), "algorithm"),
        keys.select(_bare(F.lower("algorithm")).alias("k"), F.lit(3).alias("rank"), F.col("algorithm").alias("by"), "algorithm"),
    ]
    tries = asked.select("name", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), (F.col("n") if r % 2 == 0 else _bare(F.col("n"))).alias("k")) for r in range(4)])).alias("t")).select("name", "t.rank", "t.k")
    table = known[0].unionByName(known[1]).unionByName(known[2]).unionByName(known[3])
    return tries.join(table, ["rank", "k"]).groupBy("name").agg(F.min_by("algorithm", F.struct("rank", "by")).alias("algorithm"))


def find_references(names: DataFrame, aliases: DataFrame, references: DataFrame) -> DataFrame:
    """names' rows (name, algorithm, place, variant, ...) with the implementations of what each resolves to.

    references: (algorithm, variant, layer, at, ...); place counts from 0 in order of layer (what was registered at run time
    is layer 0), then at. Names without a reference drop out.
    """
    found = canonical_names(names, aliases, references).join(references, "algorithm")
    # an algorithm has a handful of implementations: places come from a small sorted array, not from a window over names
    order = references.groupBy("algorithm").agg(F.array_sort(F.collect_list(F.struct("layer", "at"))).alias("_o"))
    place = F.array_position("_o", F.struct("layer", "at")) - 1
    return found.join(order, "algorithm").withColumn("place", place).drop("_o")


def best_references(found: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row of find_references for each name: the first of the variant that hints (name, variant) asks for, else the first."""
    if hints is None:
        return found.groupBy("name").agg(F.min_by(F.struct(*[c for c in found.columns if c != "name"]), "place").alias("b")).select("name", "b.*")
    asked = found.join(hints.select("name", F.col("variant").alias("_hint")), "name", "left")
    rank = F.struct(F.coalesce((F.col("variant") != F.col("_hint")).cast("int"), F.lit(1)).alias("other"), "place")
    return asked.groupBy("name").agg(F.min_by(F.struct(*[c for c in found.columns if c != "name"]), rank).alias("b")).select("name", "b.*")


def grams(text: Column, n: int = GRAM) -> Column:
    """The different runs of n code points of a text; of a shorter one itself, of an empty one nothing."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when(F.length(text) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _holding(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) of parts (part) that stand in wholes (whole), each pair once, by an inverted index of grams.

    A part of three code points or more is looked up by that of its grams that fewest wholes have; all wholes that
    hold it are among those, and contains() decides. Shorter parts are looked up among the grams of their own length. So
    a pair is only made where a rare gram is shared, never of each part with each whole.
    """
    wholes = wholes.where("length(whole) > 0").distinct()
    sizes = F.array(*[F.lit(k) for k in range(1, GRAM + 1)])
    index = wholes.select("whole", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.filter(grams_of(F.col("whole"), k), lambda g: F.length(g) == k))))).alias("gram"))
    index = staged(index, "index")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    probes = parts.where("length(part) > 0").distinct().select("part", F.explode(grams(F.col("part"))).alias("gram")).join(counts, "gram", "left")
    rare = probes.groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rare.join(index, "gram").where(F.contains("whole", F.col("part"))).select("part", "whole")


def grams_of(text: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))


def citing_references(wanted: DataFrame, references: DataFrame) -> DataFrame:
    """(wanted, algorithm, variant, score): references (algorithm, variant, standards) that a text of wanted (wanted) cites.

    Lower-cased, either text holds the other, or all words of more than two letters of a cited standard stand in the
    wanted text. score is the longest cited standard that fits, in code points. Null and empty texts cite nothing.
    Citations and texts meet through an index of grams, not pair by pair.
    """
    cited = references.select("algorithm", "variant", F.explode("standards").alias("s")).select("algorithm", "variant", F.lower("s").alias("cited")).where("length(cited) > 0")
    texts = wanted.select("wanted", F.lower(F.trim("wanted")).alias("text")).where("length(text) > 0")
    c, t = staged(cited.select("cited").distinct(), "cited"), staged(texts.select("text").distinct(), "texts")
    inside = _holding(c.select(F.col("cited").alias("part")), t.select(F.col("text").alias("whole"))).toDF("cited", "text")
    around = _holding(t.select(F.col("text").alias("part")), c.select(F.col("cited").alias("whole"))).select(F.col("whole").alias("cited"), F.col("part").alias("text"))
    words = F.array_distinct(F.filter(F.split(F.col("cited"), r"\s+"), lambda w: F.length(w) > SHORT_WORD))
    worded = c.select("cited", words.alias("words")).where("size(words) > 0")
    each = _holding(worded.select(F.explode("words").alias("part")), t.select(F.col("text").alias("whole")))
    # posting lists of words: a text that holds as many of a citation's words as it has holds them all
    whole = worded.select("cited", F.size("words").alias("n"), F.explode("words").alias("part")).join(each, "part").groupBy("cited", "whole").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    by_word = whole.where("k = n").select("cited", F.col("whole").alias("text"))
    pairs = inside.unionByName(around).unionByName(by_word).distinct()
    out = texts.join(pairs, "text").join(cited, "cited")
    return out.groupBy("wanted", "algorithm", "variant").agg(F.max(F.length("cited")).alias("score"))


def titled_references(wanted: DataFrame, references: DataFrame) -> DataFrame:
    """Rows of references (algorithm, variant, title), one of each algorithm and variant, that a name of wanted (name) fits:
    lower-cased, either holds the other, or all of the name's words of four or more letters stand in the title."""
    names = staged(wanted.select(F.lower("name").alias("n")).where("length(n) > 0").distinct(), "names")
    titles = staged(references.select(F.lower("title").alias("t")).where("length(t) > 0").distinct(), "titles")
    as_part, as_whole = (lambda df, c: df.select(F.col(c).alias("part"))), (lambda df, c: df.select(F.col(c).alias("whole")))
    inside = _holding(as_part(names, "n"), as_whole(titles, "t")).select(F.col("whole").alias("t"))
    around = _holding(as_part(titles, "t"), as_whole(names, "n")).select(F.col("part").alias("t"))
    words = names.select("n", F.array_distinct(F.filter(F.split("n", r"[^a-z0-9]+"), lambda w: F.length(w) > 3)).alias("w")).select("n", F.size("w").alias("k"), F.explode("w").alias("part"))
    each = words.join(_holding(words.select("part"), as_whole(titles, "t")), "part")
    by_word = each.groupBy("n", "whole").agg(F.count(F.lit(1)).alias("held"), F.max("k").alias("k")).where("held = k").select(F.col("whole").alias("t"))
    fits = inside.unionByName(around).unionByName(by_word).distinct()
    return references.join(fits, F.lower("title") == F.col("t"), "left_semi").groupBy("algorithm", "variant").agg(F.min("title").alias("title"))
