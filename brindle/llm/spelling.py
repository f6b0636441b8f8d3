"""Spelling variants of words: a symmetric-delete join finds words one edit apart, each word follows its commonest neighbour."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._staging import staged
from ._words import STEP, mix

#: The inverse of STEP modulo 2 ** 64.
BACK = np.uint64(pow(int(STEP), -1, 2**64))


@dataclass(frozen=True)
class Spelling:
    """Words are the runs of `letters`, A-Z lower-cased, of at least min_length code points that stand at least min_count
    times; a form stands at least `ratio` times as often as the word."""

    letters: str = r"[A-Za-zÀ-ÿ]+"
    min_length: int = 5
    min_count: int = 3
    ratio: int = 2


def _lower_ascii(word: Column) -> Column:
    # lower() has a fast path; translate() is only needed where it changes something
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def misspelt_every(n: int, doc_id: Column, word: Column) -> Column:
    """word without one code point where n divides the crc32 of `<doc_id>:<word>`, otherwise word: repeatable misspellings."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % n == 0, cut).otherwise(word)


def count_words(docs: DataFrame, how: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text", misspell: int | None = None) -> DataFrame:
    """(word, n): the words of all texts and how often they stand. misspell: see misspelt_every.

    Counts are combined before the shuffle, so a word in a third of all places is one row per task. Null texts have no
    words; a null id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(how.letters), F.lit(0))
    words = docs.select(F.col(id_col).alias("_id"), F.explode(runs).alias("_run")).select("_id", _lower_ascii(F.col("_run")).alias("_run"))
    word = F.col("_run") if misspell is None else misspelt_every(misspell, F.col("_id"), F.col("_run"))
    return words.select(word.alias("word")).where(F.length("word") >= how.min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= how.min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, first, last) rows: each word's own key with -1, -1 and the keys of its distinct single deletions with
    the first and last place whose deletion gives it.

    Deleting any letter of a run of equal letters gives the same string, and no two runs do. A key is a polynomial of
    the code points, so that all deletions of a word of n letters take n steps, and depends on the length.
    """
    with np.errstate(over="ignore"):
        size = np.array([len(w) for w in words], dtype=np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n, end = len(code), np.cumsum(size)
        start = end - size
        of = np.repeat(np.arange(len(words)), size)
        power, back = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64)))) for b in (STEP, BACK))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(code + np.uint64(1)) * power[:-1])))
        whole = (sums[end] - sums[start]) * back[start]
        opens = np.concatenate(([True], code[1:] != code[:-1])) if n else np.zeros(0, bool)
        opens[start[size > 0]] = True
        first = np.flatnonzero(opens)
        last = np.concatenate((first[1:], [n])).astype(np.int64) - 1
        w = of[first]
        left = (sums[first] - sums[start[w]]) * back[start[w]]
        right = (sums[end[w]] - sums[first + 1]) * back[start[w] + 1]
        key = mix(np.concatenate((whole ^ size.astype(np.uint64), (left + right) ^ (size[w] - 1).astype(np.uint64))))
        none = np.full(len(words), -1, np.int64)
        return np.concatenate((np.arange(len(words)), w)), key.view(np.int64), np.concatenate((none, first - start[w])), np.concatenate((none, last - start[w]))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        at = 0
        while at < len(words):  # about 200,000 letters or one word at a time
            to, letters = at, 0
            while to < len(words) and (to == at or letters + len(words[to]) <= 200_000):
                letters += len(words[to])
                to += 1
            w, key, first, last = deletion_keys(words[at:to])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][w]), pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["id", "key", "first", "last"])
            at = to


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether exactly one inserted, deleted or replaced code point makes a from b. Linear in the length.

    The common prefix is found by halving: its length is the last place up to which both agree.
    """
    x, y = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    halves = F.sequence(F.ceil(F.log2(F.length(y) + 2)).cast("int"), F.lit(0), F.lit(-1))

    def longer(at: Column, k: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((to <= F.length(y)) & (F.substring(x, F.lit(1), to) == F.substring(y, F.lit(1), to)), to).otherwise(at)

    same = F.aggregate(halves, F.lit(0), longer)
    rest = F.substring(x, same + 2, F.length(x))
    swapped = rest == F.substring(y, same + 2, F.length(y))
    grown = rest == F.substring(y, same + 1, F.length(y))
    gap = F.length(x) - F.length(y)
    return (x != y) & F.when(gap == 0, swapped).when(gap == 1, grown).otherwise(False)


def near_words(words: DataFrame) -> DataFrame:
    """(id, other, n, word) of words (id, word, n), word and n being the other's: all ordered pairs exactly one edit apart.

    Every word emits the key of itself and of its distinct single deletions; equal keys meet in a join. Of two words
    that share a deletion only those that lost the same place differ by a replacement, and an insertion or deletion is
    a whole word that equals another's deletion: the join's condition leaves these, so that it gives links, not all
    pairs of a key's group. A group is bounded by the alphabet: a string of m letters has at most (m + 1) * letters
    one-letter extensions. The exact distance is then verified on the words, so equal hashes do no harm.
    """
    keys = staged(words.select("id", "word").mapInArrow(_emit, "id long, key long, first int, last int"), "deletions")
    other = keys.select(F.col("id").alias("other"), F.col("key").alias("_key"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    replaced = "first >= 0 and _first >= 0 and first <= _last and _first <= last"
    met = keys.join(other, F.expr(f"key = _key and id <> other and (((first < 0) <> (_first < 0)) or ({replaced}))")).select("id", "other")
    own = words.select("id", F.col("word").alias("_own"))
    near = words.select(F.col("id").alias("other"), "word", "n")
    return met.join(own, "id").join(near, "other").where(one_edit_apart(F.col("_own"), F.col("word"))).select("id", "other", "n", "word")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form_id): each follows forms to the last. Pointers double, so a chain of d forms takes log2 d
    joins; forms' counts at least double along a chain, so d is at most 63."""
    up = forms.select("id", F.col("form_id").alias("root"))
    while True:
        step = up.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        longer = staged(up.join(step, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        up = longer.select("id", "root")
        if longer.where("moved").isEmpty():
            return up


def spelling_variants(counts: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """(word, n) to word, form, root, n, n_near, form_n.

    n_near: how many words are exactly one inserted, deleted or replaced code point away. form: the near word of largest
    n, ties by code-point order, if that n is at least how.ratio times the word's own; else null. root: the last word
    that forms lead to, the word itself if it has none. how.ratio is 2 or more, so forms never lead in a circle.

    words are distinct and not null; rows with a null word are left out. A word of any length takes work in proportion
    to its length. An empty table gives no rows. Other columns are ignored.
    """
    if how.ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in a circle")
    words = staged(counts.where("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = near_words(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("down"), F.col("word").alias("form"), F.col("other").alias("form_id"))).alias("best"))
    near = near.join(words.select("id", F.col("n").alias("own")), "id")
    strong = -F.col("best.down") >= how.ratio * F.col("own")
    near = staged(near.select("id", "n_near", *[F.when(strong, c).alias(a) for c, a in ((F.col("best.form"), "form"), (F.col("best.form_id"), "form_id"), (-F.col("best.down"), "form_n"))]), "near")
    roots = _roots(near.where("form_id is not null").select("id", "form_id"))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = words.join(near, "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
