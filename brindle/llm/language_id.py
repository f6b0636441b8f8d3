"""Language ID by Bayesian fusion of text, declared language, address suffix and hierarchically smoothed host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._staging import bound_batches, staged
from ._words import rows

#: The code of ISO 639-2 for a language that isn't determined.
OTHER = "und"
#: A text's log likelihood further below its best than all other evidence can lift counts as this far below.
DEEP = 40.0
#: Country suffixes and the language that most pages under them are in.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}


@dataclass(frozen=True)
class Fusion:
    """max_docs bounds the labelled sample the text model is fitted on, in equal shares of the languages. languages: how
    many codes, the most declared ones, are answers of their own; all rarer ones are one more class. evidence: a text counts as at most so many
    independent trigrams, as those of one text depend on each other. declared, suffix: the chance that a declaration, a suffix, names the language.
    local, site: weights, in documents, of the prior above a host and above a site."""

    max_docs: int = 4000
    languages: int = 200
    buckets: int = 1 << 15
    evidence: float = 60.0
    declared: float = 0.9
    suffix: float = 0.6
    local: float = 20.0
    site: float = 100.0
    seed: int = 11


def _trigrams(text: str, buckets: int) -> np.ndarray:
    """Bucket of every run of three bytes of the text, ASCII lower-cased, other bytes than letters as blanks."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    raw = np.where(((raw >= 97) & (raw <= 122)) | (raw >= 128), raw, 32).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)


def _counts(buckets: int, place: dict[str, int]):
    """(class, bucket, n): trigrams of the rows by class of their declaration; a code without a place is of the last class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in rows(batches, "declared", "text"):
            for code, text in part:
                if text:
                    kind = place.get(code, len(place))
                    total.setdefault(kind, np.zeros(buckets, np.int64))
                    total[kind] += np.bincount(_trigrams(text, buckets), minlength=buckets)
        for kind, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(n[at])], ["class", "bucket", "n"])

    return run


def fit(texts: DataFrame, how: Fusion) -> tuple[list[str], np.ndarray]:
    """The classes, and for each log P of every trigram bucket, with add-half smoothing: the how.languages codes that most
    rows declare, in order, and OTHER if there are more. No more than that many classes reach the driver or a plan."""
    stated = texts.where("declared is not null")
    counts = staged(stated.groupBy("declared").agg(F.count("text").alias("n")), "codes")
    most = {r.declared: r.n for r in counts.orderBy(F.desc("n"), "declared").limit(how.languages).collect()}
    codes, texts_in = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    classes = sorted(most) + [OTHER] * (codes > len(most))
    known = stated.where("text is not null")
    if (texts_in or 0) > how.max_docs:
        # an equal share for each class, so that a rare one has all its rows
        share = max(1, how.max_docs // len(classes))
        limit = lambda n: 1_000_003 if n <= share else max(1, int(1_000_003 * share / n))
        limits = F.create_map(*[F.lit(x) for k, n in most.items() for x in (k, limit(n))])
        mark = F.pmod(F.xxhash64(F.lit(how.seed), "id"), F.lit(1_000_003))
        known = known.where(mark < F.coalesce(F.try_element_at(limits, F.col("declared")), F.lit(limit(texts_in - sum(most.values())))))
    place = {x: i for i, x in enumerate(sorted(most))}
    got = known.select("declared", "text").mapInArrow(_counts(how.buckets, place), "class int, bucket long, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(classes), how.buckets), 0.5)
    table[got.column("class").to_numpy(), got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    return classes, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if classes else table.astype(np.float32)


def _soft(logs: np.ndarray) -> np.ndarray:
    """Probabilities that are in proportion to exp of logs, by row."""
    raw = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return raw / raw.sum(axis=-1, keepdims=True)


SCORED = "id {id}, declared string, host string, site string, at array<int>, logs array<float>, soft array<double>"


def _likelihoods(shared, how: Fusion):
    """Of each text the classes less than DEEP below its likeliest, with their log likelihoods and what the text alone makes of
    them; none for a text without trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = shared.value
        for batch in batches:
            at, logs, soft = [], [], []
            for part in rows(iter([batch]), "text"):
                for (text,) in part:
                    grams = _trigrams(text, how.buckets) if text else ()
                    if len(grams):
                        mean = table @ (np.bincount(grams, minlength=how.buckets) / len(grams)) if len(grams) > 4000 else table[:, grams].mean(axis=1)
                        own = (mean * min(len(grams), how.evidence)).astype(np.float32)
                        good = np.flatnonzero(own > own.max() - DEEP)
                        at.append(good.astype(np.int32))
                        logs.append(own[good])
                        soft.append(_soft(own[good].astype(np.float64)))
                    else:
                        at.append([])
                        logs.append([])
                        soft.append([])
            keep = ["id", "declared", "host", "site"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(at, pa.list_(pa.int32())), pa.array(logs, pa.list_(pa.float32())), pa.array(soft, pa.list_(pa.float64()))], [*keep, "at", "logs", "soft"])

    return run


def _dense(at: pa.Array, values: pa.Array, k: int, rest: float = 0.0) -> np.ndarray:
    """Lists of places and of their values as rows of k values."""
    sizes = np.diff(at.offsets.to_numpy())
    out = np.full((len(at), k), rest)
    out[np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy()] = values.flatten().to_numpy()
    return out


def _fuse(shared, root: np.ndarray, how: Fusion):
    """(id, language, probability, declared, host) from a row's likelihoods and the sums of its host and site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value[0]
        k, place = len(classes), {x: i for i, x in enumerate(classes) if x != OTHER}
        share = lambda sure: (np.log(sure), np.log((1 - sure) / max(1, k - 1)))
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                col = lambda name, b=batch: b.column(b.schema.get_field_index(name))
                number = lambda name: col(name).to_numpy(zero_copy_only=False)[:, None].astype(np.float64)
                site = (_dense(col("site_at"), col("site_sums"), k) + number("site_blank") / k + how.site * root) / (number("site_n") + how.site)
                prior = (_dense(col("host_at"), col("host_sums"), k) + number("host_blank") / k + how.local * site) / (number("host_n") + how.local)
                found = np.array([len(x) for x in col("at").to_pylist()]) > 0
                lowest = np.where(found, np.array([max(x, default=0.0) for x in col("logs").to_pylist()]) - DEEP, 0.0)
                logs = _dense(col("at"), col("logs"), k, np.nan)
                logs = np.where(np.isnan(logs), lowest[:, None], logs) + np.log(prior)
                declared, host = col("declared").to_pylist(), col("host").to_pylist()
                stated = [place.get(x, k - 1) if x else None for x in declared]
                ends = [place.get(SUFFIXES.get(x[-2:].lower(), "")) if x and len(x) > 2 and x[-3] == "." else None for x in host]
                for values, sure in ((stated, how.declared), (ends, how.suffix)):
                    yes, no = share(sure)
                    given = np.flatnonzero([x is not None for x in values])
                    logs[given] += no
                    logs[given, np.array([values[i] for i in given], np.int64)] += yes - no
                chances = _soft(logs)
                best = chances.argmax(axis=1)
                names = [classes[b] if classes[b] != OTHER or x is None or x in place else x for b, x in zip(best, declared, strict=True)]
                yield pa.RecordBatch.from_arrays([col("id"), pa.array(names, pa.string()), pa.array(chances[np.arange(len(best)), best]), col("declared"), col("host")], ["id", "language", "probability", "declared", "host"])

    return run


def identify_languages(rows_: DataFrame, how: Fusion = Fusion()) -> DataFrame:
    """id, language, probability, declared, host for rows (id, text, declared, host, site).

    declared is the language that markup or a column states (case and region are ignored), host where the text comes
    from and site what hosts are grouped under; each may be null. For every row, log posterior = host prior + text +
    declaration + suffix of the host, over the how.languages codes that most rows declare, and one class of all rarer
    ones with a text model, a prior and a posterior of its own. Where that class is likeliest, the language is the
    row's declaration if that is one of the rarer codes, else OTHER. So any number of codes, such as wrong markup
    makes, costs no more than a fixed number.

    The host prior is smoothed towards its site's, that towards the whole table's: (sum of the documents' text-only
    posteriors + weight * prior above) / (documents + weight), from grouped sums of all rows. These tables have a row
    per host and language and per site and language; a host with a third of all rows is one row per language for each task before the shuffle.

    Null, empty and very short texts rest on the other evidence; a very long one is worked on whole. Without any labelled
    row the language is null. Of equal chances the first code in order wins. Repeated rows count and are judged each.
    Extra columns are ignored. An empty table gives no rows.
    """
    bound_batches(rows_.sparkSession)
    spark = rows_.sparkSession
    code = lambda c: F.nullif(F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})", 1), F.lit("")), F.lit(OTHER))
    texts = rows_.select("id", F.col("text").cast("string").alias("text"), code(F.col("declared").cast("string")).alias("declared"), F.col("host").cast("string").alias("host"), F.col("site").cast("string").alias("site"))
    classes, table = fit(texts, how)
    if not classes:
        return texts.select("id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), "declared", "host")
    k = len(classes)
    shared = spark.sparkContext.broadcast((classes, table))
    kind = texts.schema["id"].dataType.simpleString()
    scored = staged(texts.mapInArrow(_likelihoods(shared, how), SCORED.format(id=kind)), "likelihoods")

    blank = F.sum(F.when(F.size("at") == 0, 1).otherwise(0)).alias("host_blank")
    hosts = staged(scored.groupBy("site", "host").agg(F.count(F.lit(1)).alias("host_n"), blank), "hosts")
    each = scored.select("site", "host", F.explode(F.arrays_zip("at", "soft")).alias("x"))
    sums = staged(each.groupBy("site", "host", F.col("x.at").alias("at")).agg(F.sum("x.soft").alias("s")), "sums")
    total, empty = hosts.agg(F.sum("host_n"), F.sum("host_blank")).first()
    root = np.full(k, 1.0 + (empty or 0) / k)
    for r in sums.groupBy("at").agg(F.sum("s").alias("s")).collect():  # a row per class
        root[r["at"]] += r.s
    root /= (total or 0) + k
    # lists of at most k values
    listed = lambda df, by, name: df.groupBy(*by).agg(F.collect_list(F.struct("at", "s")).alias("x")).select(*by, F.col("x.at").alias(f"{name}_at"), F.col("x.s").alias(f"{name}_sums"))
    same = lambda a, b, by: [a[c].eqNullSafe(b[c]) for c in by]

    def with_lists(counted: DataFrame, df: DataFrame, by: list[str], name: str) -> DataFrame:
        lists = listed(df, by, name)
        none = lambda c, t: F.coalesce(lists[c], F.array().cast(f"array<{t}>")).alias(c)
        return counted.join(lists, same(counted, lists, by), "left").select(*[counted[c] for c in counted.columns], none(f"{name}_at", "int"), none(f"{name}_sums", "double"))

    by_host = with_lists(hosts, sums, ["site", "host"], "host")
    by_site = with_lists(
        hosts.groupBy("site").agg(F.sum("host_n").alias("site_n"), F.sum("host_blank").alias("site_blank")), sums.groupBy("site", "at").agg(F.sum("s").alias("s")), ["site"], "site"
    )
    priors = by_host.join(by_site, by_host["site"].eqNullSafe(by_site["site"])).drop(by_site["site"])
    priors = staged(priors.withColumnsRenamed({"site": "_site", "host": "_host"}), "priors")
    joined = scored.join(priors, F.col("host").eqNullSafe(F.col("_host")) & F.col("site").eqNullSafe(F.col("_site"))).drop("_host", "_site", "soft", "site")
    return joined.mapInArrow(_fuse(shared, root, how), f"id {kind}, language string, probability double, declared string, host string")


def from_pages(pages: DataFrame) -> DataFrame:
    """Rows for identify_languages from pages (page_id, url, html): visible text, the html element's lang, host, site."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    host = F.nullif(host, F.lit(""))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), F.regexp_extract("html", r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1).alias("declared"), host.alias("host"), F.substring_index(host, ".", -2).alias("site"))
