"""One registered query for each operator, over its whole table, and the SQL for the same rows where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._staging import staged, table
from .decontaminate import find_leaks
from .fingerprint import SimHash, edited_fingerprints, fingerprints, near_fingerprints
from .language_id import from_pages, identify_languages
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .near_dedup import NearDup, near_duplicates
from .quality import judge_quality
from .secret_scan import scan_secrets, span_digest
from .source_mix import mix_sources
from .spelling import count_words, spelling_variants
from .token_align import align_documents
from .toxicity import score_toxicity
from .url_filter import Rule, judge_urls

#: The contract's rules.
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
MIX = {"weights": [5.0, 2.0, 1.0], "total_share": 1.5, "cap": 2.0}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: lang is their declaration, source their host."""
    docs = table(spark, sf_dir, "documents")
    given = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("site"))
    return identify_languages(given).select(F.col("id").alias("doc_id"), "language", F.round("probability", 6).alias("probability"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the html element's lang is the declaration; hosts are grouped under their last two labels."""
    return identify_languages(from_pages(table(spark, sf_dir, "pages"))).select(F.col("id").alias("page_id"), "language", F.round("probability", 6).alias("probability"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(width=4))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), **MIX)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whose id is divisible by 20, the documents within three bits of 64."""
    # three readers: without staging each would fingerprint every text, as no filter passes below the operator
    prints = staged(fingerprints(table(spark, sf_dir, "documents"), SimHash(bits=64)), "prints")
    return near_fingerprints(prints, prints.where("doc_id % 20 = 0"), radius=3)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")).drop("text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one in 97 misspelt."""
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), misspell=97))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "language_id_pages": language_id_pages,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_fingerprint": op6_fingerprint,
    "fingerprint_search": fingerprint_search,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling": op11_spelling,
    "op12_toxicity": op12_toxicity,
    "op13_token_align": op13_token_align,
}


def _host_path(url: str) -> tuple[str, str, str]:
    """DuckDB expressions of a URL's host, path and address."""
    rest = f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '')"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    address = f"CASE WHEN {host} <> '' THEN {host} || substr(regexp_extract({rest}, '^([^#]*)', 1), length({host}) + 1) END"
    return host, path, address


def _rule_sql(field: str) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r.text))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'" for r in ordered) + " END"


def _attribute_sql(name: str) -> str:
    return f"""regexp_extract(tag, '(?is)\\b{name}\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1)"""


def _url_sql() -> str:
    host, path, address = _host_path("url")
    _, _, to_address = _host_path("target")
    site = f"regexp_extract(url, '^(.*?)://', 1) || '://' || {host}"
    return f"""WITH RECURSIVE base AS (SELECT page_id, url, html, {host} AS host, {path} AS path, {address} AS node FROM pages),
tags AS (SELECT url, path, node, unnest(regexp_extract_all(html, '(?i)(<(?:link|meta)\\b[^>]*>)', 1)) AS tag FROM base WHERE node IS NOT NULL),
found AS (SELECT url, path, node, CASE WHEN lower({_attribute_sql("rel")}) = 'canonical' THEN {_attribute_sql("href")} WHEN lower({_attribute_sql("http-equiv")}) = 'refresh' THEN {_attribute_sql("url")} END AS t FROM tags),
whole AS (SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN {site} || t
  WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') THEN NULL ELSE {site} || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || t END AS target FROM found WHERE t IS NOT NULL),
one AS (SELECT node AS u, {to_address} AS v FROM whole WHERE target IS NOT NULL),
edges AS (SELECT DISTINCT u, v FROM one WHERE v IS NOT NULL AND u <> v UNION SELECT DISTINCT v, u FROM one WHERE v IS NOT NULL AND u <> v),
reach(a, b) AS (SELECT u, v FROM edges UNION SELECT a, v FROM reach JOIN edges ON u = b),
judged AS (SELECT a, {_rule_sql("verdict")} AS verdict FROM (SELECT a, regexp_extract(b, '^([^/?]*)', 1) AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM reach)),
groups AS (SELECT a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict FROM judged GROUP BY 1)
SELECT page_id, host, path, {_rule_sql("text")} AS rule, coalesce({_rule_sql("verdict")}, g.verdict, 'allow') AS verdict FROM base LEFT JOIN groups g ON g.a = node"""


_SPELLING_SQL = r"""WITH RECURSIVE folds(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM folds WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS entries FROM folds WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
raw AS (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed FROM lowered),
bytes AS (SELECT run, n, list_transform(range(0, strlen(keyed)), lambda i: ('0x' || substr(hex(encode(keyed)), 2 * i + 1, 2))::BIGINT) AS b FROM raw),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cuts AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({'d': -m, 'w': other}) AS top FROM near GROUP BY 1),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.d >= 2 * words.n THEN top.w END AS form, CASE WHEN -top.d >= 2 * words.n THEN -top.d END AS form_n FROM words LEFT JOIN best USING (word)),
follow(word, last) AS (SELECT word, form FROM forms WHERE form IS NOT NULL UNION ALL SELECT follow.word, form FROM follow JOIN forms ON forms.word = follow.last WHERE form IS NOT NULL),
roots AS (SELECT follow.word, follow.last AS root FROM follow JOIN forms ON forms.word = follow.last WHERE form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)"""


#: The others rest on hashes, models or searches that SQL has no equal of; their tests hold them against plain Python.
ORACLE_SQL: dict[str, str] = {"op8_url_filter": _url_sql(), "op11_spelling": _SPELLING_SQL}
