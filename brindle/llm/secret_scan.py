"""Secret scans: patterns, and windows of high Shannon entropy in candidate strings. Built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrays import running

#: The kinds of base span in the order of ties: name, pattern, and what a match must pass.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What the two others match where they pass: a failing match can't hide a passing one, as it ends where its run does.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Strings long enough for a window; what they may be of.
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Parts of well-known examples and fillers, and whole strings that are no secrets.
ALLOWED_PARTS = ("example", "placeholder", "changeme", "yourtoken", "your_", "your-", "dummy", "sample", "xxxx", "0123456789", "abcdefgh")
#: The words of two letters that count as words with only their first letter large.
SHORT_WORDS = "An|As|At|Be|By|Do|Go|Id|If|In|Is|It|My|No|Of|On|Or|So|To|Up|Us|We"
#: Each says that a string is no secret unless it finds what such strings don't hold. None repeats a group: the stack that
#: a search takes would grow with the string.
ALLOWED_UNLESS = (
    # a word, or some: no letter alone in its case, but A, I and the short words
    rf"[^A-Za-z]|(?<![A-Za-z])[a-z](?![a-z])|(?!{SHORT_WORDS})[A-Z][a-z](?![a-z])|(?<![A-Z])[B-HJ-Z][A-Z][a-z](?![a-z])|(?<![A-Z])[B-HJ-Z](?![A-Za-z])",
    r"[^0-9]",  # a number
    r"[^A-Za-z_/-]|^[_/-]|[_/-][_/-]|[_/-]$|^[A-Za-z]+$",  # a path or an identifier of words
    r"[^=_+/-]",  # a rule
)
ALLOWED_WHOLE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"  # a UUID
#: What a candidate's characters are; so many counts of five bits are in a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PER_LONG = 12
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class Entropy:
    """A window of `window` characters of a candidate is a secret's if its Shannon entropy in bits a character reaches
    the limit of the candidate's character class: hex digits; lower-case letters and digits; letters of both cases and
    digits; any with + / _ = -. Of a candidate that holds an allowed part, what lies between such parts is judged."""

    window: int = 20
    hex_limit: float = 3.0
    lower_limit: float = 3.5
    mixed_limit: float = 3.7
    other_limit: float = 3.8


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>>: leftmost non-overlapping matches, in code points, end exclusive.

    What lies between the matches is what split() gives, so lengths add up to places.
    """
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    spans = "array<struct<start:int,end:int,hit:string>>"

    def add_up(parts: Column) -> Column:
        ends = running(F.transform(parts["h"], lambda h, i: F.length(h) + F.get(parts["g"], i)), lambda a, b: a + b)
        return F.transform(F.arrays_zip(parts["h"].alias("h"), ends.alias("e")), lambda x: F.struct((x["e"] - F.length(x["h"])).alias("start"), x["e"].alias("end"), x["h"].alias("hit")))

    # an array of one element binds hits and gaps to a name, or each step would search the text again
    found = F.transform(F.array(F.struct(hits.alias("h"), gaps.alias("g"))), add_up)[0]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(spans))


def _kind(spans: Column, name: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("rank"), s["end"].alias("end")))


def _limit(hit: Column, how: Entropy) -> Column:
    """The limit of a candidate's character class."""
    return (
        F.when(hit.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), how.hex_limit)
        .when(hit.rlike(r"^[a-z0-9]+$"), how.lower_limit)
        .when(hit.rlike(r"^[A-Za-z0-9]+$"), how.mixed_limit)
        .otherwise(how.other_limit)
    )


def _peaks(hit: Column, how: Entropy) -> Column:
    """struct<best, first, last>: the highest entropy of any window, and the first and last windows that reach the limit.

    The counts of a window's characters, and the sum of n log2 n over them, move with the character that enters and the
    one that leaves; entropy is log2(window) less that sum over the window. So a candidate costs time in proportion to its length.
    """
    w = how.window
    if not 1 < w < 32:
        raise ValueError("a count has five bits: windows are of 2 to 31 characters")
    n_log_n = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(w + 2)])
    limit = _limit(hit, how)
    # each character's place in the alphabet; its count is five bits of one of the longs
    signs = F.transform(F.slice(F.split(hit, ""), 1, F.length(hit)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    bits = lambda sign: (sign % PER_LONG) * 5
    held = lambda counts, sign: F.call_function("shiftright", F.get(counts, F.floor(sign / PER_LONG).cast("int")), bits(sign)).bitwiseAND(F.lit(31)).cast("int")
    one = lambda sign, k: F.when(F.floor(sign / PER_LONG) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), bits(sign))).otherwise(F.lit(0).cast("bigint"))
    entropy = lambda s: F.lit(math.log2(w)) - s / w
    kind = "struct<counts:array<bigint>,sum:double,best:double,first:int,last:int>"
    none = F.array(*[F.lit(0).cast("bigint")] * -(-len(ALPHABET) // PER_LONG))
    begin = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")).cast(kind)

    def step(own: Column, acc: Column, i: Column) -> Column:
        """Character i (from 0) enters, character i - w leaves."""
        enters, leaves = F.get(own["signs"], i), F.when(i >= w, F.get(own["signs"], i - w))
        more = held(acc["counts"], enters)
        up = acc["sum"] + F.get(n_log_n, more + 1) - F.get(n_log_n, more)
        counts = F.transform(acc["counts"], lambda x, k: x + one(enters, k) - F.when(leaves.isNull(), F.lit(0).cast("bigint")).otherwise(one(leaves, k)))
        # what leaves stood there n times before, the new one counted if it's the same
        n = held(acc["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        total = F.when(leaves.isNull(), up).otherwise(up - F.get(n_log_n, n) + F.get(n_log_n, n - 1))
        full = i >= w - 1
        over = full & (entropy(total) >= own["limit"])
        at = i - (w - 2)  # the window's first character, from 1
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(full, F.greatest(acc["best"], entropy(total))).otherwise(acc["best"]).alias("best"),
            F.coalesce(acc["first"], F.when(over, at)).alias("first"), F.when(over, at).otherwise(acc["last"]).alias("last"),
        ).cast(kind)

    def fold(own: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(own["signs"]) - 1)
        return F.aggregate(places, begin, lambda acc, i: step(own, acc, i), lambda acc: F.struct(acc["best"].alias("best"), acc["first"].alias("first"), acc["last"].alias("last")))

    # bound to a name outside the fold: what a fold carries is copied at every step
    return F.transform(F.array(F.struct(signs.alias("signs"), limit.alias("limit"))), fold)[0]


def _entropy_spans(text: Column, how: Entropy) -> Column:
    """Of each candidate, or piece of one, that is not allowed, the stretch from its first to its last window at or over the limit."""
    found = _places(text, CANDIDATE % how.window)
    spans = "array<struct<start:int,end:int,hit:string>>"

    def blanked(hit: Column) -> Column:
        for part in ALLOWED_PARTS:
            hit = F.regexp_replace(hit, f"(?i){part}", " " * len(part))
        return hit

    def pieces(s: Column) -> Column:
        """A candidate; of one with allowed parts what lies between them."""
        between = F.transform(_places(blanked(s["hit"]), CANDIDATE % how.window), lambda p: F.struct((s["start"] + p["start"]).alias("start"), (s["start"] + p["end"]).alias("end"), p["hit"].alias("hit")))
        return F.when(~F.lower(s["hit"]).rlike("|".join(ALLOWED_PARTS)), F.array(s)).otherwise(between.cast(spans))

    secret = lambda hit: reduce(lambda x, y: x & y, [hit.rlike(unless) for unless in ALLOWED_UNLESS]) & ~hit.rlike(ALLOWED_WHOLE)
    # entropy is at most log2 of the number of different characters: with too few of them no window reaches the limit
    mixed = lambda hit: F.log2(F.size(F.array_distinct(F.split(hit, "")))) >= _limit(hit, how)
    open_ = F.filter(F.flatten(F.transform(found, pieces)), lambda s: secret(s["hit"]) & mixed(s["hit"]))
    rated = F.transform(open_, lambda s: F.struct(s["start"].alias("start"), _peaks(s["hit"], how).alias("p")))
    rated = F.filter(rated, lambda s: s["p"]["first"].isNotNull())
    return F.transform(rated, lambda s: F.struct((s["start"] + s["p"]["first"] - 1).alias("start"), (s["start"] + s["p"]["last"] + (how.window - 1)).alias("end"), F.lit("").alias("hit")))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, how: Entropy = Entropy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base_spans, spans for each row of docs: array<struct<start, rank, end>>, rank being a place in KINDS.

    Base spans are the three patterns' matches; the entropy windows add spans where they don't lie in a base span. Allow lists
    suppress words, numbers, paths, UUIDs and well-known fillers among the candidates; base spans stay. Rows stand
    alone: no shuffle. A text without base matches or candidates costs one search for each pattern.

    Null and empty texts have no spans. Repeated rows and extra columns make no difference. An empty table gives no rows.
    A very long text takes work in proportion to its length, times the root of its number of matches in copies of
    places; no search takes a stack that grows with it. Where spans start at the same place, the kind listed first comes first.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda s: F.regexp_extract(s["hit"], f"^{ASSIGN}$", 2)
    one = docs.select(F.col(id_col), text.alias("_text"))
    one = one.select(
        id_col,
        F.filter(_places(F.col("_text"), ASSIGN.replace("(password", "(?:password").replace('([A-Za-z0-9+/_.=-]+)', "[A-Za-z0-9+/_.=-]+")), lambda s: F.length(value(s)) >= LEAST_VALUE).alias("_assign"),
        _places(F.col("_text"), ACCESS_LONG).alias("_access"),
        _places(F.col("_text"), HEX_LONG).alias("_hex"),
        _entropy_spans(F.col("_text"), how).alias("_entropy"),
    )
    base = F.array_sort(F.concat(_kind(F.col("_assign"), "assign"), _kind(F.col("_access"), "access"), _kind(F.col("_hex"), "hex")))
    one = one.select(id_col, base.alias("base_spans"), _kind(F.col("_entropy"), "entropy").alias("_more"))
    # in order of start, base spans first: one that lies in a base span ends no later than any base span before it does
    flat = "array<struct<start:int,rank:int,end:int>>"
    one = one.select(id_col, "base_spans", F.array_sort(F.concat("base_spans", "_more")).cast(flat).alias("_all"))
    reach = running(F.transform("_all", lambda s: F.when(s["rank"] == KINDS.index("entropy"), -1).otherwise(s["end"])), F.greatest)
    one = one.select(id_col, "base_spans", "_all", reach.alias("_reach"))
    spans = F.filter("_all", lambda s, i: (s["rank"] != KINDS.index("entropy")) | (F.get("_reach", i) < s["end"]))
    return one.select(id_col, "base_spans", spans.alias("spans"))


def span_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from scan_secrets' rows."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(_text_of(F.col("base_spans")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))
