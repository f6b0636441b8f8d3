"""Semantic lints of source texts by algorithm family, and constant-time patterns, as one findings table.

A source is cut into tokens once; rules look at the numbers, names and shifts among them, so that spelling (case,
underscores, suffixes, spaces) doesn't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import strip_comments

#: Fixed values of the standards: polynomial and shift direction of each CRC-32 variant, Adler's modulus, SHA-256's first
#: initial word, AES rounds.
CRC_VARIANTS = {"ieee_reflected": (0xEDB88320, ">>"), "ieee_non_reflected": (0x04C11DB7, "<<"), "castagnoli": (0x82F63B78, None)}
ADLER_BASE = 65521
SHA256_FIRST = 0x6A09E667
AES_ROUNDS = {"aes128_ecb": 10, "aes192_ecb": 12, "aes256_ecb": 14}
#: Names that sources give these things.
CRC_TABLES = ("CRC32_TABLE", "CRC_TABLE", "crc_table")
BASE_NAMES = ("base", "adler_base", "adlerbase", "adler32_base")
ROUND_NAMES = ("nr", "round", "rounds", "num_rounds", "nr_rounds")
INPUT_NAMES = ("buf", "data", "input", "bytes", "msg")
BYTE_TYPES = r"\[u8\]|\*\s*(const|mut)\s*u8|Vec<\s*u8\s*>|&\s*str"
SECRET = r"(secret|private_?key|priv_?key|key|password|nonce|tag|mac)"

TOKEN = r"([A-Za-z_]\w*|\d\w*|>>=|<<=|>>|<<|[^\s\w])"


def tokens(source: Column) -> Column:
    """Names, numbers, shifts and single signs, comments left out."""
    return F.regexp_extract_all(strip_comments(source), F.lit(TOKEN), F.lit(1))


def number(token: Column) -> Column:
    """The value of an integer token, underscores and type suffix ignored; null for other tokens."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(token), "_", ""), "(?<=.)[ui](8|16|32|64|128|size)$", "")
    hexa = F.when(bare.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substr(bare, F.lit(3)), 16, 10))
    return F.coalesce(hexa, F.when(bare.rlike("^[0-9]{1,18}$"), bare)).cast("bigint")


def declared(names: tuple[str, ...]) -> Column:
    """The numbers that any of these names is bound to: name = n or name: type = n."""
    t = F.col("_tokens")

    def value(name: Column, i: Column) -> Column:
        plain = F.when(F.get(t, i + 1) == "=", number(F.get(t, i + 2)))
        typed = F.when((F.get(t, i + 1) == ":") & (F.get(t, i + 3) == "="), number(F.get(t, i + 4)))
        return F.when(F.lower(name).isin(*names), F.coalesce(plain, typed))

    return F.array_compact(F.transform(t, value))


def shifts(sign: str, amounts: tuple[int, ...]) -> Column:
    """Whether the source shifts by one of the amounts in the direction of the sign."""
    t = F.col("_tokens")
    return F.exists(F.transform(t, lambda x, i: x.isin(sign, sign + "=") & F.coalesce(number(F.get(t, i + 1)).isin(*amounts), F.lit(False))), lambda x: x)


@dataclass(frozen=True)
class Rule:
    """A finding of `name` wherever the condition holds for rows of the family; a null condition doesn't hold."""

    family: str
    name: str
    when: Column
    message: str


def _crc_rules() -> list[Rule]:
    variant, t = F.col("variant"), F.col("_tokens")
    bytes_in = F.exists("inputs", lambda p: p["type"].rlike(BYTE_TYPES))
    holds = {name: F.array_contains("_numbers", F.lit(poly).cast("bigint")) for name, (poly, _) in CRC_VARIANTS.items()}
    table = F.exists(t, lambda x: x.isin(*CRC_TABLES))
    # a table step of a reflected CRC shifts by a whole byte
    moves = {">>": shifts(">>", (1, 8)), "<<": shifts("<<", (1,))}
    wrong, against = F.lit(False), F.lit(False)
    for name, (_, sign) in CRC_VARIANTS.items():
        known = holds[name] | table if name == "ieee_reflected" else holds[name]
        wrong = wrong | ((variant == name) & ~known)
        if sign:
            other = "<<" if sign == ">>" else ">>"
            against = against | ((variant == name) & moves[other] & ~moves[sign])
    return [
        Rule("crc32", "crc32_wrong_polynomial", bytes_in & wrong, "the variant's polynomial is missing"),
        Rule("crc32", "crc32_traversal_direction_mismatch", bytes_in & against, "the shift goes against the variant"),
        Rule("crc32", "crc32_polynomial_mixed", bytes_in & holds["ieee_reflected"] & holds["ieee_non_reflected"], "both polynomials stand in one function"),
    ]


def _rules() -> list[Rule]:
    t = F.col("_tokens")
    named = lambda *names: F.exists(t, lambda x: F.lower(x).isin(*names))
    part = lambda text: F.exists(t, lambda x: F.contains(x, F.lit(text)))
    bases = declared(BASE_NAMES)
    no_base = ~F.array_contains("_numbers", F.lit(ADLER_BASE).cast("bigint")) & ~F.exists(t, lambda x: x.isin(*(n.upper() for n in BASE_NAMES)))
    # s1 bound to 0, with no seed among the tokens just before
    zero = F.transform(t, lambda x, i: x.isin("s1", "s_1") & F.get(t, i + 1).isin("=", ":") & (F.coalesce(number(F.get(t, i + 2)), number(F.get(t, i + 4))) == 0) & ~F.exists(F.slice(t, F.greatest(i - 19, F.lit(1)), F.least(i, F.lit(20))), lambda y: F.contains(F.lower(y), F.lit("seed"))))
    rounds = F.create_map(*[F.lit(x) for kv in AES_ROUNDS.items() for x in kv])[F.col("variant")]
    # what follows the parameter list
    close = F.array_position(t, ")")
    body = F.slice(t, close + 1, F.size(t))
    is_fn = F.array_contains(t, "pub") & F.array_contains(t, "fn") & (close > 0)
    unused = F.exists("inputs", lambda p: F.lower(F.ltrim(p["name"], F.lit("_"))).isin(*INPUT_NAMES) & ~F.array_contains(body, p["name"]))
    return [
        *_crc_rules(),
        Rule("adler32", "adler32_wrong_base", no_base | F.exists(bases, lambda b: b != ADLER_BASE), "the base must be 65521"),
        Rule("adler32", "adler32_s1_zero_init", F.exists(zero, lambda x: x), "s1 starts from the seed, not from 0"),
        Rule("sha256", "sha256_le_length_padding", part("to_le_bytes") & part("bit_len"), "the length is big-endian"),
        Rule("sha256", "sha256_missing_h0", ~F.array_contains("_numbers", F.lit(SHA256_FIRST).cast("bigint")), "the first initial word is missing"),
        Rule("md5", "md5_be_length_padding", part("to_be_bytes") & part("bit_len"), "the length is little-endian"),
        Rule("aes", "aes_wrong_round_count", F.exists(declared(ROUND_NAMES), lambda n: n != rounds), "the round count isn't the variant's"),
        Rule("", "unused_input", is_fn & named("fn") & unused, "a named input is never used"),
    ]


def lint_functions(functions: DataFrame) -> DataFrame:
    """(name, rule, severity, message) from functions (name, family, variant, source, inputs array<struct<name, type>>)."""
    cut = functions.withColumn("_tokens", tokens(F.coalesce("source", F.lit(""))))
    cut = cut.withColumn("_numbers", F.array_compact(F.transform("_tokens", number)))
    hits = [F.when(((F.col("family") == r.family) if r.family else F.lit(True)) & r.when, F.struct(F.lit(r.name).alias("rule"), F.lit("error").alias("severity"), F.lit(r.message).alias("message"))) for r in _rules()]
    return cut.select("name", F.explode(F.array_compact(F.array(*hits))).alias("f")).select("name", "f.*")


def constant_time(files: DataFrame) -> DataFrame:
    """(path, line, rule, snippet): branches, matches and early returns that look at secrets, in files (path, text)."""
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "snippet"))
    code = F.regexp_replace("snippet", r"//.*$", "")
    rules = {
        "branch_on_secret": code.rlike(rf"\bif\b[^{{]*\b{SECRET}\b\s*(\[[^\]]*\])?\s*(==|!=|<|>|&)"),
        "match_on_secret": code.rlike(rf"\bmatch\s+&?{SECRET}\b"),
        "early_return_in_secret_loop": code.rlike(rf"\bfor\b.*\b{SECRET}\b.*\breturn\b"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return lines.select("path", (F.col("line") + 1).alias("line"), F.explode(found).alias("rule"), F.trim("snippet").alias("snippet"))
