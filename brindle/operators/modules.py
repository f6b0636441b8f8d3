"""Modules of a code base: files classified by what their functions look like, and merged where they call each other much."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.graph import coupling
from brindle.operators.relational import coupled_by_stem
from brindle.staging import staged

#: File names that tell a category, those that tell one by being part of a name, families that belong
#: together, names that a merged module takes before all others, and the order of categories in a report.
ALGORITHM_NAMES = (
    "adler", "adler32", "aes", "arp", "avl", "btree", "bzip", "checksum", "cipher", "compress", "crc", "crc32", "dct", "decompress", "decrypt", "deflate", "dft", "dhcp", "dns",
    "ecdsa", "ekf", "encrypt", "fft", "filter", "hash", "hmac", "huffman", "inffast", "inflate", "inftrees", "infback", "ip", "kalman", "lz77", "lzma", "miniz", "mutex", "pid",
    "queue", "rbtree", "rsa", "scheduler", "search", "semaphore", "sha", "sort", "tcp", "tdefl", "tinfl", "trees", "udp",
)
GLUE_NAMES = (
    "buf", "buffer", "compat", "debug", "err", "error", "file", "gzclose", "gzlib", "gzread", "gzwrite", "helper", "helpers", "io", "log", "logging", "main", "os", "platform", "port",
    "read", "stream", "sys", "trace", "util", "utils", "write",
)
API_NAMES = ("api", "export", "interface", "public")
KNOWN_GROUPS = (("infback", "inffast", "inflate", "inftrees"),)
PREFERRED = ("crypto", "deflate", "inflate", "scheduler", "tcp", "tls")
CATEGORIES = ("algorithm", "data_structure", "api", "glue", "platform")
#: What a telling file name weighs, against lines times confidence.
NAME_WEIGHT = 100.0


def stem(path: Column) -> Column:
    """The file's name without its folders and its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def name_category(name: Column) -> Column:
    """The category that a lower-case stem tells: whole names first, then parts of algorithms' names; null for others."""
    whole = F.when(name.isin(*ALGORITHM_NAMES), "algorithm").when(name.isin(*GLUE_NAMES), "glue").when(name.isin(*API_NAMES), "api")
    return whole.when(name.rlike("|".join(ALGORITHM_NAMES)), "algorithm")


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """(a, b, n): pairs in order of falling n, then a, then b, each taken only if neither of its ends is taken already.

    Without an order of all pairs: a pair that is the first of all that share an end with it is taken whatever happens
    elsewhere, and takes those others away. Each round does that for all such pairs at once, as two grouped minima and
    joins, so the rounds are as many as such choices hang on one another (one by one only along a path of falling
    weights), and no list reaches the driver. Ends are of one orderable type; pairs with a null end drop out, and of
    repeated pairs the heaviest counts.
    """
    rest = pairs.where("a is not null and b is not null and a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("n").alias("n"))
    rest = staged(rest, "pairs")
    taken = rest.limit(0)
    while not rest.isEmpty():
        rank = F.struct((-F.col("n")).alias("down"), F.col("a"), F.col("b"))
        ends = rest.select(F.explode(F.array("a", "b")).alias("end"), rank.alias("rank")).groupBy("end").agg(F.min("rank").alias("best"))
        mine = lambda e: ends.select(F.col("end").alias(e), F.col("best").alias(f"_{e}"))
        new = staged(rest.join(mine("a"), "a").join(mine("b"), "b").where((F.col("_a") == rank) & (F.col("_b") == rank)).select("a", "b", "n"), "taken")
        gone = new.select(F.explode(F.array("a", "b")).alias("end"))
        rest = staged(rest.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b", "n"), "pairs")
        taken = taken.unionByName(new)
    return taken


def file_modules(functions: DataFrame) -> DataFrame:
    """(path, name, category, confidence, total_lines, functions) for functions (path, name, line_count, category, confidence, at).

    A file's category is the one of greatest weight: lines times confidence over its functions, and NAME_WEIGHT for the
    one that its name tells. Ties go to the category that comes first in the file, the name's last; confidence is the
    weight over one more than the file's lines, at most 1. A name that repeats in a file votes once, with its first row,
    but all rows' lines count. Nulls weigh nothing; a file whose functions have no category is glue.
    """
    first = functions.groupBy("path", "name").agg(F.min_by(F.struct("line_count", "category", "confidence"), "at").alias("f"), F.min("at").alias("at"))
    votes = first.select("path", F.col("f.category").alias("category"), F.coalesce(F.col("f.line_count") * F.col("f.confidence"), F.lit(0.0)).alias("w"), "at").where("category is not null")
    told = functions.select("path").distinct().select("path", name_category(F.lower(stem(F.col("path")))).alias("category"), F.lit(NAME_WEIGHT).alias("w"), F.lit(2**31 - 1).alias("at")).where("category is not null")
    sums = votes.unionByName(told).groupBy("path", "category").agg(F.sum("w").alias("w"), F.min("at").alias("at"))
    top = sums.groupBy("path").agg(F.max_by(F.struct("category", "w"), F.struct("w", (-F.col("at")).alias("early"), "category")).alias("t"))
    whole = functions.groupBy("path").agg(F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"), F.array_sort(F.collect_list(F.struct("at", "name"))).alias("f"))
    sure = F.least(F.col("t.w") / (F.col("total_lines") + 1), F.lit(1.0))
    return whole.join(top, "path", "left").select(
        "path", F.lower(stem(F.col("path"))).alias("name"), F.coalesce("t.category", F.lit("glue")).alias("category"), F.coalesce(sure, F.lit(0.0)).alias("confidence"),
        "total_lines", F.col("f.name").alias("functions"),
    )


def detect_modules(functions: DataFrame, calls: DataFrame, headers: DataFrame | None = None, least: int = 5, groups: Sequence[Sequence[str]] = KNOWN_GROUPS) -> DataFrame:
    """(name, category, confidence, total_lines, files, functions, members, description), a row per module.

    functions: see file_modules; those of headers are left out. calls: (src, dst), names of functions; a name that
    several files define belongs to the last path. headers: (path), files that are joined to the source of the same
    stem, <stem>_internal or <stem>s.

    Files named in one of the known groups merge, two at least; then pairs of other files with `least` or more calls
    between them, by greedy_matching. A merged module is named and classified as its member of a preferred name, else
    as the one of most lines (ties: the first path); members are in order of path, the chosen one's name first in the
    description. Every step is a join or a grouped aggregate over files.
    """
    own = functions.where("path is not null and name is not null and not endswith(path, '.h')")
    files = staged(file_modules(own), "files")
    # two files can have the same stem, so a group's members are told apart by path
    known = F.coalesce(*[F.when(F.col("name").isin(*g), F.lit(f"group:{i}")) for i, g in enumerate(groups)], F.lit(None).cast("string"))
    grouped = files.select("path", known.alias("key")).where("key is not null")
    many = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    grouped = grouped.join(many, "key").select("path", "key")
    owner = own.groupBy(F.col("name").alias("node")).agg(F.max("path").alias("owner"))
    pairs = coupling(calls.where("src is not null and dst is not null"), owner, least)
    for end in ("a", "b"):
        pairs = pairs.join(grouped.select(F.col("path").alias(end)), end, "left_anti")
    matched = greedy_matching(pairs.select("a", "b", "n"))
    twos = matched.select(F.explode(F.array("a", "b")).alias("path"), F.concat(F.lit("pair:"), "a").alias("key"))
    keyed = files.join(grouped.unionByName(twos), "path", "left").withColumn("key", F.coalesce("key", F.concat(F.lit("file:"), "path")))
    if headers is not None:
        beside = coupled_by_stem(files.select("path", stem(F.col("path")).alias("stem")), headers.select("path", stem(F.col("path")).alias("stem")))
        keyed = keyed.join(beside.select("path", F.coalesce("headers", F.array().cast("array<string>")).alias("headers")), "path")
    else:
        keyed = keyed.withColumn("headers", F.array().cast("array<string>"))
    first = F.struct(F.col("name").isin(*PREFERRED), F.col("total_lines"))
    best = F.array_sort(F.collect_list(F.struct(F.col("path"), F.col("name"), first.alias("rank"), "category", "confidence", "total_lines", "functions", "headers")))
    merged = keyed.groupBy("key").agg(best.alias("m"))
    # members are in order of path: the first of the greatest rank leads
    top = F.array_max(F.transform("m", lambda x: x["rank"]))
    merged = merged.withColumn("lead", F.filter("m", lambda x: x["rank"] == top)[0])
    others = F.filter(F.transform("m", lambda x: F.struct(x["path"], x["name"])), lambda x: x["path"] != F.col("lead.path"))
    many = F.size("m") > 1
    text = F.when(many, F.concat(F.lit("Merged module: "), F.col("lead.name"), F.lit(" + "), F.array_join(F.array_sort(F.transform(others, lambda x: x["name"])), ", ")))
    return merged.select(
        F.col("lead.name").alias("name"), F.col("lead.category").alias("category"), F.col("lead.confidence").alias("confidence"),
        F.aggregate("m", F.lit(0).cast("bigint"), lambda acc, x: acc + x["total_lines"]).alias("total_lines"),
        F.flatten(F.transform("m", lambda x: F.concat(F.array(x["path"]), x["headers"]))).alias("files"), F.flatten(F.transform("m", lambda x: x["functions"])).alias("functions"),
        F.transform("m", lambda x: x["path"]).alias("members"), text.otherwise(F.concat(F.lit("File-level module from "), F.element_at(F.split("lead.path", "/"), -1))).alias("description"),
    )


def by_importance(modules: DataFrame) -> DataFrame:
    """Algorithms first, other categories last, then by falling lines and name: the order of a report."""
    rank = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(CATEGORIES)], F.lit(len(CATEGORIES)))
    return modules.orderBy(rank, F.desc("total_lines"), "name")
