"""Test vectors of validation programs: text records of several lines under section headers, read at any split size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.staging import staged

#: Categories whose algorithms get vectors.
CRYPTO = ("checksum", "cipher", "hash", "kdf", "mac", "signature")
_COMMENT = r"^\s*#"
_HEADER, _PAIR = r"^\s*\[(.*)\]\s*$", r"^\s*([^=#\[\]\s][^=]*?)\s*=\s*(.*?)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, i, value): lines in order of file, split and i. A file is read in splits of spark.sql.files.maxPartitionBytes;
    within a split, lines come in order, so that their running number is one too."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), "value")


def cavp_records(lines: DataFrame) -> DataFrame:
    """(file, section, record, fields) of lines (file, split, i, value): fields is a map of a record's `name = value` lines.

    A blank line or a header ends a record, and so does the name that the block between such lines began with, when it
    comes again; of another name that comes twice the last value counts. `# ...` lines are comments. section is what
    stands in the last [header] before the record, null before the first; records count from 0 in each file.

    Headers and counts carry over from split to split, not through one task: each split is folded by itself, a table
    with a row per split carries what it hands on, and both meet in a join. A file of any length takes as many
    tasks as it has splits, and the rows are the same at any split size.
    """
    pair = F.col("value").rlike(_PAIR) & ~F.col("value").rlike(_COMMENT)
    kinds = lines.select(
        "file", "split", "i", F.when(F.col("value").rlike(_HEADER), F.regexp_extract("value", _HEADER, 1)).alias("header"), F.when(pair, F.regexp_extract("value", _PAIR, 1)).alias("name"),
        F.regexp_extract("value", _PAIR, 2).alias("given"), F.trim("value").alias("bare"),
    ).where("bare = '' or header is not null or name is not null")
    upto = Window.partitionBy("file", "split").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split

    def counted(df: DataFrame, mark: str, out: str) -> DataFrame:
        """df with the running sum of a 0/1 column over each file."""
        own = df.withColumn("_own", F.sum(mark).over(upto))
        sums = own.groupBy("file", "split").agg(F.sum(mark).alias("_n"))
        carried = sums.select("file", "split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        return own.join(carried, ["file", "split"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before")

    headed = kinds.withColumn("own", F.last("header", True).over(upto))
    handed = headed.groupBy("file", "split").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("i"))).alias("_last"))
    carried = handed.select("file", "split", F.last("_last", True).over(earlier).alias("_from"))
    headed = headed.join(carried, ["file", "split"]).withColumn("section", F.coalesce("own", "_from")).drop("own", "_from")
    blocks = counted(headed.withColumn("ends", F.when(F.col("name").isNull(), 1).otherwise(0)), "ends", "block").where("name is not null")
    blocks = staged(blocks.select("file", "split", "i", "section", "block", "name", "given"), "blocks")
    first = blocks.groupBy("file", "block").agg(F.min_by("name", F.struct("split", "i")).alias("opener"))
    opened = blocks.join(first, ["file", "block"]).withColumn("opens", (F.col("name") == F.col("opener")).cast("int"))
    rows = counted(opened, "opens", "record")
    fields = rows.groupBy("file", "record", "name").agg(F.max_by("given", F.struct("split", "i")).alias("given"), F.min(F.struct("split", "i")).alias("at"), F.first("section").alias("section"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "given"))), lambda x: F.struct(x["name"], x["given"]))
    return fields.groupBy("file", "record").agg(F.first("section").alias("section"), F.map_from_entries(entries).alias("fields")).select("file", "section", (F.col("record") - 1).cast("bigint").alias("record"), "fields")


def augment_vectors(algorithms: DataFrame, catalog: DataFrame) -> DataFrame:
    """algorithms (category, canonical, test_vectors array<struct<description, expected_output, ...>>, ...) with what catalog
    (canonical, vector of the same struct) has for those of a cryptographic category, behind their own and without
    those of a description and output that they have; n_added counts them."""
    kind = algorithms.schema["test_vectors"].dataType
    listed = catalog.groupBy("canonical").agg(F.array_sort(F.collect_list("vector")).alias("_new"))
    own = F.coalesce("test_vectors", F.array().cast(kind))
    key = lambda v: F.struct(v["description"], v["expected_output"])
    fresh = F.filter("_new", lambda v: ~F.array_contains(F.transform(own, key), key(v)))
    added = F.when(F.col("category").isin(*CRYPTO), F.coalesce(fresh, F.array().cast(kind))).otherwise(F.array().cast(kind))
    joined = algorithms.join(listed, "canonical", "left")
    return joined.withColumn("n_added", F.size(added)).withColumn("test_vectors", F.concat(own, added)).select(*algorithms.columns, "n_added")
