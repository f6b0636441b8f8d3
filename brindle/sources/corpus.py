"""Scans of source trees, JSON catalogues and event logs, and snapshots of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "path string, sha256 string, mtime double"


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("c", "h"), root_wins: bool = True) -> DataFrame:
    """(path, text, content, mtime, line_count) of the files under root by extension; paths are relative. Folders .git
    and names with "test" are left out. root_wins: if any file lies in root itself, only such files are kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.split("path", F.lit(base.rsplit("/", 1)[-1] + "/"), 2)[1], "^/+", "")
    found = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), "content", F.col("modificationTime").cast("double").alias("mtime"))
    found = found.where(F.col("path").rlike(rf"\.({'|'.join(extensions)})$") & ~F.col("path").rlike(r"(^|/)\.git/") & ~F.lower("path").contains("test"))
    found = found.withColumn("line_count", F.size(F.split("text", "\n", -1)))
    if root_wins and not found.where(~F.contains("path", F.lit("/"))).isEmpty():
        found = found.where(~F.contains("path", F.lit("/")))
    return found


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"), "mtime")


def save_snapshot(snap: DataFrame, path: str) -> None:
    snap.write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot at path; a missing or broken one is empty."""
    try:
        return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path).where("path is not null")
    except Exception as e:  # noqa: BLE001  AnalysisException of a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SNAPSHOT)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Test vectors of JSON files: algorithm, name, variant, input, expected, key (binary), from {algorithm, vectors: [...]}."""
    schema = "algorithm string, vectors array<struct<name:string,variant:string,input_hex:string,expected_hex:string,key_hex:string,mode:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("algorithm", F.explode("vectors").alias("v"))
    return rows.select("algorithm", "v.name", "v.variant", F.unhex("v.input_hex").alias("input"), F.lower("v.expected_hex").alias("expected"), F.unhex("v.key_hex").alias("key"), "v.mode")


def check_vectors(vectors: DataFrame) -> DataFrame:
    """(algorithm, name, ok): every vector of a digest that the library has, held against its own result; hex is compared
    without leading zeros."""
    from brindle.functions import checksums as C

    bare = lambda c: F.regexp_replace(F.lower(c), "^0+(?=.)", "")
    known = F.lit(None).cast("string")
    for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        known = F.when(F.col("algorithm") == name, C.digest(F.col("input"), name)).otherwise(known)
    known = F.when(F.col("algorithm") == "crc32", F.hex(C.crc32(F.col("input")))).when(F.col("algorithm") == "adler32", F.hex(C.adler32(F.col("input")))).otherwise(known)
    return vectors.select("algorithm", "name", bare(known).eqNullSafe(bare(F.col("expected"))).alias("ok")).where(known.isNotNull())
