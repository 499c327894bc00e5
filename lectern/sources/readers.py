"""Readers of the archive's file formats. Rows are checked in the plan; a bad one fails the query with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("mp3", "m4a", "wav", "flac", "ogg", "opus", "aac", "wma")


def _fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def pipe_text(spark: SparkSession, path: str) -> DataFrame:
    """``surah|ayah|text`` lines: later bars are text; blank and ``#`` lines go; malformed or repeated keys and files without records fail."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    part = F.split("value", r"\|", 3)
    number = lambda i: F.coalesce(F.when(F.get(part, F.lit(i)).rlike(r"^\s*[1-9]\d*\s*$"), F.trim(F.get(part, F.lit(i))).cast("int")), _fail("malformed line", "int"))
    text = F.coalesce(F.when(F.trim(F.get(part, F.lit(2))) != "", F.trim(F.get(part, F.lit(2)))), _fail("line without text", "string"))
    rows = lines.select(number(0).alias("surah"), number(1).alias("ayah"), text.alias("text"))
    counted = rows.groupBy("surah", "ayah").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    return counted.select("surah", "ayah", F.when(F.col("n") == 1, F.col("text")).otherwise(_fail("repeated key", "string")).alias("text"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one tag; attributes are columns without prefix."""
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").schema(schema).load(path)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON list."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``#`` comments; ids are unique, questions non-empty, statuses known, and found questions have labels."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    schema = "id string, question string, expected_segment_ids array<long>, expected_status string, tags array<string>, notes string"
    g = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("g")).select("g.*")
    good = (F.trim("question") != "") & F.col("expected_status").isin("answered", "partial", "not_found") & ((F.col("expected_status") == "not_found") == (F.size("expected_segment_ids") == 0))
    seen = g.groupBy("id").agg(F.count("*").alias("n"))
    return g.join(seen, "id").withColumn("id", F.when(good & (F.col("n") == 1), F.col("id")).otherwise(_fail("bad golden item", "string"))).drop("n")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line) of text files. ``line`` orders all lines: by the file's path, then by the place of the block in it, then as the block is read, whatever blocks a task gets."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select("value", "file", F.struct("file", "block", "row").alias("line"))


def checkpoint_lines(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """JSON lines of one or more files, which follow each other by path; the last of each key wins. Blank lines go. Only a file's last line may be corrupt, where its writer was stopped."""
    lines = ordered_lines(spark, path)
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim("value") != "").join(last, "file").select("line", "last", parsed.alias("r"))
    good = F.col("r._corrupt").isNull() & F.col(f"r.{key}").isNotNull()
    rows = rows.where(good | (F.col("line") < F.col("last")))
    checked = rows.select("line", F.when(good, F.col("r")).otherwise(F.raise_error(F.lit("corrupt line")).cast(rows.schema["r"].dataType)).alias("r"))
    return checked.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", "line").alias("r")).select("r.*").drop("_corrupt")


def only_audio(files: DataFrame) -> DataFrame:
    """Files whose suffix, in either case, is that of a kind of audio."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*AUDIO))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of audio files below a folder, by path; suffixes in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return only_audio(files).orderBy("path")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def sidecars(files: DataFrame, extension: str) -> DataFrame:
    """For each audio file its sidecar: ``x.mp3.ext`` first, else ``x.ext``."""
    every = files.select(F.col("path").alias("p"))
    audio = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*AUDIO))
    full, short = F.concat("path", F.lit(f".{extension}")), F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit(f".{extension}"))
    a, b = every.withColumnRenamed("p", "p1"), every.withColumnRenamed("p", "p2")
    # names made by expressions are larger than their estimate, so a listing must not be taken for a small side and broadcast
    return audio.join(a.hint("merge"), F.col("p1") == full, "left").join(b.hint("merge"), F.col("p2") == short, "left").select("path", F.coalesce("p1", "p2").alias("sidecar"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(entry, line): trimmed non-empty lines, once each, at their first place, in order; files follow each other by path."""
    lines = ordered_lines(spark, path).select(F.trim("value").alias("entry"), "line").where("entry <> ''")
    return lines.groupBy("entry").agg(F.min("line").alias("line")).orderBy("line")
