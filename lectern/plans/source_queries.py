"""Readers and writers: rows of the driver tables are written in a format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ranking import numbered
from lectern.plans.tables import table
from lectern.sources import readers, writers
from lectern.sources.shared import shared_folder

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def written(lines: DataFrame, one_file: bool = False) -> str:
    """The folder of these lines (column ``value``)."""
    folder = shared_folder(lines.sparkSession)
    (lines.coalesce(1) if one_file else lines).write.text(folder)
    return folder


def _lines(*rows: str):
    return F.explode(F.array(*(F.lit(r) if isinstance(r, str) else r for r in rows))).alias("value")


@query("SELECT CAST(p_partkey + 1 AS INT) AS surah, p_size + 1 AS ayah, p_name || '|x' AS text FROM part")
def read_pipe_text(spark, sf):
    p = table(spark, sf, "part")
    row = F.concat_ws("|", (p["p_partkey"] + 1).cast("string"), (p["p_size"] + 1).cast("string"), p["p_name"], F.lit("x"))
    return readers.pipe_text(spark, written(p.select(_lines("# comment", "", row))))


@query("SELECT n_nationkey, n_name FROM nation")
def read_xml(spark, sf):
    n = table(spark, sf, "nation")
    element = F.concat(F.lit('<nation n_nationkey="'), n["n_nationkey"].cast("string"), F.lit('" n_name="'), writers.xml_escaped(n["n_name"]), F.lit('"/>'))
    whole = n.agg(F.concat(F.lit("<nations>"), F.array_join(F.collect_list(element), ""), F.lit("</nations>")).alias("value"))  # a reference list of a few rows
    return readers.xml_rows(spark, written(whole, one_file=True), "nation", "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_json_records(spark, sf):
    n = table(spark, sf, "nation")
    whole = n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value"))  # a reference list of a few rows
    return readers.json_records(spark, written(whole, one_file=True), "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT 'q' || item_id AS id, text AS question, CASE WHEN item_id % 3 = 0 THEN 'not_found' ELSE 'answered' END AS expected_status, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 2 END AS labels FROM benchmark")
def read_golden(spark, sf):
    b, none = table(spark, sf, "benchmark"), F.col("item_id") % 3 == 0
    item = F.struct(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.when(none, F.array().cast("array<long>")).otherwise(F.array("item_id", F.col("item_id") + 1)).alias("expected_segment_ids"),
        F.when(none, "not_found").otherwise("answered").alias("expected_status"), F.array(F.lit("t")).alias("tags"), F.lit("").alias("notes"),
    )
    got = readers.golden(spark, written(b.select(_lines("# golden", "", F.to_json(item)))))
    return got.select("id", "question", "expected_status", F.size("expected_segment_ids").alias("labels"))


@query("SELECT c AS k, max(o) AS v FROM (SELECT o_custkey AS c, o_orderkey AS o FROM orders) GROUP BY 1")
def read_checkpoint(spark, sf):
    """The log's lines are in order over several files, and the last of the last one is cut off."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    lines = o.orderBy("v").select(F.to_json(F.struct("k", "v")).alias("value"))
    folder = written(lines.unionByName(spark.createDataFrame([('{"k": 1, "v"',)], "value string")))
    return readers.checkpoint_lines(spark, folder, "k", "k long, v long")


@query("SELECT entry, row_number() OVER (ORDER BY first) AS place FROM (SELECT 'c' || o_custkey AS entry, min(o_orderkey) AS first FROM orders GROUP BY 1)")
def read_manifest(spark, sf):
    """Entries in the order of their first lines, over several files."""
    o = table(spark, sf, "orders").orderBy("o_orderkey")
    entry = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    found = readers.manifest(spark, written(o.select(_lines(F.concat(F.lit("  "), entry), "", entry))))
    return numbered(found, ["line"], "place", "total").select("entry", "place")


@query("SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256, md5(n_name || chr(10)) AS md5 FROM nation")
def file_digests(spark, sf):
    folder = shared_folder(spark)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value"))
    n.repartition("k").write.partitionBy("k").text(folder)
    got = readers.digests(spark, folder)
    return got.where(F.contains("path", F.lit("/k="))).select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("n_nationkey"), "sha256", "md5")


@query("SELECT DISTINCT n_nationkey FROM nation")
def walk_files(spark, sf):
    """Audio files below a folder; here parts named so."""
    folder = shared_folder(spark)
    n = table(spark, sf, "nation").select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string"), F.lit(".mp3")).alias("k"), F.col("n_name").alias("value"))
    n.repartition("k").write.partitionBy("k").option("compression", "none").text(folder)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", r"/part-[^/]*$", "").alias("path"), "length")
    return readers.only_audio(every).select(F.regexp_extract("path", r"a(\d+)\.mp3$", 1).cast("int").alias("n_nationkey"))


@query("SELECT 'd/' || p_partkey || '.mp3' AS path, CASE WHEN p_size % 3 = 0 THEN 'd/' || p_partkey || '.mp3.txt' WHEN p_size % 2 = 0 THEN 'd/' || p_partkey || '.txt' END AS sidecar FROM part")
def sidecar_files(spark, sf):
    p = table(spark, sf, "part").withColumn("stem", F.concat(F.lit("d/"), F.col("p_partkey").cast("string")))
    names = F.array(F.concat("stem", F.lit(".mp3")), F.when(F.col("p_size") % 3 == 0, F.concat("stem", F.lit(".mp3.txt"))), F.when(F.col("p_size") % 2 == 0, F.concat("stem", F.lit(".txt"))))
    return readers.sidecars(p.select(F.explode(F.array_compact(names)).alias("path")), "txt")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS text FROM orders UNION ALL SELECT o_orderkey + 10000000, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def index_upsert(spark, sf):
    index = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    some = index.where("id % 4 = 0").select("id", F.lit("new").alias("text"))
    return writers.upsert_index(index, some.unionByName(some.select((F.col("id") + 10_000_000).alias("id"), "text")), "id")


@query("SELECT c_nationkey AS segment, count(*) AS n FROM customer WHERE c_nationkey <> 7 GROUP BY 1")
def index_delete(spark, sf):
    index = table(spark, sf, "customer").select(F.col("c_nationkey").alias("segment"), "c_custkey")
    return writers.delete_segment(index, 7).groupBy("segment").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey * 10 + l_linenumber AS chunk, o_orderkey AS transcript, c_custkey AS segment, c_name AS title, l_shipmode AS text FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def index_documents(spark, sf):
    chunks = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_orderkey").alias("transcript"), F.col("l_returnflag").alias("text"))
    transcripts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("transcript"), F.col("o_custkey").alias("segment"))
    segments = table(spark, sf, "customer").select(F.col("c_custkey").alias("segment"), F.col("c_name").alias("title"))
    return writers.index_documents(chunks, transcripts, segments).select("chunk", "transcript", "segment", "title", "text")


_CS = "({0} // 360000)::VARCHAR || ':' || lpad(({0} // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad(({0} % 100)::VARCHAR, 2, '0')"


@query(f"SELECT 'Dialogue: 0,' || {_CS.format('(p_partkey * 777)')} || ',' || {_CS.format('(p_partkey * 777 + 150)')} || ',Default,,0,0,0,,{{\\c&H00FF0000&}}a(' || p_name || ')' AS value FROM part")
def subtitle_events(spark, sf):
    """A line for each part's name, in brackets that a subtitle would take for its own."""
    p = table(spark, sf, "part")
    lines = p.select(F.col("p_partkey").alias("line"), (F.col("p_partkey") * 777).alias("start_cs"), (F.col("p_partkey") * 777 + 150).alias("end_cs"), F.concat(F.lit("a{"), "p_name", F.lit("}\\")).alias("text"))
    return writers.ass_dialogue(lines, "#0000ff")
