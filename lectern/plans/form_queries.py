"""Titles, names, texts and vectors that other systems read, and operators that return verdicts on listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import references, text, vectors
from lectern.operators import aggregates, catalog, corpus, segmentation
from lectern.plans.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'تلاوة' ELSE 'خواطر' END || ' سورة ' || c_nationkey AS head, c_custkey % 4 AS k FROM customer)
 SELECT c_custkey, CASE k WHEN 0 THEN c_name WHEN 1 THEN head WHEN 2 THEN head || ' — الآية 7' ELSE head || ' — الآيات 7–' || (c_nationkey + 8) END AS title FROM s""")
def segment_titles(spark, sf):
    """Titles of segments without a chapter, of a whole chapter, of a verse and of a range."""
    k, nation = F.col("c_custkey") % 4, F.col("c_nationkey")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "recitation").otherwise("khawatir")
    first, last = F.when(k > 1, 7), F.when(k == 2, F.lit(7)).when(k == 3, nation + 8)
    return table(spark, sf, "customer").select("c_custkey", text.segment_title(kind, F.when(k > 0, nation.cast("string")), first, last, F.col("c_name")).alias("title"))


def _stamp(ms: str) -> str:
    return f"CASE WHEN {ms} // 3600000 > 0 THEN ({ms} // 3600000) || '.' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') ELSE ({ms} // 60000)::VARCHAR END || '.' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0')"


@query(f"SELECT p_partkey, p_name || ' ' || {_stamp('(p_partkey * 17771)')} || '-' || {_stamp('(p_partkey * 17771 + p_size * 1000)')} || '.mp4' AS name FROM part")
def clip_names(spark, sf):
    start = F.col("p_partkey") * 17_771
    return table(spark, sf, "part").select("p_partkey", text.clip_name(F.col("p_name"), start, start + F.col("p_size") * 1000, "mp4").alias("name"))


@query("""SELECT doc_id, md5(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS body_md5 FROM documents WHERE NOT contains(text, '`')""")
def fenced_answers(spark, sf):
    """Every document without a backtick, fenced as a model's answer, some with a language."""
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    fence = F.when(F.col("doc_id") % 2 == 0, "```json\n").otherwise(" ```\n")
    d = table(spark, sf, "documents").where("NOT contains(text, '`')")
    return d.select("doc_id", F.md5(text.strip_fences(F.concat(fence, body, F.lit("\n```")))).alias("body_md5"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE source || chr(10) || text END) AS embed_md5 FROM documents""")
def embed_texts(spark, sf):
    """What is embedded of each document: its text under a header, where that is not blank."""
    header = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.embed_text(header, F.col("text"))).alias("embed_md5"))


@query("""WITH r AS (SELECT doc_id, list_transform(range(8), lambda i: ('0x' || sha256(text)[i * 2 + 1:i * 2 + 2])::INT / 127.5::DOUBLE - 1) AS v FROM documents)
 SELECT doc_id, unnest(range(8)) AS k, unnest(list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6))) AS component FROM r""")
def stub_vectors(spark, sf):
    """Offline vectors of all documents, every component."""
    v = table(spark, sf, "documents").select("doc_id", F.posexplode(vectors.stub_vector(F.col("text"), 8)).alias("k", "component"))
    return v.select("doc_id", "k", F.round("component", 6).alias("component"))


@query("""WITH p AS (SELECT p_partkey, least(greatest(p_partkey % 60 * 1000 - 3000, 0), p_size * 1000) AS a, p_size * 1000 AS d FROM part), s AS (SELECT *, greatest(least(a + 30000, d) - a, least(1000, d)) AS span FROM p), e AS (SELECT *, least(a + span, d) AS stop FROM s)
 SELECT p_partkey, greatest(stop - span, 0) AS start_ms, stop AS end_ms FROM e""")
def default_ranges(spark, sf):
    """The clip that is offered at a position, some of them before the start or behind the end."""
    r = corpus.default_range(F.col("p_partkey") % 60 * 1000 - 3000, F.col("p_size") * 1000)
    return table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.start_ms", "r.end_ms")


@query("SELECT 'in/' || p_partkey || '.mp3' AS path, lpad(p_partkey::VARCHAR, 9, '0') AS key FROM part")
def discovered_files(spark, sf):
    files = table(spark, sf, "part").select(F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path"))
    return corpus.discovered(files, F.lpad(F.regexp_extract("path", r"(\d+)\.mp3$", 1), 9, "0"))


@query("""WITH r AS (SELECT p_partkey AS record, p_partkey % 10 AS chapter, unnest(range(p_size, p_size + 5)) AS verse, p_name AS key FROM part), l AS (SELECT chapter, verse, max_by(key, record) AS key FROM r GROUP BY 1, 2)
 SELECT chapter, count(*) AS verses, md5(string_agg(verse || '=' || key, ',' ORDER BY verse)) AS map_md5 FROM l GROUP BY 1""")
def manifest_map(spark, sf):
    """The one map of all chapters, read back."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("record"), (F.col("p_partkey") % 10).alias("chapter"), F.col("p_size").alias("first"), (F.col("p_size") + 4).alias("last"), F.col("p_name").alias("key"))
    chapters = aggregates.whole_mapping(p).select(F.explode("chapters").alias("chapter", "verses"))
    line = F.array_join(F.transform("verses", lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",")
    return chapters.select("chapter", F.size("verses").cast("long").alias("verses"), F.md5(line).alias("map_md5"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'q=' || p_name || '&juz=' || p_size WHEN 1 THEN 'page=' || p_size ELSE '' END AS params FROM part""")
def filter_params(spark, sf):
    """Filters as the parameters of a page's address; empty ones are left out."""
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", references.filter_params(F.when(k == 0, F.col("p_name")).otherwise(""), F.lit(None), F.when(k == 0, size), F.when(k == 1, size)).alias("params"))


@query("""SELECT o_orderkey AS id, CASE WHEN c.c_custkey IS NULL THEN 'not_found' WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE 'set' END AS verdict FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) c ON c_custkey = o_custkey""")
def feedback_verdicts(spark, sf):
    """Votes on answers: those on unknown ones are not found, and an equal one changes nothing."""
    votes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("answer"), F.when(F.col("o_orderkey") % 3 == 0, "up").otherwise("down").alias("vote"))
    known = table(spark, sf, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("answer"), F.lit("up").alias("feedback"))
    return catalog.feedback_verdicts(votes, known).select("id", "verdict")


@query("""WITH p AS (SELECT s_nationkey AS surah, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) SELECT surah, s_suppkey, CAST(r AS INT) AS place FROM p WHERE r BETWEEN 3 AND 4""")
def verse_pages(spark, sf):
    """The second page of two verses of every chapter; chapters without that many have none."""
    v = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("surah"), "s_suppkey")
    return catalog.pages_of(v, "surah", ["s_suppkey"], 2, 2).select("surah", "s_suppkey", "place")


@query("""SELECT p_partkey, unnest(range(p_size % 7 + 2)) AS k, unnest([p_partkey + (p_size * 10 * i) // (p_size % 7 + 1) for i in range(p_size % 7 + 2)]) AS at FROM part""")
def word_boundaries(spark, sf):
    """Marks between the words of a span, whole numbers that start and end with it."""
    n = F.col("p_size") % 7 + 1
    marks = segmentation.boundaries(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size") * 10, n)
    return table(spark, sf, "part").select("p_partkey", F.posexplode(marks).alias("k", "at"))
