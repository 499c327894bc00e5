"""Context, ranking, answer and clip queries, and a composite search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import arabic
from lectern.operators import corpus, corrections, search, smart
from lectern.plans.tables import TOKENS, WORDS, table, words
from lectern.plans.text_queries import filled
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


@query(f"""WITH {WORDS}, s AS (SELECT transcript AS w, idx, sum(idx * 7 % 40 + 1) OVER (PARTITION BY transcript ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix,
 sum(CASE WHEN idx >= 4 THEN idx * 7 % 40 + 1 ELSE 0 END) OVER (PARTITION BY transcript ORDER BY idx ROWS UNBOUNDED PRECEDING) AS from_seed FROM words)
 SELECT w AS "window", idx FROM s WHERE CASE WHEN idx < 4 THEN suffix <= 150 WHEN idx > 5 THEN from_seed <= 150 ELSE true END""")
def trim_windows(spark, sf):
    """Every transcript as a window around its fifth and sixth chunk."""
    w = words(spark, sf).select(F.col("transcript").alias("window"), "idx", (F.col("idx") * 7 % 40 + 1).alias("words"), F.lit(4).alias("seed_a"), F.lit(5).alias("seed_b"))
    return smart.trim_windows(w, 150).select("window", "idx")


@query("""SELECT p_partkey, CASE WHEN kept = 0 THEN 'not_found' WHEN given = 'answered' AND kept * 2 < drafted THEN 'partial' ELSE given END AS status FROM (SELECT p_partkey, p_size % 7 AS drafted, p_partkey % 4 AS kept, ['answered', 'partial', 'not_found'][p_partkey % 3 + 1] AS given FROM part)""")
def answer_status(spark, sf):
    given = F.element_at(F.array(F.lit("answered"), F.lit("partial"), F.lit("not_found")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", smart.status_after(F.col("p_size") % 7, F.col("p_partkey") % 4, given).alias("status"))


@query("""SELECT p_partkey, unnest(['text', 'citation', 'text', 'ayah']) AS kind, unnest([p_name || ' ', p_size::VARCHAR, ' and ', (p_partkey % 114 + 1) || ':' || p_size]) AS value, unnest([0, 1, 2, 3]) AS pos FROM part""")
def parse_answer(spark, sf):
    size = F.col("p_size").cast("string")
    answer = F.concat("p_name", F.lit(" ["), size, F.lit("] and [[ayah:"), (F.col("p_partkey") % 114 + 1).cast("string"), F.lit(":"), size, F.lit("]]"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(smart.parse_answer(answer)).alias("pos", "n")).select("p_partkey", "n.kind", "n.value", "pos")


@query("SELECT p_partkey, least(s, e) AS start_ms, CASE WHEN greatest(s, e) - least(s, e) < 1000 THEN least(s, e) + 1000 ELSE greatest(s, e) END AS end_ms FROM (SELECT p_partkey, p_size * 100 AS s, (p_partkey % 50) * 100 AS e FROM part)")
def clamp_ranges(spark, sf):
    p = table(spark, sf, "part")
    r = corpus.clamp_range(F.col("p_size") * 100, (F.col("p_partkey") % 50) * 100, F.lit(1_000_000))
    return p.select("p_partkey", r.alias("r")).select("p_partkey", "r.start_ms", "r.end_ms")


@query("""SELECT p_partkey, CASE WHEN n < 3 THEN 0 ELSE least(greatest(a - 1, 0), n - 3) END AS first, CASE WHEN n < 3 THEN n - 1 ELSE least(greatest(a - 1, 0), n - 3) + 2 END AS last FROM (SELECT p_partkey, p_size % 6 + 1 AS n, p_partkey % (p_size % 6 + 1) AS a FROM part)""")
def grow_selection(spark, sf):
    """One to six words of 300 ms, 400 ms apart, from a selection of one: three of them last a second."""
    n = F.col("p_size") % 6 + 1
    w = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * 400).alias("start_ms"), (i * 400 + 300).alias("end_ms")))
    at = F.col("p_partkey") % n
    return table(spark, sf, "part").select("p_partkey", corpus.grow_selection(w, at, at).alias("g")).select("p_partkey", "g.first", "g.last")


@query(f"""WITH {TOKENS}, {filled(["the", "which"])}, q AS (SELECT doc AS id, row_number() OVER (ORDER BY all_terms DESC, rank_cd DESC, doc) AS rank FROM f),
 l AS (SELECT 0 AS li, id, rank, 2.0::DOUBLE AS w FROM q WHERE rank <= 50 UNION ALL SELECT 1, id, rank, 1.0::DOUBLE FROM q WHERE rank <= 50),
 g AS (SELECT id, round(sum(w / (60 + rank)), 9) AS s, min(struct_pack(li := li, r := rank)) AS fst FROM l GROUP BY id), r AS (SELECT id, row_number() OVER (ORDER BY s DESC, fst, id) AS place FROM g)
 SELECT id, 3.0::DOUBLE AS score, place AS kept_place, false AS weak FROM r WHERE place <= 8""")
def smart_search(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return smart.smart_search(d, "the which")


@query(f"""WITH {WORDS}, e AS (SELECT transcript, CASE WHEN idx > 4 THEN idx - 1 ELSE idx END AS idx, text FROM words WHERE transcript = 3 AND (idx < 2 OR idx > 4) UNION ALL SELECT 3, 2 + i, ['new', 'text'][i + 1] FROM range(2) r(i))
 SELECT transcript, md5(string_agg(text, ' ' ORDER BY idx)) AS text_md5, count(*) AS word_count FROM e GROUP BY 1""")
def correction_transcript(spark, sf):
    w = words(spark, sf)
    chunks = w.groupBy("transcript", F.floor(F.col("idx") / 10).alias("idx")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return corpus.apply_correction(w, chunks, 3, 2, 4, ["new", "text"])["transcript"].select("transcript", F.md5("raw_text").alias("text_md5"), "word_count")


@query(f"""WITH {WORDS}, l AS (SELECT transcript, list(text ORDER BY idx) AS w FROM words GROUP BY 1 HAVING count(*) >= 10),
 a AS (SELECT transcript, w[:2] || ['new', 'longer', 'text'] || w[5:] AS w FROM l), b AS (SELECT transcript, w[:6] || ['one'] || w[9:] AS w FROM a), c AS (SELECT transcript, ['first'] || w[2:] AS w FROM b)
 SELECT transcript, md5(array_to_string(w, ' ')) AS text_md5, len(w) AS word_count, 3::BIGINT AS version FROM c""")
def correction_log(spark, sf):
    """Three edits of every transcript of ten words and more, each counting words as the one before left them, and one that is refused."""
    w = words(spark, sf)
    chunks = w.groupBy("transcript", F.floor(F.col("idx") / 10).alias("idx")).agg(F.min("start_ms").alias("start_ms"), (F.max("end_ms") + 1).alias("end_ms"))
    some = w.groupBy("transcript").count().where(F.col("count") >= 10)
    edit = lambda seq, a, b, new: F.struct(F.lit(seq).alias("seq"), F.lit(a).alias("word_start"), F.lit(b).alias("word_end"), F.lit(new).alias("suggested_text"))
    log = some.select("transcript", F.inline(F.array(edit(1, 2, 3, "new longer text"), edit(2, 6, 7, "one"), edit(3, 0, 0, "first"), edit(4, 3, 1, "refused"))))
    log = log.select((F.col("transcript") * 4 + F.col("seq")).alias("correction"), "seq", F.lit("pending").alias("status"), "transcript", F.lit(0).alias("chunk"), "word_start", "word_end", "suggested_text")
    shared_folder(spark)  # for checkpoints
    return corrections.replay_corrections(w, chunks, log)["transcripts"].select("transcript", F.md5("raw_text").alias("text_md5"), "word_count", "version")


@query("SELECT p_brand || p_size AS sha256, p_partkey, min(s) AS segment, CASE WHEN min(s) IS NULL THEN 'new' ELSE 'known' END AS status FROM part LEFT JOIN (SELECT p_brand || p_size AS h, p_partkey AS s FROM part WHERE p_partkey % 3 = 0) a ON a.h = p_brand || p_size GROUP BY 1, 2")
def ingest_dedup(spark, sf):
    p = table(spark, sf, "part").withColumn("sha256", F.concat("p_brand", F.col("p_size").cast("string")))
    assets = p.where("p_partkey % 3 = 0").select("sha256", F.col("p_partkey").alias("segment"))
    return corpus.ingest(p.select("sha256", "p_partkey"), assets).select("sha256", "p_partkey", "segment", "status")


_OPENING = ("بسم الله الرحمن الرحيم", "بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ")


@query(f"""WITH l AS (SELECT p_partkey + 2 AS surah, p_size % 2 + 1 AS ayah, p_partkey % 3 AS kind, p_name FROM part)
 SELECT surah, ayah, ayah = 1 AND kind = 0 AS stripped, length(CASE WHEN kind = 0 AND ayah = 1 THEN p_name WHEN kind = 0 THEN '{_OPENING[1]} ' || p_name WHEN kind = 1 THEN p_name ELSE '{_OPENING[0]}' END) AS n FROM l
 UNION ALL SELECT 1, 1, false, {len(_OPENING[0])} FROM region WHERE r_regionkey = 0""")
def strip_opening(spark, sf):
    """Chapters of two verses: with the opening before a name, a name alone, and the opening alone, behind chapter 1."""
    kind, p = F.col("p_partkey") % 3, table(spark, sf, "part")
    said = F.when(kind == 0, F.concat(F.lit(_OPENING[1] + " "), "p_name")).when(kind == 1, F.col("p_name")).otherwise(_OPENING[0])
    lines = p.select((F.col("p_partkey") + 2).alias("surah"), (F.col("p_size") % 2 + 1).alias("ayah"), said.alias("text"))
    first = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(1).cast("long").alias("surah"), F.lit(1).alias("ayah"), F.lit(_OPENING[0]).alias("text"))
    return corpus.strip_opening(lines.unionByName(first)).select("surah", "ayah", "stripped", F.length("text").alias("n"))


@query("""WITH n AS (SELECT p_size AS surah, count(*) AS n FROM part GROUP BY 1) SELECT 'size of chapters' AS problem, (SELECT count(*) FROM nation) AS found UNION ALL SELECT 'size of verses', (SELECT count(*) FROM part) UNION ALL SELECT 'size of quarters', NULL UNION ALL SELECT 'size of pages', NULL
 UNION ALL SELECT 'unknown chapter ' || surah, n FROM n WHERE surah % 5 = 0 UNION ALL SELECT 'verses of chapter ' || surah, n FROM n WHERE surah % 5 > 0 AND surah % 7 = 0""")
def reference_problems(spark, sf):
    """Parts as verses, their sizes as chapters: some of these are not declared, some with a verse more."""
    p = table(spark, sf, "part").select(F.col("p_size").alias("surah"), F.col("p_partkey").alias("ayah"))
    size = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    juz = table(spark, sf, "region").agg(F.lit("juz").alias("name"), (F.count("*") * 6).alias("n"))
    counts = size("chapters", table(spark, sf, "nation")).unionByName(size("verses", p)).unionByName(juz)
    declared = p.where("surah % 5 > 0").groupBy("surah").agg((F.count("*") + F.when(F.col("surah") % 7 == 0, 1).otherwise(0)).alias("ayah_count"))
    return corpus.full_reference_problems(counts, declared, p)


@query(f"WITH {TOKENS}, h AS (SELECT a.doc, min(a.pos) AS start FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos = a.pos + 1 JOIN documents d ON d.doc_id = a.doc WHERE a.word = 'of' AND b.word = 'the' GROUP BY 1) SELECT doc, start, row_number() OVER (ORDER BY doc) AS rank, count(*) OVER () AS total FROM h")
def lexical_search_strict(spark, sf):
    return search.lexical_search(table(spark, sf, "documents"), "doc_id", "text", '"of the"', latin=True).select("doc", "start", "rank", "total")


@query(f"SELECT doc, start, 0 AS stems, 0 AS typos, 'imlaei' AS attr, rank FROM ({SQL['lexical_search_strict']})")
def verse_search(spark, sf):
    """The documents as verses of one spelling twice."""
    v = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("uthmani"), F.col("text").alias("imlaei"))
    return corpus.verse_search(v, '"of the"').select("doc", "start", "stems", "typos", "attr", "rank")


@query()
def build_passages(spark, sf):
    w = words(spark, sf)
    c = w.groupBy("transcript", F.floor(F.col("idx") / 5).alias("idx")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    headers = w.select("transcript").distinct().withColumn("header", F.concat(F.lit("t "), F.col("transcript").cast("string")))
    return corpus.build_passages(c, headers, 15, 30).select("transcript", "passage", "chunk_start", "chunk_end", "word_count", "content_hash")


@query("""WITH t AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN repeat('سلام عليكم ', 40) || text ELSE text END AS t FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(t, '\\p{L}')) AS l, len(regexp_extract_all(t, '[ء-ي]')) AS a FROM t) SELECT doc_id, l > 0 AND a >= 0.7 * l AS arabic FROM c""")
def arabic_answers(spark, sf):
    """Short documents behind an Arabic greeting, long ones as they are."""
    t = F.when(F.col("n_chars") < 300, F.concat(F.repeat(F.lit("سلام عليكم "), F.lit(40)), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", arabic.is_arabic(t).alias("arabic"))
