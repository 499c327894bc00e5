"""Queries of listings, projections, verdicts, verified answers and the recogniser's stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import aggregates, answers, catalog, corpus, joins, smart
from lectern.plans.tables import WORDS, table, words

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {WORDS}, t AS (SELECT DISTINCT user_id AS transcript FROM events WHERE user_id % 7 > 0), l AS (SELECT w.transcript, md5(string_agg(concat_ws(':', w.idx, w.text, w.start_ms, w.end_ms, round_even(e.value / 1000, 3)), ',' ORDER BY w.idx)) AS h, count(*) AS n
 FROM words w JOIN events e USING (event_id) WHERE w.transcript % 5 > 0 GROUP BY 1)
 SELECT c_custkey AS segment, CASE WHEN t.transcript IS NULL THEN 'no transcript' WHEN l.h IS NULL THEN 'no words' ELSE 'ok' END AS found, coalesce(CASE WHEN t.transcript IS NOT NULL THEN n END, 0) AS n, CASE WHEN t.transcript IS NOT NULL THEN h END AS words_md5 FROM customer LEFT JOIN t ON t.transcript = c_custkey LEFT JOIN l ON l.transcript = t.transcript""")
def compact_words(spark, sf):
    w = words(spark, sf).join(table(spark, sf, "events").select("event_id", (F.col("value") / 1000).alias("confidence")), "event_id").where("transcript % 5 > 0")
    t = table(spark, sf, "events").where("user_id % 7 > 0").select(F.col("user_id").alias("segment"), F.col("user_id").alias("transcript"), F.lit(1).alias("version"), F.lit("stub").alias("engine"), F.lit(False).alias("is_human_reviewed")).distinct()
    got = catalog.compact_words(table(spark, sf, "customer").select(F.col("c_custkey").alias("segment")), t, w)
    line = F.array_join(F.transform("words", lambda x: F.concat_ws(":", x["i"].cast("string"), x["t"], x["s"].cast("string"), x["e"].cast("string"), F.format_string("%s", x["c"]))), ",")
    return got.select("segment", "found", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n"), F.when(F.size("words") > 0, F.md5(line)).alias("words_md5"))


@query("SELECT event_id AS chunk_id, c_custkey AS segment_id, c_name AS segment_title, c_nationkey AS surah, 1 AS ayah_start, 2 AS ayah_end, c_mktsegment AS kind, event_type AS text, event_id AS start_ms, event_id + 5 AS end_ms FROM events JOIN customer ON c_custkey = user_id")
def result_shape(spark, sf):
    e = table(spark, sf, "events")
    chunks = e.select(F.col("event_id").alias("chunk"), F.col("user_id").alias("transcript"), F.col("event_type").alias("text"), F.col("event_id").alias("start_ms"), (F.col("event_id") + 5).alias("end_ms"))
    segments = table(spark, sf, "customer").select(F.col("c_custkey").alias("segment"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("surah"), F.lit(1).alias("ayah_start"), F.lit(2).alias("ayah_end"), F.col("c_mktsegment").alias("kind"))
    return catalog.result_shape(chunks, e.select(F.col("user_id").alias("transcript"), F.col("user_id").alias("segment")).distinct(), segments)


def _topics(spark, sf):
    topics = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("topic"), (F.col("s_suppkey") % 3 > 0).alias("is_published"))
    links = table(spark, sf, "lineitem").where("l_suppkey % 4 > 0").select(F.col("l_suppkey").alias("topic"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_discount").alias("score"))
    return topics, links


_LINKS = "k AS (SELECT l_suppkey AS topic, l_orderkey * 10 + l_linenumber AS chunk, l_discount AS score FROM lineitem WHERE l_suppkey % 4 > 0), n AS (SELECT s_suppkey AS topic, count(chunk) AS chunk_count FROM supplier LEFT JOIN k ON k.topic = s_suppkey WHERE s_suppkey % 3 > 0 GROUP BY 1)"


@query(f"WITH {_LINKS} SELECT * FROM n")
def published_topics(spark, sf):
    return aggregates.topic_counts(*_topics(spark, sf))


@query(f"WITH {_LINKS}, r AS (SELECT topic, chunk, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, chunk) AS INT) AS place FROM k JOIN n USING (topic)) SELECT r.*, chunk_count FROM r JOIN n USING (topic) WHERE place <= 100")
def topic_chunks(spark, sf):
    return aggregates.topic_chunks(*_topics(spark, sf))


@query("SELECT s_suppkey AS topic FROM supplier WHERE s_suppkey % 3 > 0 AND s_name = 'Supplier#000000002'")
def published_topic(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("topic"), (F.col("s_suppkey") % 3 > 0).alias("is_published"), F.col("s_name").alias("slug"))
    return catalog.published(s, "Supplier#000000002").select("topic")


@query("SELECT o_orderkey, CASE WHEN length(o_orderpriority) <= 5 THEN o_orderpriority ELSE left(o_orderpriority, 2) || '…' END AS short FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%urgent%' AND date_trunc('year', o_orderdate) = (SELECT min(date_trunc('year', o_orderdate)) FROM orders)")
def admin_listing(spark, sf):
    o = table(spark, sf, "orders")
    year = o.agg(F.date_format(F.date_trunc("year", F.min("o_orderdate")), "yyyy-MM-dd")).first()[0]
    got = catalog.listing(o, {"o_orderstatus": "F"}, (["o_orderpriority"], "URGENT"), ("o_orderdate", "year", year), "o_orderdate")
    return got.select("o_orderkey", catalog.short_question(F.col("o_orderpriority"), 5).alias("short"))


@query("""SELECT p_partkey::VARCHAR AS path, p_brand AS sha256, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'skipped' WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'mismatch' ELSE 'downloaded' END AS verdict FROM part""")
def download_verdicts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("sha256"), F.col("p_partkey").alias("k"))
    present = p.where("k % 3 = 0").select("path", F.when(F.col("k") % 2 == 0, F.col("sha256")).otherwise("old").alias("sha256"))
    fetched = p.where("k % 5 > 0").select("path", F.when(F.col("k") % 7 == 0, "broken").otherwise(F.col("sha256")).alias("sha256"))
    return catalog.download_verdicts(p.drop("k"), present, fetched)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(CASE WHEN l_linenumber % 3 = 0 THEN 0.25 WHEN l_linenumber % 3 = 1 THEN (l_partkey * 0.3 + l_suppkey * 2.5) / 1000000 END), 9)::DOUBLE AS cost FROM lineitem GROUP BY 1, 2")
def call_costs(spark, sf):
    n = F.col("l_linenumber") % 3
    price = lambda x: F.when(n == 1, F.lit(x))
    cost = catalog.cost_usd(F.when(n == 0, F.lit(0.25)), F.col("l_partkey"), F.col("l_suppkey"), price(0.3), price(2.5))
    return table(spark, sf, "lineitem").withColumn("c", cost).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("c").cast("double"), 9).alias("cost"))


@query("SELECT CAST(floor(sum(n_chars) * 2.5) AS BIGINT) + count(*) * 30 AS tokens FROM documents")
def embedding_tokens(spark, sf):
    return catalog.token_estimate(table(spark, sf, "documents"), "n_chars")


_VOCABULARY = ["alif", "ba", "ta", "tha", "jim"]


@query(f"""WITH d AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h, greatest(n_chars * 7 // 600, 1) AS n FROM documents), w AS (SELECT doc_id, i, {_VOCABULARY}[(('0x' || h[1:2])::INT + i) % 5 + 1] AS word, round(0.8 + ('0x' || h[i % 32 * 2 + 1:i % 32 * 2 + 2])::INT / 255.0::DOUBLE * 0.19, 4) AS c FROM d, LATERAL (SELECT unnest(range(n)) AS i))
 SELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY i)) AS words_md5, round(sum(c), 4) AS confidence FROM w GROUP BY 1""")
def stub_transcripts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.stub_words(F.sha2(F.col("doc_id").cast("string"), 256), F.col("n_chars") * 7, _VOCABULARY).alias("w"))
    total = F.aggregate(F.transform("w", lambda x: x["confidence"]), F.lit(0.0), lambda a, x: a + x)
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join(F.transform("w", lambda x: x["text"]), " ")).alias("words_md5"), F.round(total, 4).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN a < 10 OR a > 14 THEN -1 WHEN a >= 13 THEN p_size + 1 ELSE p_size END AS token, (p_size % 5 + 1) / 5.0::DOUBLE AS density FROM (SELECT p_partkey, p_size, p_partkey % 8 + 8 AS a FROM part)")
def active_tokens(spark, sf):
    size, none = F.col("p_size"), F.lit(-1)
    token = text.active_token(F.array(size, none, none, size + 1, none), F.lit(10), F.lit(14), F.col("p_partkey") % 8 + 8)
    return table(spark, sf, "part").select("p_partkey", token.alias("token"), text.alignment_density(size % 5 + 1, F.lit(10), F.lit(14)).alias("density"))


@query(f"""WITH {WORDS}, ch AS (SELECT transcript, idx // 10 AS pos, min(idx) + 2 AS a, max(idx) - 1 AS b FROM words GROUP BY 1, 2 HAVING max(idx) - 1 >= min(idx) + 2), m AS (SELECT w.transcript, w.idx, ch.pos, greatest(a - w.idx, w.idx - b, 0) AS gap FROM words w LEFT JOIN ch ON ch.transcript = w.transcript)
 SELECT transcript, idx, min_by(pos, struct_pack(g := gap, p := pos)) AS chunk FROM m GROUP BY 1, 2""")
def nearest_chunk(spark, sf):
    w = words(spark, sf)
    low, high = F.min("idx") + 2, F.max("idx") - 1
    ch = w.groupBy("transcript", F.floor(F.col("idx") / 10).alias("pos")).agg(F.when(high >= low, low).alias("word_start"), F.when(high >= low, high).alias("word_end"))
    return joins.nearest_chunk(w.select("transcript", "idx"), ch, "transcript", "idx")


@query("""SELECT '{"folder":"in","source_title":"s","kind":"khawatir","accepted":' || count(*) FILTER (p_size % 5 > 1) || ',"created":' || count(*) FILTER (p_size % 5 = 2) || ',"unparseable":' || count(*) FILTER (p_size % 5 = 0) || ',"failed":' || count(*) FILTER (p_size % 5 = 1) || '}' AS stats FROM part""")
def batch_stats(spark, sf):
    k = F.col("p_size") % 5
    files = table(spark, sf, "part").select((k == 2).alias("created"), F.when(k == 0, "unparseable").when(k == 1, "failed").alias("problem"))
    return aggregates.batch_stats(files, "in", "s", "khawatir")


@query("SELECT count(*) AS files, count(DISTINCT p_partkey % 10) AS chapters, CAST(sum(p_size) AS BIGINT) AS bytes FROM part")
def mapping_totals(spark, sf):
    return aggregates.mapping_totals(table(spark, sf, "part").withColumn("chapter", F.col("p_partkey") % 10), "p_size")


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(abs(value) * 1000000) AS BIGINT)) AS BIGINT) AS micros, sum(CAST(floor(abs(value) * 1000000) AS BIGINT)) >= 15000000000 AS over_budget FROM events GROUP BY 1")
def days_over_budget(spark, sf):
    return aggregates.over_budget(aggregates.daily_spend(table(spark, sf, "events"), "ts", F.abs("value")), 15_000)


@query("""WITH p AS (SELECT p_partkey, p_size * 40 AS a, (p_partkey % 50) * 60 AS b, 2000 AS d, 1000 AS m FROM part) SELECT p_partkey, greatest(0, least(b, greatest(0, least(greatest(a, m), d) - m))) AS s_start, least(greatest(a, m), d) AS s_end,
 least(greatest(a, 0), d - m) AS e_start, least(greatest(b, least(least(greatest(a, 0), d - m) + m, d)), d) AS e_end FROM p""")
def clip_moves(spark, sf):
    a, b, d = F.col("p_size") * 40, (F.col("p_partkey") % 50) * 60, F.lit(2000)
    got = table(spark, sf, "part").select("p_partkey", corpus.move_start(a, b, d).alias("s"), corpus.move_end(a, b, d).alias("e"))
    return got.select("p_partkey", F.col("s.start_ms").alias("s_start"), F.col("s.end_ms").alias("s_end"), F.col("e.start_ms").alias("e_start"), F.col("e.end_ms").alias("e_end"))


_PROBLEMS = ("ok", "already approved", "no words", "end before start", "chunk without words", "outside the chunk", "words missing")


@query(f"WITH {WORDS} SELECT transcript * 10 + k AS correction, CASE WHEN k > 0 THEN {list(_PROBLEMS)}[k + 1] END AS problem FROM (SELECT DISTINCT transcript FROM words), range(7) r(k)")
def correction_problems(spark, sf):
    """Seven corrections of each transcript, one for each reason and one without."""
    w = words(spark, sf)
    n = w.groupBy("transcript").agg(F.max("idx").alias("last"))
    far = F.col("transcript") + 1_000_000  # a chunk that claims more words than there are
    span = lambda chunk, high: F.struct(chunk.alias("chunk"), F.lit(0).cast("long").alias("low"), high.alias("high"))
    chunks = n.select(F.inline(F.array(span(F.col("transcript"), F.col("last")), span(far, F.col("last") + 5))))
    case = lambda k, chunk, a, b, status="pending", new="new text": F.struct(F.lit(k).alias("k"), chunk.cast("long").alias("chunk"), a.cast("long").alias("word_start"), b.cast("long").alias("word_end"), F.lit(status).alias("status"), F.lit(new).alias("suggested_text"))
    t, last, zero = F.col("transcript"), F.col("last"), F.lit(0)
    cases = F.array(case(0, t, zero, zero), case(1, t, zero, zero, "approved"), case(2, t, zero, zero, new=" \n"), case(3, t, zero + 1, zero), case(4, -t - 1, zero, zero), case(5, t, zero, last + 1), case(6, far, last, last + 2))
    c = n.select("transcript", F.inline(cases)).withColumn("correction", F.col("transcript") * 10 + F.col("k"))
    return corpus.correction_problems(c, chunks, w)


#: Quotes of each document: words 6 to 12, two words, none of its words, and one of a passage that was not drafted.
_QUOTED = "d AS (SELECT doc_id AS answer, w FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 12)"


def _verified(spark, sf):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("answer"), F.slice(w, 1, 40).alias("w")).where("size(w) >= 12")
    spoken = d.select(F.col("answer").alias("transcript"), F.posexplode("w").alias("idx", "text")).withColumn("start_ms", (F.col("idx") * 500).cast("long")).withColumn("end_ms", F.col("start_ms") + 400)
    passages = d.select("answer", F.lit("p1").alias("passage"), (F.col("answer") + 7).alias("segment"), F.col("answer").alias("transcript"), F.lit(0).cast("long").alias("start_ms"), F.lit(10**9).alias("end_ms"))
    case = lambda pos, passage, quote: F.struct(F.lit(pos).alias("pos"), F.lit(passage).alias("passage"), quote.alias("quote"))
    good = F.when(F.col("answer") % 2 == 0, F.array_join(F.slice("w", 6, 7), " ")).otherwise(F.lit("0" * 20 + " " + "1" * 20 + " " + "2" * 20))
    quotes = d.select("answer", F.inline(F.array(case(1, "p1", good), case(2, "p1", F.array_join(F.slice("w", 1, 2), " ")), case(3, "p1", F.lit("3" * 20 + " " + "4" * 20 + " " + "5" * 20)), case(4, "p9", good))))
    said = "الصبر عند الصدمة [p1][p1]. جملة بلا علامة [p9]. ثم [[ayah:2:155]] و[[ayah:9:999]] هنا [p1]."
    none = F.array().cast("array<struct<surah:int,ayah:int>>")
    drafts = d.select("answer", F.lit("answered").alias("status"), F.lit(said).alias("answer_md"), none.alias("refs"), F.array(F.lit(" لماذا؟ "), F.lit("why?"), F.lit("كيف؟")).alias("followups"))
    verses = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(2).alias("surah"), F.lit(155).alias("ayah"))
    return answers.verify(drafts, quotes, passages, spoken, verses)


@query(f"""WITH {_QUOTED} SELECT answer, unnest([1, 2, 3, 4]) AS pos, unnest([CASE WHEN answer % 2 = 1 THEN 'quote not found' END, 'length of quote', 'quote not found', 'unknown passage']) AS problem, unnest([CASE WHEN answer % 2 = 0 THEN 1 END, NULL, NULL, NULL]) AS n,
 unnest([CASE WHEN answer % 2 = 0 THEN answer + 7 END, NULL, NULL, NULL]) AS segment FROM d""")
def checked_citations(spark, sf):
    return _verified(spark, sf)[1].select("answer", "pos", "problem", "n", F.when(F.col("n").isNotNull(), F.col("segment")).alias("segment"))


@query(f"""WITH {_QUOTED} SELECT answer, CASE WHEN answer % 2 = 0 THEN 'partial' ELSE 'not_found' END AS status, CASE WHEN answer % 2 = 0 THEN 'الصبر عند الصدمة [1].' || chr(10) || 'ثم [[ayah:2:155]] و هنا [1].' ELSE '{answers.NOT_FOUND_TEXT}' END AS answer_md,
 CASE WHEN answer % 2 = 0 THEN '2:155' ELSE '' END AS refs, 'لماذا؟|كيف؟' AS followups, 4 AS drafted, CASE WHEN answer % 2 = 0 THEN 1 ELSE 0 END AS kept, NULL AS error FROM d""")
def verified_answers(spark, sf):
    """Half of the answers keep one of four citations; the others keep none and say so."""
    refs = F.array_join(F.transform("ayah_refs", lambda r: F.concat_ws(":", r["surah"].cast("string"), r["ayah"].cast("string"))), ",")
    return _verified(spark, sf)[0].select("answer", "status", "answer_md", refs.alias("refs"), F.array_join("followups", "|").alias("followups"), "drafted", "kept", "error")


@query(f"""WITH RECURSIVE {WORDS}, c AS (SELECT transcript, idx // 5 AS idx, count(*) AS words, min(start_ms) AS start_ms FROM words GROUP BY 1, 2),
 w AS (SELECT transcript, transcript % 7 AS question, sum(words) AS words, min(start_ms) AS start_ms FROM c WHERE (idx IN (1, 2) OR (idx = 3 AND words <= 2)) AND transcript IN (SELECT transcript FROM c WHERE idx = 3) GROUP BY 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY transcript) AS k FROM w),
 f AS (SELECT question, 0::BIGINT AS k, 0::HUGEINT AS spent, NULL::BIGINT AS transcript FROM (SELECT DISTINCT question FROM k) UNION ALL SELECT k.question, k.k, CASE WHEN spent + words <= 52 THEN spent + words ELSE spent END, CASE WHEN spent + words <= 52 THEN k.transcript END FROM f JOIN k ON k.question = f.question AND k.k = f.k + 1)
 SELECT question, w.transcript AS "window", w.transcript % 3 AS segment, CAST(words AS BIGINT) AS words, 'p' || row_number() OVER (PARTITION BY question ORDER BY w.transcript % 3, start_ms, w.transcript) AS passage FROM f JOIN w USING (question, transcript)""")
def context_passages(spark, sf):
    """Seven questions; windows of four chunks around the second, trimmed to twelve words, and a budget of 52 for each question."""
    w = words(spark, sf)
    chunks = w.groupBy("transcript", F.floor(F.col("idx") / 5).alias("idx")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    whole = chunks.where("idx BETWEEN 0 AND 3").groupBy("transcript").agg(F.count("*").alias("n")).where("n = 4")
    windows = whole.select((F.col("transcript") % 7).alias("question"), F.col("transcript").alias("window"), F.col("transcript").alias("priority"), "transcript", (F.col("transcript") % 3).alias("segment"), F.lit(0).alias("a"), F.lit(3).alias("b"), F.lit(1).alias("seed_a"), F.lit(1).alias("seed_b"))
    return smart.context(windows, chunks, limit=12, budget=52).select("question", "window", "segment", "words", "passage")
