"""File names, jumps, filters, quotes, anchors, corrections and composite search queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import alignment, arabic, references, text, vectors
from lectern.operators import joins, search
from lectern.plans.tables import TOKENS, WORDS, table, words
from lectern.plans.text_queries import base_word, filled, literals

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH n AS (SELECT p_partkey, p_size, p_partkey % 5 AS k, p_partkey % 130 AS c FROM part), o AS (SELECT *, k < 4 AND c BETWEEN 1 AND 114 AS ok FROM n)
 SELECT p_partkey, CASE WHEN ok THEN c END AS surah, CASE WHEN ok AND k < 2 THEN p_size END AS first, CASE WHEN ok AND k = 0 THEN p_size + 3 WHEN ok AND k = 1 THEN p_size END AS last, CASE WHEN ok AND k = 2 THEN p_size % 9 + 1 END AS ordinal,
 CASE WHEN ok THEN CASE WHEN k = 2 THEN 'khawatir' ELSE 'recitation' END END AS kind, CASE WHEN ok THEN ['range', 'verse', 'part', 'chapter'][k + 1] END AS pattern FROM o""")
def parse_filenames(spark, sf):
    """Names of each pattern in folders and of several suffixes, chapters beyond the last, and names of none."""
    k, c, size = F.col("p_partkey") % 5, F.col("p_partkey") % 130, F.col("p_size")
    three = lambda x: F.lpad(x.cast("string"), 3, "0")
    name = (
        F.when(k == 0, F.concat(F.lit("a/b/"), three(c), F.lit("-"), three(size), F.lit("-"), three(size + 3), F.lit(".MP3"))).when(k == 1, F.concat(F.lit("S"), c.cast("string"), F.lit("a"), size.cast("string"), F.lit(".opus")))
        .when(k == 2, F.concat(three(c), F.lit(" part "), (size % 9 + 1).cast("string"), F.lit(".mp3"))).when(k == 3, F.concat(three(c), F.lit(".wav"))).otherwise("hello.mp3")
    )
    return table(spark, sf, "part").select("p_partkey", references.parse_filename(name).alias("p")).select("p_partkey", "p.surah", "p.first", "p.last", "p.ordinal", "p.kind", "p.pattern")


@query("""WITH c AS (SELECT n_nationkey + 1 AS number, n_nationkey * 3 + 5 AS verses FROM nation), n AS (SELECT p_partkey, p_size, p_partkey % 9 AS k, p_partkey % 700 AS v, p_size % 28 + 1 AS s FROM part)
 SELECT p_partkey, CASE WHEN k = 0 THEN CASE WHEN v BETWEEN 1 AND 604 THEN 'page' END WHEN k = 1 THEN CASE WHEN p_size BETWEEN 1 AND 30 THEN 'juz' END WHEN c.number IS NULL OR k = 8 THEN NULL WHEN k IN (2, 4, 5) THEN CASE WHEN p_size BETWEEN 1 AND c.verses THEN 'ayah' END ELSE 'surah' END AS target,
 CASE WHEN k IN (2, 4, 5) AND p_size <= c.verses OR k IN (3, 6, 7) THEN c.number END AS surah, CASE WHEN k = 0 AND v BETWEEN 1 AND 604 THEN v WHEN k = 1 AND p_size <= 30 THEN p_size WHEN k IN (2, 4, 5) AND p_size <= c.verses THEN p_size END AS number FROM n LEFT JOIN c ON c.number = n.s""")
def parse_jumps(spark, sf):
    """Pages, juz, numbers, names with and without the article, with fillers and verses, some beyond a chapter's last verse, and nothing."""
    base = lambda n: F.concat(F.lit("سم"), base_word(n))
    nation = table(spark, sf, "nation")
    chapters = nation.select((F.col("n_nationkey") + 1).alias("number"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "ال").otherwise(""), base(F.col("n_nationkey") + 1)).alias("name"), (F.col("n_nationkey") * 3 + 5).alias("ayah_count"))
    k, size, s = F.col("p_partkey") % 9, F.col("p_size").cast("string"), F.col("p_size") % 28 + 1
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    q = (
        F.when(k == 0, say("صفحه ", (F.col("p_partkey") % 700).cast("string"))).when(k == 1, say("juz ", size)).when(k == 2, say(s.cast("string"), " : ", size)).when(k == 3, say("سوره ", s.cast("string")))
        .when(k == 4, say("ال", base(s), " ", size)).when(k == 5, say("سوره ", base(s), " ايه ", size)).when(k == 6, base(s)).when(k == 7, say("سوره ال", base(s))).otherwise("abc 5")
    )
    return references.jumps(table(spark, sf, "part").select("p_partkey", q.alias("q")), "q", chapters).select("p_partkey", "target", "surah", "number")


@query("SELECT page_id, CASE WHEN TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS INT) BETWEEN 1 AND 9999 THEN TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS INT) END AS v FROM pages")
def bounded_params(spark, sf):
    return table(spark, sf, "pages").select("page_id", references.bounded(F.regexp_extract("url", r"/(\d+)", 1), 1, 9999).alias("v"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND 10 BETWEEN p_size AND p_size + 9 AND 25 BETWEEN p_size - 5 AND p_size + 30")
def chapter_index(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").where(references.chapter_filter(F.col("p_name"), (size, size + 9), (size - 5, size + 30), "a", None, 10, 25)).select("p_partkey")


_PLACES = "len(left({0}, {1})) - len(replace(left({0}, {1}), ' ', ''))"


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), q AS (SELECT doc_id, array_to_string(w[6:12], ' ') AS quote, array_to_string(w[:60], ' ') AS source FROM w WHERE len(w) >= 12)
 SELECT doc_id, 'inside' AS kind, {_PLACES.format('source', 'instr(source, quote) - 1')} AS first_word, {_PLACES.format('source', 'instr(source, quote) - 1 + length(quote)')} AS last_word FROM q
 UNION ALL SELECT doc_id, 'longer', 0, 3 FROM q UNION ALL SELECT doc_id, 'absent', NULL, NULL FROM q""")
def quote_spans(spark, sf):
    """Seven words of each document in its first sixty, a quote that goes beyond its passage on both sides, and one that is not there."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = table(spark, sf, "documents").select("doc_id", w.alias("w")).where("size(w) >= 12")
    line = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    case = lambda kind, quote, source: F.struct(F.lit(kind).alias("kind"), quote.alias("quote"), source.alias("source"))
    cases = F.array(case("inside", line(6, 7), line(1, 60)), case("longer", line(4, 9), line(6, 4)), case("absent", F.lit("0" * 40), line(1, 60)))
    found = d.select("doc_id", F.inline(cases)).withColumn("s", references.find_span("quote", "source"))
    return found.select("doc_id", "kind", "s.first_word", "s.last_word")


_SPOKEN, _VERSES = ("qulhu", "wallahu", "ahadun"), [(7, ["qulhu", "wallahu", "ahadun", "samad"]), (8, ["never", "spokenwords", "hereabouts"])]


@query("""WITH n AS (SELECT doc_id, least(3, n) AS a, greatest(least(3, n - 3), 0) AS b FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents))
 SELECT doc_id, 8 AS verse, NULL AS first_word, NULL AS end_word FROM n UNION ALL SELECT doc_id, NULL, 0, a FROM n WHERE a > 0 UNION ALL SELECT doc_id, 7, a, a + 3 FROM n UNION ALL SELECT doc_id, NULL, a + 3, a + 3 + b FROM n WHERE b > 0""")
def anchor_blocks(spark, sf):
    """A verse spoken, but for its last word, between the first words of each document; another verse is pinned, which nobody speaks."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.slice(w, 1, 3), F.array(*(F.lit(s) for s in _SPOKEN)), F.slice(w, 4, 3)).alias("toks"))
    found = alignment.verse_anchors(d, literals(spark, _VERSES, "verse int, tokens array<string>"), "doc_id", "toks")
    return found.select("doc_id", F.inline(references.verse_blocks(F.col("anchors"), F.size("toks"), F.lit(8))))


@query()
def benchmark_anchors(spark, sf):
    """The benchmark's items as verses: where documents speak their first forty words."""
    tokens = lambda n: F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""), 1, n).alias("toks")
    verses = table(spark, sf, "benchmark").select(F.col("item_id").alias("verse"), tokens(40)).withColumnRenamed("toks", "tokens")
    docs = table(spark, sf, "documents").select("doc_id", tokens(1 << 30))
    return alignment.verse_anchors(docs, verses, "doc_id", "toks").select("doc_id", F.inline("anchors"))


@query(f"""WITH {WORDS}, sp AS (SELECT transcript, string_agg(text, ' ' ORDER BY idx) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM words GROUP BY transcript, idx // 20)
 SELECT transcript, md5(text) AS text_md5, start_ms, end_ms, n FROM sp""")
def chunk_texts(spark, sf):
    w = words(spark, sf).groupBy("transcript", F.floor(F.col("idx") / 20).alias("chunk"))
    t = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    return w.agg(F.md5(t).alias("text_md5"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("chunk")


@query(f"WITH {WORDS}, r AS (SELECT transcript, min(idx) AS a, max(idx) AS b FROM words GROUP BY 1) SELECT transcript, e.first, e.last, CASE WHEN e.last < e.first THEN 'end before start' WHEN e.first < a THEN 'first outside' WHEN e.last > b THEN 'last outside' ELSE 'ok' END AS verdict FROM r, (VALUES (0, 2), (5, 3), (60, 80)) e(first, last)")
def correction_verdicts(spark, sf):
    r = words(spark, sf).groupBy("transcript").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    e = F.explode(F.array(*(F.struct(F.lit(x).alias("first"), F.lit(y).alias("last")) for x, y in ((0, 2), (5, 3), (60, 80)))))
    v = F.when(F.col("last") < F.col("first"), "end before start").when(F.col("first") < F.col("a"), "first outside").when(F.col("last") > F.col("b"), "last outside").otherwise("ok")
    return r.select("*", e.alias("e")).select("transcript", "a", "b", "e.*").select("transcript", "first", "last", v.alias("verdict"))


@query("""WITH j AS (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'done' ELSE 'queued' END AS status FROM part WHERE p_retailprice < 1000)
 SELECT p_partkey AS k, CASE WHEN j.k IS NULL THEN 'created' WHEN status = 'failed' THEN 'requeued' ELSE 'existing' END AS verdict FROM part LEFT JOIN j ON j.k = p_partkey""")
def job_cache(spark, sf):
    """Jobs exist for the cheaper parts; all are asked for."""
    p = table(spark, sf, "part")
    status = F.when(F.col("p_size") % 3 == 0, "failed").when(F.col("p_size") % 3 == 1, "done").otherwise("queued")
    jobs = p.where("p_retailprice < 1000").select(F.col("p_partkey").alias("k"), status.alias("status"))
    return p.select(F.col("p_partkey").alias("k")).join(jobs, "k", "left").select("k", F.when(F.col("status").isNull(), "created").when(F.col("status") == "failed", "requeued").otherwise("existing").alias("verdict"))


@query("SELECT c_custkey, CASE WHEN f.vote IS NOT NULL THEN f.vote ELSE c_mktsegment END AS vote FROM customer LEFT JOIN (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) AS vote FROM orders GROUP BY 1) f ON f.k = c_custkey")
def feedback_overlay(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("vote"))
    c = table(spark, sf, "customer")
    return c.join(f, F.col("k") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("vote", "c_mktsegment").alias("vote"))


@query("SELECT user_id, event_type, CAST(r AS INT) AS place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS r FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2)) WHERE r <= 3")
def recent_lru(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    r = last.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"))))
    return r.where("place <= 3").select("user_id", "event_type", "place")


@query("SELECT doc_id, n_words, CAST(n_words * 1.3 AS DOUBLE)::DECIMAL(18, 4) AS tokens FROM (SELECT doc_id, len(regexp_split_to_array(trim(text), '\\s+')) AS n_words FROM documents)")
def token_estimates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n_words"))
    return d.select("doc_id", "n_words", (F.col("n_words") * 1.3).cast("decimal(18,4)").alias("tokens"))


@query("SELECT doc_id, left(concat_ws(' — ', 'مقطع ' || doc_id, 'سورة ' || lang || ': الآيات 1–' || n_chars, source), 300) AS header FROM documents")
def passage_headers(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.passage_header(F.lit(""), F.col("lang"), F.lit(1), F.col("n_chars"), F.col("source"), F.col("doc_id")).alias("header"))


@query("SELECT item_id, sha256('{\"filters\": {\"surah\": ' || item_id || '}, \"question\": \"q' || item_id || '\"}') AS h FROM benchmark")
def question_hashes(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", text.question_hash(F.concat(F.lit("q"), F.col("item_id").cast("string")), F.col("item_id"), F.lit(None).cast("string")).alias("h"))


@query(f"""WITH {TOKENS}, {filled(["the", "which"])}, lex AS (SELECT doc AS id, row_number() OVER (ORDER BY all_terms DESC, rank_cd DESC, doc) AS rank FROM f),
 sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6), vec_id) AS rank FROM embeddings),
 l AS (SELECT 0 AS li, id, rank, 2.0::DOUBLE AS w FROM lex WHERE rank <= 50 UNION ALL SELECT 1, id, rank, 1.0::DOUBLE FROM sem WHERE rank <= 50),
 g AS (SELECT id, round(sum(w / (60 + rank)), 9) AS score, min(struct_pack(li := li, r := rank)) AS fst FROM l GROUP BY id), r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, fst, id) AS place FROM g) SELECT * FROM r WHERE place <= 40""")
def retrieve_hybrid(spark, sf):
    """The lexical and the semantic list, fused."""
    post = search.postings(table(spark, sf, "documents"), "doc_id", arabic.normalize_index(F.col("text"), latin=True))
    lex = search.lexical_fill(post, ["the", "which"]).select(F.lit(0).alias("list_index"), F.col("doc").alias("id"), F.col("place").alias("rank"), F.lit(2.0).alias("weight"))
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    near = e.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in q["embedding"]))), 6).alias("d")).orderBy("d", "vec_id").limit(50)
    sem = near.select(F.lit(1).alias("list_index"), F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy("d", "vec_id")).alias("rank"), F.lit(1.0).alias("weight"))
    return search.fuse(lex.unionByName(sem))


@query(f"""WITH {WORDS}, ch AS (SELECT transcript, idx // 10 AS ord, min(start_ms) AS s, max(end_ms) AS e FROM words GROUP BY 1, 2) SELECT p.transcript, p.ord AS want, p.s AS at_ms, min(c.ord) AS ord FROM ch p JOIN ch c ON c.transcript = p.transcript AND c.s <= p.s AND c.e > p.s GROUP BY 1, 2, 3""")
def point_in_chunk(spark, sf):
    """The first chunk that holds the start of each chunk."""
    ch = words(spark, sf).groupBy("transcript", F.floor(F.col("idx") / 10).alias("ord")).agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    p = ch.select("transcript", F.col("ord").alias("want"), F.col("s").alias("at_ms"))
    hit = joins.points_in_spans(p, ch, "transcript", "at_ms", "s", "e")
    return hit.groupBy("transcript", "want", "at_ms").agg(F.min("ord").alias("ord"))


@query("SELECT role, count(*) AS n, sum((length(text) > 200)::INT) AS long_turns FROM conversations GROUP BY role")
def turn_tally(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum((F.length("text") > 200).cast("int")).alias("long_turns"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(url, '[\x00-\x1f\x7f<>:"/\\|?*]', '', 'g') AS c FROM pages), x AS (SELECT page_id, c, regexp_extract(c, '(\.[A-Za-z0-9]{1,8})$', 1) AS e FROM c),
 t AS (SELECT page_id, e, regexp_replace(trim(regexp_replace(left(c, length(c) - length(e)), '\s+', ' ', 'g')), '^[ .\-]+|[ .\-]+$', '', 'g') AS t FROM x) SELECT page_id, regexp_replace(left(t, 60), '[ .\-]+$', '') || e AS safe FROM t""")
def safe_filenames(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_filename(F.col("url")).alias("safe"))
