"""Lookup, range, as-of, nearest, reconciling and change queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import joins, segmentation
from lectern.plans.tables import WORDS, ms, table, words
from lectern.plans.text_queries import literals
from lectern.sources import subtitles

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_lookup(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT r.rank, d.doc_id, d.source FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) r JOIN documents d USING (doc_id) WHERE rank <= 30")
def join_hydrate_order(spark, sf):
    d = table(spark, sf, "documents")
    ranked = d.orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return joins.in_rank_order(ranked, d.select("doc_id", "source"), "doc_id", "rank").select("rank", "doc_id", "source")


_COVER = """v AS (SELECT p_partkey AS verse, p_partkey % 20 AS surah, p_size AS number FROM part),
 s AS (SELECT s_suppkey AS segment, s_nationkey % 20 AS surah, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 40 END AS a, s_suppkey % 40 + s_nationkey AS b FROM supplier)"""


def _verses(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("verse"), (F.col("p_partkey") % 20).alias("surah"), F.col("p_size").alias("number"))


def _segments(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("segment"), (F.col("s_nationkey") % 20).cast("long").alias("surah"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 40).alias("a"), (F.col("s_suppkey") % 40 + F.col("s_nationkey")).alias("b"))


@query(f"""WITH {_COVER}, j AS (SELECT verse, segment, row_number() OVER (PARTITION BY verse ORDER BY segment) AS r, count(*) OVER (PARTITION BY verse) AS n FROM v JOIN s ON v.surah = s.surah AND number BETWEEN a AND b)
 SELECT v.verse, coalesce(max(n), 0) AS total, coalesce(string_agg(CASE WHEN r <= 5 THEN segment::VARCHAR END, ',' ORDER BY r), '') AS first_ids FROM v LEFT JOIN j USING (verse) GROUP BY v.verse""")
def covering_top5(spark, sf):
    return joins.covering_first(_verses(spark, sf), _segments(spark, sf), "surah", "number", "a", "b", ["segment"], "verse", "segment")


@query(f"WITH {_COVER} SELECT verse, segment FROM v JOIN s ON v.surah = s.surah AND number BETWEEN a AND b WHERE verse = (SELECT min(verse) FROM v JOIN s ON v.surah = s.surah AND number BETWEEN a AND b)")
def covering_one(spark, sf):
    """The segments that cover one verse, the first that any covers."""
    return joins.covering_least(_verses(spark, sf), _segments(spark, sf), "surah", "number", "a", "b", "verse").select("verse", "segment")


_CHUNKS = "ch AS (SELECT DISTINCT transcript, start_ms // 86400000 AS chunk, start_ms // 86400000 * 86400000 AS s, (start_ms // 86400000 + 1) * 86400000 AS e FROM words)"


def _chunks(w):
    day = F.floor(F.col("start_ms") / 86_400_000)
    return w.select("transcript", day.alias("chunk"), (day * 86_400_000).alias("s"), ((day + 1) * 86_400_000).alias("e")).distinct()


@query(f"WITH {WORDS}, {_CHUNKS} SELECT w.transcript, chunk, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM words w JOIN ch ON w.transcript = ch.transcript AND start_ms >= s AND start_ms < e GROUP BY 1, 2")
def event_in_span(spark, sf):
    w = words(spark, sf)
    c = _chunks(w)
    hit = joins.points_in_spans(w.select("transcript", "idx", "start_ms"), c, "transcript", "start_ms", "s", "e")
    return hit.groupBy("transcript", "chunk").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"))


def _clips(w):
    return w.where("event_id % 50 = 0").select("transcript", F.col("event_id").alias("clip"), (F.col("start_ms") - 3_600_000).alias("cs"), (F.col("start_ms") + 3_600_000).alias("ce"))


_CLIPS = "clips AS (SELECT transcript, event_id AS clip, start_ms - 3600000 AS cs, start_ms + 3600000 AS ce FROM words WHERE event_id % 50 = 0)"


@query(f"WITH {WORDS}, {_CLIPS} SELECT clip, count(*) AS n, min(idx) AS first_idx FROM clips c JOIN words w ON w.transcript = c.transcript AND start_ms < ce AND end_ms > cs GROUP BY clip")
def overlap_spans(spark, sf):
    w = words(spark, sf)
    return joins.bucketed_overlap(w.drop("event_id"), _clips(w), "transcript", "start_ms", "end_ms", "cs", "ce", 7_200_000).groupBy("clip").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@query(f"WITH {WORDS}, {_CLIPS} SELECT clip, count(*) AS n FROM clips c JOIN words w ON w.transcript = c.transcript AND start_ms <= ce AND end_ms >= cs GROUP BY clip")
def overlap_inclusive(spark, sf):
    w = words(spark, sf)
    return joins.bucketed_overlap(w.drop("event_id"), _clips(w), "transcript", "start_ms", "end_ms", "cs", "ce", 7_200_000, closed=True).groupBy("clip").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, division FROM (SELECT p_partkey, (p_size > 1 OR (p_size = 1 AND p_partkey % 100 >= 0))::INT + (p_size > 5 OR (p_size = 5 AND p_partkey % 100 >= 10))::INT + (p_size > 20 OR (p_size = 20 AND p_partkey % 100 >= 1))::INT + (p_size > 40 OR (p_size = 40 AND p_partkey % 100 >= 50))::INT AS division FROM part)")
def asof_division(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("surah"), (F.col("p_partkey") % 100).cast("int").alias("ayah"))
    marks = literals(spark, [(1, 1, 0), (2, 5, 10), (3, 20, 1), (4, 40, 50)], "number int, surah int, ayah int")
    return joins.division_of(v, marks).select("p_partkey", "division")


_BUY = "(SELECT event_type FROM events GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)"


def _rare(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").count().orderBy("count", "event_type").first()["event_type"]


@query(f"SELECT a.event_id, max(struct_pack(t := b.ts, e := b.event_id)).e AS found FROM events a LEFT JOIN (SELECT * FROM events WHERE event_type = {_BUY}) b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id")
def asof_event(spark, sf):
    e = table(spark, sf, "events").withColumn("at", ms()).select("event_id", "user_id", "event_type", "at")
    marks = e.where(F.col("event_type") == _rare(spark, sf)).select("user_id", F.col("at").alias("mark_at"), F.col("event_id").alias("mark"))
    return joins.asof(e, marks, "user_id", "at", "mark_at", F.col("mark")).select("event_id", "found")


_PROBE = "p AS (SELECT event_id AS probe, user_id AS transcript, epoch_us(ts) // 1000 + 1800000 AS at_ms FROM events)"


@query(f"""WITH {WORDS}, {_PROBE}, b AS (SELECT probe, max(struct_pack(s := start_ms, e := end_ms, i := idx)) AS b FROM p JOIN words w ON w.transcript = p.transcript AND start_ms <= at_ms GROUP BY probe),
 n AS (SELECT probe, min(struct_pack(s := start_ms, e := end_ms, i := idx)) AS n FROM p JOIN words w ON w.transcript = p.transcript AND start_ms > at_ms GROUP BY probe)
 SELECT probe, CASE WHEN b IS NULL THEN n.i WHEN at_ms < b.e THEN b.i WHEN n IS NULL OR at_ms - b.e < n.s - at_ms THEN b.i ELSE n.i END AS nearest_idx FROM p LEFT JOIN b USING (probe) LEFT JOIN n USING (probe)""")
def nearest_event(spark, sf):
    p = table(spark, sf, "events").select(F.col("event_id").alias("probe"), F.col("user_id").alias("transcript"), (ms() + 1_800_000).alias("at"))
    return joins.nearest_word(p, words(spark, sf).drop("event_id"), "transcript", "at").select("probe", "nearest_idx")


@query(f"""WITH {WORDS}, cuts AS (SELECT DISTINCT transcript, start_ms // 86400000 * 86400000 AS ideal FROM words), m AS (SELECT c.transcript, ideal, min(struct_pack(g := abs(ideal - start_ms), m := start_ms)).m AS mid FROM cuts c JOIN words w ON w.transcript = c.transcript AND abs(ideal - start_ms) <= 7200000 GROUP BY 1, 2)
 SELECT c.transcript, c.ideal, coalesce(mid, c.ideal) AS snapped FROM cuts c LEFT JOIN m ON m.transcript = c.transcript AND m.ideal = c.ideal""")
def nearest_silence(spark, sf):
    """Cuts at the starts of days, moved to the nearest event within two hours."""
    w = words(spark, sf)
    cuts = w.select("transcript", (F.floor(F.col("start_ms") / 86_400_000) * 86_400_000).alias("ideal")).distinct()
    return joins.nearest_mark(cuts, w.select("transcript", "start_ms"), "transcript", "ideal", "start_ms", 7_200_000)


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def semi_exists(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 9000")
    return table(spark, sf, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("n_nationkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def anti_missing(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


_NEW = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 100 = 0)"


@query(f"""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'created' WHEN n.c_custkey IS NULL THEN 'kept' WHEN o.c_name = n.c_name AND o.c_acctbal = n.c_acctbal THEN 'unchanged' ELSE 'updated' END AS action,
 coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey""")
def upsert_actions(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 3 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    new = new.unionByName(old.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return joins.reconcile(old, new, ["c_custkey"], ["c_name", "c_acctbal"])


_RECORDS = """records AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS c_custkey, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS c_name, o_totalprice AS c_acctbal FROM orders),
 judged AS (SELECT *, CASE WHEN c_custkey IS NULL THEN 'no c_custkey' WHEN c_name = '' THEN 'no title' END AS problem FROM records), last AS (SELECT c_custkey, max_by(struct_pack(n := c_name, b := c_acctbal), seq) AS l FROM judged WHERE problem IS NULL GROUP BY 1)"""


def _records(spark, sf):
    o = table(spark, sf, "orders")
    new = o.select(F.when(F.col("o_orderkey") % 50 > 0, F.col("o_custkey")).alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("c_name"), F.col("o_totalprice").alias("c_acctbal"))
    old = table(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal")
    return joins.reconcile_records(old, new, ["c_custkey"], ["c_name", "c_acctbal"], "seq", F.when(F.col("c_name") == "", "no title"))


@query(f"""WITH {_RECORDS} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'created' WHEN n.c_custkey IS NULL THEN 'kept' WHEN o.c_name = l.n AND o.c_acctbal = l.b THEN 'unchanged' ELSE 'updated' END AS action, coalesce(l.n, o.c_name) AS c_name, coalesce(l.b, o.c_acctbal) AS c_acctbal
 FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN last n ON o.c_custkey = n.c_custkey""")
def upsert_records(spark, sf):
    """Orders as records of customers, in order: bad ones fail alone, the last good one of a key counts."""
    return _records(spark, sf)[0]


@query(f"WITH {_RECORDS} SELECT c_custkey, seq, problem FROM judged WHERE problem IS NOT NULL")
def upsert_failures(spark, sf):
    return _records(spark, sf)[1]


_LIST = "(SELECT p_partkey % 1500 AS k, md5(CASE WHEN p_partkey % 4 = 0 THEN p_brand || 'x' ELSE p_brand END) AS sha, p_size AS keep FROM part)"


@query(f"""SELECT r.k, r.sha, CASE WHEN bool_or(l.sha = r.sha) THEN 'matched' WHEN count(l.sha) > 0 THEN 'mismatched' ELSE 'missing' END AS state, min(CASE WHEN l.sha = r.sha THEN keep END) AS borrowed
 FROM (SELECT p_partkey AS k, md5(p_brand) AS sha FROM part) r LEFT JOIN {_LIST} l USING (k) GROUP BY 1, 2""")
def three_state(spark, sf):
    p = table(spark, sf, "part")
    listing = p.select((F.col("p_partkey") % 1500).alias("k"), F.md5(F.when(F.col("p_partkey") % 4 == 0, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand"))).alias("sha"), F.col("p_size").alias("keep"))
    return joins.three_state(p.select(F.col("p_partkey").alias("k"), F.md5("p_brand").alias("sha")), listing, "k", "sha", "keep")


@query("SELECT a.p_partkey, b.v AS carried FROM part a LEFT JOIN (SELECT p_brand, max_by(p_partkey, p_partkey) AS v FROM part WHERE p_size < 5 GROUP BY 1) b USING (p_brand)")
def carry_over(spark, sf):
    p = table(spark, sf, "part")
    old = p.where("p_size < 5").select("p_brand", "p_partkey", F.col("p_partkey").alias("carried"))
    return joins.carry_over(p.select("p_partkey", "p_brand"), old, "p_brand", "p_partkey", "carried").select("p_partkey", "carried")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'copy' WHEN a.k IS NULL THEN 'extra' WHEN a.z <> b.z THEN 'replace' ELSE 'same' END AS status FROM (SELECT p_partkey AS k, p_size AS z FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_size + (p_partkey % 7 = 0)::INT AS z FROM part WHERE p_partkey % 3 <> 0) b ON a.k = b.k")
def sync_listing(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    b = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int")).alias("z"))
    return joins.listing_difference(a, b, "k", "z")


@query("SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def last_wins(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT w.transcript, w.idx, min(v.idx) AS lo, max(v.idx) AS hi FROM words w JOIN words v ON v.transcript = w.transcript AND v.idx BETWEEN w.idx - 1 AND w.idx + 1 GROUP BY 1, 2")
def neighbour_range(spark, sf):
    order = Window.partitionBy("transcript").orderBy("idx")
    w = words(spark, sf).withColumn("lo", F.coalesce(F.lag("idx").over(order), "idx")).withColumn("hi", F.coalesce(F.lead("idx").over(order), "idx"))
    return w.select("transcript", "idx", "lo", "hi")


@query(f"""WITH RECURSIVE {WORDS}, e AS (SELECT *, lead(start_ms) OVER (PARTITION BY transcript ORDER BY idx) AS nxt FROM words),
 f AS (SELECT transcript, idx, start_ms AS from_ms, 0 AS chunk, ((nxt - end_ms > 3600000) AND (end_ms - start_ms >= 36000000)) OR (end_ms - start_ms >= 259200000) AS cut, nxt FROM e WHERE idx = 0
 UNION ALL SELECT e.transcript, e.idx, CASE WHEN f.cut THEN e.start_ms ELSE f.from_ms END, f.chunk + f.cut::INT,
 coalesce(((e.nxt - e.end_ms > 3600000) AND (e.end_ms - (CASE WHEN f.cut THEN e.start_ms ELSE f.from_ms END) >= 36000000)), false) OR (e.end_ms - (CASE WHEN f.cut THEN e.start_ms ELSE f.from_ms END) >= 259200000), e.nxt FROM f JOIN e ON e.transcript = f.transcript AND e.idx = f.idx + 1)
 SELECT f.transcript, chunk, min(f.idx) AS word_start, max(f.idx) + 1 AS word_end, min(w.start_ms) AS start_ms, max_by(w.end_ms, f.idx) AS end_ms FROM f JOIN words w ON w.transcript = f.transcript AND w.idx = f.idx GROUP BY 1, 2""")
def plan_chunks_events(spark, sf):
    return segmentation.plan_chunks(words(spark, sf), "transcript", gap_ms=3_600_000, least_ms=36_000_000, most_ms=259_200_000)


@query(f"""WITH {WORDS}, a AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER w > 1200, false)::INT AS p FROM words WINDOW w AS (PARTITION BY transcript ORDER BY idx)), b AS (SELECT *, sum(p) OVER (PARTITION BY transcript ORDER BY idx) AS island FROM a),
 c AS (SELECT *, (row_number() OVER (PARTITION BY transcript, island ORDER BY idx) - 1) // 9 AS blk FROM b) SELECT transcript, idx, dense_rank() OVER (PARTITION BY transcript ORDER BY island, blk) - 1 AS line FROM c""")
def line_groups(spark, sf):
    return segmentation.player_lines(words(spark, sf).drop("event_id"), "transcript").select("transcript", "idx", "line")


@query()
def subtitle_lines(spark, sf):
    return segmentation.subtitle_lines(words(spark, sf), "transcript")


@query()
def plan_passages(spark, sf):
    order = Window.partitionBy("transcript").orderBy("idx")
    w = words(spark, sf)
    c = w.select("transcript", "idx", F.length("text").cast("long").alias("words"), F.coalesce(F.lead("start_ms").over(order) - F.col("end_ms"), F.lit(0)).alias("gap"))
    return segmentation.plan_passages(c, "transcript", 40, 80)


@query(f"WITH {WORDS} SELECT transcript, idx, sum(length(text) + 1) OVER (PARTITION BY transcript ORDER BY idx) - length(text) - 1 AS char_start FROM words")
def offset_map(spark, sf):
    return segmentation.offset_map(words(spark, sf), "transcript", "text").select("transcript", "idx", "char_start")


@query(f"WITH {WORDS}, a AS (SELECT *, (start_ms + 5) // 10 AS s, (end_ms + 5) // 10 AS e, idx // 6 AS line FROM words) SELECT transcript, idx, coalesce(lead(s) OVER (PARTITION BY transcript, line ORDER BY idx), e) - s AS k_cs FROM a")
def karaoke(spark, sf):
    return segmentation.karaoke(words(spark, sf).withColumn("line", F.floor(F.col("idx") / 6)), "transcript", "line").select("transcript", "idx", "k_cs")


@query(f"""WITH {WORDS}, c AS (SELECT min(start_ms) + 86400000 AS a, min(start_ms) + 172800000 AS b FROM words), k AS (SELECT transcript, idx, (least(greatest(start_ms - a, 0), b - a) + 5) // 10 AS start_cs, (least(greatest(end_ms - a, 0), b - a) + 5) // 10 AS end_cs FROM words, c WHERE start_ms < b AND end_ms > a) SELECT * FROM k WHERE end_cs > start_cs""")
def clip_words(spark, sf):
    w = words(spark, sf)
    t0 = w.agg(F.min("start_ms")).first()[0] or 0
    return segmentation.clip_words(w, t0 + 86_400_000, t0 + 172_800_000).select("transcript", "idx", "start_cs", "end_cs")


@query(f"""WITH {WORDS}, t AS (SELECT transcript, idx, text, start_ms, end_ms FROM words), sp AS (SELECT transcript, min(start_ms) AS s, max(end_ms) AS e FROM t WHERE idx BETWEEN 2 AND 4 GROUP BY 1)
 SELECT transcript, CASE WHEN idx > 4 THEN idx - 1 ELSE idx END AS idx, text, start_ms, end_ms FROM t WHERE idx < 2 OR idx > 4
 UNION ALL SELECT transcript, 2 + i, ['new', 'text'][i + 1], s + (e - s) * i // 2, s + (e - s) * (i + 1) // 2 FROM sp, range(2) r(i)""")
def apply_edits(spark, sf):
    return segmentation.renumber(words(spark, sf), 2, 4, ["new", "text"], F.col("start_ms"), F.col("end_ms"))


@query("SELECT p_partkey, p_size // 7 AS n_slots, 1000 * p_size // greatest(p_size // 7, 1) AS slot FROM part WHERE p_size >= 7")
def even_timings(spark, sf):
    p = table(spark, sf, "part").where("p_size >= 7").withColumn("n", F.floor(F.col("p_size") / 7).cast("int"))
    t = segmentation.even_timings(F.col("p_size") * 1000, F.col("n"))
    return p.select("p_partkey", F.size(t).alias("n_slots"), F.when(F.size(t) > 1, F.get(t, F.lit(1))["start_ms"]).otherwise(F.col("p_size") * 1000).alias("slot"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([round_even(i * 100.0 / p_size, 0)::BIGINT for i in range(p_size)])), ',') AS starts FROM part")
def verse_starts(spark, sf):
    starts = segmentation.verse_starts(F.lit(100.0), F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(starts, lambda x: x.cast("long").cast("string")), ",").alias("starts"))


@query()
def subtitle_cards(spark, sf):
    """A subtitle file for every fiftieth event: the words within an hour of it."""
    w = words(spark, sf)
    clips = _clips(w).select("clip", "transcript", F.col("cs").alias("start_ms"), F.col("ce").alias("end_ms"), F.concat(F.lit("clip "), F.col("clip").cast("string")).alias("credit"))
    return subtitles.subtitle_files(clips, w.drop("event_id"))
