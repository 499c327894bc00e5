"""Aggregation, metric, function and change-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import arabic, text
from lectern.operators import aggregates
from lectern.plans.tables import WORDS, ms, table, words
from lectern.plans.text_queries import base_word, literals
from lectern.sources import writers
from lectern.sources.shared import shared_folder
from lectern.streaming import lapsing, stateful

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT n_nationkey, coalesce(c, 0) AS n_first, least, most FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(DISTINCT c_custkey) AS c FROM customer GROUP BY 1) USING (n_nationkey) LEFT JOIN (SELECT s_nationkey AS n_nationkey, min(s_acctbal) AS least, max(s_acctbal) AS most FROM supplier GROUP BY 1) USING (n_nationkey)")
def two_child_counts(spark, sf):
    return aggregates.two_children(table(spark, sf, "nation"), "n_nationkey", table(spark, sf, "customer"), "c_nationkey", "c_custkey", table(spark, sf, "supplier"), "s_nationkey", "s_acctbal")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders")
def status_counts(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).unionByName(o.agg(F.lit("total").alias("status"), F.count("*").alias("n")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY source")
def topic_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


@query(f"WITH {WORDS} SELECT transcript, md5(string_agg(text, ' ' ORDER BY idx)) AS text_md5, count(*) AS n_words FROM words GROUP BY 1")
def transcript_text(spark, sf):
    return aggregates.joined_text(words(spark, sf), "transcript").select("transcript", F.md5("text").alias("text_md5"), "n_words")


@query("SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large, count(*) AS total FROM events")
def tally(spark, sf):
    return table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("large"), F.count("*").alias("total"))


@query("SELECT l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(18, 6))) AS cost, CAST(sum(l_linenumber) AS BIGINT) AS calls FROM lineitem GROUP BY 1")
def usage_sums(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,6)")).alias("cost"), F.sum("l_linenumber").alias("calls"))


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(abs(value) * 1000000) AS BIGINT)) AS BIGINT) AS micros FROM events GROUP BY 1")
def daily_spend(spark, sf):
    return aggregates.daily_spend(table(spark, sf, "events"), "ts", F.abs("value"))


@query("WITH c AS (SELECT n_regionkey AS k, count(*) AS counted FROM nation GROUP BY 1), d AS (SELECT r_regionkey AS k, 5 AS declared FROM region) SELECT coalesce(c.k, d.k) AS k, counted, declared, coalesce(counted = declared, false) AS ok FROM c FULL JOIN d ON c.k = d.k")
def ayah_counts(spark, sf):
    c = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("counted"))
    d = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.lit(5).alias("declared"))
    return c.join(d, "k", "full_outer").select("k", "counted", "declared", F.coalesce(F.col("counted") == F.col("declared"), F.lit(False)).alias("ok"))


@query("""WITH r AS (SELECT p_partkey AS record, p_partkey % 10 AS chapter, p_size AS first, p_size + 3 AS last, p_brand AS key FROM part), e AS (SELECT chapter, unnest(range(first, last + 1)) AS verse, record, key FROM r),
 l AS (SELECT chapter, verse, max_by(key, record) AS key FROM e GROUP BY 1, 2) SELECT chapter, count(*) AS n, string_agg(verse || '=' || key, ',' ORDER BY verse) AS entries FROM l GROUP BY 1""")
def nested_map(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("record"), (F.col("p_partkey") % 10).alias("chapter"), F.col("p_size").alias("first"), (F.col("p_size") + 3).alias("last"), F.col("p_brand").alias("key"))
    m = aggregates.nested_mapping(p)
    return m.select("chapter", F.size("verses").cast("long").alias("n"), F.array_join(F.transform(F.map_entries("verses"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("entries"))


@query("""WITH b AS (SELECT abs(value) AS v, ntile(800) OVER (ORDER BY ts, event_id) - 1 AS bucket FROM events), m AS (SELECT bucket, max(v) AS v FROM b GROUP BY 1)
 SELECT r.i AS bucket, coalesce(round(v / (SELECT max(v) FROM m), 4), 0) AS peak FROM range(800) r(i) LEFT JOIN m ON bucket = i""")
def peaks_800(spark, sf):
    return aggregates.peaks(table(spark, sf, "events"), ["ts", "event_id"], "value")


@query("SELECT event_type, list_sort(list(value))[least(greatest(CAST(round_even(0.95 * count(*) + 0.5, 0) AS BIGINT), 1), count(*))] AS p95 FROM events GROUP BY 1")
def percentile_nearest(spark, sf):
    return aggregates.percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p95": 95})


_RANKS = "r AS (SELECT user_id % 20 AS question, event_id AS id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY value DESC, event_id) AS rank FROM events), x AS (SELECT user_id % 20 AS question, event_id AS id FROM events WHERE event_id % 97 = 0)"


@query(f"WITH {_RANKS}, h AS (SELECT x.question, (coalesce(min(rank), 101) <= 100)::INT::DOUBLE AS recall, min(rank) AS f FROM x LEFT JOIN r ON x.question = r.question AND x.id = r.id GROUP BY 1) SELECT round(avg(recall), 6) AS recall, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM h")
def retrieval_metrics(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("question", F.col("user_id") % 20)
    ranked = e.select("question", F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("question").orderBy(F.desc("value"), "event_id")).alias("rank"))
    return aggregates.retrieval_metrics(ranked, e.where("event_id % 97 = 0").select("question", F.col("event_id").alias("id")), 100)


@query("SELECT quality AS expected, toxic AS actual, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, sf):
    return table(spark, sf, "labels").groupBy(F.col("quality").alias("expected"), F.col("toxic").alias("actual")).agg(F.count("*").alias("n"))


@query("SELECT round(avg(((quality = 1) = (toxic = 1))::INT::DOUBLE), 6) AS abstention FROM labels")
def abstention(spark, sf):
    named = lambda c: F.when(F.col(c) == 1, "not_found").otherwise("answered").alias(c)
    return aggregates.abstention(table(spark, sf, "labels").select(named("quality"), named("toxic")), "quality", "toxic")


_RUNS = """runs AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'not_found' ELSE 'answered' END AS expected_status, CASE WHEN event_id % 4 = 0 THEN 'not_found' ELSE 'answered' END AS status, event_id % 17 = 0 AS error,
 CASE WHEN event_id % 11 > 0 THEN event_id % 11 END AS hit_rank, event_id % 5 AS citations, event_id % 2 AS citations_dropped, event_id % 3 = 0 AS judged, event_id % 7 AS sentences, event_id % 4 AS unsupported,
 event_id % 2 AS contradicted, abs(value) * 100 AS latency_ms, CAST(event_id % 1000 AS DECIMAL(18,9)) / 1000 AS cost_usd FROM events)"""


def _runs(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    status = lambda c: F.when(c, "not_found").otherwise("answered")
    return e.select(
        status(F.col("user_id") % 3 == 0).alias("expected_status"), status(n % 4 == 0).alias("status"), (n % 17 == 0).alias("error"), F.when(n % 11 > 0, n % 11).alias("hit_rank"), (n % 5).alias("citations"),
        (n % 2).alias("citations_dropped"), (n % 3 == 0).alias("judged"), (n % 7).alias("sentences"), (n % 4).alias("unsupported"), (n % 2).alias("contradicted"), (F.abs("value") * 100).alias("latency_ms"),
        ((n % 1000).cast("decimal(18,9)") / 1000).cast("decimal(18,9)").alias("cost_usd"),
    )


@query(f"""WITH {_RUNS}, ok AS (SELECT * FROM runs WHERE NOT error), s AS (SELECT list_sort(list(latency_ms)) AS l, count(*) AS m FROM ok)
 SELECT (SELECT count(*) FROM runs) AS n, (SELECT count(*) FROM runs WHERE error) AS errors, count(*) FILTER (expected_status <> 'not_found') AS labelled,
 round(avg((coalesce(hit_rank, 99) <= 8)::INT::DOUBLE) FILTER (expected_status <> 'not_found'), 4) AS recall_at_8, round(avg(coalesce(1.0 / hit_rank, 0)) FILTER (expected_status <> 'not_found'), 4) AS mrr,
 round(avg(((expected_status = 'not_found') = (status = 'not_found'))::INT::DOUBLE), 6) AS abstention_accuracy, round(sum(citations)::DOUBLE / (sum(citations) + sum(citations_dropped)), 4) AS citation_validity,
 round(sum(citations)::DOUBLE / count(*), 2) AS citations_per_answer, count(*) FILTER (judged) AS judged, round((sum(unsupported) FILTER (judged))::DOUBLE / sum(sentences) FILTER (judged), 4) AS unsupported_ratio,
 CAST(sum(contradicted) FILTER (judged) AS BIGINT) AS contradicted, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, round(CAST(sum(cost_usd) AS DOUBLE) / count(*), 4) AS cost_per_query_usd,
 (SELECT l[least(greatest(CAST(round_even(0.5 * m + 0.5, 0) AS BIGINT), 1), m)] FROM s) AS latency_p50_ms, (SELECT l[least(greatest(CAST(round_even(0.95 * m + 0.5, 0) AS BIGINT), 1), m)] FROM s) AS latency_p95_ms FROM ok""")
def eval_report(spark, sf):
    r = aggregates.summarize(_runs(spark, sf))
    return r.withColumn("cost_usd", F.col("cost_usd").cast("double")).withColumn("cost_per_query_usd", F.round(F.col("cost_per_query_usd").cast("double"), 4))


@query("""WITH v AS (SELECT avg(quality) AS r, 1 - avg(toxic) AS a, avg(toxic) AS u, (SELECT max(n_chars)::DOUBLE FROM documents) AS l FROM labels)
 SELECT metric, value, threshold::DOUBLE AS threshold, CASE WHEN metric IN ('unsupported_ratio', 'latency_p95_ms') THEN value <= threshold ELSE value >= threshold END AS passed
 FROM (SELECT unnest(['recall_at_8', 'abstention_accuracy', 'citation_validity', 'unsupported_ratio', 'latency_p95_ms']) AS metric, unnest([r, a, NULL, u, l]) AS value, unnest([0.8, 0.9, 0.95, 0.05, 15000]) AS threshold FROM v)""")
def eval_gates(spark, sf):
    """Measures of the labels and the longest document against the five thresholds; one has no value."""
    n = table(spark, sf, "labels").agg(F.avg("quality").alias("recall_at_8"), (1 - F.avg("toxic")).alias("abstention_accuracy"), F.avg("toxic").alias("unsupported_ratio"))
    longest = table(spark, sf, "documents").agg(F.max("n_chars").cast("double").alias("latency_p95_ms"))
    return aggregates.gates(n.crossJoin(longest).unpivot([], ["recall_at_8", "abstention_accuracy", "unsupported_ratio", "latency_p95_ms"], "metric", "value"))  # one row each


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size + 20 < 60 THEN (p_partkey % 100 * 60 + p_size + 20) * 1000 END WHEN 1 THEN CASE WHEN p_size + 20 < 60 THEN ((p_partkey % 5 * 60 + p_size + 20) * 60 + 30) * 1000 END WHEN 2 THEN p_size * 1000 + 500 END AS ms FROM part""")
def parse_ms_cases(spark, sf):
    """Minutes and seconds, hours, fractions in Arabic digits and no times at all, some with sixty seconds or minutes and more."""
    n, size = F.col("p_partkey"), F.col("p_size")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.when(n % 4 == 0, F.concat_ws(":", (n % 100).cast("string"), two(size + 20))).when(n % 4 == 1, F.concat_ws(":", (n % 5).cast("string"), two(size + 20), F.lit("30"))).when(n % 4 == 2, F.concat(arabic.arabic_digits(size.cast("string")), F.lit(".5"))).otherwise(F.concat(F.lit("x"), size.cast("string")))
    return table(spark, sf, "part").select("p_partkey", text.parse_ms(s).alias("ms"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 1777 // 3600000 > 0 THEN (p_partkey * 1777 // 3600000) || ':' || lpad((p_partkey * 1777 // 60000 % 60)::VARCHAR, 2, '0') ELSE (p_partkey * 1777 // 60000)::VARCHAR END || ':' || lpad((p_partkey * 1777 // 1000 % 60)::VARCHAR, 2, '0') AS t FROM part")
def format_ms_parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.format_ms(F.col("p_partkey") * 1777).alias("t"))


@query("SELECT p_partkey, (p_partkey * 777 // 360000)::VARCHAR || ':' || lpad((p_partkey * 777 // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((p_partkey * 777 // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((p_partkey * 777 % 100)::VARCHAR, 2, '0') AS t FROM part")
def ass_times(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.ass_time(F.col("p_partkey") * 777).alias("t"))


@query("SELECT p_partkey, '&H00' || upper(h[5:6] || h[3:4] || h[1:2]) AS colour, 'a(' || p_name || ') c' AS escaped FROM (SELECT p_partkey, p_name, printf('%06x', p_partkey * 7919 % 16777216) AS h FROM part)")
def ass_cases(spark, sf):
    rgb = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16_777_216)), 6, "0"))
    return table(spark, sf, "part").select("p_partkey", text.ass_colour(rgb).alias("colour"), text.ass_escape(F.concat(F.lit("a{"), "p_name", F.lit("}\\ c"))).alias("escaped"))


@query("SELECT page_id, 'corpus/' || lpad((page_id % 114)::VARCHAR, 3, '0') || '/' || lpad((page_id % 1000)::VARCHAR, 3, '0') || '.opus' AS key, '/listen/' || page_id || '?t=' || page_id * 10 AS listen, left(sha256('s:2024-01-01:' || page_id), 32) AS ip_hash FROM pages")
def keys_and_hashes(spark, sf):
    p = table(spark, sf, "pages")
    pid = F.col("page_id")
    return p.select("page_id", text.object_key(pid % 114, pid % 1000).alias("key"), text.listen_url(pid, pid * 10).alias("listen"), text.ip_hash("s", F.lit("2024-01-01"), pid.cast("string")).alias("ip_hash"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2.2.2.' || p_size WHEN 1 THEN '9.9.9.9' ELSE '3.3.3.' || p_size END AS ip FROM part")
def client_ips(spark, sf):
    """Two hops, none, and one, behind one trusted proxy."""
    n, last = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    forwarded = F.when(n == 0, F.concat(F.lit("1.1.1.1, 2.2.2."), last)).when(n == 1, "").otherwise(F.concat(F.lit(" 3.3.3."), last))
    return table(spark, sf, "part").select("p_partkey", text.client_ip(forwarded, F.lit("9.9.9.9"), 1).alias("ip"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN 2 WHEN 2 THEN p_size % 25 + 1 WHEN 3 THEN p_size % 25 + 1 END AS surah, CASE p_partkey % 5 WHEN 0 THEN p_partkey % 200 + 1 WHEN 1 THEN 255 WHEN 2 THEN p_size WHEN 3 THEN p_size END AS ayah FROM part""")
def verse_references(spark, sf):
    """References by number, by a verse's own name, by a chapter's name with and without fillers, and none."""
    name = lambda n: F.concat(F.lit("سم"), base_word(n))
    names = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("number"), name(F.col("n_nationkey")).alias("name"))
    n, size, mine = F.col("p_partkey"), F.col("p_size").cast("string"), name(F.col("p_size") % 25)
    q = F.when(n % 5 == 0, F.concat_ws(":", size, (n % 200 + 1).cast("string"))).when(n % 5 == 1, "ايه الكرسي").when(n % 5 == 2, F.concat(F.lit("سوره "), mine, F.lit(" ايه "), size)).when(n % 5 == 3, F.concat_ws(" ", mine, size)).otherwise("nothing")
    df = table(spark, sf, "part").select("p_partkey", q.alias("q")).withColumn("n", text.named_reference(F.col("q"))).join(names, F.col("n.name") == F.col("name"), "left")
    named = F.when(F.col("number").isNotNull(), F.struct(F.col("number").alias("surah"), F.col("n.ayah").alias("ayah")))
    return df.withColumn("r", F.coalesce(text.numeric_reference(F.col("q")), text.famous_reference(F.col("q")), named)).select("p_partkey", "r.surah", "r.ayah")


@query("""SELECT p_partkey, CASE WHEN e < 1000 THEN 'too_short' WHEN e > 900000 THEN 'outside' WHEN v AND e > 300000 THEN 'video_too_long' ELSE 'ok' END AS verdict FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 40 ELSE p_size * 20000 END AS e, p_partkey % 2 = 0 AS v FROM part)""")
def clip_verdicts(spark, sf):
    end = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 40).otherwise(F.col("p_size") * 20_000)
    return table(spark, sf, "part").select("p_partkey", text.clip_verdict(F.lit(0), end, F.lit(900_000), F.col("p_partkey") % 2 == 0).alias("verdict"))


@query("SELECT p_partkey, p_name || ' [' || p_size || '] b[' || p_partkey || ']' AS clean FROM part")
def strip_marker_cases(spark, sf):
    """A marker, and another that is repeated at once."""
    two = F.concat(F.lit("[p"), F.col("p_partkey").cast("string"), F.lit("]"))
    raw = F.concat("p_name", F.lit(" [p"), F.col("p_size").cast("string"), F.lit("] b"), two, F.lit(" "), two)
    return table(spark, sf, "part").select("p_partkey", text.strip_markers(raw).alias("clean"))


@query("SELECT '<url><loc>https://example.com/o/' || o_orderkey || '?a=1&amp;b=' || o_orderpriority || '</loc><lastmod>' || strftime(o_orderdate, '%Y-%m-%d') || '</lastmod></url>' AS value FROM orders")
def sitemap_rows(spark, sf):
    o = table(spark, sf, "orders")
    return writers.sitemap_rows(o, F.concat(F.lit("https://example.com/o/"), F.col("o_orderkey").cast("string"), F.lit("?a=1&b="), F.col("o_orderpriority")), F.col("o_orderdate"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_roundtrip(spark, sf):
    n = table(spark, sf, "nation")
    return writers.json_lines(n, ["n_nationkey"]).select(F.from_json("value", "n_nationkey int, n_name string, n_regionkey int").alias("r")).select("r.*")


@query("SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events")
def json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t_ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
 f AS (SELECT user_id, event_id, k, true AS allowed, [t_ms] AS recent FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, len(list_filter(f.recent, lambda r: r > e.t_ms - 86400000)) < 2,
 CASE WHEN len(list_filter(f.recent, lambda r: r > e.t_ms - 86400000)) < 2 THEN list_append(list_filter(f.recent, lambda r: r > e.t_ms - 86400000), e.t_ms) ELSE list_filter(f.recent, lambda r: r > e.t_ms - 86400000) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
 SELECT user_id, event_id AS id, allowed FROM f""")
def rate_limit_window(spark, sf):
    e = table(spark, sf, "events").select("user_id", ms().alias("at"), F.col("event_id").alias("id"))
    return stateful.rate_limit(e, "user_id", 2, 86_400_000)


@query(SQL["rate_limit_window"])
def rate_limit_stream(spark, sf):
    """The same from a stream of the events' files, whose state lapses with the window."""
    e = table(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parque[t]")
    requests = stream.select("user_id", ms().alias("at"), F.col("event_id").alias("id"))
    return lapsing.collected(lapsing.rate_limit_stream(requests, "user_id", 2, 86_400_000), shared_folder(spark))


_RUNS = """runs AS (SELECT user_id % 50 AS segment, event_type AS stage, epoch_us(ts) // 1000 AS t, event_id AS id, ['running', 'completed', 'failed', 'skipped'][CAST(floor(abs(value)) AS BIGINT) % 4 + 1] AS status FROM events)"""


@query(f"""WITH RECURSIVE {_RUNS}, e AS (SELECT *, row_number() OVER (PARTITION BY segment, stage ORDER BY id) AS k FROM runs),
 f AS (SELECT segment, stage, 0::BIGINT AS k, NULL::BIGINT AS id, '' AS verdict, false AS busy, NULL::BIGINT AS seen FROM (SELECT DISTINCT segment, stage FROM e)
 UNION ALL SELECT segment, stage, k, id, verdict, CASE WHEN verdict = 'accepted' THEN status = 'running' ELSE busy END, CASE WHEN verdict = 'accepted' THEN t ELSE seen END
 FROM (SELECT e.segment, e.stage, e.k, e.id, e.status, e.t, f.busy, f.seen, CASE WHEN e.t < f.seen THEN 'late' WHEN (f.busy AND e.status IN ('completed', 'failed', 'skipped')) OR (NOT f.busy AND e.status IN ('running', 'failed')) THEN 'accepted' ELSE 'illegal' END AS verdict
 FROM f JOIN e ON e.segment = f.segment AND e.stage = f.stage AND e.k = f.k + 1))
 SELECT segment, stage, id, verdict FROM f WHERE k > 0""")
def run_log(spark, sf):
    """Events as the rows of runs, in order of arrival by their ids."""
    status = F.element_at(F.array(*(F.lit(s) for s in ("running", "completed", "failed", "skipped"))), (F.floor(F.abs("value")) % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("segment"), F.col("event_type").alias("stage"), ms().alias("at"), F.col("event_id").alias("id"), status.alias("status"), F.col("event_id").alias("seq"))
    return lapsing.run_log(rows)


@query("SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1")
def pipeline_log(spark, sf):
    return stateful.latest_status(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def top_central(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "documents").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    return d.where("r <= 5").select("source", "doc_id", "n_chars")


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus NOT IN ('F') ORDER BY o_custkey NULLS LAST, o_orderkey LIMIT 50")
def top_pending(spark, sf):
    return table(spark, sf, "orders").where(~F.col("o_orderstatus").isin("F")).orderBy(F.asc_nulls_last("o_custkey"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus", "o_custkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_suppkey LIMIT 20 OFFSET 20")
def ayah_page(spark, sf):
    return table(spark, sf, "supplier").orderBy("s_nationkey", "s_suppkey").offset(20).limit(20).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("SELECT p_brand, min_by(p_partkey, struct_pack(s := p_size, k := p_partkey)) AS first_key FROM part GROUP BY 1")
def locate_first(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("first_key"))


@query("SELECT p_partkey FROM part WHERE (p_size BETWEEN 3 AND 6 AND p_partkey % 10 = 1) OR (p_size BETWEEN 20 AND 22 AND p_partkey % 10 = 4)")
def or_of_ranges(spark, sf):
    refs = literals(spark, [(1, 3, 6), (4, 20, 22)], "surah long, a int, b int")
    p = table(spark, sf, "part")
    return p.join(F.broadcast(refs), (F.col("p_partkey") % 10 == F.col("surah")) & F.col("p_size").between(F.col("a"), F.col("b")), "left_semi").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IS NULL OR p_type IS DISTINCT FROM p_name OR p_size <> 7")
def stale_embeddings(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand").isNull() | ~F.col("p_type").eqNullSafe(F.col("p_name")) | (F.col("p_size") != 7)).select("p_partkey")
