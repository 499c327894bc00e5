"""Aggregations: children counted apart, tallies, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import numbered

# --- fixed values ---------------------------------------------------------------
PEAKS = 800
GATES = (("recall_at_8", 0.80, True), ("abstention_accuracy", 0.90, True), ("citation_validity", 0.95, True), ("unsupported_ratio", 0.05, False), ("latency_p95_ms", 15_000.0, False))
RECALL_AT = 8
TOPIC_CHUNKS = 100
# ----------------------------------------------------------------------------------


def two_children(parent: DataFrame, key: str, first: DataFrame, first_key: str, first_id: str, second: DataFrame, second_key: str, measure: str) -> DataFrame:
    """For each parent the number of distinct first children and the bounds of the second ones. Each child is summed before its join, so rows never multiply."""
    a = first.groupBy(F.col(first_key).alias(key)).agg(F.countDistinct(first_id).alias("n_first"))
    b = second.groupBy(F.col(second_key).alias(key)).agg(F.min(measure).alias("least"), F.max(measure).alias("most"))
    return parent.select(key).join(a, key, "left").join(b, key, "left").select(key, F.coalesce("n_first", F.lit(0)).alias("n_first"), "least", "most")


def joined_text(words: DataFrame, key: str) -> DataFrame:
    """Words to text in order, their number, and, of words with a ``confidence``, the mean of those that are there."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    mean = [F.avg("confidence").alias("confidence")] if "confidence" in words.columns else []
    return words.groupBy(key).agg(text.alias("text"), F.count("*").alias("n_words"), *mean)


def mapping_totals(ranges: DataFrame, size: str) -> DataFrame:
    """Of the records of a mapping: files, chapters and bytes."""
    return ranges.agg(F.count("*").alias("files"), F.countDistinct("chapter").alias("chapters"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def whole_mapping(ranges: DataFrame) -> DataFrame:
    """One map from chapter to its map from verse to key, as a manifest holds it; at most a few thousand verses exist."""
    return nested_mapping(ranges).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chapter", F.map_entries("verses").alias("verses"))))).alias("chapters"))


def batch_stats(files: DataFrame, folder: str, source_title: str, kind: str) -> DataFrame:
    """(created, problem) of a batch's files to the JSON that its log row holds: what was accepted and created, what could not be parsed and what failed."""
    n = lambda c: F.count_if(c)
    stats = F.struct(
        F.lit(folder).alias("folder"), F.lit(source_title).alias("source_title"), F.lit(kind).alias("kind"), n(F.col("problem").isNull()).alias("accepted"),
        n(F.col("problem").isNull() & F.col("created")).alias("created"), n(F.col("problem") == "unparseable").alias("unparseable"), n(F.col("problem") == "failed").alias("failed"),
    )
    return files.agg(stats.alias("s")).select(F.to_json("s").alias("stats"))


def topic_counts(topics: DataFrame, links: DataFrame) -> DataFrame:
    """Published topics with the number of their passages, also those without any."""
    n = links.groupBy("topic").agg(F.count("*").alias("n"))
    return topics.where("is_published").join(n, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def topic_chunks(topics: DataFrame, links: DataFrame, limit: int = TOPIC_CHUNKS) -> DataFrame:
    """Of each published topic the first passages by score, then chunk, beside the topic's real size. A topic's best are found by a
    window that Spark limits in each task before the shuffle; the size is summed apart."""
    mine = links.join(topics.where("is_published").select("topic"), "topic", "left_semi")
    best = mine.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "chunk"))).where(F.col("place") <= limit)
    return best.join(topic_counts(topics, links), "topic").select("topic", "chunk", "score", "place", "chunk_count")


def nested_mapping(ranges: DataFrame) -> DataFrame:
    """(record, chapter, first, last, key) → for each chapter a map from verse to key; the last record wins where ranges overlap."""
    rows = ranges.select("chapter", F.explode(F.sequence("first", "last")).alias("verse"), "record", "key")
    last = rows.groupBy("chapter", "verse").agg(F.max_by("key", "record").alias("key"))
    return last.groupBy("chapter").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("verse", "key")))).alias("verses"))


def peaks(samples: DataFrame, order: list[str], value: str, n: int = PEAKS) -> DataFrame:
    """Greatest magnitude of each of n buckets (the first ones take what does not divide), over the loudest, to four digits; empty ones are 0.

    Buckets come from each row's place in the order.
    """
    placed = numbered(samples.select(*order, F.abs(value).alias("v")), order, "place", "total")
    i, q, r = F.col("place") - 1, F.floor(F.col("total") / n), F.col("total") % n
    bucket = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1))))
    loud = placed.select(bucket.cast("long").alias("bucket"), "v").groupBy("bucket").agg(F.max("v").alias("v"))
    every = samples.sparkSession.range(n).select(F.col("id").alias("bucket")).join(loud, "bucket", "left")
    top = F.max("v").over(Window.partitionBy())
    return every.select("bucket", F.coalesce(F.when(top > 0, F.round(F.col("v") / top, 4)), F.lit(0.0)).alias("peak"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """For each name of ``at`` the element at index round(p / 100 * n + 0.5) - 1 (half to even), clamped, of each group's values that are not null. By places in one
    distributed sort, so that no group is gathered; without keys one row, zeros of nothing."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    placed = numbered(rows, [*keys, "_v"], "_place", "_total")
    groups = placed.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    joined = placed.join(groups, keys) if keys else placed.crossJoin(F.broadcast(groups))  # one row
    index = lambda p: F.least(F.greatest(F.bround(F.lit(p / 100) * F.col("_n") + 0.5, 0).cast("long") - 1, F.lit(0)), F.col("_n") - 1)
    picked = [F.max(F.when(F.col("_place") - F.col("_first") == index(p), F.col("_v"))) for p in at.values()]
    return joined.groupBy(*keys).agg(*((x if keys else F.coalesce(x, F.lit(0.0))).alias(n) for n, x in zip(at, picked, strict=True)))


def first_hits(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """Of each question of ``expected`` (question, id) the rank of the first expected id in ``ranked`` (question, id, rank), or null."""
    return expected.join(ranked, ["question", "id"], "left").groupBy("question").agg(F.min("rank").alias("hit_rank"))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Mean recall at k (1 for a question with any expected id among the first k) and mean reciprocal rank over the questions of ``expected``."""
    first = F.col("hit_rank")
    recall, mrr = F.avg(F.coalesce((first <= k).cast("double"), F.lit(0.0))), F.avg(F.coalesce(1 / first, F.lit(0.0)))
    return first_hits(expected, ranked).agg(F.round(F.coalesce(recall, F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(mrr, F.lit(0.0)), 6).alias("mrr"))


def abstention(df: DataFrame, expected: str, actual: str) -> DataFrame:
    return df.agg(F.round(F.avg(((F.col(expected) == "not_found") == (F.col(actual) == "not_found")).cast("double")), 6).alias("abstention"))


def confusion(df: DataFrame, expected: str, actual: str) -> DataFrame:
    return df.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))


def summarize(runs: DataFrame, k: int = RECALL_AT) -> DataFrame:
    """One report row of (expected_status, status, error, hit_rank, citations, citations_dropped, judged, sentences, unsupported, contradicted, latency_ms,
    cost_usd). Errors only count as such; recall is over questions that have an answer, support over runs that were judged."""
    ok, label = ~F.col("error"), ~F.col("error") & (F.col("expected_status") != "not_found")
    judged = ok & F.col("judged")
    total = lambda c, where=ok: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    ratio = lambda a, b, digits=4: F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)
    n_ok = F.count_if(ok)
    hit = F.when(label, F.coalesce((F.col("hit_rank") <= k).cast("double"), F.lit(0.0)))
    right = (F.col("expected_status") == "not_found") == (F.col("status") == "not_found")
    cost = F.coalesce(F.sum(F.when(ok, F.col("cost_usd").cast("decimal(18,9)"))), F.lit(0).cast("decimal(28,9)"))
    report = runs.agg(
        F.count("*").alias("n"), F.count_if(F.col("error")).alias("errors"), F.count_if(label).alias("labelled"), F.round(F.avg(hit), 4).alias(f"recall_at_{k}"),
        F.round(F.avg(F.when(label, F.coalesce(1 / F.col("hit_rank"), F.lit(0.0)))), 4).alias("mrr"), F.round(F.avg(F.when(ok, right.cast("double"))), 6).alias("abstention_accuracy"),
        ratio(total("citations"), total("citations") + total("citations_dropped")).alias("citation_validity"), ratio(total("citations"), n_ok, 2).alias("citations_per_answer"),
        F.count_if(judged).alias("judged"), ratio(total("unsupported", judged), total("sentences", judged)).alias("unsupported_ratio"), total("contradicted", judged).alias("contradicted"),
        cost.alias("cost_usd"), F.bround(F.try_divide(cost, n_ok), 6).cast("decimal(28,6)").alias("cost_per_query_usd"),
    )
    return report.crossJoin(F.broadcast(percentiles(runs.where(ok), [], "latency_ms", {"latency_p50_ms": 50, "latency_p95_ms": 95})))  # one row each


def gates(report: DataFrame) -> DataFrame:
    """(metric, value) → verdict: true, false, or null without a value."""
    spark = report.sparkSession
    g = spark.createDataFrame(GATES, "metric string, threshold double, at_least boolean")
    v = F.when(F.col("value").isNotNull(), F.when(F.col("at_least"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")))
    return F.broadcast(g).join(report, "metric", "left").select("metric", "value", "threshold", v.alias("passed"))


def evaluate(golden: DataFrame, ranked: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report and the gates of a set of questions: golden (question, expected_status, expected ids), what retrieval ranked (question, id, rank), and what each run gave (the rest of
    ``summarize``'s columns by question; a question without a run is an error)."""
    hits = first_hits(golden.select("question", F.explode("expected").alias("id")), ranked)
    rows = golden.select("question", "expected_status").join(hits, "question", "left").join(runs, "question", "left").withColumn("error", F.coalesce("error", F.lit(True)))
    report = summarize(rows)
    named = report.select(F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m, *_ in GATES)), F.array(*(F.col(m).cast("double") for m, *_ in GATES)))).alias("metric", "value"))
    return report, gates(named)


def daily_spend(events: DataFrame, ts: str, cost: Column) -> DataFrame:
    """Micro-units per UTC day; each event is truncated before the sum."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.sum(F.floor(cost * 1_000_000).cast("long")).alias("micros"))


def over_budget(spend: DataFrame, daily_usd: float) -> DataFrame:
    """Days whose micro-units reach the budget."""
    return spend.withColumn("over_budget", F.col("micros") >= F.lit(int(round(daily_usd * 1_000_000))))
