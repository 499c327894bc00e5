"""Range, as-of, nearest, reconciling and ordered joins.

Range joins carry an equality key, or bucket the spans, so that none plans as a nested loop over everything.
As-of joins are one sort per key: both sides are unioned and the last value is carried by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covering(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """Spans whose closed range holds the point; a span with a null end holds nothing."""
    return points.join(spans, (points[key] == spans[key]) & (points[at] >= spans[low]) & (points[at] <= spans[high])).drop(spans[key])


def covering_first(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, by: list[str], point_id: str, span_id: str, most: int = 5) -> DataFrame:
    """For each point the number of spans and the ids of the first ``most`` in order. Points at the same place are asked for once, and of a place's spans only the first are gathered."""
    hits = covering(points.select(key, at).distinct(), spans, key, at, low, high)
    totals = hits.groupBy(key, at).agg(F.count("*").alias("total"))
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy(key, at).orderBy(*by))).where(F.col("place") <= most)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(span_id).cast("string").alias("s")))), lambda x: x["s"]), ",")
    got = totals.join(first.groupBy(key, at).agg(ids.alias("first_ids")), [key, at])
    return points.select(point_id, key, at).join(got, [key, at], "left").select(point_id, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("first_ids", F.lit("")).alias("first_ids"))


def covering_least(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, point_id: str) -> DataFrame:
    """``covering`` for the least point that any span covers: of the points at one place only the least is asked for."""
    places = points.groupBy(key, at).agg(F.min(point_id).alias(point_id))
    least = covering(places, spans, key, at, low, high).agg(F.min(point_id).alias(point_id))  # one row
    return covering(points.join(F.broadcast(least), point_id), spans, key, at, low, high)


def bucketed_overlap(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re: str, width: int, closed: bool = False) -> DataFrame:
    """Overlapping intervals by equality on (key, bucket of ``width``): a pair is kept in its first common bucket only."""
    spread = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width))))
    lhs, rhs = spread(left, ls, le, "lb"), spread(right, rs, re, "rb")
    meet = (lhs[ls] <= rhs[re]) & (lhs[le] >= rhs[rs]) if closed else (lhs[ls] < rhs[re]) & (lhs[le] > rhs[rs])
    first = F.col("lb") == F.floor(F.greatest(lhs[ls], rhs[rs]) / width)
    return lhs.join(rhs, (lhs[key] == rhs[key]) & (F.col("lb") == F.col("rb")) & meet & first).drop(rhs[key]).drop("lb", "rb")


def _carried(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: Column, forward: bool, strict: bool = False) -> DataFrame:
    """Each point with ``found``: the value of the last mark at or before it, or of the first at or after it (strict: past it)."""
    cols = points.columns
    p = points.select(*cols, F.col(at).alias("_t"), F.lit(None).cast(marks.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_point"))
    m = marks.select(*(F.col(key).alias(c) if c == key else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols), F.col(mark_at).alias("_t"), value.alias("_v"), F.lit(0).alias("_point"))
    # at equal times marks come before the points that may see them
    tie = F.col("_point") if not strict else -F.col("_point")
    order = Window.partitionBy(key).orderBy(F.col("_t").desc() if forward else F.col("_t"), tie, *([F.col("_v").desc()] if forward else [F.col("_v")]))
    seen = F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return p.unionByName(m).withColumn("found", seen).where("_point = 1").select(*cols, "found")


def asof(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: Column) -> DataFrame:
    return _carried(points, marks, key, at, mark_at, value, forward=False)


def next_of(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: Column) -> DataFrame:
    """The first mark strictly after the point."""
    return _carried(points, marks, key, at, mark_at, value, forward=True, strict=True)


def nearest_word(points: DataFrame, words: DataFrame, key: str, at: str) -> DataFrame:
    """The idx of the word that holds ``at``, else the one with the nearer edge; a tie goes forward."""
    word = F.struct("start_ms", "end_ms", "idx")
    both = next_of(asof(points, words, key, at, "start_ms", word).withColumnRenamed("found", "before"), words, key, at, "start_ms", word)
    back, ahead = F.col(at) - F.col("before.end_ms"), F.col("found.start_ms") - F.col(at)
    pick = F.when(F.col("before").isNull(), F.col("found.idx")).when(F.col(at) < F.col("before.end_ms"), F.col("before.idx")).when(F.col("found").isNull() | (back < ahead), F.col("before.idx")).otherwise(F.col("found.idx"))
    return both.withColumn("nearest_idx", pick).drop("before", "found")


def points_in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, width: int | None = None) -> DataFrame:
    """Pairs of a point and a span (columns of their own names, but for the key) of its key that holds it, low <= at < high.

    A span lies in every bucket of ``width`` that it touches, a point in one, and they meet on (key, bucket). The width is the mean length of a span if none
    is given: then spans take three places each at most on average, and a point meets those near it only, not all of its key. Empty spans hold nothing.
    """
    real = spans.where(F.col(low) < F.col(high))
    if width is None:
        mean = real.agg(F.avg(F.col(high) - F.col(low))).first()[0]
        width = max(1, int(mean or 1))
    spread = real.withColumnRenamed(key, "_k").withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    placed = points.withColumn("_a", F.floor(F.col(at) / width))
    met = placed.join(spread, (placed[key] == spread["_k"]) & (F.col("_a") == F.col("_b")) & (placed[at] >= spread[low]) & (placed[at] < spread[high]))
    return met.drop("_k", "_a", "_b")


def nearest_chunk(points: DataFrame, chunks: DataFrame, key: str, at: str) -> DataFrame:
    """Each point (a word's index) with the chunk (pos, word_start, word_end) of its key that holds it, the first by pos of several, else the nearest by index; a tie goes to the
    first by pos. Chunks with a null range hold nothing. A point that no chunk holds lies past or before each of them, so the nearest are the last that ends before it and the first that starts
    behind it: one sort for each, as in the other as-of joins."""
    real = chunks.where("word_start IS NOT NULL AND word_end IS NOT NULL").select(F.col(key), F.col("pos").cast("long").alias("pos"), "word_start", "word_end")
    bounds = real.select(key, F.col("pos").alias("_p"), F.col("word_start").alias("_s"), (F.col("word_end") + 1).alias("_e"))
    inside = points_in_spans(points.select(key, at).distinct(), bounds, key, at, "_s", "_e").groupBy(key, at).agg(F.min("_p").alias("_in"))
    before = asof(points, real, key, at, "word_end", F.struct("word_end", (-F.col("pos")).alias("p"))).withColumnRenamed("found", "_before")
    both = next_of(before, real, key, at, "word_start", F.struct("word_start", "pos"))
    back = F.struct((F.col(at) - F.col("_before.word_end")).alias("gap"), (-F.col("_before.p")).alias("pos"))
    ahead = F.struct((F.col("found.word_start") - F.col(at)).alias("gap"), F.col("found.pos").alias("pos"))
    near = F.least(F.when(F.col("_before").isNotNull(), back), F.when(F.col("found").isNotNull(), ahead))["pos"]
    held = both.withColumn("_near", near).alias("b").join(inside.alias("i"), (F.col(f"b.{key}") == F.col(f"i.{key}")) & (F.col(f"b.{at}") == F.col(f"i.{at}")), "left")
    return held.select(*(F.col(f"b.{c}") for c in points.columns), F.coalesce("_in", "_near").alias("chunk"))


def nearest_mark(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, within: int) -> DataFrame:
    """Each point with ``snapped``: the nearest mark of its key at most ``within`` away, the earlier of two as near, else its own time."""
    both = next_of(asof(points, marks, key, at, mark_at, F.col(mark_at)).withColumnRenamed("found", "_before"), marks, key, at, mark_at, F.col(mark_at))
    side = lambda m: F.when(F.abs(m - F.col(at)) <= within, F.struct(F.abs(m - F.col(at)).alias("gap"), m.alias("mark")))
    return both.withColumn("snapped", F.coalesce(F.least(side(F.col("_before")), side(F.col("found")))["mark"], F.col(at))).drop("_before", "found")


#: Markers of a division at most.
MOST_MARKERS = 10_000


def division_of(verses: DataFrame, markers: DataFrame) -> DataFrame:
    """1-based number of the last marker (surah, ayah) at or before each verse; a verse before the first fails.

    Markers are a few hundred rows: they are an ordered literal array, checked on the driver.
    """
    rows = [(r["surah"], r["ayah"]) for r in markers.orderBy("number").limit(MOST_MARKERS + 1).collect()]
    if len(rows) > MOST_MARKERS:
        raise ValueError("too many markers")
    if rows != sorted(set(rows)):
        raise ValueError("markers are not in order")
    starts = F.array(*(F.struct(F.lit(s).alias("surah"), F.lit(a).alias("ayah")) for s, a in rows))
    verse = F.struct(F.col("surah").cast("int").alias("surah"), F.col("ayah").cast("int").alias("ayah"))
    before = F.size(F.filter(starts, lambda m: m <= verse)) if rows else F.lit(0)
    return verses.withColumn("division", F.when(before > 0, before).otherwise(F.raise_error(F.lit("verse before the first marker")).cast("int")))


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Action of each key: created, updated, unchanged or kept (only in old), with the merged fields."""
    o = old.select(*keys, F.struct(*fields).alias("_old"))
    n = new.select(*keys, F.struct(*fields).alias("_new"))
    joined = o.join(n, keys, "full_outer")
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return joined.select(*keys, action.alias("action"), *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f"_old.{f}")).alias(f) for f in fields))


def reconcile_records(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], order: str, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of an import, record by record: a record with a ``problem``, or a null in its key, fails alone and changes nothing; of several good ones of a key the last in order counts.

    rows: as ``reconcile`` gives them; failures: (*keys, order, problem)."""
    lacks = F.concat(F.lit("no "), F.concat_ws(", ", *(F.when(F.col(k).isNull(), F.lit(k)) for k in keys)))
    judged = new.withColumn("problem", F.when(F.array_contains(F.array(*(F.col(k).isNull() for k in keys)), True), lacks).otherwise(problem))
    last = judged.where("problem IS NULL").groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_last")).select(*keys, "_last.*")
    return reconcile(old, last, keys, fields), judged.where("problem IS NOT NULL").select(*keys, order, "problem")


def three_state(records: DataFrame, listing: DataFrame, key: str, sha: str, keep: str) -> DataFrame:
    """matched, mismatched or missing for each record; a key may have several candidates; a match lends ``keep``."""
    l = listing.select(F.col(key), F.col(sha).alias("_sha"), F.col(keep).alias("_keep"))  # noqa: E741
    pairs = records.join(l, key, "left")
    same = F.coalesce(F.col(sha) == F.col("_sha"), F.lit(False))
    out = pairs.groupBy(*records.columns).agg(F.max(same).alias("_m"), F.count("_sha").alias("_n"), F.min(F.when(same, F.col("_keep"))).alias("borrowed"))
    return out.select(*records.columns, F.when(F.col("_m"), "matched").when(F.col("_n") > 0, "mismatched").otherwise("missing").alias("state"), "borrowed")


def carry_over(rows: DataFrame, existing: DataFrame, digest: str, order: str, value: str) -> DataFrame:
    """Values carried to rebuilt rows of equal digest; the last existing row of a digest wins."""
    last = existing.groupBy(digest).agg(F.max_by(value, order).alias(value))
    return rows.join(last, digest, "left")


def in_rank_order(ranked: DataFrame, rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Rows of the ranked ids that exist, in the order given."""
    return ranked.join(rows, key).orderBy(rank, key)


def listing_difference(source: DataFrame, target: DataFrame, key: str, size: str) -> DataFrame:
    """copy where absent, replace where the size differs, same, or extra."""
    s, t = source.select(key, F.col(size).alias("_s")), target.select(key, F.col(size).alias("_t"))
    status = F.when(F.col("_t").isNull(), "copy").when(F.col("_s").isNull(), "extra").when(F.col("_s") != F.col("_t"), "replace").otherwise("same")
    return s.join(t, key, "full_outer").select(key, status.alias("status"))
