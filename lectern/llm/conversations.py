"""Operator 11: cheapest repair of damaged conversations, as a fold over sorted turns.

Faults are flags that windows derive; the turns of a conversation are collected as sorted structs, and
``aggregate()`` carries four (cost, audit) structs, one for each state of the automaton of ``(s?(ua)+)?``:
nothing yet, after the system turn, after a user turn, after an assistant turn. ``least`` over these structs takes
the cheapest, ties by the audit in ASCII order. That order may be taken state by state: of two audits of equal
cost that have passed the same turns neither is a proper prefix of the other, as what the longer one has more
would be insertions, which cost. Equal turns are one struct with a count. All of it is column expressions.

Letters of an audit inside the fold tell more than the public ones: I and J insert a user and an
assistant turn, R and S change a role to these, C deletes a further copy. Where two audits first differ they
have passed the same turns into the same state, so the finer letters sort as the public ones do.

A conversation beyond ``LONG`` rows or ``LONG_BYTES`` of text is never gathered. Its turns are sorted over
all tasks and cut into blocks; a block folds to a matrix of (cost, audit) for each pair of states, matrices are
multiplied ``FAN`` at a time, and the way back down gives each block its two states. Only SHA-256, which reads its
input in order, passes such a conversation's text through one task, a block at a time (in Python).

Defined results: a null role or text is a space; a null ``turn`` sorts first and counts in no gap; a null
``conv_id`` is a conversation of its own; turns of the same number are in order of role, then text, as
bytes; repeated rows are repeated turns; a role is its initial, so one that is none of s, u and a must be
changed or deleted; long texts are passed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import checkpoints

#: A conversation of more rows or bytes than these is folded in blocks.
LONG = 1024
LONG_BYTES = 16 << 20
#: Turns of a block (one counts more by its bytes), and matrices multiplied in one row.
BLOCK = 256
FAN = 32
#: The cost of a state that cannot be reached.
FAR = 1 << 40

VISIBLE = "[^\\x20\\x09-\\x0D]"


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): a row stands for n equal adjacent turns; a dropped row stays with n = 0 and no text."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _flags(rows: DataFrame, seen: Column) -> DataFrame:
    """What the text of a turn and ``seen`` (an earlier turn is equal) say: initial, blank, twin, cut (ends without a mark), gone."""
    flagged = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("blank", ~F.col("text").rlike(VISIBLE)).withColumn("twin", ~F.col("blank") & seen)
    whole = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    return flagged.withColumn("gone", F.col("blank") | F.col("twin")).withColumn("cut", (~F.col("gone") & ~whole).cast("long"))


def _grown(state: Column, letters: Column, cost: Column) -> Column:
    return F.struct((state["c"] + cost).alias("c"), F.concat(state["s"], letters).alias("s"))


def _named(*states: Column) -> Column:
    return F.struct(*(s.alias(f"q{k}") for k, s in enumerate(states)))


def _at(cost: int, letters: str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("c"), F.lit(letters).alias("s"))


def _inserted(q: Column) -> Column:
    """The states closed under insertions."""
    user = F.least(q["q2"], _grown(F.least(q["q0"], q["q1"], q["q3"]), F.lit("I"), F.lit(2)))
    return _named(q["q0"], q["q1"], user, F.least(q["q3"], _grown(user, F.lit("J"), F.lit(2))))


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _turn(q: Column, x: Column) -> Column:
    """The four states after the turn ``x``."""
    copies, extra = F.repeat(F.lit("C"), (x["n"] - 1).cast("int")), 3 * (x["n"] - 1)
    gone = lambda s: _grown(s, F.concat(F.lit("D"), copies), 3 + extra)

    def to(state: Column, role: str, change: str) -> Column:
        same = x["initial"] == role
        return F.when(~x["gone"], _grown(state, F.concat(F.when(same, "K").otherwise(change), copies), F.when(same, 0).otherwise(2) + x["cut"] + extra))

    system = F.when(~x["gone"] & (x["initial"] == "s"), _grown(q["q0"], F.concat(F.lit("K"), copies), x["cut"] + extra))
    after = _named(gone(q["q0"]), F.least(gone(q["q1"]), system), F.least(gone(q["q2"]), to(F.least(q["q0"], q["q1"], q["q3"]), "u", "R")), F.least(gone(q["q3"]), to(q["q2"], "a", "S")))
    return _let(after, _inserted)


#: The states before the first turn: nothing, or turns inserted.
_START = ((0, ""), (FAR, ""), (2, "I"), (4, "IJ"))


def _lines(audit: Column, rows: Column) -> Column:
    """The repaired turns, each after a line feed; ``audit`` has its inner letters."""

    def piece(edits: Column, row: Column) -> Column:
        last = F.right(edits, F.lit(1))
        new = F.replace(F.replace(F.regexp_replace(edits, "[CDKRS]", ""), F.lit("I"), F.lit("\nuser:")), F.lit("J"), F.lit("\nassistant:"))
        role = F.when(last == "K", row["role"]).when(last == "R", "user").when(last == "S", "assistant")
        return F.concat(new, F.coalesce(F.concat(F.lit("\n"), role, F.lit(":"), row["text"]), F.lit("")))

    return F.array_join(F.zip_with(F.split(audit, "(?<=[DKRS])"), rows, piece), "")


def _public(audit: Column) -> Column:
    return F.translate(audit, "CJS", "DIR")


def _counts() -> tuple[Column, ...]:
    twice = F.col("n") - (~F.col("twin")).cast("long")
    return F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(twice)).alias("duplicate"), F.sum("cut").alias("truncated")


def _illegal(before: Column) -> Column:
    """Adjacent pairs that end in this row, its own copies included."""
    return F.greatest(F.col("n") - 1, F.lit(0)) + F.when(before.isNull() | F.concat(before, F.col("initial")).isin("su", "ua", "au"), 0).otherwise(1)


def _repaired_short(rows: DataFrame) -> DataFrame:
    """All of it in one exchange by ``conv_id``; windows and groups share it. Rows with n = 0 count for nothing."""
    turn, real = F.col("turn").asc_nulls_first(), F.col("n") > 0
    dealt = rows.repartition("conv_id").withColumn("real", real)
    rank = F.row_number().over(Window.partitionBy("conv_id", "real", "role", "text").orderBy(turn))
    flagged = _flags(dealt.withColumn("rank", rank), F.col("rank") > 1)
    run = Window.partitionBy("conv_id", "real").orderBy(turn, "role", "text")
    placed = flagged.withColumn("pos", F.row_number().over(run)).withColumn("before", F.lag("initial").over(run)).withColumn("turn_before", F.lag("turn").over(run))
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    folded = placed.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(new_turn.cast("long")), F.lit(0)).alias("gaps"), *_counts(), F.sum(_illegal(F.col("before"))).alias("illegal"),
        F.array_sort(F.collect_list(F.when(F.col("real"), F.struct("pos", "initial", "gone", "cut", "n", "role", "text")))).alias("turns"),
    )
    ends = F.aggregate("turns", _named(*(_at(*s) for s in _START)), _turn)
    best = folded.withColumn("ends", ends).withColumn("best", F.least("ends.q0", "ends.q3"))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), _public(F.col("best.s")).alias("audit"), F.sha2(F.substring(_lines(F.col("best.s"), F.col("turns")), 2, 1 << 30), 256).alias("repaired_sha256"))


def _matrix(cell) -> Column:
    return F.array(*(F.array(*(cell(s, e) for e in range(4))) for s in range(4)))


def _product(a: Column, b: Column) -> Column:
    both = lambda x, y: F.struct((x["c"] + y["c"]).alias("c"), F.concat(x["s"], y["s"]).alias("s"))
    return _matrix(lambda s, e: F.least(*(both(a[s][m], b[m][e]) for m in range(4))))


def _way(entry: Column, exit_: Column, matrices: Column) -> Column:
    """The states after each of the matrices on the best way from ``entry`` to ``exit_``."""

    def merge(acc: Column, m: Column) -> Column:
        step = lambda a, b, e: F.struct((a["c"] + b["c"]).alias("c"), F.concat(a["s"], b["s"]).alias("s"), F.concat(a["way"], F.array(F.lit(e))).alias("way"))
        return F.array(*(F.least(*(step(acc[k], m[k][e], e) for k in range(4))) for e in range(4)))

    none = F.array().cast("array<int>")
    first = F.array(*(F.struct(F.when(entry == k, 0).otherwise(FAR).cast("long").alias("c"), F.lit("").alias("s"), none.alias("way")) for k in range(4)))
    return F.get(F.aggregate(matrices, first, merge), exit_)["way"]


def _hashed(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's lines in order, without the first line feed; lines come sorted by (conv, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, digest = None, False, hashlib.sha256()
        for batch in batches:
            for conv, text in zip(batch.column(0), batch.column(1), strict=True):
                key, piece = (conv.as_py(),), text.as_py().encode()
                if held is not None and key != held:
                    yield pa.RecordBatch.from_arrays([pa.array([held[0]], batch.column(0).type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])
                    begun, digest = False, hashlib.sha256()
                held = key
                digest.update(piece if begun else piece[1:])
                begun = begun or bool(piece)
                kind = batch.column(0).type
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    kind = lines.schema["conv_id"].dataType.simpleString()
    return lines.select("conv_id", "lines").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _repaired_long(rows: DataFrame) -> DataFrame:
    """The same rows for conversations that are too long to be gathered."""
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).where("n > 0").withColumn("digest", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = distinct.groupBy("conv_id", "digest").agg(F.min(place).alias("first"))
    seen = distinct.alias("a").join(first.alias("b"), same("a", "b", "conv_id", "digest")).select("a.*", "b.first").withColumn("seen", place > F.col("first"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_ = _flags(seen, F.col("seen")).repartitionByRange("conv_id", order[0], "role", F.left("text", F.lit(64))).withColumn("part", F.spark_partition_id())
    run = Window.partitionBy("conv_id", "part").orderBy(*order)
    placed = sorted_.withColumn("pos", F.row_number().over(run)).withColumn("before", F.lag("initial").over(run))
    weight = F.sum(1 + (F.octet_length("text") / 4096).cast("long")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("block", (weight / BLOCK).cast("long")).checkpoint()

    turns = F.array_sort(F.collect_list(F.struct("pos", "initial", "gone", "cut", "n")))
    blocks = placed.groupBy("conv_id", "part", "block").agg(turns.alias("turns"), F.sum(_illegal(F.col("before"))).alias("illegal"), F.min_by("initial", "pos").alias("head"), F.max_by("initial", "pos").alias("tail"), *_counts())
    ways = F.array(*(F.aggregate("turns", _named(*(_at(0 if s == k else FAR, "") for s in range(4))), _turn) for k in range(4)))
    numbered = blocks.withColumn("matrix", _let(ways, lambda w: _matrix(lambda s, e: w[s][f"q{e}"]))).drop("turns").checkpoint()
    run = Window.partitionBy("conv_id").orderBy("part", "block")
    places = numbered.select("conv_id", "part", "block", "head", "tail").withColumn("k", F.row_number().over(run) - 1).withColumn("past", F.lag("tail").over(run)).withColumn("past_part", F.lag("part").over(run))
    across = F.when((F.col("past_part") != F.col("part")) & ~F.concat("past", "head").isin("su", "ua", "au"), 1).otherwise(0)
    level = numbered.alias("a").join(places.withColumn("across", across).drop("head", "tail").alias("b"), same("a", "b", "conv_id", "part", "block")).select("a.*", "b.k", "b.across").checkpoint()
    counts = level.groupBy("conv_id").agg(F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum(F.col("illegal") + F.col("across")).alias("illegal"))

    levels = [level]
    while levels[-1].where("k > 0").head(1):
        group = levels[-1].groupBy("conv_id", F.floor(F.col("k") / FAN).cast("int").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "matrix"))).alias("parts"))
        unit = _matrix(lambda s, e: _at(0 if s == e else FAR, ""))
        levels.append(group.select("conv_id", "k", F.aggregate("parts", unit, lambda acc, p: _product(acc, p["matrix"])).alias("matrix")).checkpoint())
    begin = F.array(*(_at(*s) for s in _START))
    reached = lambda s, e: F.struct((begin[s]["c"] + F.col("matrix")[s][e]["c"]).alias("c"), F.concat(begin[s]["s"], F.col("matrix")[s][e]["s"]).alias("s"), F.lit(s).alias("entry"), F.lit(e).alias("exit"))
    top = levels[-1].select("conv_id", "k", F.least(*(reached(s, e) for s in range(4) for e in (0, 3))).alias("best")).checkpoint()
    chosen = top.select("conv_id", "k", "best.entry", "best.exit")
    for lower in reversed(levels[:-1]):
        group = lower.groupBy("conv_id", F.floor(F.col("k") / FAN).cast("int").alias("up")).agg(F.array_sort(F.collect_list(F.struct("k", "matrix"))).alias("parts"))
        found = group.alias("a").join(chosen.alias("b"), [F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), F.col("a.up") == F.col("b.k")])
        way = found.select("a.conv_id", "parts.k", "entry", F.col("parts.matrix").alias("matrices"), "exit").withColumn("way", _way(F.col("entry"), F.col("exit"), F.col("matrices")))
        steps = F.transform("way", lambda e, i: F.struct(F.col("k")[i].alias("k"), F.when(i == 0, F.col("entry")).otherwise(F.get("way", i - 1)).alias("entry"), e.alias("exit")))
        chosen = way.select("conv_id", F.explode(steps).alias("x")).select("conv_id", "x.*").checkpoint()
    audits = level.alias("a").join(chosen.alias("b"), same("a", "b", "conv_id", "k")).select("a.conv_id", "a.k", "a.part", "a.block", F.concat(F.when(F.col("a.k") == 0, F.get(begin, "b.entry")["s"]).otherwise(""), F.get(F.get("a.matrix", "b.entry"), "b.exit")["s"]).alias("audit"))
    texts = placed.groupBy("conv_id", "part", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    lines = texts.alias("a").join(audits.alias("b"), same("a", "b", "conv_id", "part", "block")).select("a.conv_id", "b.k", _lines(F.col("b.audit"), F.col("a.turns")).alias("lines"))
    hashed = _hashed(lines.repartition("conv_id").sortWithinPartitions("conv_id", "k"))
    turned = placed.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    joined = turned.alias("a").join(counts.alias("b"), same("a", "b", "conv_id")).join(top.alias("c"), same("a", "c", "conv_id")).join(hashed.alias("d"), same("a", "d", "conv_id"))
    return joined.select("a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), _public(F.col("best.s")).alias("audit"), "repaired_sha256")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, n), as ``damage`` gives them."""
    checkpoints.ensure(rows.sparkSession)
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    real = rows.where("n > 0")
    # every conversation has one row with n = 0, however many turns it lost
    all_ = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    sizes = real.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = sizes.where((F.col("rows") > LONG) | (F.col("bytes") > LONG_BYTES)).select("conv_id").checkpoint()
    if not long.head(1):
        return _repaired_short(real.unionByName(all_))
    short = real.unionByName(all_).alias("a").join(long.alias("b"), same, "left_anti")
    return _repaired_short(short).unionByName(_repaired_long(real.alias("a").join(long.alias("b"), same, "left_semi")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same rows in DuckDB; its recursion keeps the best way into each state, turn by turn, and crc32 is a fold over bits.
SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(flatten([[4294967295::UBIGINT]] || list_transform(range(1, length(key) + 1), lambda i: [ascii(substr(key, i, 1))::UBIGINT] || list_transform(range(8), lambda j: 256::UBIGINT))),
    lambda c, e: CASE WHEN e < 256 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END), 4294967295::UBIGINT) % 20 AS fate FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER run AS pos, lag(role[1]) OVER run AS before FROM damaged
  WINDOW run AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), flagged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, role[1] AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS whole FROM placed
), judged AS (
  SELECT *, blank OR seen AS gone, (NOT (blank OR seen OR whole))::BIGINT AS cut FROM flagged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT)::BIGINT AS blank, sum((seen AND NOT blank)::BIGINT)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated,
    sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT)::BIGINT AS illegal, max(pos) AS turns FROM judged GROUP BY conv_id
), fold AS (
  SELECT conv_id, 0::BIGINT AS pos, state, cost, audit, lines FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 0::BIGINT, '', []::VARCHAR[]), (2, 2, 'I', ['user:']), (3, 4, 'II', ['user:', 'assistant:'])) v(state, cost, audit, lines)
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, lines FROM (
    SELECT f.conv_id, j.pos, e.state, e.cost, e.audit, e.lines, row_number() OVER (PARTITION BY f.conv_id, e.state ORDER BY e.cost, e.audit) AS best
    FROM fold f JOIN judged j ON f.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = f.pos + 1,
    LATERAL (SELECT unnest([
      {state: f.state, cost: f.cost + 3, audit: f.audit || 'D', lines: f.lines},
      CASE WHEN NOT j.gone AND f.state = 0 AND j.initial = 's' THEN {state: 1, cost: f.cost + j.cut, audit: f.audit || 'K', lines: f.lines || [j.role || ':' || j.text]} END,
      CASE WHEN NOT j.gone AND f.state <> 2 THEN {state: 2, cost: f.cost + j.cut + CASE WHEN j.initial = 'u' THEN 0 ELSE 2 END, audit: f.audit || CASE WHEN j.initial = 'u' THEN 'K' ELSE 'R' END, lines: f.lines || [CASE WHEN j.initial = 'u' THEN j.role ELSE 'user' END || ':' || j.text]} END,
      CASE WHEN NOT j.gone AND f.state = 2 THEN {state: 3, cost: f.cost + j.cut + CASE WHEN j.initial = 'a' THEN 0 ELSE 2 END, audit: f.audit || CASE WHEN j.initial = 'a' THEN 'K' ELSE 'R' END, lines: f.lines || [CASE WHEN j.initial = 'a' THEN j.role ELSE 'assistant' END || ':' || j.text]} END
    ]) AS t) r,
    LATERAL (SELECT unnest(CASE WHEN r.t IS NULL THEN [] ELSE [
      r.t,
      CASE WHEN r.t.state <> 2 THEN {state: 2, cost: r.t.cost + 2, audit: r.t.audit || 'I', lines: r.t.lines || ['user:']} ELSE {state: 3, cost: r.t.cost + 2, audit: r.t.audit || 'I', lines: r.t.lines || ['assistant:']} END,
      CASE WHEN r.t.state <> 2 THEN {state: 3, cost: r.t.cost + 4, audit: r.t.audit || 'II', lines: r.t.lines || ['user:', 'assistant:']} END
    ] END) AS x) u, LATERAL (SELECT u.x.state AS state, u.x.cost AS cost, u.x.audit AS audit, u.x.lines AS lines WHERE u.x IS NOT NULL) e
  ) WHERE best = 1
), ended AS (
  SELECT f.conv_id, f.cost, f.audit, f.lines, row_number() OVER (PARTITION BY f.conv_id ORDER BY f.cost, f.audit) AS best FROM fold f LEFT JOIN counts c ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  WHERE f.pos = coalesce(c.turns, 0) AND f.state IN (0, 3)
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, e.cost, e.audit,
  sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE e.best = 1
"""
