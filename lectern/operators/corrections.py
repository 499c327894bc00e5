"""A log of corrections, replayed over many transcripts at once.

Each correction counts words as they stand when its turn comes: behind an edit that writes more or fewer words than it
replaces, indexes are shifted. A transcript's edits are replayed in order over the times of its words, 24 bytes a word,
by one task for each transcript that has edits; texts stay out of it. What comes back is the verdict on each edit, the runs of words that were
moved, and the new words; the words themselves are then joined with the runs where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arabic import normalize_index

#: Letters of a word at most.
WORD_LETTERS = 100
PENDING = "pending"

_OUT = "kind string, transcript {id}, correction long, problem string, version long, replaced long, written long, start_ms long, end_ms long, old_from long, old_to long, idx long, text string"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


@dataclass
class Replay:
    """The words of a transcript as the edits leave them: for each its index, times, and the old index it had (new words: -1, with a text)."""

    idx: np.ndarray
    start: np.ndarray
    end: np.ndarray
    old: np.ndarray = field(init=False)
    text: np.ndarray = field(init=False)
    version: int = 0

    def __post_init__(self):
        self.old, self.text = self.idx.copy(), np.full(len(self.idx), None, dtype=object)

    def problem(self, e: dict, new: list[str]) -> str | None:
        if e["status"] != PENDING:
            return f"already {e['status']}"
        if not new:
            return "no words"
        if e["word_end"] < e["word_start"]:
            return "end before start"
        inside = np.flatnonzero((self.start >= e["chunk_start"]) & (self.start < e["chunk_end"])) if e["chunk_start"] is not None and e["chunk_end"] is not None else np.zeros(0, int)
        if not len(inside):
            return "chunk without words"
        if e["word_start"] < self.idx[inside].min() or e["word_end"] > self.idx[inside].max():
            return "outside the chunk"
        if np.count_nonzero((self.idx >= e["word_start"]) & (self.idx <= e["word_end"])) != e["word_end"] - e["word_start"] + 1:
            return "words missing"
        return None

    def apply(self, e: dict) -> dict:
        """The edit's verdict; a refused one changes nothing."""
        new = [w[:WORD_LETTERS] for w in (e["suggested_text"] or "").split()]
        out = {"kind": "edit", "correction": e["correction"], "problem": self.problem(e, new)}
        if out["problem"] is None:
            a = int(np.searchsorted(self.idx, e["word_start"]))
            b = int(np.searchsorted(self.idx, e["word_end"], side="right"))
            first, last = int(self.start[a]), int(self.end[b - 1])
            marks = [first + (last - first) * k // len(new) for k in range(len(new))] + [last]
            same = len(new) == b - a
            put = lambda x, y: np.concatenate([x[:a], y, x[b:]])
            tail = self.idx[b:] + len(new) - (b - a)
            if not same:
                self.start, self.end = put(self.start, np.array(marks[:-1])), put(self.end, np.array(marks[1:]))
            self.idx = np.concatenate([self.idx[:a], e["word_start"] + np.arange(len(new)), tail])
            self.old, self.text = put(self.old, np.full(len(new), -1)), put(self.text, np.array(new, dtype=object))
            self.version += 1
            out |= {"version": self.version, "replaced": b - a, "written": len(new), "start_ms": first, "end_ms": last}
        return out

    def rows(self) -> list[dict]:
        """Runs of old words that moved by the same step, and the new words."""
        out = []
        kept = np.flatnonzero(self.old >= 0)
        if len(kept):
            shift = self.idx[kept] - self.old[kept]
            cut = np.flatnonzero(np.diff(shift) | (np.diff(kept) != 1)) + 1
            for run in np.split(kept, cut):
                out.append({"kind": "run", "old_from": int(self.old[run[0]]), "old_to": int(self.old[run[-1]]), "idx": int(self.idx[run[0]] - self.old[run[0]])})
        for k in np.flatnonzero(self.old < 0):
            out.append({"kind": "word", "idx": int(self.idx[k]), "text": self.text[k], "start_ms": int(self.start[k]), "end_ms": int(self.end[k])})
        return out


def replay_corrections(words: DataFrame, chunks: DataFrame, corrections: DataFrame, versions: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a log of corrections (correction, seq, status, transcript, chunk, word_start, word_end, suggested_text) makes of transcripts' words (transcript, idx, text, start_ms,
    end_ms[, confidence]) and chunks (transcript, idx, start_ms, end_ms); ``chunk`` is a chunk's idx.

    ``edits``: each correction with its ``problem`` (as ``corpus.correction_problems`` names it) or with the version it made, the words it replaced and wrote and their span;
    ``words``: all words, those of new texts without confidence; ``transcripts``: text, count and version of those with an applied edit; ``chunks``: the chunks an applied edit
    touches, with their new texts. Corrections of a transcript without words find none; null transcripts are left alone.
    """
    spans = chunks.select(F.col("transcript").alias("_t"), F.col("idx").cast("long").alias("_i"), F.col("start_ms").cast("long").alias("chunk_start"), F.col("end_ms").cast("long").alias("chunk_end"))
    log = corrections.where("transcript IS NOT NULL").join(spans, (F.col("transcript") == F.col("_t")) & (F.col("chunk") == F.col("_i")), "left")
    log = log.select("transcript", F.col("correction").cast("long").alias("correction"), "seq", "status", F.col("word_start").cast("long").alias("word_start"), F.col("word_end").cast("long").alias("word_end"), "suggested_text", "chunk_start", "chunk_end")
    edited = log.select("transcript").distinct()
    times = words.join(edited, "transcript", "left_semi").select(F.col("transcript").alias("own"), *(F.col(c).cast("long").alias(c) for c in ("idx", "start_ms", "end_ms")))
    schema = _OUT.format(id=words.schema["transcript"].dataType.simpleString())

    def run(word_rows: pa.Table, edit_rows: pa.Table) -> pa.Table:
        w = word_rows.sort_by("idx")
        state = Replay(*(w.column(c).to_numpy() for c in ("idx", "start_ms", "end_ms")))
        edits = sorted(edit_rows.to_pylist(), key=lambda e: (e["seq"], e["correction"]))
        rows = [state.apply(e) for e in edits] + state.rows()
        columns = {n: [r.get(n) for r in rows] for n in _NAMES}
        id_ = edit_rows.column("transcript") if edit_rows.num_rows else w.column("own")
        columns["transcript"] = [id_[0].as_py()] * len(rows)
        text = {"kind", "problem", "text"}
        return pa.table([pa.array(columns[n], id_.type if n == "transcript" else pa.string() if n in text else pa.int64()) for n in _NAMES], names=_NAMES)

    told = times.groupBy("own").cogroup(log.groupBy("transcript")).applyInArrow(run, schema).checkpoint()
    edits = told.where("kind = 'edit'").select("transcript", "correction", "problem", "version", "replaced", "written", "start_ms", "end_ms")
    runs = told.where("kind = 'run'").select(F.col("transcript").alias("_t"), "old_from", "old_to", F.col("idx").alias("_shift"))
    extra = [c for c in words.columns if c not in ("transcript", "idx", "text", "start_ms", "end_ms")]
    done = edits.where("problem IS NULL")
    changed = done.select("transcript").distinct()
    still = words.join(changed, "transcript", "left_anti").select("transcript", "idx", "text", "start_ms", "end_ms", *extra)
    # a transcript has few runs: two for each edit at most
    moved = words.join(changed, "transcript", "left_semi").join(runs, (F.col("transcript") == F.col("_t")) & F.col("idx").between(F.col("old_from"), F.col("old_to")))
    moved = moved.select("transcript", (F.col("idx") + F.col("_shift")).cast(words.schema["idx"].dataType).alias("idx"), "text", "start_ms", "end_ms", *extra)
    fresh = told.where("kind = 'word'").select("transcript", F.col("idx").cast(words.schema["idx"].dataType).alias("idx"), "text", "start_ms", "end_ms", *(F.lit(None).cast(words.schema[c].dataType).alias(c) for c in extra))
    after = moved.unionByName(fresh)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    made = done.groupBy("transcript").agg(F.max("version").alias("version"))
    if versions is not None:
        made = made.join(versions.select("transcript", F.col("version").alias("_v")), "transcript", "left").select("transcript", (F.col("version") + F.coalesce("_v", F.lit(0))).alias("version"))
    transcripts = after.groupBy("transcript").agg(joined.alias("raw_text"), F.count("*").alias("word_count")).join(made, "transcript").withColumn("text_normalized", normalize_index(F.col("raw_text")))
    c, e = chunks.alias("c"), done.alias("e")
    touched = c.join(e, (F.col("c.transcript") == F.col("e.transcript")) & (F.col("c.start_ms") <= F.col("e.end_ms")) & (F.col("c.end_ms") >= F.col("e.start_ms")), "left_semi")
    w = after.select(F.col("transcript").alias("_t"), F.col("idx").alias("_w"), F.col("text").alias("_x"), F.col("start_ms").alias("_s"))
    held = touched.join(w, (F.col("transcript") == F.col("_t")) & (F.col("_s") >= F.col("start_ms")) & (F.col("_s") < F.col("end_ms")), "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_w").isNotNull(), F.struct("_w", "_x")))), lambda x: x["_x"]), " ")
    rebuilt = held.groupBy("transcript", "idx", "start_ms", "end_ms").agg(text.alias("text")).withColumn("text_normalized", normalize_index(F.col("text")))
    return {"edits": edits, "words": still.unionByName(after), "transcripts": transcripts, "chunks": rebuilt}
