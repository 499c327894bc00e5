"""Subtitle files against a plain writer."""

import random

import pytest

from lectern.sources import subtitles

WORDS = "transcript long, idx long, text string, start_ms long, end_ms long"
CLIPS = "clip long, transcript long, start_ms long, end_ms long, credit string"


def stamp(cs):
    return f"{cs // 360000}:{cs // 6000 % 60:02d}:{cs // 100 % 60:02d}.{cs % 100:02d}"


def plain_events(clip, words):
    _, transcript, a, b, credit = clip
    clean = lambda t: t.translate({ord("{"): "(", ord("}"): ")", ord("\n"): " ", ord("\r"): " ", ord("\\"): None}).strip()
    cs = lambda t: (min(max(t - a, 0), b - a) + 5) // 10
    inside = [(clean(x), cs(s), cs(e)) for t, _, x, s, e in sorted(words) if t == transcript and s < b and e > a]
    lines = []
    for word in (w for w in inside if w[2] > w[1] and w[0]):
        line = lines[-1] if lines else None
        if line is None or len(line) >= 6 or sum(len(w[0]) + 1 for w in line) + len(word[0]) > 28 or word[1] - line[-1][2] > subtitles.segmentation.ASS_GAP_CS:
            lines.append([word])
        else:
            line.append(word)
    out = []
    for line in lines:
        marks = [w[1] for w in line] + [line[-1][2]]
        parts = [f"{{\\kt{marks[k] - marks[0]}\\k{marks[k + 1] - marks[k]}}}{w[0]}" for k, w in enumerate(line)]
        out.append(f"Dialogue: 0,{stamp(line[0][1])},{stamp(line[-1][2])},Words,,0,0,0,,{' '.join(reversed(parts))}")
    if clean(credit or ""):
        out.append(f"Dialogue: 0,{stamp(0)},{stamp((b - a + 5) // 10)},Credit,,0,0,0,,{clean(credit)}")
    return out


def test_files_equal_a_plain_writer(spark):
    rng = random.Random(4)
    words = []
    for t in (1, 2):
        at = 0
        for i in range(120):
            at += rng.choice([0, 40, 90, 700])
            words.append((t, i, rng.choice(["one", "tw{o}", "three\\", "a\nb", "incomprehensible", "", "five"]), at, at := at + rng.choice([0, 4, 200, 430])))
    clips = [(1, 1, 0, 20_000, "me {x}"), (2, 1, 3333, 9001, None), (3, 2, 10_000, 10_500, ""), (4, 2, 10**7, 10**7 + 1000, "none"), (5, 9, 0, 5, "no transcript")]
    got = {r["clip"]: r["file"] for r in subtitles.subtitle_files(spark.createDataFrame(clips, CLIPS), spark.createDataFrame(words, WORDS).repartition(3)).collect()}
    for clip in clips:
        head, _, events = got[clip[0]].partition(f"Format: {subtitles.EVENT_FIELDS}\n")
        assert [e for e in events.split("\n") if e] == plain_events(clip, words)
        assert head.startswith("[Script Info]\n; clip\n") and "Style: Words,Amiri,72,&H00FFFFFF,&H00A6A09A,&H00000000,&H00242120,-1,0,0,0,100,100,0,0,1,4,0,5,140,140,160,1\n" in head
        assert got[clip[0]].endswith("\n")
    assert len(plain_events(clips[0], words)) > 5


def test_empty_clip_fails(spark):
    with pytest.raises(Exception, match="length"):
        subtitles.subtitle_files(spark.createDataFrame([(1, 1, 5, 5, "x")], CLIPS), spark.createDataFrame([], WORDS)).collect()
