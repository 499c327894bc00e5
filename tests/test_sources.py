import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import readers, writers


def test_pipe_text(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("# comment\n\n1|1|a b|c\n2|3|x\n")
    assert sorted(map(tuple, readers.pipe_text(spark, str(f)).collect())) == [(1, 1, "a b|c"), (2, 3, "x")]
    for bad in ("1|1|a\n1|1|b\n", "x|1|a\n", "1|2\n", "0|1|a\n"):
        f.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            readers.pipe_text(spark, str(f)).collect()


def test_xml_json_golden_manifest(spark, tmp_path):
    x = tmp_path / "m.xml"
    x.write_text('<q><suras><sura index="1" ayas="7" name="a"/><sura index="2" ayas="286" name="b"/></suras></q>')
    assert sorted((r["index"], r["ayas"]) for r in readers.xml_rows(spark, str(x), "sura", "index int, ayas int, name string").collect()) == [(1, 7), (2, 286)]
    j = tmp_path / "r.json"
    j.write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert sorted(r["id"] for r in readers.json_records(spark, str(j), "id int").collect()) == [1, 2]
    g = tmp_path / "g.jsonl"
    item = {"id": "a", "question": "q", "expected_segment_ids": [1], "expected_status": "answered", "tags": [], "notes": ""}
    g.write_text("# c\n" + json.dumps(item) + "\n" + json.dumps({**item, "id": "b", "expected_segment_ids": [], "expected_status": "not_found"}) + "\n")
    assert readers.golden(spark, str(g)).count() == 2
    g.write_text(json.dumps({**item, "expected_status": "maybe"}) + "\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.golden(spark, str(g)).collect()
    m = tmp_path / "m.txt"
    m.write_text("b\n\n a \nb\nc\n")
    assert [r["entry"] for r in readers.manifest(spark, str(m)).collect()] == ["b", "a", "c"]


def test_checkpoint_last_wins_and_only_the_last_line_may_be_corrupt(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"k": "c", "v"')
    assert sorted(map(tuple, readers.checkpoint_lines(spark, str(f), "k", "k string, v int").collect())) == [("a", 3), ("b", 2)]
    f.write_text('{"k": "a", "v": 1}\n{oops\n{"k": "b", "v": 2}\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.checkpoint_lines(spark, str(f), "k", "k string, v int").collect()


def test_files_digests_sidecars(spark, tmp_path):
    for name in ("a.mp3", "sub/b.WAV", "c.txt", "a.mp3.json", "a.json", "sub/b.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    files = readers.audio_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.mp3", "b.WAV"]
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")
    got = {r["path"].rsplit("/", 1)[1]: r["sidecar"].rsplit("/", 1)[1] for r in readers.sidecars(every, "json").collect()}
    assert got == {"a.mp3": "a.mp3.json", "b.WAV": "b.json"}
    assert readers.digests(spark, str(tmp_path)).where("length(sha256) = 64 AND length(md5) = 32").count() == 6


def test_index_and_output(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "id int, segment int, text string")
    new = spark.createDataFrame([(2, 1, "B"), (4, 2, "d")], "id int, segment int, text string")
    merged = writers.upsert_index(old, new, "id")
    assert sorted(map(tuple, merged.collect())) == [(1, 1, "a"), (2, 1, "B"), (3, 2, "c"), (4, 2, "d")]
    assert sorted(r["id"] for r in writers.delete_segment(merged, 1).collect()) == [3, 4]
    lines = spark.createDataFrame([(0, 0, 150, "a{b}\\")], "line int, start_cs int, end_cs int, text string")
    assert writers.ass_dialogue(lines, "#0000ff").first()["value"] == "Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,{\\c&H00FF0000&}a(b)"


def test_sidecars_broadcast_no_listing(spark):
    names = spark.range(20).select(F.explode(F.array(F.concat(F.lit("d/"), "id", F.lit(".mp3")), F.concat(F.lit("d/"), "id", F.lit(".txt")))).alias("path"))
    got = readers.sidecars(names, "txt")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["sidecar"]) for r in got.collect()} == {(f"d/{i}.mp3", f"d/{i}.txt") for i in range(20)}
