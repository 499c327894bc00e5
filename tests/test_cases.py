"""Single cases of column functions, worked out by hand."""

from pyspark.sql import functions as F

from lectern.functions import arabic, fuzzy, references, text
from lectern.operators import search, smart


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").select("k", *columns).orderBy("k").drop("k").collect()]


def test_normal_forms(spark):
    rows = [("ٱلْحَمْدُ لِلَّهِ",), ("أَإِآٱةىؤئ",), ("٠١٢  ۳۴۵",), ("مـــد",), (" a\t b\n",), ("",)]
    assert [r[0] for r in one(spark, "s string", rows, arabic.normalize_index(F.col("s")))] == ["الحمد لله", "ااااهيوي", "012 345", "مد", "a b", ""]


def test_stems(spark):
    cases = [("الصبر", "صبر"), ("بالصبر", "صبر"), ("والمومنين", "مومن"), ("الله", "الله"), ("بالله", "الله"), ("كتاب", "كتاب"), ("وحده", "وحده"), ("والوالدين", "والد"), ("مسلماتهم", "مسلمات"), ("255", "255"), ("للناس", "ناس"), ("", "")]
    assert [r[0] for r in one(spark, "w string", [c[:1] for c in cases], arabic.light_stem(F.col("w")))] == [c[1] for c in cases]
    assert one(spark, "s string", [("الصبر عند الصدمه",), ("في من",)], arabic.stem_text(F.col("s")), arabic.stem_words(F.col("s"))) == [("صبر صدمه", "صبر عند صدمه"), ("", "في من")]


def test_word_costs(spark):
    cases = [("صبر", "صبر", (0, 0)), ("الصبر", "بالصبر", (1, 0)), ("there", "theer", (0, 1)), ("there", "hhere", None), ("the", "teh", None), ("something", "somethign", (0, 1)), ("something", "smoethign", (0, 2))]
    df = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, q string, w string").withColumn("d", fuzzy.osa_distance("q", "w"))
    got = df.select("k", fuzzy.word_cost(F.col("q"), F.lit(False), F.col("w"), F.col("d")).alias("c")).orderBy("k").collect()
    assert [r["c"] and tuple(r["c"]) for r in got] == [c[2] for c in cases]


def test_times(spark):
    cases = [("1:02:03", 3723000), ("75:00", 4500000), ("9", 9000), ("1:60", None), ("x", None), ("٢:٠٥", 125000), ("1:75:00", None), ("2.5", 2500)]
    assert [r[0] for r in one(spark, "s string", [c[:1] for c in cases], text.parse_ms(F.col("s")))] == [c[1] for c in cases]


def test_addresses_and_markers(spark):
    assert [r[0] for r in one(spark, "f string, r string", [("1.1.1.1, 2.2.2.2", "9.9.9.9"), ("", "9.9.9.9"), ("3.3.3.3", "9.9.9.9")], text.client_ip(F.col("f"), F.col("r"), 1))] == ["2.2.2.2", "9.9.9.9", "3.3.3.3"]
    assert [r[0] for r in one(spark, "s string", [("a [p1] b",), ("[p2][p2] c",)], text.strip_markers(F.col("s")))] == ["a [1] b", "[2] c"]
    assert one(spark, "rgb string, s string", [("#ff8000", "a{b}\\ c")], text.ass_colour(F.col("rgb")), text.ass_escape(F.col("s"))) == [("&H000080FF", "a(b) c")]


def test_file_names(spark):
    cases = [("a/002-001-005.mp3", (2, 1, 5, None, "recitation", "range")), ("s3a7.opus", (3, 7, 7, None, "recitation", "verse")), ("004 part 2.mp3", (4, None, None, 2, "khawatir", "part")), ("114.wav", (114, None, None, None, "recitation", "chapter")), ("999.mp3", None), ("hello.mp3", None)]
    got = one(spark, "n string", [c[:1] for c in cases], references.parse_filename(F.col("n")).alias("p"))
    assert [r[0] and tuple(r[0]) for r in got] == [c[1] for c in cases]


JUMPS = (
    [("page 12", ("page", None, 12)), ("صفحه 604", ("page", None, 604)), ("page 605", None), ("juz 31", None), ("الجزء 30", ("juz", None, 30)), ("2:255", ("ayah", 2, 255)), ("2 : 287", None), ("2", ("surah", 2, None)), ("سوره 1", ("surah", 1, None)), ("3", None), ("بقره", ("surah", 2, None)),
     ("سوره البقره", ("surah", 2, None)), ("البقره ايه 7", ("ayah", 2, 7)), ("بقره رقم 286", ("ayah", 2, 286)), ("البقره 287", None), ("سوره", None), ("abc", None), ("abc 5", None), ("", None)]
)


def test_jumps(spark):
    chapters = spark.createDataFrame([(1, "الفاتحه", 7), (2, "البقره", 286)], "number int, name string, ayah_count int")
    got = references.jumps(spark.createDataFrame([(q,) for q, _ in JUMPS], "q string"), "q", chapters).collect()
    assert {r["q"]: None if r["target"] is None else (r["target"], r["surah"], r["number"]) for r in got} == dict(JUMPS)


def test_windows_and_answers(spark):
    seeds = spark.createDataFrame([(1, 0, 5, 7), (1, 1, 8, 9), (1, 2, 1, 2), (1, 3, 3, 4), (2, 0, 0, 0)], "transcript int, priority int, a int, b int")
    assert sorted(map(tuple, search.merge_windows(seeds).collect())) == [(1, 0, 3, 9), (1, 2, 1, 2), (2, 0, 0, 0)]
    df = spark.createDataFrame([("See [2] and [[ayah:2:255]]",)], "a string")
    assert [tuple(n) for n in df.select(F.explode(smart.parse_answer(F.col("a"))).alias("n")).select("n.*").collect()] == [("text", "See "), ("citation", "2"), ("text", " and "), ("ayah", "2:255")]
    trim = [(1, i, 100, 4, 5) for i in range(9)] + [(2, i, 600, 1, 1) for i in range(3)] + [(3, 0, 10, 0, 0)]
    kept = smart.trim_windows(spark.createDataFrame(trim, "window int, idx int, words int, seed_a int, seed_b int")).select("window", "idx")
    assert sorted(map(tuple, kept.collect())) == [(1, 4), (1, 5), (1, 6), (1, 7), (2, 1), (3, 0)]


def test_reranking_fills_where_few_are_good(spark):
    schema = "id long, score double, place int"
    keep = lambda rows: sorted(map(tuple, search.keep_reranked(spark.createDataFrame(rows, schema)).collect()), key=lambda r: r[2])
    assert keep([(1, 3.0, 5), (2, 2.5, 1), (3, 2.0, 2), (4, 1.0, 3), (5, 0.0, 4)]) == [(1, 3.0, 1, False), (2, 2.5, 2, False), (3, 2.0, 3, False)]
    assert keep([(1, 1.0, 2), (3, 1.5, 1)]) == [(3, 1.5, 1, True), (1, 1.0, 2, True)]
