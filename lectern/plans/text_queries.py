"""Normalisation, phrase search, fusion and vector queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import arabic, fuzzy, text, vectors
from lectern.operators import search
from lectern.plans.tables import TOKENS, WORDS, table, words

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literals(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Digits as letters that neither affixes nor marks have.
_LETTERS = "صحرقطغضظثذ"
_BASE = f"translate(lpad((p_partkey * 7919 % 100000)::VARCHAR, 5, '0'), '0123456789', '{_LETTERS}')"


def base_word(number) -> Column:
    """Five letters that stand for a number's last digits."""
    return F.translate(F.lpad((number % 100_000).cast("string"), 5, "0"), "0123456789", _LETTERS)


_FROM, _TO = arabic.FOLDED_FROM + arabic.DIGITS_FROM + arabic.STRIPPED, arabic.FOLDED_TO + arabic.DIGITS_TO


_MARKED = "'ٱلْحَمْدُ  لِلَّهِ ' || translate(p_partkey::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' مـــد	' || p_name || ' أَإِآٱةىؤئ '"


@query(f"SELECT p_partkey, trim(regexp_replace(translate(nfc_normalize(s), '{_FROM}', '{_TO}'), '\\s+', ' ', 'g')) AS norm, translate(nfc_normalize(s), '{arabic.STRIPPED}', '') AS light FROM (SELECT p_partkey, {_MARKED} AS s FROM part)")
def norm_literals(spark, sf):
    """Marks, folded letters and digits of every kind around each part's name."""
    s = F.concat(F.lit("ٱلْحَمْدُ  لِلَّهِ "), arabic.arabic_digits(F.col("p_partkey").cast("string")), F.lit(" مـــد\t"), "p_name", F.lit(" أَإِآٱةىؤئ "))
    return table(spark, sf, "part").select("p_partkey", arabic.normalize_index(s).alias("norm"), arabic.normalize_light(s).alias("light"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(translate(nfc_normalize(text), '{_FROM}', '{_TO}'), '\\s+', ' ', 'g'))) AS norm_md5 FROM documents")
def norm_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(arabic.normalize_index(F.col("text"), latin=True)).alias("norm_md5"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(translate(nfc_normalize(text || ' e' || chr(769)), '{_FROM}', '{_TO}'), '\\s+', ' ', 'g'))) AS norm_md5 FROM documents")
def norm_composed(spark, sf):
    """The path that any text takes, NFC included; each document ends in a decomposed letter."""
    text_ = F.concat("text", F.lit(" e\u0301"))
    return table(spark, sf, "documents").select("doc_id", F.md5(arabic.normalize_index(text_)).alias("norm_md5"))


@query(f"SELECT p_partkey, ['', 'ال', 'بال', 'وال', 'لل', 'فال'][p_partkey % 6 + 1] || {_BASE} || ['', 'ين', 'ون', 'ات', 'هم'][p_size % 5 + 1] AS word, {_BASE} AS stem FROM part")
def stem_literals(spark, sf):
    """A word of each part between one of six prefixes and one of five suffixes."""
    pick = lambda options, n: F.element_at(F.array(*(F.lit(o) for o in options)), (n % len(options) + 1).cast("int"))
    word = F.concat(pick(("", "ال", "بال", "وال", "لل", "فال"), F.col("p_partkey")), base_word(F.col("p_partkey") * 7919), pick(("", "ين", "ون", "ات", "هم"), F.col("p_size")))
    return table(spark, sf, "part").withColumn("word", word).select("p_partkey", "word", arabic.light_stem(F.col("word")).alias("stem"))


@query(f"SELECT p_partkey, {_BASE} || ' ' || {_BASE.replace('p_partkey', 'p_size')} AS stems, 'في ' || {_BASE} || ' من ' || {_BASE.replace('p_partkey', 'p_size')} AS every FROM part")
def stem_text_literals(spark, sf):
    """Two words with the article between stop words, which only one of the forms keeps."""
    s = F.concat(F.lit("في ال"), base_word(F.col("p_partkey") * 7919), F.lit(" من ال"), base_word(F.col("p_size") * 7919))
    return table(spark, sf, "part").select("p_partkey", arabic.stem_text(s).alias("stems"), arabic.stem_words(s).alias("every"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n_tokens, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n_space FROM documents")
def tokenize_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(arabic.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(arabic.space_tokens(arabic.collapse(F.col("text")))).cast("long").alias("n_space"))


#: Words whose pairs are counted first.
FREQUENT = 1000


def top_pair(spark, sf) -> list[str]:
    """The most frequent pair of neighbouring words. A pair is no more frequent than its words: pairs of the most frequent words are counted, and a word that is rarer than the best of them is in none better."""
    t = table(spark, sf, "documents").select(arabic.tokens(arabic.normalize_index(F.col("text"), latin=True)).alias("t"))
    words = t.select(F.explode("t").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w")
    wide = FREQUENT
    while True:
        rows = words.limit(wide + 1).collect()
        named = [r["w"] for r in rows[:wide]]
        mine = t.select(F.explode(F.arrays_zip(F.col("t").alias("a"), F.concat(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.array(F.lit(None).cast("string"))).alias("b"))).alias("p"))
        pairs = mine.select("p.a", "p.b").where(F.col("a").isin(named) & F.col("b").isin(named))
        best = pairs.groupBy("a", "b").count().orderBy(F.desc("count"), "a", "b").first() if rows else None
        if len(rows) <= wide or (best and rows[wide]["count"] < best["count"]):
            return [best["a"], best["b"]] if best else []
        wide *= 8


_PAIR = f"""{TOKENS}, pairs AS (SELECT a.doc, a.pos, a.word AS w1, b.word AS w2 FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos = a.pos + 1),
 top AS (SELECT w1, w2 FROM pairs GROUP BY 1, 2 ORDER BY count(*) DESC, w1, w2 LIMIT 1),
 hit AS (SELECT doc, min(pos) AS start FROM pairs JOIN top USING (w1, w2) GROUP BY doc),
 ranked AS (SELECT doc, start, 0 AS stems, 0 AS typos, row_number() OVER (ORDER BY doc) AS rank, count(*) OVER () AS total FROM hit)"""


def ranked_pair(spark, sf):
    pair = " ".join(top_pair(spark, sf))
    found = search.lexical_search(table(spark, sf, "documents"), "doc_id", "text", f'"{pair}"', latin=True)
    return found.select("doc", "start", "stems", "typos", "rank", "total")


@query(f"WITH {_PAIR} SELECT * FROM ranked")
def phrase_strict(spark, sf):
    return ranked_pair(spark, sf)


@query(f"WITH {_PAIR} SELECT * FROM ranked WHERE rank BETWEEN 21 AND 40")
def phrase_page2(spark, sf):
    return search.page(ranked_pair(spark, sf), 2, 20)


@query(f"""WITH {TOKENS}, hit AS (SELECT doc, pos, damerau_levenshtein(word, 'there') AS t FROM tok WHERE word[1] = 't' AND abs(length(word) - 5) <= 1 AND (word = 'there' OR damerau_levenshtein(word, 'there') <= 1)),
 two AS (SELECT h.doc, h.pos AS start, h.t AS typos FROM hit h JOIN tok ON tok.doc = h.doc AND tok.pos = h.pos + 1 AND tok.word = 'the')
 SELECT doc, min(struct_pack(t := typos, s := start)).s AS start, 0 AS stems, CAST(min(typos) AS BIGINT) AS typos FROM two GROUP BY doc""")
def phrase_typo1(spark, sf):
    post = search.postings(table(spark, sf, "documents"), "doc_id", arabic.normalize_index(F.col("text"), latin=True))
    return search.phrase_match(post, [("there", False), ("the", True)]).select("doc", "start", F.col("stems").cast("int").alias("stems"), "typos")


@query("SELECT p_partkey, damerau_levenshtein(p_name, b)::INT AS d FROM (SELECT p_partkey, p_name, substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 4) || p_size AS b FROM part)")
def osa_cases(spark, sf):
    """Each part's name against itself with two letters swapped, one gone and a number behind."""
    other = F.concat(F.substr("p_name", F.lit(2), F.lit(1)), F.left("p_name", F.lit(1)), F.substr("p_name", F.lit(4)), F.col("p_size").cast("string"))
    return table(spark, sf, "part").withColumn("b", other).select("p_partkey", fuzzy.osa_distance("p_name", "b").alias("d"))


_TYPED = "'w' || translate(lpad((p_partkey * 7919 % 100000000)::VARCHAR, 8, '0'), '0123456789', 'bcdfghjkmn')"


@query(f"""WITH q AS (SELECT p_partkey, p_size % 3 AS kind, {_TYPED} AS q FROM part), c AS (SELECT p_partkey, CASE WHEN kind < 2 THEN (q[4] <> q[5])::INT + CASE WHEN kind = 1 THEN (q[7] <> q[8])::INT ELSE 0 END END AS typos FROM q)
 SELECT p_partkey, CASE WHEN typos IS NOT NULL THEN 0 END AS stems, typos FROM c""")
def word_cost_cases(spark, sf):
    """A word of nine letters against itself with one pair of letters swapped, two pairs, or another first letter."""
    q = F.concat(F.lit("w"), F.translate(F.lpad((F.col("p_partkey") * 7919 % 100_000_000).cast("string"), 8, "0"), "0123456789", "bcdfghjkmn"))
    at = lambda first, n=1: F.substr("q", F.lit(first), F.lit(n))
    one = F.concat(at(1, 3), at(5), at(4), at(6, 4))
    two = F.concat(at(1, 3), at(5), at(4), at(6), at(8), at(7), at(9))
    kind = F.col("p_size") % 3
    df = table(spark, sf, "part").withColumn("q", q).withColumn("w", F.when(kind == 0, one).when(kind == 1, two).otherwise(F.concat(F.lit("x"), at(2, 8))))
    return df.withColumn("d", fuzzy.osa_distance("q", "w")).withColumn("c", fuzzy.word_cost(F.col("q"), F.lit(False), F.col("w"), F.col("d"))).select("p_partkey", "c.stems", "c.typos")


def filled(terms: list[str]) -> str:
    """``f`` (doc, all_terms, rank_cd): documents with any of the terms, those with all by cover density; for a WITH that has ``tok``."""
    last = ", ".join(f"max(CASE WHEN word = '{t}' THEN pos END) OVER w AS p{i}" for i, t in enumerate(terms))
    every = ", ".join(f"p{i}" for i in range(len(terms)))
    return f"""h AS (SELECT doc, pos, word, {last} FROM tok WHERE word IN ({", ".join(f"'{t}'" for t in terms)}) WINDOW w AS (PARTITION BY doc ORDER BY pos)),
 n AS (SELECT doc, count(DISTINCT word) = {len(terms)} AS all_terms, count(*) AS hits FROM h GROUP BY doc),
 c AS (SELECT doc, list_min([{every}]) AS s, min(pos) AS e FROM h WHERE {" AND ".join(f"p{i} IS NOT NULL" for i in range(len(terms)))} GROUP BY 1, 2),
 d AS (SELECT doc, round(sum(1.0::DOUBLE / (e - s + 1)), 6) AS cd FROM c GROUP BY doc),
 f AS (SELECT n.doc, all_terms, CASE WHEN all_terms THEN cd ELSE hits::DOUBLE END AS rank_cd FROM n LEFT JOIN d ON d.doc = n.doc)"""


@query(f"WITH {TOKENS}, {filled(['the', 'that', 'which', 'inoning'])}, r AS (SELECT *, row_number() OVER (ORDER BY all_terms DESC, rank_cd DESC, doc) AS place FROM f) SELECT * FROM r WHERE place <= 50")
def lexical_fill(spark, sf):
    post = search.postings(table(spark, sf, "documents"), "doc_id", arabic.normalize_index(F.col("text"), latin=True))
    return search.lexical_fill(post, ["the", "that", "which", "inoning"])


@query(f"""WITH {TOKENS}, h AS (SELECT doc, pos, max(CASE WHEN word = 'the' THEN pos END) OVER w AS a, max(CASE WHEN word = 'with' THEN pos END) OVER w AS b FROM tok WHERE word IN ('the', 'with') WINDOW w AS (PARTITION BY doc ORDER BY pos)),
 c AS (SELECT doc, least(a, b) AS s, min(pos) AS e FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2) SELECT doc, round(sum(1.0::DOUBLE / (e - s + 1)), 6) AS rank_cd FROM c GROUP BY doc""")
def cover_density(spark, sf):
    post = search.postings(table(spark, sf, "documents"), "doc_id", arabic.normalize_index(F.col("text"), latin=True))
    return search.cover_density(post, ["the", "with"])


def _lists(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    one = d.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))).select(F.lit(0).alias("list_index"), "rank", F.col("doc_id").alias("id"), F.lit(2.0).alias("weight"))
    two = d.where("source IN ('src0', 'src1')").orderBy("doc_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy("doc_id"))).select(F.lit(1).alias("list_index"), "rank", F.col("doc_id").alias("id"), F.lit(1.0).alias("weight"))
    return one.unionByName(two)


@query("""WITH l AS (SELECT * FROM (SELECT 0 AS li, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, doc_id AS id, 2.0::DOUBLE AS w FROM documents WHERE lang = 'en') WHERE rank <= 50
 UNION ALL SELECT * FROM (SELECT 1, row_number() OVER (ORDER BY doc_id) AS rank, doc_id, 1.0::DOUBLE FROM documents WHERE source IN ('src0', 'src1')) WHERE rank <= 50),
 g AS (SELECT id, round(sum(w / (60 + rank)), 9) AS score, min(struct_pack(li := li, r := rank)) AS f FROM l GROUP BY id),
 r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, f, id) AS place FROM g) SELECT * FROM r WHERE place <= 40""")
def rrf_fuse(spark, sf):
    return search.fuse(_lists(spark, sf))


@query("""SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 50""")
def knn_exact(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    vec = F.array(*(F.lit(float(x)) for x in q["embedding"])) if q else F.array().cast("array<double>")
    return e.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), vec), 6).alias("distance")).orderBy("distance", "vec_id").limit(50)


@query("""SELECT vec_id, unnest(range(16)) AS k, unnest(list_transform(embedding[:16], lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding[:16], lambda y: y::DOUBLE * y::DOUBLE))), 6))) AS component FROM embeddings""")
def fit_vectors(spark, sf):
    fitted = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.fit_vector(F.col("embedding"), 16)).alias("k", "component"))
    return fitted.select("vec_id", "k", F.round("component", 6).alias("component"))


@query("""SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source""")
def distinct_keep_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return search.first_seen(d, F.lower("source"), "doc_id").select("source", "doc_id")


@query(f"WITH c AS (SELECT id, (id % 4)::DOUBLE AS score, place FROM ({SQL['rrf_fuse']})), g AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, place) AS kept_place FROM c WHERE score >= 2) SELECT *, false AS weak FROM g WHERE kept_place <= 8")
def rerank_keep(spark, sf):
    """The fused candidates, scored by their ids."""
    return search.keep_reranked(search.fuse(_lists(spark, sf)).select("id", (F.col("id") % 4).cast("double").alias("score"), "place"))


@query(f"SELECT id, CASE WHEN place = 7 THEN 2.5 ELSE 1 END::DOUBLE AS score, row_number() OVER (ORDER BY place = 7 DESC, place) AS kept_place, true AS weak FROM ({SQL['rrf_fuse']}) QUALIFY kept_place <= 3")
def rerank_weak(spark, sf):
    """The fused candidates, of which only the seventh is good."""
    return search.keep_reranked(search.fuse(_lists(spark, sf)).select("id", F.when(F.col("place") == 7, 2.5).otherwise(1.0).alias("score"), "place"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 80 THEN t WHEN rtrim(regexp_extract(left(t, 81), '(?s)^(.*)\\s', 1)) <> '' THEN rtrim(regexp_extract(left(t, 81), '(?s)^(.*)\\s', 1)) ELSE left(t, 80) END AS snippet FROM (SELECT doc_id, trim(text) AS t FROM documents)""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("""SELECT doc_id, md5(CASE WHEN len(w) > 60 THEN array_to_string(w[:60], ' ') || ' …' ELSE array_to_string(w, ' ') END) AS excerpt_md5 FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.excerpt(F.col("text"), 60)).alias("excerpt_md5"))


@query("""SELECT d.doc_id, string_split(text, chr(10))[1] AS title, sha256(concat_ws(chr(10), source, text)) AS content_hash FROM documents d""")
def content_hashes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.split("text", "\n")[0].alias("title"), text.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query("""SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source = 'src3'""")
def filter_kind_source(spark, sf):
    return table(spark, sf, "documents").where("lang = 'fr' AND source = 'src3'").select("doc_id", "lang", "source")


@query("""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?]\\s+|\\n+'), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM documents""")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.split_sentences(F.col("text"))).cast("long").alias("n"))


@query("""SELECT DISTINCT left(trim(text), 20) AS suggestion FROM documents WHERE list_bool_or(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: starts_with(x, 'ith'))) ORDER BY 1 LIMIT 6""")
def suggest_prefix(spark, sf):
    return search.suggest(table(spark, sf, "documents"), "text", "ith", F.left(F.trim("text"), F.lit(20)))


@query(f"WITH {WORDS} SELECT transcript, (idx // 10)::INT AS priority, (idx // 10 * 10)::INT AS a, (idx // 10 * 10 + CASE WHEN bool_or(idx % 10 = 2) THEN 3 ELSE 1 END)::INT AS b FROM words GROUP BY transcript, idx // 10")
def context_merge(spark, sf):
    """Two words of every ten as a seed, and later two more beside them, which widen the first."""
    seed = lambda first, priority: F.when(F.col("idx") % 10 == first, F.struct(priority.cast("int").alias("priority"), F.col("idx").cast("int").alias("a"), (F.col("idx") + 1).cast("int").alias("b")))
    tens = F.floor(F.col("idx") / 10)
    seeds = words(spark, sf).withColumn("s", F.coalesce(seed(0, tens), seed(2, tens + 1_000_000))).where("s IS NOT NULL")
    return search.merge_windows(seeds.select("transcript", "s.*"))


@query("""WITH RECURSIVE w AS (SELECT doc_id AS id, n_chars AS words, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
 f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS spent, NULL::BIGINT AS id UNION ALL SELECT w.k, CASE WHEN spent + words <= 36000 THEN spent + words ELSE spent END, CASE WHEN spent + words <= 36000 THEN w.id END FROM f JOIN w ON w.k = f.k + 1)
 SELECT 1 AS run, id FROM f WHERE id IS NOT NULL""")
def context_budget(spark, sf):
    d = table(spark, sf, "documents").select(F.lit(1).alias("run"), F.col("doc_id").alias("priority"), F.col("doc_id").alias("id"), F.col("n_chars").alias("words"))
    return search.spend_budget(d, 36000)
