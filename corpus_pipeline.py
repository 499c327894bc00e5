"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last one
returns the packed pieces. ``run`` applies them in order and writes each stage's result to the
shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import checkpoints, decontaminate, jaccard, packing, pii, quality


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    return name if name not in docs.columns else _free(docs, name + "_")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels, does not reject. A null or empty text has the score of an empty one, equal
    texts equal scores; a row without doc_id is judged as any other; without labels of both kinds all rows have one score; no column clashes."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, passed = _free(docs, "quality_score"), _free(docs, "quality_predicted")
    return quality.score_quality(docs, *model, names=(score, passed)).where(F.col(passed) == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of least doc_id; of rows that share this doc_id, or have none, that of
    least set of shingles and then least text. Documents without words (null and empty texts) are linked with nothing and stay, repeated ones too."""
    columns = docs.columns
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()
    found = jaccard.jaccard_components(docs).checkpoint()
    plain = docs.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti")
    kept = plain.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*columns)
    unnamed = docs.where("doc_id IS NULL")
    if not repeated.head(1) and not unnamed.head(1):
        return kept
    # rows that doc_id does not tell apart are told apart by their sets
    odd = docs.join(repeated, "doc_id", "left_semi").select(*columns).unionByName(unnamed)
    whole = jaccard.set_ids(odd.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "text"))
    classes = found.select(F.col("doc_id").alias("d"), F.col("set_id").alias("s"), "class_id", "component_id").distinct()
    judged = whole.join(classes, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("set_id") == F.col("s")), "left")
    first = judged.where("set_id IS NOT NULL AND row.doc_id <=> component_id").groupBy("class_id").agg(F.min_by("row", F.struct("set_id", "text")).alias("row"))
    return kept.unionByName(first.select("row.*")).unionByName(judged.where("set_id IS NULL").select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none and stay, each of repeated rows is judged alike, an
    empty benchmark keeps all."""
    name = _free(docs, "benchmark_items")
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.where(F.size(name) == 0).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; a null text stays null, rows and other columns stay as they are."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; a null or empty text is one end token, repeated rows are packed as often as they
    occur, a null doc_id stays null, other columns go."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_pii),
    ("packing", pack),
]

#: No stage but the joins can be said in SQL; the tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints.ensure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
