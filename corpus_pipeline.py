"""The corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; run() writes each
stage's result as Parquet to the shared folder and reads it again. All stages but the last return the columns of documents.
Nulls, empty texts, repeated rows and empty tables are handled as in the operators; columns of documents that a stage does
not use pass through it (n_chars is kept true where a text changes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import common as C
from barograph.llm import identity, jaccard, language, mixing, packing, suffixes

#: A document whose most likely language has less than this share of it is rejected, as are those without any letter.
LEAST_SHARE = 0.3
NEAR = jaccard.Rule(5, 80)


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*like.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of an identified language. The models are learned from the labelled documents of this very input; where
    there are none, only documents without letters go."""
    C.small_batches(spark)
    names, model = language.learn(docs)
    found = language.identify(docs, names, model, ("_pred", "_share", "_set"))
    sure = (F.col("_pred") != language.UNKNOWN) & (F.col("_share") >= LEAST_SHARE) if names else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return _columns(found.where(sure), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near-duplicates, those without one first; of rows equal in doc_id
    and text, one. Different texts that share a doc_id, or have none, are different documents."""
    found, names = jaccard.classes(docs, NEAR)
    kept = found.where(F.col("_d") == F.col("component_id")).select("_d")
    if names is None:
        return _columns(docs.join(kept.withColumnRenamed("_d", "doc_id").hint("merge"), "doc_id", "left_semi"), docs)
    kept = names.join(kept, "_d").select("_d", F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"))
    x = docs.withColumn("_h", identity.text_hash())
    x = x.join(kept.hint("merge"), x["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (x["_h"] == kept["_hash"]))
    one = x.groupBy("_d").agg(F.min_by(F.struct(*docs.columns), F.coalesce("source", F.lit(""))).alias("_row"))
    return one.select("_row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that stand earlier too out of the texts; documents with no word left go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = suffixes.strip_repeats(docs, carry=others).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _columns(left.select("doc_id", "text", "row.*", F.length("text").cast("long").alias("n_chars")), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: rows repeat for repeated epochs. Where doc_ids are null or repeated, rows
    go by a number of their own."""
    times = (F.col("taken") / F.col("size")).cast("int").alias("_times")
    if identity.unique(docs):
        taken = mixing.mix_documents(docs, whole=True).where("taken > 0").select(F.col("doc_id").alias("_id"), times)
        x = docs.join(taken.hint("merge"), docs["doc_id"] == taken["_id"])
    else:
        rows = C.stash(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
        sized = rows.select("_row", "doc_id", "source", mixing.size_of(F.col("text")).alias("size"), mixing.key_of(F.col("doc_id"), identity.text_hash()).alias("_key"))
        taken = mixing.mix(C.stash(sized, "sizes"), whole=True).where("taken > 0").select("_row", times)
        x = rows.join(taken.hint("merge"), "_row")
    return _columns(x.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of the training sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("best_fit_packing", pack),
]
#: Language ID and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    before = C.mark()
    for name, stage in STAGES[:-1]:
        docs = C.stash(stage(spark, docs, sf_dir), name)
        C.discard(spark, before)  # a stage's result is all that the next one reads
    return STAGES[-1][1](spark, docs, sf_dir)
