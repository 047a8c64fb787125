"""From documents to packed training sequences, in five stages that each write what they keep.

Every stage but the last returns the columns of `documents`; clean documents pass all of them.
Every row is judged by its own text, whatever ids repeat: decisions are joined on (doc_id, hash of the
text). The stages set the session's Arrow batches to at most 1,000 rows, as rows carry whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm import common, jaccard, packing, pii, toxicity, winnowing


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches the threshold; learns from `docs` and labels."""
    common.keep_batches_small(spark)
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"), toxicity.learns)
    return toxicity.below(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, of the smallest doc_id (a null one is the last
    choice); texts without words all stay. Rows are told by (doc_id, text), whatever ids repeat."""
    docs, back = common.apart(docs, "doc_id", "text")
    found = jaccard.grouped(docs).withColumn("_wordless", F.col("n_shingles") == 0)
    # rows without words: each (doc_id, text) is a group of its own
    group = [F.when(~F.col("_wordless"), F.col("component")).alias("_group"), *(F.when(F.col("_wordless"), F.col(c)).alias(f"_{c}") for c in ("doc_id", "text_hash")), "_wordless"]
    heads = found.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_head"))
    # documents are moved once: the join deals them by these columns, and equal rows of a head meet there
    keys = ["_id", "_null", "_hash"]
    of = lambda id_, hash_: [F.coalesce(id_, F.lit(0).cast("long")).alias("_id"), id_.isNull().alias("_null"), hash_.alias("_hash")]
    heads = heads.select(*of(F.col("_head.doc_id"), F.col("_head.text_hash")), "_wordless")
    kept = docs.select("*", *of(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(heads, keys)
    each = F.when(F.col("_wordless"), F.monotonically_increasing_id())
    one = kept.withColumn("_each", each).groupBy(*keys, "_each").agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return back(one.select("_row.*"))


def _of_rows(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """`docs` joined with decisions on (_id, _hash): the row's id and the hash of its text."""
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(decided, same, how)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, each row by its own text."""
    common.keep_batches_small(spark)
    docs, back = common.apart(docs, "doc_id", "text")
    found = winnowing.contamination(docs, common.read(spark, sf_dir, "benchmark")).where("n_hit > 0")
    return back(_of_rows(docs, found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "left_anti"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each personal span in its place."""
    return pii.redacted(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences (sequence_id, doc_ids of its pieces in their order, ids as little-endian unsigned 32-bit
    integers): what a training run reads."""
    common.keep_batches_small(spark)
    return packing.sequences(packing.pack_documents(docs, with_ids=True))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_personal_data),
    ("best-fit packing", pack),
]

#: Learned models and a tokenizer decide: SQL can't express it. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the whole table `documents`."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
