"""A corpus pipeline: language ID, near duplicates, repeated passages, mixing by source, packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import jaccard_join, langid, mixing, packing, substring_dedup
from threadloom.llm.common import table, written
from threadloom.llm.queries import MAX_REPEATS
from threadloom.sources import shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with less than the calibrated score go; a missing language is filled in."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs, model, keep=COLUMNS)
    return out.where("NOT rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays. Rows that repeat an id are documents of their
    own: one goes only if it links with a row that stays, or has its id and text; rows without an id stay."""
    rows = docs.select(*COLUMNS).where("doc_id IS NOT NULL")
    again = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id", F.lit(True).alias("_again")), "pipeline-repeated")
    if again.isEmpty():
        keyed = rows.withColumn("_row", F.col("doc_id"))
    else:  # a key of its own for each text of a repeated id
        keyed = rows.join(again, "doc_id", "left").withColumn("_row", F.when(F.col("_again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).drop("_again")
    found = jaccard_join.classes(keyed, key="_row").select("_row", "component_id").distinct()
    ids = keyed.select("_row", "doc_id").distinct()
    first = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("r")).select("r._row")
    one = keyed.join(first, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return one.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that came in an earlier document; a text that loses nothing stays as it is."""
    out = substring_dedup.dedup(docs, carry=("lang", "source", "n_chars"), as_was=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, none more than MAX_REPEATS times; every document is used at least once."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in bins of 2,048 words; null and empty texts are pieces of 0, and repeats of a document, or copies
    equal but for case, never share a bin."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained weights and a packing order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage but the last is written; what it and those before it wrote besides goes then, and
    nothing that other queries have written meanwhile."""
    docs = table(spark, sf_dir, "documents")
    with shared.run():
        for name, stage in STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            path = shared.new_path(spark, f"pipeline-{name}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            shared.forget(spark, keep=[path])
        return STAGES[-1][1](spark, docs, sf_dir)
