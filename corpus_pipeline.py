"""A corpus pipeline of four stages, each one operator of ``seqspark.llm`` over all rows that its
predecessor kept: toxicity, near copies, repeated passages, packing. All but the last return the columns
of ``documents``. No SQL can express a stage, so ORACLE_SQL is None and tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import jaccard, packing, substrings, toxicity
from seqspark.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of being toxic is below one half."""
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fitted(spark, sf_dir))
    return scored.filter("p_toxic < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five words, similarity of 0.8 or more): the
    first by id (null ids last), and of rows with that id the one of least hash; of rows equal in id and
    text one stays. Documents without words have no copies and all stay."""
    docs = docs.select(*COLUMNS)
    groups = jaccard.jaccard_components(docs, size=5, percent=80)
    wordless = groups.filter("n_shingles = 0").select("doc_id", "h").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = groups.filter("n_shingles > 0").groupBy("component").agg(F.min(order).alias("r")).select("r.doc_id", "r.h")
    keyed = docs.withColumn("h_", F.xxhash64("text"))

    def pick(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("k_"), "h")
        return keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("k_")) & (F.col("h_") == F.col("h")), "left_semi")

    return pick(first).dropDuplicates(["doc_id", "h_"]).unionByName(pick(wordless)).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that repeat from the texts; documents that are left without words go. A document
    that loses nothing keeps its text as it is (null too); others keep their words joined by one space. Rows
    with null or equal ids are documents of their own. An empty table gives no rows."""
    docs = docs.select(*COLUMNS)
    done = substrings.remove_repeats(docs).select(F.coalesce("doc_id", F.lit(0)).alias("k_"), F.col("h").alias("h_"), "n_removed", "kept")
    done = done.filter("n_removed > 0").dropDuplicates(["k_", "h_"])
    keyed = docs.withColumn("k_", F.coalesce("doc_id", F.lit(0))).withColumn("h_", substrings.row_hash("doc_id", "text"))
    out = keyed.join(done, ["k_", "h_"], "left").filter("n_removed is null or kept != ''")
    text = F.when(F.col("n_removed").isNotNull(), F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed").isNotNull(), F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of 1,024 tokens; a null text is empty. An empty table gives no rows."""
    import public_tokenizers as P

    return packing.pack(docs, P.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_each_group), ("substring_dedup", cut_repeats), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
