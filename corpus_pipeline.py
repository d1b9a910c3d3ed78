"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents; where a stage shortens
a text it also sets ``n_chars``.

In every stage a NULL text is an empty one that stays NULL, rows equal in id and
text are one document, NULL ids come first among ids unless a stage says
otherwise, texts may be of any length, extra columns pass unchanged but for the
last stage, which ignores them, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.llm import lines, packing, queries, simhash, suffix, toxicity
from labelgrid.llm.common import row_key, table
from labelgrid.plans.materialize import discard, materialize, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain finds toxic go; a NULL text is kept."""
    chain = toxicity.train(docs, toxicity.chain_labels(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return toxicity.score(docs, chain).where(F.col("p_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go but for the first, short ones too; so do documents that had nothing else."""
    out = lines.drop_recurring_lines(docs, shortest=1)
    left = out.where((F.col("lines_dropped") == 0) | (F.trim("text") != ""))
    return _sized(left.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id, NULL last; of repeated rows one."""
    row = row_key("doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row.alias("row")).alias("key")
    groups = simhash.near_copies(docs.select(key, "text"), "key")
    gone = groups.where(F.col("key") != F.col("group_id")).select(F.col("key.row").alias("_labelgrid_row")).distinct()
    once = docs.withColumn("_labelgrid_row", row).dropDuplicates(["_labelgrid_row"])
    return once.join(gone, "_labelgrid_row", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occurred before go; so do documents that had nothing else."""
    rest = [c for c in docs.columns if c != "text"]
    out = suffix.remove_repeats(docs, suffix.kept_text, suffix.KEPT, keep=rest)
    left = out.where((F.col("removed") == 0) | (F.trim("text") != ""))
    return _sized(left.select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    return packing.pack(docs, queries.word_bpe())


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("suffix-array dedup", drop_repeats), ("best-fit packing", pack)]

#: The trained chain and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage wrote for its own use, and its input, go once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
