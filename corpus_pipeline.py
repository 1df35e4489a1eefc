"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
it as Parquet under the shared checkpoint folder and reads it back as the next
one's ``docs``.  All stages but the last return the columns they were given.

1. quality rules: documents that fail the base or the repetition rules go.
2. line dedup: lines that repeat an earlier line, or nearly so, go; a document none
   of whose words is left goes with them.
3. SimHash near-dedup: of each group the document with the smallest id stays.
4. decontamination: documents that hold a window of a benchmark item go.
5. mixing: the documents the mix takes, with their number of repetitions.

Each stage's output is removed when the next one's is written; the last one stays.

Defined results: a document with a null text fails stage 1.  Given to a later stage
directly, null and empty texts stay as they are in stages 2 and 4, are one group in
stage 3 (fingerprint zero) and have size 0 in stage 5, so the mix doesn't take them.
Repeated rows of one id and text are one document from stage 3 on.  Null ids come
last wherever an order decides.  An empty table gives an empty mix.  Columns beside
those of documents pass through; ``doc_id``, ``text`` and ``source`` must be there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.components import delete_path
from pairlab.llm.decontaminate import with_contamination
from pairlab.llm.edit_line_dedup import with_line_dedup
from pairlab.llm.mixing import mix
from pairlab.llm.registry import read
from pairlab.llm.repetition_quality import with_quality
from pairlab.llm.simhash_tiles import simhash_groups
from pairlab.session import cut_lineage, scratch_path

_TEXT = "text"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = with_quality(docs.select(F.struct("*").alias("doc"), _TEXT))
    return judged.filter("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_line_dedup(docs.select(F.struct("*").alias("doc"), "doc_id", _TEXT), short_lines=True)
    changed = F.size("removed") > 0
    rows = rows.filter(~changed | F.col(_TEXT).rlike(r"[^\x20\x09-\x0D]"))
    new = {_TEXT: F.col(_TEXT), "n_chars": F.when(changed, F.length(_TEXT)).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if new.get(c) is not None else F.col("doc")[c].alias(c) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash_groups(docs.select("doc_id", _TEXT))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    row = F.struct("doc_id", "digest")
    least = groups.groupBy("component").agg(F.min_by(row, order).alias("s"))
    copies = groups.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    stays = (least.select("s.*").join(copies.withColumnsRenamed({"doc_id": "c_id", "digest": "c_digest"}),
                                      F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest")))
             .select(F.md5(F.concat_ws(":", "digest", "doc_id")).alias("s_key"), "copies"))
    stays = cut_lineage(stays)
    key = F.md5(F.concat_ws(":", F.md5(F.coalesce(F.col(_TEXT), F.lit(""))), "doc_id"))
    kept = docs.select(F.struct("*").alias("doc"), key.alias("key")).join(stays, F.col("key") == F.col("s_key"))
    # only rows that stand there several times are shuffled again
    once = kept.filter("copies = 1").select("doc")
    return once.union(kept.filter("copies > 1").dropDuplicates(["key"]).select("doc")).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = with_contamination(docs.select(F.struct("*").alias("doc"), _TEXT), read(spark, sf_dir, "benchmark"))
    return judged.filter("not contaminated").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix(docs.select(F.struct("*").alias("doc"), "doc_id", _TEXT, "source")).filter("taken > 0")
    added = ["size", "source_size", "target", "taken", "repeats"]
    return taken.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in added), *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# words in SimHash shingles, components and the seeded mix are beyond SQL: tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read back."""
    docs = read(spark, sf_dir, "documents")
    place = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete_path(spark, f"{place}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
