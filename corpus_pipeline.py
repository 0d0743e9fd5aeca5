"""The corpus pipeline: toxicity, quality rules, line dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of docs. Ids may repeat: each row
is judged by itself, and the near-duplicate stage keeps one row of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Stash, numbered, ship, table
from basalt.llm.line_dedup import dedup_lines
from basalt.llm.ngram_join import near_duplicates
from basalt.llm.packing import pack_documents
from basalt.llm.quality import judge
from basalt.llm.tokens import free_name
from basalt.llm.toxicity import train

CAPACITY, END_ID = 2048, 0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    ship(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    _, predicted, _ = model.names(docs)
    return model.score(docs, keep_text=True).where(F.col(predicted) == 0).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    stash, row = Stash(spark, "quality"), free_name(docs, "__row")
    rows = numbered(docs, row, stash)
    bad = judge(rows, table(spark, sf_dir, "labels"), stash=stash, keep=(row,)).where("not kept").select(row)
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go; documents stay, with n_chars of what is left."""
    ship(spark)
    out = dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays; of its equal rows, one."""
    ship(spark)
    stash = Stash(spark, "near")
    row = free_name(docs, "__row")
    rows = numbered(docs, row, stash)
    known = near_duplicates(rows.select(F.struct("doc_id", row).alias("key"), "text"), "key", stash=stash)
    stays = known.where(F.col("key").eqNullSafe(F.col("class_id"))).select(F.col("key")[row].alias(row))
    return rows.join(stays, row, "left_semi").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    import public_tokenizers

    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]
#: SQL can't express the automata, signatures and tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stash = Stash(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash.put(docs, name)
    return docs
