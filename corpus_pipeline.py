"""From raw documents to packed sequences: toxic texts and near copies go, long repeats are cut, personal data masked."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import nearest_copies, packing, personal_data, suffixes, toxicity
from tidelog.llm.common import Stages, few, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, each row by its own text, with or without an id.

    Null and empty texts stay, as does every column; an empty table gives an empty table.
    """
    return few(toxicity.without_toxic(docs, table(spark, sf_dir, "labels")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of those with the smallest id, any one; null ids come last.

    Rows are judged by their texts alone: rows of one id stay where their texts differ, and
    copies go whatever their ids. Null texts and texts without words are copies of nothing
    and stay. Columns are kept, whatever their names; an empty table gives an empty table.
    """
    # stored, since row numbers would differ when computed again; the struct keeps columns of any name apart
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = Stages(spark, "rows").keep(few(packed, docs))
    found = nearest_copies.near_copies(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    judged = rows.select("number", F.col("row.doc_id").alias("id")).join(found.select(F.col("doc_id").alias("number"), "component_id"), "number")
    first = judged.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "number")).alias("first"))
    kept = rows.join(first.select(F.col("first.number").alias("number")), "number", "left_semi")
    return few(kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)), rows)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more, or strings of 400 bytes or more, that also stand anywhere else.

    All occurrences go, those in repeated rows and in rows without an id too. A character
    cut in two is dropped, a null text stays null, and n_chars follows the text. Other
    columns are kept, whatever their names; an empty table gives an empty table.
    """
    return few(suffixes.cut(docs), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows the text.

    Every row stays, also without an id or repeated; a null text stays null. Other columns
    are kept, whatever their names; an empty table gives an empty table.
    """
    out = personal_data.masked(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row with their places in sequences.

    A null or empty text is one piece; rows that repeat or have no id are packed each for
    themselves; columns other than doc_id and text are left out; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
#: Scores, sketches and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stages = Stages(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        done = stages.keep(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            stages.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
