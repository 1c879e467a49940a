"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  The first four
return the columns of ``documents``; the last returns packed pieces.

Null and empty texts, null ids, repeated rows, other columns and empty tables
pass every stage without an error; each function says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import decontamination, neardup, packing, quality, toxicity
from timberline.llm.queries import tokenizer_file, toxic_labels
from timberline.llm.tables import materialize, table


def _rows_where(scored: DataFrame, docs: DataFrame, keep) -> DataFrame:
    """The rows of ``docs`` whose ``score`` fits; their own columns only."""
    return scored.where(keep(F.col("score"))).select(*[F.col("__own")[c].alias(c) for c in docs.columns])


def _own(docs: DataFrame) -> DataFrame:
    """``text`` and everything else in one column, so that no name clashes with a score."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the weak-label quality model rejects.

    A text without features, so a null or empty one, has the score of the
    model's bias; a score equal to the threshold is kept; repeated rows fare alike.
    """
    _, scorer = quality.train(docs)
    return _rows_where(quality.score(_own(docs), scorer, ["__own"]), docs, lambda score: score >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model rejects; it learns from the labels of what is left.

    Without labels of both classes the model gives every text one score.  Null
    and empty texts have the score of no features; a score equal to the
    threshold is rejected.
    """
    model = toxicity.fit(docs, toxic_labels(spark, sf_dir))
    return _rows_where(toxicity.score(_own(docs), model, ["__own"]), docs, lambda score: score < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of smallest id, of each near-duplicate group.

    Texts without words are in no group; rows with a null id stay; rows that
    share an id are one document and stay or go together.
    """
    groups = neardup.near_duplicates(docs)
    gone = materialize(groups.where(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    return neardup.by_ids(docs, gone, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    All rows of an id go if one of them holds an item; null ids stay, as they
    cannot be told apart.  Null and empty texts and items match nothing.
    """
    leaks = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = materialize(leaks.select("doc_id").distinct(), "contaminated")
    return neardup.by_ids(docs, gone, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a null text counts as empty, and repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: No stage but the fourth has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
