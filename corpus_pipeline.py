"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents.

Cases, of every stage: an empty table gives no rows. Columns beyond doc_id and text stay as they came, whatever their names
(packing alone returns pieces). Rows that repeat are judged alike. Nulls, empty and very long texts: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.exact_dedup import keep_first
from loomgraph.llm.jaccard_join import keep_representatives
from loomgraph.llm.packing import pack
from loomgraph.llm.shared import materialize, resumed, table
from loomgraph.llm.substring_dedup import remove_repeats
from loomgraph.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below their language's threshold stay; at the threshold they go.

    A null text scores as an empty one, a null language has the threshold of the language ''. Without labels of both classes all stay.
    """
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike but for white space one stays: the one with the most code points, then the smallest doc_id.

    Null texts are empty ones, so one of all such stays. A null doc_id comes after every other; of rows that repeat one stays.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays.

    Texts that are null or have no words link with nothing and stay. Documents without an id come last; rows alike in id and text share a verdict.
    """
    return keep_representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that also start elsewhere go; n_chars follows the text.

    No document goes; a text of which nothing stays, or a null one, is empty then. What a cut leaves of a broken character goes too.
    """
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, in sequences of at most 2048 tokens.

    A null or empty text is its end token alone. Rows that repeat are packed each.
    """
    return pack(docs).drop("ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("jaccard_join", near), ("suffix_array_dedup", repeats), ("packing", packing)]

#: SQL can't express a trained classifier or a tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """work: a shared folder for the stages' tables. What is whole there is read, not made again: a driver that was lost goes on where it stood.

    The folder belongs to one input; other documents need another folder.
    """
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1], 1):
        if work is None:
            docs = materialize(stage(spark, docs, sf_dir))
        else:
            docs = resumed(spark, f"{work}/{number}_{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
