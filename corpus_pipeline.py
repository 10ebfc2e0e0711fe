"""From raw documents to encoded training text, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes it as Parquet and reads it back as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.  Before each, executors give back the heap
that earlier stages filled with garbage, as the Python workers need memory beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import near_dup, queries, secret_scan, toxicity, winnow
from inkwell.llm.text import give_back_heaps, learned_fold, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidied(stage: Stage) -> Stage:
    @wraps(stage)
    def after_others(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return stage(spark, docs, sf_dir)

    return after_others


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with columns named by place, so that none clashes with a column that an operator adds, and the names of
    ``doc_id`` and ``text``."""
    names = [f"column{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def _as_before(found: DataFrame, plain: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*plain.columns).toDF(*docs.columns)


@_tidied
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier calls toxic go; the others keep all their columns as they are.

    It learns from the labels of learnable ids only.  Without any toxic label all documents stay.  A null or empty text is
    scored as one without words; a row with a null id is scored, never learned from; repeated rows are scored each; an empty
    table gives an empty one.
    """
    plain, key, text = _numbered(docs)
    model = toxicity.fitted(plain, queries.table(spark, sf_dir, "labels"), learned_fold, id_col=key, text_col=text)
    return _as_before(toxicity.scored(plain, model, keep=plain.columns, text_col=text).where("predicted = 0"), plain, docs)


@_tidied
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, that with the least id, with all its columns as they are.

    Of rows repeated as they are one stays.  Null and empty texts are copies of each other; a null id is the least only where
    all ids of a group are null; an empty table gives an empty one.
    """
    plain, key, text = _numbered(docs)
    return _as_before(near_dup.deduplicated(plain, id_col=key, text_col=text), plain, docs)


@_tidied
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by passages of the benchmark go; the others keep all their columns as they are.

    A null text has no words and is clean, as all documents are if the benchmark is empty; repeated rows are judged each; an
    empty table gives an empty one.
    """
    plain, _, text = _numbered(docs)
    found = winnow.contamination(plain, queries.table(spark, sf_dir, "benchmark"), keep=plain.columns, text_col=text)
    return _as_before(found.where("NOT contaminated"), plain, docs)


@_tidied
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows its text; every document and any other column stays as it is.

    A null text stays null with its ``n_chars``; repeated rows are cleaned each; an empty table gives an empty one.
    """
    plain, _, text = _numbered(docs)
    model = secret_scan.trained(secret_scan.labelled_samples(spark, plain, text))
    found = secret_scan.scan(plain, model, keep=plain.columns, text_col=text)
    # a generator of one row computes the new text once; as an expression used twice, Spark 4.1 counts its length wrong
    found = found.select("*", F.explode(F.array(secret_scan.redacted(F.col(text), F.col("spans")))).alias("new"))
    out = {text: F.col("new")}
    if "n_chars" in docs.columns:
        count = plain.columns[docs.columns.index("n_chars")]
        out[count] = F.when(F.size("spans") > 0, F.length("new").cast(plain.schema[count].dataType)).otherwise(F.col(count))
    return found.select(*[out.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*docs.columns)


@_tidied
def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded training text: ``doc_id``, ``sample``, ``ids``, ``log_prob``, ``gumbel``, ``inclusion``, ``round_trip``.

    A row for the model's own encoding of each whole text (sample 0) and for each of two sampled segmentations; texts with
    fewer have fewer.  A null or empty text has one segmentation, without ids (samples 0 and 1); repeated rows are encoded each, alike; an
    empty table gives an empty one; no other column is returned.
    """
    plain, key, text = _numbered(docs)
    return queries.encoded(plain, [key], key, text).withColumnRenamed(key, "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Trained models and sampled segmentations are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
