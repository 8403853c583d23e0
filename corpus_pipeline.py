"""A corpus pipeline from five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents.  ``run`` writes each stage's rows to the shared
folder and reads them again, so that a stage is computed once and a lost
executor takes nothing of it along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import mixing, near_dedup, pieces, secrets, toxicity
from tracelake.llm.common import forget, fresh, marker, table, written

#: Targets of junk and of good domains, as multiples of their tokens: good documents stay, junk is thinned.
FACTORS = (0.5, 1.0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under one half, with all their columns.

    Null and empty texts have the model's score of a text without features and stay with clean ones; without labels
    nothing goes; a score of exactly one half goes; repeated rows stay or go together; texts are read
    whole; no rows give no rows; a column named score stays as it is.
    """
    model = toxicity.train(docs, toxicity.train_rows(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    score = fresh(docs, "score")
    return toxicity.score(docs, model, tuple(docs.columns), out=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns.

    The row whose id names the class stays (least id; of several texts with that id the one of the least digest; of repeated
    rows any).  Null and empty texts are one class; a null id stays only where no row of its class has one; texts are
    read whole; no rows give no rows; other columns may have any name.
    """
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; n_chars follows the new text.

    A null text and its n_chars stay null and as they are, an empty text stays empty; overlapping findings become one mark;
    repeated rows change alike; texts are read whole; no rows give no rows; other columns stay as they are.
    """
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows thinned to the domains' targets, rates held at 1: no row is repeated, good documents stay.

    Null and empty texts have no tokens and the rate of the network's posterior for them; repeated rows have one rate and one draw (from the id); a
    null id draws as any value; texts are read whole; no rows give no rows; without labels no domain is told apart
    and all are thinned alike; other columns may have any name.
    """
    return mixing.mix(docs, mixing.train_domains(docs, table(spark, sf_dir, "labels")), FACTORS, repeat=False)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and two sampled segmentations of each text, with their scores.

    A null or empty text has the one empty segmentation; a text with one segmentation alone has that; repeated
    rows have equal samples; a null id draws as 0; texts are read whole; no rows give no rows; other columns are not read.
    """
    return pieces.encode_samples(docs, k=2, slice_bytes=1 << 20).drop("ids_sha256")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secret_scan", redact_secrets), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = table(spark, sf_dir, "documents"), marker()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, begun, docs)  # what the stage and those before it left behind
    return STAGES[-1][1](spark, docs, sf_dir)
