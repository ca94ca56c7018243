"""A training-corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import line_dedup, minhash, mixing, pieces, toxicity
from evalframe.llm.common import remove, scratch_dir, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores below the threshold; labels only teach, they decide no document.

    Null, empty and wordless texts stay, and so does everything where the labels teach nothing.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit_and_score(docs, labels, score_col="__ef_score").where(F.col("__ef_score") < toxicity.TOXIC).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources show stay only at their first place; every document stays, n_chars follows the text.

    A null text stays null, with a null n_chars; a text whose every line goes becomes empty.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows without words or with a null id stay; rows of one id stay or go together.
    """
    return minhash.drop_near_duplicates(docs, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights, in its shards' shuffled order; a document comes as often as it is taken, up to three times.

    Rows without words weigh nothing and go where their block goes; a null source is a source, a null id is dealt like
    any other. A document above its source's target may be left out whole.
    """
    return mixing.laid_out(mixing.mix(docs)).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as piece ids, with proof that they decode to the text.

    A null text has null ids and a null n_pieces and decodes to null, an empty one has no ids. round_trip is false only for
    texts that hold the white-space mark itself, which comes back as a space.
    """
    both = pieces.encode_and_decode(docs.select("doc_id", "lang", "source", "text"))
    return both.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentence_pieces", to_pieces),
]

#: A trained network and sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what stands between them lies in the shared folder until the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = f"{folder}/{number}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
