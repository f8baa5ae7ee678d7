"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, SentencePiece.

Each stage takes the documents its predecessor kept and returns the columns of
documents; the last returns token ids. Stages are written as Parquet in the
shared folder and read again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import materialise, table
from varloom.llm.line_dedup import BLANKS, line_dedup
from varloom.llm.mixing import mix_sources, word_count
from varloom.llm.ngram_join import ngram_join
from varloom.llm.queries import TOKENIZER
from varloom.llm.sentencepiece import PieceModel, encode
from varloom.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.7; labels teach the score and never decide for a document."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, score_col="__score").where(F.col("__score") < TOXIC).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more sources share; those with nothing left go."""
    kept = line_dedup(docs).where((F.col("n_removed") == 0) | (F.btrim(F.replace("text", F.lit("\n"), F.lit("")), F.lit(BLANKS)) != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of five-word Jaccard 0.8 or more; wordless ones all stay.

    Rows that repeat an id, or have none, are documents of their own: then each
    row gets a key, and a null id counts as larger than any other. Of rows with
    one id in a group that with the smallest hash of its columns stays.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        groups = ngram_join(docs, k=5, percent=80)
        keep = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__keep"))
        return docs.join(keep, F.col("doc_id") == F.col("__keep"), "left_semi").select(*COLUMNS)
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = ngram_join(rows, k=5, percent=80, id_col="__row").select("__row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text", "lang", "source", "n_chars"), F.col("__row").alias("row"))
    first = groups.join(rows.select("__row", order.alias("o")), "__row").groupBy("component_id").agg(F.min("o")["row"].alias("__row"))
    return rows.join(first.select("__row"), "__row", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the whole times its words are taken, the rest by a hash of its id."""
    taken = mix_sources(docs).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken"))
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).alias("__times"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    part = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    mixed = docs.withColumn("__words", word_count(F.col("text"))).join(taken, same).withColumn("__copies", F.floor(F.col("__times") + part).cast("int"))
    return mixed.where("__copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text."""
    return encode(docs, PieceModel.load(TOKENIZER)).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram join", near_copies), ("mixing", mixing), ("sentencepiece", tokens)]

#: The score and the token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
