"""From raw documents to tokens: five stages, each written as Parquet and read again by the next.

1. quality: documents that the additive classifier rejects go;
2. near copies: one document of each SimHash group stays, the one with the smallest id (rows without id come last; of
   rows with the same id the one with the smallest hash of the text);
3. secrets: every span that the scanner finds is masked by the name of its kind; no document goes;
4. mixing: each document occurs as often as the balanced mix takes it, so some go and some repeat;
5. tokens: SentencePiece ids of every document of the mix.

Stages 1 to 4 return the columns of ``documents`` as they came, whatever they are named beside doc_id, text and source;
stage 3 keeps ``n_chars`` right where it exists. A null text goes through as null and has null ids; an empty table stays
empty. Every stage works on its predecessor's rows alone; only ``labels`` is read beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm import gam, mixing, queries, secrets, simhash, spiece
from stayrate.llm.common import fold, packed, table, unpacked
from stayrate.session import cut, scratch_path

LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = gam.train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = gam.scores(packed(docs, "doc_id", "text"), model, keep=("doc_id", "text", "row"))
    return unpacked(scored.where(F.col("score") >= LEAST_QUALITY), docs.columns, "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packed(docs, "doc_id", "text").select(
        "*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.xxhash64("text").alias("text_hash"))
    found = simhash.near_copies(rows, width=3, bits=2, keep=("key", "text_hash"), roots=True)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "text_hash")).alias("at"))
    kept = rows.join(first.select("at.key", "at.text_hash"), ["key", "text_hash"], "left_semi")
    return unpacked(kept.dropDuplicates(["key", "text_hash"]), docs.columns, "doc_id", "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = scratch_path(spark, "ledger")
    secrets.update(docs.select("text"), ledger)
    rows = packed(docs, "text").withColumn("n_chars", F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))
    found = secrets.joined_back(rows, secrets.findings(spark, ledger))
    masked = found.withColumn("text", secrets.masked(F.col("text"), F.col("spans"))).withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return unpacked(masked, docs.columns, "text", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, mixing.shares(docs, weights=(5.0, 2.0, 1.0), most=3))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spiece.round_trips(docs, spiece.Pieces.load(queries.TOKENIZER), keep=("doc_id", "source"))


STAGES = [
    ("quality", quality), ("near copies", near_copies), ("secrets", mask_secrets), ("mix", mix), ("tokens", tokens),
]
#: Hashes, trained tables and token ids are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
