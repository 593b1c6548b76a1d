"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, BPE.

run() applies the STAGES to the documents table; each stage's result is written as Parquet to the shared folder and
read again as the next one's docs. Stages drop or change documents:

language_id       drops documents without a letter, or whose language scores below MIN_SCORE
line_dedup        takes out repeated lines (n_chars follows the text); a document that lost its whole text goes
ngram_jaccard     keeps the document with the least id of each group of near duplicates (repeated rows: one)
decontamination   drops documents that hold a span of a benchmark item
bpe               returns doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256

Documents with a null id or text: a null text has no letter and goes in the first stage; a null id is kept as far as no
stage can tell it from others (it is never dropped as a near duplicate). Rows that a stage does not change are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import op1_jaccard, op2_bpe, op7_winnowing, op8_langid, op9_lines
from bitloom.llm.common import id_filter, load, written

MIN_SCORE = 0.5
#: Documents of an Arrow batch in bpe.
BPE_BATCH = 500
#: SQL has no PPM trees and no SimHash; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = op8_langid.train(docs.where(~op8_langid.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    found = op8_langid.predict(rows, counts, keep=("doc",))
    return found.where((F.col("lang_pred") != op8_langid.UND) & (F.col("score") >= MIN_SCORE)).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op9_lines.dedup(docs)
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.trim(F.translate("row.text", "\n\r\t", "   ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.when(changed, F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType))).otherwise(F.col("row")))
    return out.select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op1_jaccard.components(docs).where("doc_id is not null")
    odd = written(found.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("n")).where("first <> doc_id or n > 1").select(F.col("doc_id").alias("__id"), (F.col("first") == F.col("doc_id")).alias("__stays")))
    maybe = F.coalesce(id_filter(odd, "__id")(F.coalesce("doc_id", F.lit(0)).cast("bigint")) & F.col("doc_id").isNotNull(), F.lit(False))
    asked = docs.where(maybe).join(odd, F.col("doc_id") == F.col("__id"), "left").where(F.coalesce("__stays", F.lit(True))).select(docs.columns)
    return docs.where(~maybe).unionByName(asked.dropDuplicates())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = written(op7_winnowing.spans(docs, load(spark, sf_dir, "benchmark")).select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).distinct())
    mark = F.xxhash64("text")
    maybe = id_filter(hits, "__mark")(mark)
    asked = docs.where(maybe).join(hits, F.col("doc_id").eqNullSafe(F.col("__doc")) & (mark == F.col("__mark")), "left_anti")
    return docs.where(~maybe).unionByName(asked.select(docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # An executor is full from the stages before: whole texts go to Python in small batches.
    return written(op2_bpe.encode_decode(docs, op2_bpe.default_tokenizer(), keep=("doc_id", "lang", "source")), batch=BPE_BATCH)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
