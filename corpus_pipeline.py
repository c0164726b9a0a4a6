"""A corpus pipeline from the training-data operators: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, ngram_join, packing, secrets
from tidemark.llm._common import drop, fresh, materialize
from tidemark.llm.queries import BYTE_BPE, pack_digests, tokenizer_path

#: A document goes if no language holds this share of it.
LEAST_SHARE = 0.3
#: Bytes of words that packing keeps in a worker: the executors' heaps have grown in the stages before it.
KEPT_BYTES = 64 << 20


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a main language; fills in languages that are null.

    Without any labelled row nothing can be told, and all documents with letters stay.
    """
    held_out = F.coalesce(language.is_held_out(F.col("doc_id")), F.lit(False))
    model = language.fit(docs.where(~held_out))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # What isn't text goes along as one value, so that no column of its own is taken for one of the stage's.
    whole = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")
    found = language.identify(whole, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    own = {"text": F.col("text"), "lang": F.coalesce("doc.lang", "lang_pred").alias("lang")}
    return found.select(*[own.get(c, F.col("doc")[c].alias(c)) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links join; repeated rows become one.

    Of rows that share the id too, the one stays whose text's md5 is smallest, then the one
    whose other columns are, nulls first; of texts without words only those that are equal
    and share their id count as repeated. Rows without an id are kept.
    """
    number, same, order, group, maybe = fresh(docs.columns, "_row", "_same", "_order", "_group", "_maybe")
    # Rows may share an id, so each has a number of its own, written so that it stays the same.
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    named = rows.where(F.col("doc_id").isNotNull())
    digest = F.md5(F.col("text"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    marks = named.select(number, F.struct("doc_id", digest.alias("text"), *others, number).alias(order), F.concat_ws(":", "doc_id", F.coalesce(digest, F.lit("null"))).alias(same))
    found = ngram_join.join(named, number).select(number, "n_links", "class_id")
    own = F.when(F.col("n_links") > 0, F.concat(F.lit("class:"), "class_id")).otherwise(F.col(same))
    groups = materialize(found.join(marks, number).select(number, order, own.alias(group)), "groups")
    first = groups.groupBy(group).agg(F.min(order)[number].alias(number)).select(number)
    gone = materialize(groups.select(number).join(first, number, "left_anti"), "gone")
    drop(groups)
    # Only rows whose bit says that they may have to go are shuffled with their texts.
    filters, bits = ngram_join.member_filter(gone, number, gone.count())
    flagged = ngram_join.maybe_members(rows, number, materialize(filters, "filter"), bits, maybe)
    kept = flagged.where(~F.col(maybe)).unionByName(flagged.where(F.col(maybe)).join(gone, number, "left_anti").select(*flagged.columns))
    return kept.select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in every text; all documents stay."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows: a row for each piece."""
    return pack_digests(docs, tokenizer_path(BYTE_BPE), KEPT_BYTES)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Language identification is no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
