"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bit_sliced, cover_tree, html_text, language, ngram_join, packing, pieces, secrets, sharding, warc

SHARDS = 24
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def pack_digests(docs: DataFrame, path: str, kept_bytes: int | None = None) -> DataFrame:
    """The pieces of all documents in their windows, ids being given by their crc32."""
    cut = packing.tokenize(docs, path, kept_bytes=kept_bytes).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digests(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = tokenizer_path(PIECE_BPE)
    coded = pieces.encode(docs, path, decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        # A piece's mark for a space decodes to a space.
        (F.col("decoded") == F.translate("text", pieces.SPACE, " ")).alias("round_trip"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.span_string(base), 256).alias("base_sha256"),
        secrets.span_string(F.col("secrets")).alias("spans"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language.is_held_out(F.col("doc_id")), F.lit(False))
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    date = F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = warc.derivatives(warc.page_responses(pages, "url", "html", date, F.col("page_id")), "key")
    return made.select(
        F.col("key").alias("page_id"),
        "record_type",
        "record_id",
        F.col("headers")["WARC-Refers-To"].alias("refers_to"),
        "target_uri",
        "date",
        F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"),
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.col("headers")["X-Source-Content-Type"].alias("source_content_type"),
        F.octet_length("block").cast("long").alias("content_length"),
        F.crc32("block").alias("block_crc32"),
    )


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = sharding.assign_shard(rows, "doc_id", [1.0] * SHARDS, grown="grown_shard")
    rows = sharding.number_slots(rows, "shard", ["doc_id", "text_crc32", "size", "grown_shard"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_packing": op2_packing,
    "op3_pieces": op3_pieces,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_cover_tree": op6_cover_tree,
    "op7_html": op7_html,
    "op8_warc": op8_warc,
    "op9_bit_sliced": op9_bit_sliced,
    "op10_sharding": op10_sharding,
}
