"""The operators applied to the tables, with production parameters: one query for each, and the SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, linedup, media, neardup, pii, quality, sharding, sitetree, toxicity, trie, vectorcode, warc
from .common import held_out


#: For tests and the check only; a real run takes its key from its own secret store.
PII_KEY = b"example key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a model of the non-negative positive-unlabelled risk, learnt from rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity of 0.75 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the style tree of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = sitetree.extract(pages)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier line, exactly or but for one character."""
    return linedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op5_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a WAV column, read back and fingerprinted; the digest of its time-coded pairs is ``feature``."""
    found = media.media_features(table(spark, sf_dir, "documents"))
    code = F.concat(F.size("peaks").cast("string"), F.lit(":"), F.sha2(F.array_join("peaks", ","), 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", code.alias("feature"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of the benchmark items."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the public byte-level BPE and decoded again."""
    found = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives with revisits and segments, then read back and reassembled."""
    pages = table(spark, sf_dir, "pages")
    found = warc.archive_round_trip(pages)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "valid")


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 equal shards by rendezvous hashing of doc_id, and to 41."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = sharding.shard_records(docs, "doc_id", [1.0] * 40, text="text_crc32")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by keyed pseudonyms of the same format."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, PII_KEY)
    return found.select("doc_id", F.size("pii").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",").alias("kinds"), "text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All starts of all conversations, each opened by the first turns of its family's head."""
    return trie.family_trie(table(spark, sf_dir, "conversations"))


def op12_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored for toxicity by classifiers of confirmed toxic texts and the corpus without labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector coded by eight codebooks of sixteen entries."""
    return vectorcode.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pu_quality, op2_minhash_near_duplicates, op3_site_style_tree, op4_line_dedup, op5_media_fingerprints, op6_decontaminate, op7_bpe, op8_warc, op9_rendezvous_shards, op10_pii_pseudonyms, op11_prefix_trie, op12_pu_toxicity, op13_dual_tree_codes)}
ORACLES: dict[str, str] = {"op2_minhash_near_duplicates": neardup.ORACLE, "op4_line_dedup": linedup.ORACLE, "op6_decontaminate": decontam.ORACLE, "op11_prefix_trie": trie.ORACLE, "op13_dual_tree_codes": vectorcode.oracle()}
