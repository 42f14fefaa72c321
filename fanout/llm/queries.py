"""One registered query per operator, over the whole of its table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from fanout.llm import (
    exact_dedup,
    jaccard_join,
    manifest,
    order_minhash,
    packing,
    pieces,
    pitman_yor,
    quality,
    quality_rules,
    quotes,
    repair,
    sql,
    substring_dedup,
    wrapper,
)
from fanout.llm.shared import table


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_messages(table(spark, sf_dir, "conversations"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality(docs, labels, F.col("source"), F.col("lang"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), 4, 85, 100)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = pieces.coded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", "n_bytes", F.crc32("ids").alias("ids_crc32"), "restored")


def op10_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, robbed of sentence ends, repeated or given the user's role, by a hash of id and turn."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat_ws(":", *named)) % 20
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("copy", "times")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct().withColumn("conv", repair.key_of(F.col("conv_id")))
    told = ids.join(found.conversations, "conv", "left").join(repair.digests(found.messages), "conv", "left")
    return told.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    torn = [F.translate("text", "\n", "") if f == "text" else F.col(f) for f in fields]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    kept = {"tampered": F.when(chosen, manifest.leaf(torn))}
    rows = manifest.manifest(table(spark, sf_dir, "documents"), fields, "source", "doc_id", kept)
    checked = manifest.verified(rows, F.coalesce("tampered", "leaf"))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_links,
        op2_exact_dedup,
        op3_quality,
        op4_pitman_yor,
        op5_packing,
        op6_substring_dedup,
        op7_order_minhash,
        op8_jaccard_join,
        op9_pieces,
        op10_wrapper_text,
        op11_conversation_repair,
        op12_merkle_manifest,
        op13_line_rules,
    )
}
ORACLES = {
    "op2_exact_dedup": sql.exact_groups(),
    "op8_jaccard_join": sql.jaccard_groups(4, 85, 100),
    "op11_conversation_repair": sql.conversation_repair(),
    "op12_merkle_manifest": sql.merkle_manifest(),
    "op13_line_rules": sql.quality_rules(),
}
