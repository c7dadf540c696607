"""Queries and oracle SQL of the training-data operators, one opN_<name> for each, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosea.llm.common import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    """Windows of 35 words that start anywhere else go."""
    from cartosea.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"), F.col("_longest").alias("longest_repeat"))


def op7_bpe(spark, sf_dir):
    """Encode all documents, decode the ids, digest both."""
    from cartosea.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    """Base rules and fertility bands over all documents."""
    from cartosea.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_pieces", "n_tokens", "n_byte_pieces", F.round("entropy", 6).alias("entropy")
    )


def op10_warc(spark, sf_dir):
    """Write all pages as WARC and read them back."""
    from cartosea.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_chat_formatting(spark, sf_dir):
    """Format all conversations and one of control strings, read the tree back."""
    from cartosea.llm.chat import format_tree, read_back

    own = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(*format_tree(turns.unionByName(own)))


def op4_html_extraction(spark, sf_dir):
    """Main text of all pages."""
    from cartosea.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_minhash_near_dedup(spark, sf_dir):
    """Components of near-duplicate documents."""
    from cartosea.llm.near_dedup import mark_documents

    return mark_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark, sf_dir):
    """Learn on labelled rows that are not held out, score all documents."""
    from cartosea.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model, ["doc_id"])
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_decontamination(spark, sf_dir):
    """Documents and the benchmark items that they leak."""
    from cartosea.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark, sf_dir):
    """Write all documents' ids and read the files back."""
    from cartosea.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_cross_tokenizer_alignment(spark, sf_dir):
    """Minimal groups of two tokenizers' tokens in all documents, and the counts of the id pairs that they link."""
    from cartosea.llm import alignment

    return alignment.digests(table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    from cartosea.llm import fingerprint

    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op13_conversation_structure_repair(spark, sf_dir):
    """Damage all conversations, then repair them."""
    from cartosea.llm import repair

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damage(turns), turns)


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op7_bpe": op7_bpe, "op8_quality_rules": op8_quality_rules, "op10_warc": op10_warc, "op6_chat_formatting": op6_chat_formatting, "op4_html_extraction": op4_html_extraction, "op9_minhash_near_dedup": op9_minhash_near_dedup, "op5_toxicity": op5_toxicity, "op3_decontamination": op3_decontamination, "op2_token_files": op2_token_files, "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment, "op12_document_fingerprints": op12_document_fingerprints, "op13_conversation_structure_repair": op13_conversation_structure_repair, "pipeline": pipeline}
SQL: dict[str, str] = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN winner END AS refers_to
FROM q
""",
}


def queries():
    """Name -> callable(spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql():
    """Name -> DuckDB SQL."""
    return dict(SQL)
