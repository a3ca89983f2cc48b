"""The registered queries of the operators of this subpackage, at their production parameters."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from newsloom.llm import audit, decontaminate, exact, hnsw, htmltext, licenses, packing, quality, repeats, resample, simhash, tokenfile, toxicity
from newsloom.llm.tables import table
from newsloom.workspace import new_path, write_through


def _remainder(n):
    """crc32 of the document's id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_hnsw(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_suffix_dedup(spark, sf_dir):
    return repeats.remove(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_covering(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark, sf_dir):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary)


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    held_out = _remainder(4) == 2
    stats = write_through(quality.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.train(stats, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(stats, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(3) == 1
    model, raw = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(raw, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_token_binary(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary)
    return tokenfile.read_tokens(spark, path, with_ids=False)


def op11_filter_audit(spark, sf_dir):
    found = audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.interactions(audit.postings(found))


def op12_exact_dedup(spark, sf_dir):
    return exact.find(table(spark, sf_dir, "documents"), digest=True)


def op13_importance_resample(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.draw(docs, target, percent=25, least_words=20, seed=7).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


QUERIES = {
    "op1_hnsw": op1_hnsw,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_simhash_covering": op4_simhash_covering,
    "op5_html_text": op5_html_text,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_token_binary": op10_token_binary,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_importance_resample": op13_importance_resample,
    "pipeline": corpus_pipeline.run,
}

# The others cannot be written in SQL; tests/llm compares them with brute force.
ORACLE = {
    "op11_filter_audit": audit.SQL,
    "op12_exact_dedup": exact.SQL,
    "op13_importance_resample": resample.SQL,
    "pipeline": corpus_pipeline.ORACLE_SQL,
}
