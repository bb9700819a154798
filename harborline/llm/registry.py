"""Registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from harborline.llm import common as C
from harborline.llm import (exact_dedup, fertility, langid, license_scan, merkle, mixing, ngram_join, packing, simhash,
                            toxicity, trie_tokens, variants, warc)


def op1_warc_revisits(spark, sf_dir):
    found = warc.resolve_revisits(warc.records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("headers", warc.header_lines(found["headers"]))


def op2_tokeniser_fertility(spark, sf_dir):
    return fertility.measure(C.documents(spark, sf_dir))


def op3_naive_bayes_language(spark, sf_dir):
    return langid.identify(C.documents(spark, sf_dir))


def op4_trie_token_counts(spark, sf_dir):
    return trie_tokens.token_counts(C.documents(spark, sf_dir))


def op5_license_diagonals(spark, sf_dir):
    return license_scan.scan(C.documents(spark, sf_dir)).drop("spans")


def op6_first_fit_packing(spark, sf_dir):
    return packing.with_digest(packing.pack(C.documents(spark, sf_dir)))


def op7_subword_toxicity(spark, sf_dir):
    return toxicity.score(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_source_mix(spark, sf_dir):
    return mixing.taken(C.documents(spark, sf_dir))


def op9_streaming_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(C.documents(spark, sf_dir)).drop("file", "row")


def op10_prefix_tree_jaccard(spark, sf_dir):
    return ngram_join.groups(C.documents(spark, sf_dir))


def op11_merkle_multiproof(spark, sf_dir):
    return merkle.verify(C.documents(spark, sf_dir)).drop("proof")


def op12_simhash_tiles(spark, sf_dir):
    return simhash.groups(C.documents(spark, sf_dir))


def op13_spelling_variants(spark, sf_dir):
    return variants.variants(C.documents(spark, sf_dir))


def queries():
    return {f.__name__: f for f in (
        op1_warc_revisits, op2_tokeniser_fertility, op3_naive_bayes_language, op4_trie_token_counts,
        op5_license_diagonals, op6_first_fit_packing,
        op7_subword_toxicity, op8_source_mix, op9_streaming_exact_dedup, op10_prefix_tree_jaccard,
        op11_merkle_multiproof, op12_simhash_tiles, op13_spelling_variants)}


def oracle_sql():
    return {"op1_warc_revisits": warc.ORACLE_SQL, "op8_source_mix": mixing.ORACLE_SQL,
            "op9_streaming_exact_dedup": exact_dedup.ORACLE_SQL, "op11_merkle_multiproof": merkle.ORACLE_SQL,
            "op13_spelling_variants": variants.ORACLE_SQL}
