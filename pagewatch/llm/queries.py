"""Registered queries of the training-text operators and the SQL that checks them."""

from __future__ import annotations

from pagewatch.llm import (
    bk_dedup, cover_tree, decontaminate, deobfuscate, licences, mixing, rule_ensemble, simhash, simplex_clusters, suffix_dedup, token_pack,
    trie_codes, url_terms,
)
from pagewatch.llm.tables import table


def op1_mixing(spark, folder):
    return mixing.mixed(table(spark, folder, "documents"))


def op2_token_pack(spark, folder):
    return token_pack.packed(spark, table(spark, folder, "documents"))


def op3_decontaminate(spark, folder):
    return decontaminate.flag_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_licences(spark, folder):
    return licences.scan_documents(table(spark, folder, "documents"))


def op5_suffix_dedup(spark, folder):
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op6_rule_ensemble(spark, folder):
    return rule_ensemble.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_url_terms(spark, folder):
    return url_terms.judge_urls(table(spark, folder, "pages"))


def op8_simhash(spark, folder):
    return simhash.fingerprints(table(spark, folder, "documents"))


def op9_deobfuscate(spark, folder):
    return deobfuscate.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_bk_dedup(spark, folder):
    return bk_dedup.near_components(table(spark, folder, "documents"))


def op11_simplex_clusters(spark, folder):
    return simplex_clusters.cluster(table(spark, folder, "embeddings")).drop("n_compared")


def op12_trie_codes(spark, folder):
    return trie_codes.compress(table(spark, folder, "embeddings"))


def op13_cover_tree(spark, folder):
    return cover_tree.near_vectors(table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_token_pack, op3_decontaminate, op4_licences, op5_suffix_dedup, op6_rule_ensemble, op7_url_terms, op8_simhash, op9_deobfuscate,
        op10_bk_dedup, op11_simplex_clusters, op12_trie_codes, op13_cover_tree,
    )
}
ORACLE_SQL = {
    "op1_mixing": mixing.oracle(),
    "op7_url_terms": url_terms.oracle(),
    "op11_simplex_clusters": simplex_clusters.oracle(),
    "op12_trie_codes": trie_codes.oracle(),
    "op13_cover_tree": cover_tree.oracle(),
}
