"""The queries of this package by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oeuvre.llm import jaccard, language, licences, mixing, nearest, oracle, phrases, quality, secrets, substring, templates, trie, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": templates.query,
        "op2_language_id": language.query,
        "op3_licence_scan": licences.query,
        "op4_secret_scan": secrets.query,
        "op5_quality_classifier": quality.query,
        "op6_mix_sources": mixing.query,
        "op7_embedding_dedup": vectors.query,
        "op8_ngram_jaccard_join": jaccard.query,
        "op9_warc_round_trip": warc.query,
        "op10_substring_dedup": substring.query,
        "op11_nearest_neighbours": nearest.query,
        "op12_phrase_mining": phrases.query,
        "op13_conversation_trie": trie.query,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
