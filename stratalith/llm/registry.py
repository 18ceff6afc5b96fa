"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module; each module has a function of that name, and OPN_SQL where SQL can express it.
MODULES = {
    "op1_chat_formatting": "chat_format",
    "op2_quality_classifier": "quality_classifier",
    "op3_minhash_near_dedup": "near_dedup",
    "op4_sentencepiece": "sentencepiece_codec",
    "op5_exact_dedup": "exact_dedup",
    "op6_substring_dedup": "substring_dedup",
    "op7_quality_rules": "quality_rules",
    "op8_token_binary": "token_binary",
    "op9_toxicity": "toxicity",
    "op10_mixing": "mixing",
    "op11_topk_search": "topk_search",
    "op12_phrase_collocations": "collocations",
    "op13_source_divergence": "source_divergence",
}


#: Queries that have SQL: a module that lacks a library must not take the others with it, so only these are imported for it.
WITH_SQL = ("op1_chat_formatting", "op5_exact_dedup", "op11_topk_search", "op12_phrase_collocations", "op13_source_divergence")


def _module(name: str):
    return import_module(f".{MODULES[name]}", __package__)


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(_module(name), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries():
    """Each module is imported when its query runs."""
    return {name: _query(name) for name in MODULES}


def oracle_sql():
    return {name: getattr(_module(name), f"{name.split('_')[0].upper()}_SQL") for name in WITH_SQL}
