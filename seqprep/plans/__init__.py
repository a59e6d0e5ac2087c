"""Registered queries: operators applied to the given tables, with the SQL that checks them."""

from __future__ import annotations


def all_queries():
    import importlib

    for module in MODULES:
        importlib.import_module(f"seqprep.plans.{module}")
    from seqprep.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES


MODULES = ["text_queries", "signal_queries", "score_queries", "corpus_queries", "phone_queries", "stream_queries", "source_queries"]
