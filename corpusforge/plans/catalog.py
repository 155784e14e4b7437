"""Import every query module so the registry is complete."""

from __future__ import annotations

from corpusforge.plans import q_archive, q_batching, q_charset, q_crawl, q_exchange, q_metrics, q_stream, q_text, q_trials, q_vocab  # noqa: F401
from corpusforge.plans.registry import QUERIES


def all_queries():
    return dict(QUERIES)
