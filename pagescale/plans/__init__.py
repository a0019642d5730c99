"""Named queries over the given tables, by topic."""

from __future__ import annotations

import importlib

TOPICS = ("selection", "segments", "cleaning", "alignment", "sampling", "summaries", "intervals", "scoring", "pages", "fits", "collapse", "streams")


def _load() -> None:
    for topic in TOPICS:
        importlib.import_module(f"pagescale.plans.{topic}")


def all_queries() -> dict:
    from pagescale.plans.catalog import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    from pagescale.plans.catalog import ORACLES

    _load()
    return dict(ORACLES)
