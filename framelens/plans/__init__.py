"""Named queries over the given tables."""

from __future__ import annotations


def _load() -> None:
    from framelens.plans import identity_queries, provenance_queries, scalar_queries, sequence_queries, telemetry_queries  # noqa: F401


def registered():
    from framelens.plans.catalog import QUERIES

    _load()
    return dict(QUERIES)


def oracles():
    from framelens.plans.catalog import ORACLES

    _load()
    return dict(ORACLES)
