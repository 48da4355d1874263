"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL oracles."""

from __future__ import annotations

from reelcat.plans import catalog, identity, lifecycle, media, metrics, streaming

_MODULES = [catalog, identity, media, lifecycle, metrics, streaming]


def all_queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
