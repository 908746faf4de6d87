"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from . import decontaminate, html, jaccard, language, lines, mixing, quality, secrets, suffix, urls

MODULES = (quality, mixing, decontaminate, secrets, language, jaccard, urls, html, lines, suffix)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
