"""Queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from chainlake.llm import chat, lines, media, mixing, packing, quality, simhash, tokens, urls, warc

MODULES = (chat, lines, media, mixing, packing, quality, simhash, tokens, urls, warc)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
