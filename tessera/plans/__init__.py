"""Registry of the queries: each pack of this folder adds its queries and their SQL."""

from __future__ import annotations

import importlib

PACKS: list[str] = ["retrieval_pack", "text_pack", "rules_pack", "structure_pack", "analytics_pack", "relational_pack", "residual_pack", "quality_pack", "ingest_pack", "service_pack", "index_pack"]
FLAGSHIP = "hybrid_retrieval"


def _packs():
    return [importlib.import_module(f"tessera.plans.{name}") for name in PACKS]


def queries() -> dict:
    return {name: query for pack in _packs() for name, (query, _) in pack.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for pack in _packs() for name, (_, sql) in pack.QUERIES.items() if sql}
