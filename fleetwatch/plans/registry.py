"""Single place that imports every query module and exposes the registry."""
from __future__ import annotations

from . import catalog
from . import io_queries, model_queries, stream_queries  # noqa: F401  (each registers its queries)


def all_queries() -> dict:
    return dict(catalog.QUERIES)


def all_oracle_sql() -> dict:
    return dict(catalog.ORACLE)
