"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

import loomspark.llm as here


def _modules():
    return [importlib.import_module(f"{here.__name__}.{m.name}") for m in pkgutil.iter_modules(here.__path__)]


def queries() -> dict:
    import corpus_pipeline

    found = {k: f for m in _modules() for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Each module's ORACLE_SQL maps its query to SQL."""
    return {k: sql for m in _modules() for k, sql in getattr(m, "ORACLE_SQL", {}).items()}
