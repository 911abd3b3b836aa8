"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    names = [m.name for m in pkgutil.iter_modules(__import__(__package__, fromlist=["_"]).__path__) if m.name.endswith("_query")]
    return [importlib.import_module(f"{__package__}.{n}") for n in sorted(names)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {m.NAME: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
