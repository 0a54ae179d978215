"""Registry of named queries with their reference SQL.

A query is a function of ``Shapes`` (the given tables seen as urban layers). ``cols`` fixes the output
columns for both engines; ``name:k`` rounds a double to k digits where summation order could show.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import joins_by_true_size
from .shapes import VIEWS, Shapes

_REGISTRY: dict[str, tuple[Callable[[Shapes], DataFrame], str | None, list[str]]] = {}


def query(name: str, cols: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` may use the ``v_`` views of the shapes module."""

    def wrap(fn: Callable[[Shapes], DataFrame]) -> Callable[[Shapes], DataFrame]:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql, cols.split())
        return fn

    return wrap


def _parts(cols: list[str]) -> list[tuple[str, int | None]]:
    return [(c.split(":")[0], int(c.split(":")[1]) if ":" in c else None) for c in cols]


def _project(df: DataFrame, cols: list[str]) -> DataFrame:
    # adding 0.0 turns a negative zero into a plain one
    return df.select(*[
        F.col(n) if k is None else (F.round(F.col(n).cast("double"), k) + F.lit(0.0)).alias(n) for n, k in _parts(cols)
    ])


def _needed(text: str) -> list[str]:
    """Views used by a text, dependencies first."""
    out: list[str] = []

    def visit(t: str) -> None:
        for v in re.findall(r"\bv_\w+", t):
            if v in VIEWS and v not in out:
                visit(VIEWS[v])
                out.append(v)

    visit(text)
    return out


def _sql(body: str, cols: list[str]) -> str:
    proj = ", ".join(
        f'"{n}"' if k is None else f'round(CAST("{n}" AS DOUBLE), {k}) + 0.0 AS "{n}"' for n, k in _parts(cols)
    )
    views = _needed(body)
    body = body.strip()
    own = ""
    if body.upper().startswith("WITH "):
        # the query's own common tables: everything up to the final SELECT marker
        head, body = body[5:].split("\n--final\n")
        own = head.strip()
    rec = "RECURSIVE " if own.upper().startswith("RECURSIVE ") else ""
    own = own[len(rec):] if rec else own
    ctes = [f"{v} AS ({VIEWS[v]})" for v in views] + ([own] if own else [])
    prefix = f"WITH {rec}{', '.join(ctes)} " if ctes else ""
    return f"{prefix}SELECT {proj} FROM ({body}) result"


def _load() -> None:
    from . import domain_queries, geometry_queries, network_queries, overlay_queries, raster_queries, spatial_queries, table_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn, cols):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            joins_by_true_size(spark)
            return _project(fn(Shapes(spark, sf_dir)), cols)

        return run

    return {n: bind(fn, cols) for n, (fn, _, cols) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: _sql(s, cols) for n, (_, s, cols) in _REGISTRY.items() if s is not None}
