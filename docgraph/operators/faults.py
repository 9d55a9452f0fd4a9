"""Faults for a valid graph, one per validation rule: each breaks its rule wherever it can and no other one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An id that nothing has.
NOWHERE = "u_none"


def _column(name: str, column: str, value: Callable) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    return lambda g: {name: g[name].withColumn(column, value(F.col(column)))}


def _without(kind: str) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    return lambda g: {"edges": g["edges"].where(F.col("type") != kind)}


FAULTS: dict[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {
    "X1": _column("documents", "text", lambda c: F.concat(c, F.lit("!"))),
    "X2": _without("ABOUT_PRODUCT"),
    "X3": _column("sources", "sha256", lambda c: F.lit("0")),
    "X4": _column("chunks", "unit_ids", lambda c: F.array_append(c, NOWHERE)),
    "X5": _without("MENTIONS"),
    "X6": _without("SUPPORTED_BY"),
    "X7": _column("facts", "unit_ids", lambda c: F.array_append(c, NOWHERE)),
    "X8": _column("facts", "statement", lambda c: F.concat(c, F.lit("!"))),
    "X9": _column("chunks", "unit_ids", lambda c: F.slice(c, F.lit(1), F.size(c) - 1)),
    "X10": _column("facts", "document_id", lambda c: F.lit("d_other")),
    "X11": _column("chunks", "ordinal", lambda c: c * 2),
    "X12": _column("edges", "unit_ids", lambda c: F.when(F.col("type") == "MENTIONS", F.array().cast("array<string>")).otherwise(c)),
    "X13": lambda g: {"units": g["units"].withColumn("raw_start", F.col("raw_end"))},
}


def faulty(graph: dict[str, DataFrame], rule: str) -> dict[str, DataFrame]:
    """graph (documents, sources, units, chunks, facts, nodes, edges) with the fault of one rule.

    X9 takes the last unit from every chunk, so the facts on it are found; the others hit all rows that the rule looks at.
    """
    return graph | FAULTS[rule](graph)
