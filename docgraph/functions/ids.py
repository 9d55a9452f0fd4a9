"""Stable ids: a prefix and the first 20 hex digits of the SHA-256 of a compact JSON list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters whose JSON escapes have a hex letter, which must be lower case.
_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def json_text(c: Column) -> Column:
    """JSON of a string or of an array of strings, escapes in lower case."""
    return reduce(lambda out, e: F.replace(out, F.lit(f"\\u00{e}"), F.lit(f"\\u00{e.lower()}")), _ESCAPES, F.to_json(c))


def json_string(c: Column) -> Column:
    whole = json_text(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def stable_id(prefix: str, *json_parts: Column) -> Column:
    """json_parts are JSON already: json_string(), json_text(), or numbers cast to string."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *json_parts), F.lit("]")), 256), 1, 20))


def document_id(sha256: Column) -> Column:
    return stable_id("d", json_string(sha256))


def product_id(name: Column) -> Column:
    return stable_id("p", json_string(name))


def source_id(path: Column) -> Column:
    return stable_id("s", json_string(path))


def unit_id(document: Column, ordinal: Column) -> Column:
    return stable_id("u", json_string(document), ordinal.cast("string"))


def chunk_id(document: Column, unit_ids: Column) -> Column:
    return stable_id("c", json_string(document), json_text(unit_ids))


def fact_id(document: Column, kind: Column, name: Column, unit_ids: Column) -> Column:
    return stable_id("f", json_string(document), json_string(kind), json_string(name), json_text(F.array_sort(unit_ids)))


def entity_id(kind: Column, name: Column) -> Column:
    return stable_id("entity", json_string(kind), json_string(name))


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return stable_id("e", json_string(kind), json_string(source), json_string(target))
