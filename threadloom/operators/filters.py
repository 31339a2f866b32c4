"""Queries over messages: conjunctive filters on participant, source, external id and metadata paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_path(path: str) -> str:
    """``a.0.b`` as a variant path; numeric parts index arrays."""
    out = "$"
    for part in path.split("."):
        if re.fullmatch(r"\d+", part):
            out += f"[{part}]"
        elif re.fullmatch(r"\w+", part):
            out += f".{part}"
        else:
            out += "['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return out


def metadata_value(path: str, kind: str, column: str = "metadata_json") -> Column:
    """Value at a dotted path of the metadata, null where the path ends early or the type differs."""
    return F.try_variant_get(F.try_parse_json(F.col(column)), json_path(path), kind)


def metadata_equals(path: str, value: object, column: str = "metadata_json") -> Column:
    """Strict equality at a path: a number never equals its text."""
    variant = F.try_variant_get(F.try_parse_json(F.col(column)), json_path(path), "variant")
    shape = F.schema_of_variant(variant)
    if value is None:
        return F.coalesce(shape == "VOID", F.lit(False))
    if isinstance(value, bool):
        same, sort = metadata_value(path, "boolean", column) == value, shape == "BOOLEAN"
    elif isinstance(value, (int, float)):
        same, sort = metadata_value(path, "double", column) == float(value), shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    elif isinstance(value, str):
        same, sort = metadata_value(path, "string", column) == value, shape == "STRING"
    else:
        return F.lit(False)  # lists and objects are never the same one
    return F.coalesce(sort & same, F.lit(False))


def predicate(source: str | None = None, external_ids: list | None = None, participant: str | None = None, metadata: dict | None = None) -> Column:
    """All given conditions; an omitted one, and an empty list of ids, match everything."""
    found = F.lit(True)
    if source is not None:
        found = found & metadata_equals("external.source", source)
    if external_ids:
        own = metadata_value("external.id", "string")
        found = found & F.coalesce((own != "") & own.isin(list(external_ids)), F.lit(False))
    if participant is not None:
        found = found & (F.col("participant") == participant)
    for path, value in (metadata or {}).items():
        found = found & metadata_equals(path, value)
    return found


def query(state: DataFrame, limit: int | None = None, reverse: bool = False, **conditions) -> DataFrame:
    """Matching messages of each session in log order (or reversed) with total_count, before the limit, and rank."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    order = W.partitionBy("session").orderBy(F.desc("pos") if reverse else F.asc("pos"))
    out = state.filter(predicate(**conditions))
    out = out.withColumn("total_count", F.count(F.lit(1)).over(W.partitionBy("session"))).withColumn("rank", F.row_number().over(order) - 1)
    return out if limit is None else out.filter(F.col("rank") < limit)


def find_by_external_id(state: DataFrame, source: str, external_id: str) -> DataFrame:
    """The first match of each session."""
    return query(state, limit=1, source=source, external_ids=[external_id]).drop("total_count", "rank")
