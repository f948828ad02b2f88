"""What a bundle's schema says of its raw JSON: keys, kinds, constants, lengths, ranges and times."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.operators.json_schema import flaws

_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"


def _text(most: int) -> dict:
    return {"kinds": ("string",), "length": (1, most), "pattern": r"\S"}


def _whole(low: int, high: int = 1_000_000) -> dict:
    return {"kinds": ("integer",), "range": (low, high)}


def _list(items: dict, low: int, high: int) -> dict:
    return {"kinds": ("array",), "items": items, "length": (low, high)}


def _object(**keys: dict) -> dict:
    return {"kinds": ("object",), "keys": keys}


def _or_null(schema: dict) -> dict:
    return schema | {"kinds": (*schema["kinds"], "null")}


_AT = {"kinds": ("string",), "pattern": _TIME, "time": True}
_GATE = _whole(1, 99)
_SECONDS = {"kinds": ("number", "null"), "range": (-math.inf, 1000), "above": 0}
_LAPS = _object(segment_ends_m=_list(_whole(1), 1, 100), values_s=_list(_SECONDS, 1, 100))
_GROUP = _object(
    members=_list(_GATE, 1, 99),
    inner_to_outer=_or_null(_list(_GATE, 1, 99)),
    marked_leader=_or_null(_GATE),
    gap_from_previous={"among": (None, "unknown", "one_to_under_two", "two_to_under_five", "five_or_more")},
)
_CORNERS = _list(_object(checkpoint=_text(100), groups=_list(_GROUP, 0, 99), unobserved_gate_numbers=_list(_GATE, 0, 99), unknown_reason=_or_null(_text(1000))), 0, 10)
#: The viewer's contract, version 1. Every key is required and no other is allowed.
SCHEMA = _object(
    schema_version={"among": ("viewer/v1",)},
    bundle_type={"among": ("race_simulation_result",)},
    run_id=_text(100),
    race_id=_text(100),
    as_of=_AT,
    generated_at=_AT,
    producer_code_commit={"kinds": ("string",), "pattern": r"^[0-9a-f]{40}$"},
    dataset_id=_text(100),
    model_id=_or_null(_text(1000)),
    origin={"among": ("synthetic", "baseline_prediction", "learned_prediction")},
    mode={"among": ("prospective", "retrospective")},
    race=_object(
        name=_text(1000),
        course=_text(1000),
        surface={"among": ("turf", "dirt")},
        distance_m=_whole(1),
        start_at=_AT,
        runners=_list(_object(horse_id=_text(100), gate_no=_GATE, name=_text(1000)), 1, 99),
    ),
    simulation=_object(
        total_trials=_whole(1),
        completed_trials=_whole(0),
        representative_trials=_list(_object(trial_id=_text(100), laps=_LAPS, corners=_CORNERS), 0, 20),
        lap_quantiles=_list(_object(segment_end_m=_whole(1), p10_s=_SECONDS, p50_s=_SECONDS, p90_s=_SECONDS, sample_count=_whole(0)), 0, 100),
    ),
    observations=_object(laps=_or_null(_LAPS), corners=_CORNERS),
    quality=_object(missing_fields=_list(_text(1000), 0, 100), notes=_list(_text(1000), 1, 100)),
)


def document(schema: dict = SCHEMA) -> dict:
    """The contract as a JSON schema (``json_schema``)."""
    if "among" in schema:
        return {"enum": list(schema["among"])}
    kinds = schema["kinds"]
    out: dict = {"type": kinds[0] if len(kinds) == 1 else list(kinds)}
    if "keys" in schema:
        out |= {"properties": {k: document(v) for k, v in schema["keys"].items()}, "required": list(schema["keys"]), "additionalProperties": False}
    if "items" in schema:
        out["items"] = document(schema["items"])
    if "length" in schema:
        of = "Items" if "array" in kinds else "Length"
        out |= {f"min{of}": schema["length"][0], f"max{of}": schema["length"][1]}
    if "pattern" in schema:
        out["pattern"] = schema["pattern"]
    if "time" in schema:
        out["format"] = "date-time"
    if "range" in schema:
        out |= {k: v for k, v in zip(("minimum", "maximum"), schema["range"]) if math.isfinite(v)}
    if "above" in schema:
        out["exclusiveMinimum"] = schema["above"]
    return out


def schema_flaws(text: str, schema: dict | None = None) -> Column:
    """``path: flaw`` of the column ``text``, a bundle's JSON, by its schema, or by another JSON schema (``json_schema.flaws``); none for null."""
    return F.coalesce(flaws(text, schema or document()), F.array().cast("array<string>"))


def _canonical(text: str | None) -> str | None:
    """JSON with keys in order at every depth, without blanks; null where it is none, or has numbers that JSON lacks."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except (ValueError, RecursionError):
        return None


def _canonicals(texts: pd.Series) -> pd.Series:
    return texts.map(_canonical, na_action="ignore").astype(object)


def canonical(text: Column) -> Column:
    """A JSON text with keys in order at every depth and without blanks; numbers as Python writes them: 1.50 is 1.5, 1E5 is 100000.0."""
    return F.pandas_udf(_canonicals, "string")(text)


def bundle_sha256(text: Column) -> Column:
    """SHA-256 of the canonical JSON of a bundle and a line feed."""
    return F.sha2(F.encode(F.concat(canonical(text), F.lit("\n")), "UTF-8"), 256)
