"""Compiled schemas against a plain walk over parsed JSON."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import json_schema
from tracewell.operators.bundle_schema import document
from tracewell.plans.catalogue import TREE
from tracewell.plans.samples import BROKEN, SOUND
from tracewell.session import scratch


def kinds(v):
    if isinstance(v, bool) or v is None:
        return {"boolean"} if v is not None else {"null"}
    if isinstance(v, (int, float)):
        return {"number", "integer"} if v == int(v) else {"number"}
    return {{str: "string", list: "array", dict: "object"}[type(v)]}


def walk(v, s, root, path="$", depth=12):
    """All flaws, in order."""
    if "$ref" in s:
        return walk(v, root["$defs"][s["$ref"].split("/")[-1]], root, path, depth - 1) if depth else [f"{path}: depth"]
    if "anyOf" in s:
        told = [walk(v, o, root, path, depth) for o in s["anyOf"]]
        return [] if [] in told else next((t for t in told if t[0] != f"{path}: kind"), [f"{path}: kind"])
    if "enum" in s or "const" in s:
        ok = any(type(v) is type(x) and v == x for x in s.get("enum", [s.get("const")]))
        return [] if ok else [f"{path}: not among the values"]
    if "type" in s and not kinds(v) & ({s["type"]} if isinstance(s["type"], str) else set(s["type"])):
        return [f"{path}: kind"]
    out = []
    if isinstance(v, dict):
        out += [f"{path}: missing key"] * (not set(s.get("required", [])) <= v.keys())
        out += [f"{path}: unknown key"] * (s.get("additionalProperties") is False and not v.keys() <= s.get("properties", {}).keys())
        for k, of in s.get("properties", {}).items():
            out += walk(v[k], of, root, f"{path}.{k}", depth) if k in v else []
    elif isinstance(v, list):
        out += [f"{path}: length"] * (not s.get("minItems", 0) <= len(v) <= s.get("maxItems", 99))
        for x in v if "items" in s else []:
            out += walk(x, s["items"], root, f"{path}[]", depth)
    elif isinstance(v, str):
        out += [f"{path}: length"] * (not s.get("minLength", 0) <= len(v) <= s.get("maxLength", 99))
        out += [f"{path}: pattern"] * ("pattern" in s and not re.search(s["pattern"], v))
    elif kinds(v) & {"number"}:
        ok = s.get("minimum", v) <= v <= s.get("maximum", v) and v > s.get("exclusiveMinimum", -math.inf)
        out += [f"{path}: range"] * (not ok)
    return list(dict.fromkeys(out))


def compare(spark, values, schema, depth=12):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, a_text string")
    got = {r["i"]: r["f"] for r in rows.select("i", json_schema.flaws("a_text", schema, depth).alias("f")).collect()}
    for i, v in enumerate(values):
        assert got[i] == walk(v, schema, schema, depth=depth), v


SCALARS = [None, True, False, 0, 1, 2, 2.0, -1, 1.5, 60, 61, 1e20, 12345678901234567890, "", "x", "abc", "é", " ", "A b", [], {}]


def test_random_values(spark):
    rng = random.Random(3)

    def tree(n=0):
        out = {"v": rng.choice(SCALARS)} if rng.random() < 0.9 else {}
        if n < 5 and rng.random() < 0.6:
            out["kids"] = [tree(n + 1) for _ in range(rng.randrange(4))] if rng.random() < 0.9 else rng.choice(SCALARS)
        return out

    def record():
        out = {"id": rng.choice(SCALARS), "k": rng.choice(SCALARS), "name": rng.choice(SCALARS), "tree": rng.choice([tree(), tree(), rng.choice(SCALARS)]), "other": 1}
        return {k: v for k, v in out.items() if rng.random() < 0.85 and (k != "other" or rng.random() < 0.2)}

    compare(spark, [record() for _ in range(400)] + SCALARS, TREE)
    compare(spark, [record() for _ in range(100)], TREE, depth=3)


def test_keywords_one_by_one(spark):
    values = SCALARS + [["x"], [1, 2, 3], [[1], ["a"]], {"a": 1}, {"a": None, "b": 2}, {"it's": "a\\b"}]
    for schema in (
        {}, {"title": "any"}, {"type": "integer"}, {"type": ["number", "null"], "minimum": 1}, {"type": "string", "pattern": r"^\S+$"}, {"pattern": "'|\\\\"}, {"enum": [None, "x", 1, 1.5, True]}, {"const": 2},
        {"type": "array", "items": {"type": ["array", "integer"], "items": {"type": "integer"}}}, {"maxItems": 2, "maxLength": 1, "maximum": 1.0}, {"properties": {"a": {"type": "integer"}, "it's": {"minLength": 4}}, "required": ["a"]},
        {"properties": {}, "additionalProperties": False}, {"anyOf": [{"type": "string", "minLength": 2}, {"type": "array", "minItems": 1}]}, {"exclusiveMinimum": 0},
    ):
        compare(spark, values, schema)


def test_times_and_what_cannot_be_read(spark):
    times = {"2024-02-29T00:00:00Z": [], "2023-02-29T00:00:00Z": ["$: time"], "2024-01-01T00:00:00": ["$: time"], "2024-01-01T10:00:00.5+09:00": [], "0000-01-01T00:00:00Z": ["$: time"], "x": ["$: time"]}
    rows = spark.createDataFrame([(json.dumps(t), t) for t in times], "t string, k string")
    assert {r["k"]: r["f"] for r in rows.select("k", json_schema.flaws("t", {"format": "date-time"}).alias("f")).collect()} == times
    rows = spark.createDataFrame([("{",), ("",), (None,), ('{"a": 1, "a": 2}',), ("NaN",)], "t string")
    assert [r["f"] for r in rows.select(json_schema.flaws("t", {}).alias("f")).collect()] == [["$: not read"], ["$: not read"], None, ["$: not read"], ["$: not read"]]


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"$ref": "#/$defs/none"}, {"$ref": "http://elsewhere/x"}, {"const": []}, {"type": "text"}, {"properties": {"a": {"not": {}}}}])
def test_what_is_not_known_is_refused(spark, schema):
    with pytest.raises(ValueError):
        json_schema.flaws("t", schema)


def test_the_contract_as_a_file(spark):
    """The contract's schema, written and read, and the same with references, tells the same."""
    place = scratch(spark, "schema")
    spark.createDataFrame([(json.dumps(document(), indent=2),)], "value string").coalesce(1).write.text(place)
    schema = json_schema.read(spark, place)
    assert schema == document()
    trial = schema["properties"]["simulation"]["properties"]["representative_trials"]
    shared = schema | {"$defs": {"trial": trial["items"], "corners": schema["properties"]["observations"]["properties"]["corners"]}}
    shared = json.loads(json.dumps(shared))
    shared["properties"]["simulation"]["properties"]["representative_trials"]["items"] = {"$ref": "#/$defs/trial"}
    shared["properties"]["observations"]["properties"]["corners"] = {"$ref": "#/$defs/corners"}
    texts = [SOUND] + [SOUND.replace(a, b) for a, b, _ in BROKEN]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for s in (schema, shared):
        got = rows.select("t", json_schema.flaws("t", s).alias("f")).collect()
        assert {r["t"]: r["f"] for r in got} == {t: walk(json.loads(t), s, s) for t in texts}


def test_no_python_worker(spark):
    rows = spark.range(3).select(F.lit(SOUND).alias("t")).select(json_schema.flaws("t", document()).alias("f"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
