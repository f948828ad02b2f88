"""A JSON schema as a SQL expression over VARIANT: what is wrong with a value, and where, without leaving the JVM.

The part of JSON Schema (2020-12) that data contracts use: ``$ref`` to ``#/$defs``, ``anyOf``, ``const``,
``enum``, ``type``, ``required``, ``properties``, ``additionalProperties: false``, ``items``, ``minItems``, ``maxItems``,
``minLength``, ``maxLength``, ``pattern``, ``format: date-time``, ``minimum``, ``maximum``, ``exclusiveMinimum``.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: From the SQL of a VARIANT to the SQL of an array of flaws.
Check = Callable[[str], str]
#: Keywords that are known, and those that say nothing of a value.
KNOWN = {"$ref", "anyOf", "const", "enum", "type", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "exclusiveMinimum"}
SILENT = {"$schema", "$id", "$defs", "title", "description", "$comment", "default", "examples"}
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
_TIME = r"^(?!0000)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_NONE, _MANY = "CAST(array() AS array<string>)", 1 << 31


def read(spark: SparkSession, path: str) -> dict:
    """A schema from a JSON file, wherever Spark reads from."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(texts: list[str]) -> str:
    return f"CAST(array({', '.join(map(_quoted, texts))}) AS array<string>)"


def _told(*rules: tuple[str, str]) -> str:
    """The flaws of those rules (SQL, flaw) that don't hold; null doesn't."""
    return f"array_compact(array({', '.join(f'IF({ok}, NULL, {_quoted(flaw)})' for ok, flaw in rules)}))" if rules else _NONE


def _equal(v: str, value) -> str:
    """Whether a variant is this scalar, of the same type: 1 is neither true nor 1.0."""
    shape = f"schema_of_variant({v})"
    if value is None:
        return f"{shape} = 'VOID'"
    if isinstance(value, bool):
        return f"({shape} = 'BOOLEAN' AND try_variant_get({v}, '$', 'boolean') = {value})"
    if isinstance(value, str):
        return f"({shape} = 'STRING' AND try_variant_get({v}, '$', 'string') = {_quoted(value)})"
    if isinstance(value, int):
        return f"({shape} = 'BIGINT' AND try_variant_get({v}, '$', 'decimal(38,0)') = {value}BD)"
    if isinstance(value, float):
        return f"({shape} RLIKE '^(DOUBLE|FLOAT|DECIMAL)' AND try_variant_get({v}, '$', 'double') = {value!r}D)"
    raise ValueError("const and enum take scalars")


def compiled(schema: dict, depth: int = 12) -> Check:
    """From the SQL of a VARIANT to that of an array of ``path: flaw``, each once and in order.

    Flaws: ``kind`` (the type), ``not among the values``, ``missing key``, ``unknown key``, ``length``, ``pattern``, ``time``,
    ``range``. All items of an array have the path ``[]``. Where no option of ``anyOf`` fits, the flaws are those of the first whose kind does. A schema
    may refer to itself: it is written out ``depth`` references deep, and a value that goes deeper has the flaw ``depth``.
    An unknown keyword, a reference elsewhere or a ``const`` that isn't a scalar is a ValueError, so that nothing goes unchecked.
    """
    count = itertools.count()

    def let(value: str, use: Callable[[str], str]) -> str:
        """SQL that names a value, which then is worked out once."""
        name = f"v{next(count)}"
        return f"get(transform(array({value}), {name} -> {use(name)}), 0)"

    def node(s: dict | bool, path: str, left: int) -> Check:
        if s is True or not set(s) - SILENT:
            return lambda v: _NONE
        if odd := set(s) - KNOWN - SILENT:
            raise ValueError(f"unknown keywords at {path}: {sorted(odd)}")
        if "$ref" in s:
            name = s["$ref"].removeprefix("#/$defs/")
            if name not in schema.get("$defs", {}):
                raise ValueError(f"unknown reference at {path}: {s['$ref']}")
            return node(schema["$defs"][name], path, left - 1) if left else lambda v: _strings([f"{path}: depth"])
        if "anyOf" in s:
            options, other = [node(o, path, left) for o in s["anyOf"]], f"{path}: kind"
            near = lambda all_: f"coalesce(get(filter({all_}, f -> get(f, 0) <> {_quoted(other)}), 0), {_strings([other])})"
            return lambda v: let(f"array({', '.join(o(v) for o in options)})", lambda all_: f"IF(exists({all_}, f -> size(f) = 0), {_NONE}, {near(all_)})")
        if "const" in s or "enum" in s:
            values = s["enum"] if "enum" in s else [s["const"]]
            return lambda v: _told((" OR ".join(f"coalesce({_equal(v, x)}, false)" for x in values), f"{path}: not among the values"))
        return typed(s, path, left)

    def typed(s: dict, path: str, left: int) -> Check:
        types = s.get("type", TYPES)
        types = {types} if isinstance(types, str) else set(types)
        if odd := types - set(TYPES):
            raise ValueError(f"unknown types at {path}: {sorted(odd)}")
        wrong = _strings([f"{path}: kind"])

        def scalar(v: str) -> str:
            def by(shape: str) -> str:
                whens = [f"WHEN {shape} = '{told}' THEN {_NONE}" for t, told in (("null", "VOID"), ("boolean", "BOOLEAN")) if t in types]
                if "string" in types:
                    whens.append(f"WHEN {shape} = 'STRING' THEN {text(s, path, v)}")
                if types & {"number", "integer"}:
                    number = f"try_variant_get({v}, '$', 'double')"
                    point = f"{shape} RLIKE '^(DOUBLE|FLOAT|DECIMAL)'" + ("" if "number" in types else f" AND {number} = rint({number})")
                    whens.append(f"WHEN {shape} = 'BIGINT' OR {point} THEN {range_(s, path, number)}")
                return f"CASE {' '.join(whens)} ELSE {wrong} END"

            return let(f"schema_of_variant({v})", by) if types - {"object", "array"} else wrong

        def array(v: str) -> str:
            return let(f"try_variant_get({v}, '$', 'array<variant>')", lambda a: f"IF({a} IS NULL, {scalar(v)}, {items(s, path, left)(a)})") if "array" in types else scalar(v)

        def object_(v: str) -> str:
            return let(f"try_variant_get({v}, '$', 'map<string,variant>')", lambda m: f"IF({m} IS NULL, {array(v)}, {members(s, path, left)(m)})") if "object" in types else array(v)

        return object_

    def members(s: dict, path: str, left: int) -> Check:
        props, required, rules = s.get("properties", {}), s.get("required", []), []
        checks = {k: node(p, f"{path}.{k}", left) for k, p in props.items()}

        def check(m: str) -> str:
            if required:
                rules.append((f"size(array_except({_strings(required)}, map_keys({m}))) = 0", f"{path}: missing key"))
            if s.get("additionalProperties", True) is False:
                rules.append((f"size(array_except(map_keys({m}), {_strings(list(props))})) = 0", f"{path}: unknown key"))
            each = [let(f"try_element_at({m}, {_quoted(k)})", lambda v: f"IF({v} IS NULL, {_NONE}, {c(v)})") for k, c in checks.items()]
            return f"concat({', '.join([_told(*rules), *each])})"

        return check

    def items(s: dict, path: str, left: int) -> Check:
        each = node(s["items"], f"{path}[]", left) if "items" in s else None

        def check(a: str) -> str:
            length = _told((f"size({a}) BETWEEN {s.get('minItems', 0)} AND {s.get('maxItems', _MANY)}", f"{path}: length")) if {"minItems", "maxItems"} & set(s) else _NONE
            if each is None:
                return length
            name = f"v{next(count)}"
            return f"concat({length}, array_distinct(flatten(transform({a}, {name} -> {each(name)}))))"

        return check

    def text(s: dict, path: str, v: str) -> str:
        def rules(x: str) -> str:
            out = []
            if {"minLength", "maxLength"} & set(s):
                out.append((f"char_length({x}) BETWEEN {s.get('minLength', 0)} AND {s.get('maxLength', _MANY)}", f"{path}: length"))
            if "pattern" in s:
                out.append((f"{x} RLIKE {_quoted('(?U)' + s['pattern'])}", f"{path}: pattern"))
            if s.get("format") == "date-time":
                out.append((f"{x} RLIKE {_quoted(_TIME)} AND try_cast({x} AS timestamp) IS NOT NULL", f"{path}: time"))
            return _told(*out)

        return let(f"try_variant_get({v}, '$', 'string')", rules) if {"minLength", "maxLength", "pattern", "format"} & set(s) else _NONE

    def range_(s: dict, path: str, number: str) -> str:
        bounds = [f"{number} {sign} {float(s[k])!r}D" for k, sign in (("minimum", ">="), ("maximum", "<="), ("exclusiveMinimum", ">")) if k in s]
        return _told((" AND ".join(bounds), f"{path}: range")) if bounds else _NONE

    top = node(schema, "$", depth)
    return lambda v: let(v, lambda x: f"array_distinct({top(x)})")


def flaws(text: str, schema: dict, depth: int = 12) -> Column:
    """``compiled`` over the column ``text`` of JSON; null for null, ``$: not read`` for what isn't JSON (names twice in an object, NaN and numbers beyond double among it)."""
    json_ = f"`{text}`"
    parsed = f"try_parse_json({json_})"
    return F.expr(f"CASE WHEN {json_} IS NULL THEN NULL WHEN {parsed} IS NULL THEN {_strings(['$: not read'])} ELSE {compiled(schema, depth)(parsed)} END")
