"""Parsers that a caller plugs in: what they read from saved bodies, and what is put aside for review where they fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a parser that answers False is said to do, and what one says that nobody has reviewed.
REJECTED, UNREVIEWED = "response parser rejected source structure", "source structure has not been reviewed"


class StructureChange(ValueError):
    """A body isn't built as the parser expects."""


@dataclass(frozen=True)
class Parser:
    """``parse(body)`` returns the fields of ``schema`` (DDL) as a dict; False, or an exception, says that the body isn't as expected."""

    schema: str
    parse: Callable[[bytes], dict | bool | None]


def _unreviewed(body: bytes) -> None:
    raise StructureChange(UNREVIEWED)


#: The parser of a source that nobody has reviewed: it refuses every body.
REVIEW_FIRST = Parser("", _unreviewed)


def read(body: Column, parser: Parser) -> Column:
    """(fields, error): the fields that a parser reads from a body (binary), or why it doesn't; both null for a null body."""
    fields = T.StructType.fromDDL(parser.schema) if parser.schema else T.StructType([T.StructField("none", T.StringType())])
    names, parse = fields.names, parser.parse
    out = T.StructType([T.StructField(f"f_{f.name}", f.dataType) for f in fields] + [T.StructField("error", T.StringType())])

    def one(raw: bytes | None) -> tuple:
        nothing = (None,) * len(names)
        if raw is None:
            return (*nothing, None)
        try:
            found = parse(bytes(raw))
        except Exception as e:  # whatever a parser throws is its verdict on the body
            return (*nothing, str(e) or type(e).__name__)
        return (*nothing, REJECTED) if found is False else (*[(found or {}).get(n) for n in names], None)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(x) for x in batch], columns=out.names, dtype=object)

    def task(batches):
        yield from run(batches)

    task.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(task, out)(body)


def parsed(responses: DataFrame, parser: Parser, body: str = "body", outcome: str = "outcome") -> DataFrame:
    """``responses`` with the parser's fields and ``error``; where it fails, ``outcome`` becomes ``parse_error``.

    Only bodies whose outcome is ``ok`` are parsed; of others, and of those that fail, the fields are null. A failing
    body never fails the job, and is never asked for again: ``quarantine`` has it for review.
    """
    fields = T.StructType.fromDDL(parser.schema).names if parser.schema else []
    rows = responses.withColumn("_read", read(F.when(F.col(outcome) == "ok", F.col(body)), parser))
    error = F.col("_read.error")
    rows = rows.withColumn(outcome, F.when(error.isNotNull(), "parse_error").otherwise(F.col(outcome)))
    return rows.select(*responses.columns, *[F.col(f"_read.f_{n}").alias(n) for n in fields], error.alias("error"))


def quarantine(parsed_rows: DataFrame, path: str) -> None:
    """Appends the rows that a parser failed on, bodies and reasons included."""
    parsed_rows.filter(F.col("error").isNotNull()).write.mode("append").parquet(path)
