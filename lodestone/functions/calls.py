"""Calls of tools in text as a table function for lateral joins."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, udtf
from pyspark.sql.udtf import AnalyzeResult

_KINDS = {"string": T.StringType(), "long": T.LongType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_RANGE = {"long": 1 << 63, "bigint": 1 << 63, "int": 1 << 31}


def _fields(spec: str) -> list[tuple[str, str]]:
    """``a string, n long`` as names and types."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, kind = part.rpartition(" ")
        if not name.strip() or kind.lower() not in _KINDS:
            raise ValueError(f"no argument of a call: {part!r}; known types are {', '.join(_KINDS)}")
        out.append((name.strip(), kind.lower()))
    return out


def _typed(value, kind: str):
    """``value`` if it is of the kind, else None; whole numbers are doubles too, anything but a text is one as JSON."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value)
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    if kind == "double":
        return float(value)
    if isinstance(value, float) and not value.is_integer():
        return None
    return int(value) if -_RANGE[kind] <= int(value) < _RANGE[kind] else None


def calls_in(text: str | None) -> Iterator[tuple[str, dict]]:
    """(name, arguments) of each JSON object {"name": ..., "arguments": {...}} in ``text``, in order; what does not parse is passed over."""
    decoder, at = json.JSONDecoder(), 0
    text = text or ""
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        name, arguments = value.get("name"), value.get("arguments", {})
        if isinstance(name, str) and name.strip() and isinstance(arguments, dict):
            yield name, arguments
            at = end
        else:
            at += 1  # calls may stand inside


class ToolCalls:
    """tool_calls(text, 'a string, n long'): a row (place, name, a, n) for each call; the columns come from the second argument."""

    @staticmethod
    def analyze(text: AnalyzeArgument, arguments: AnalyzeArgument) -> AnalyzeResult:
        if not arguments.isConstantExpression or not isinstance(arguments.value, str):
            raise ValueError("the arguments' types must be a constant text")
        fields = [T.StructField(n, _KINDS[k]) for n, k in _fields(arguments.value)]
        return AnalyzeResult(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("name", T.StringType()), *fields]))

    def eval(self, text: str, arguments: str) -> Iterator[tuple]:
        fields = _fields(arguments)
        for place, (name, given) in enumerate(calls_in(text)):
            yield (place, name, *(_typed(given.get(n), k) for n, k in fields))


def register(spark: SparkSession) -> None:
    """Make ``tool_calls`` known to SQL: FROM t, LATERAL tool_calls(t.text, 'a string, n long') c."""
    spark.udtf.register("tool_calls", udtf(ToolCalls))
