"""JSON inside text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCED = r"(?s)```json\s*(.*?)\s*```"
_PLAIN = r"(?s)```\s*(.*?)\s*```"


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def parse_reply(c: Column) -> Column:
    """A model's JSON reply: the whole text if it parses, else its fenced block, else null."""
    fenced = F.nullif(F.regexp_extract(c, _FENCED, 1), F.lit(""))
    return F.when(is_json(c), c).when(is_json(fenced), fenced)


def _objects(text: str) -> list[str]:
    """Balanced {...} spans, braces in strings aside."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, ch in enumerate(text):
        if quoted:
            escaped, quoted = ch == "\\" and not escaped, ch != '"' or escaped
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start, depth = (i, 1) if not depth else (start, depth + 1)
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _is_call(value) -> bool:
    return isinstance(value, dict) and isinstance(value.get("name"), str) and bool(value["name"].strip()) and isinstance(value.get("arguments"), dict)


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object, one with a name before others; the text itself if there is none."""

    def pick(t):
        if t is None:
            return None
        good = [o for o in _objects(t) if isinstance(_loads(o), dict)]
        named = [o for o in good if "name" in _loads(o)]
        return (named or good or [t])[0]

    return texts.map(pick)


def extract_json(c: Column) -> Column:
    """JSON in a text: a json block, a plain block, the whole, the first balanced object, else the text."""
    block, plain = (F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (_FENCED, _PLAIN))
    return F.when(is_json(block), block).when(is_json(plain), plain).when(is_json(F.trim(c)), F.trim(c)).otherwise(first_object(c))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])))
def tool_calls(texts: pd.Series) -> pd.Series:
    """All distinct valid tool calls of a text, in order: objects, or arrays of them, with a name and arguments."""

    def calls(t):
        found = {}
        whole = _loads(t or "")
        values = whole if isinstance(whole, list) else [_loads(o) for o in _objects(t or "")]
        for v in values:
            for x in v if isinstance(v, list) else [v]:
                if _is_call(x):
                    found.setdefault(json.dumps(x, sort_keys=True), {"name": x["name"], "arguments": json.dumps(x["arguments"], ensure_ascii=False)})
        return list(found.values())

    return texts.map(calls)


def _pairs(text: str) -> dict[int, int]:
    """Where each brace that opens is closed."""
    waiting: list[int] = []
    closed: dict[int, int] = {}
    for brace in re.finditer("[{}]", text):
        if brace.group() == "{":
            waiting.append(brace.start())
        elif waiting:
            closed[waiting.pop()] = brace.start()
    return closed


@F.pandas_udf(T.StringType())
def last_boxed_balanced(texts: pd.Series) -> pd.Series:
    r"""The last \boxed{...} or \fbox{...} with any depth of braces, or ``\boxed x`` up to a dollar sign; null if none."""
    bare, marks = re.compile(r".*\\boxed (?P<rest>[^$]*)", re.S), [re.compile(r".*(?P<mark>\\boxed)", re.S), re.compile(r".*(?P<mark>\\fbox)", re.S)]

    def find(t):
        if t is None or (plain := bare.match(t)):
            return None if t is None else "\\boxed " + plain["rest"]
        found = next((m for m in (p.match(t) for p in marks) if m), None)
        brace = t.find("{", found.end("mark")) if found else -1
        end = _pairs(t).get(brace)
        return None if end is None else t[found.start("mark") : end + 1]

    return texts.map(find)
