"""JSON as text, with the number and key rules that typed columns keep: sorted keys, shortest floats, no spaces."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXPONENT = re.compile(r"e([+-])0*(\d)")


def number(x: float) -> str:
    """Shortest form that reads back equal; the exponent has its sign and no zeros in front."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    return _EXPONENT.sub(r"e\1\2", repr(float(x)))


def text(value: Any) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, int):
        return str(value) if abs(value) < 10**38 else number(float(str(value)))
    if isinstance(value, float):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{text(k)}:{text(value[k])}" for k in sorted(value)) + "}"
    return "[" + ",".join(map(text, value)) + "]"


def select(value: Any, path: tuple[str, ...]) -> Any:
    """The value at a path, or None. A segment of digits is a key of an object and a place in an array."""
    for p in path:
        if isinstance(value, dict):
            value = value.get(p)
        elif isinstance(value, list) and p.isascii() and p.isdigit() and int(p) < len(value):
            value = value[int(p)]
        else:
            return None
    return value


@F.pandas_udf(T.StringType())
def _number_text(x: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v and pd.isna(v) else number(v) for v in x], dtype=object)


def _part_text(path: tuple[str, ...]):
    @F.pandas_udf(T.StringType())
    def part(raw: pd.Series) -> pd.Series:
        return pd.Series([text(select(json.loads(r), path)) if isinstance(r, str) else None for r in raw], dtype=object)

    return part


def number_text(x: Column) -> Column:
    """Text of a double. Values that Java and this rule write alike stay in the JVM; null rows cost the UDF nothing."""
    plain = x.cast("string")
    easy = plain.rlike(r"^-?[0-9]+\.[0-9]+$")
    return F.when(easy, plain).otherwise(_number_text(F.when(~easy, x)))


def part_text(raw: Column, part: Column, path: tuple[str, ...], here: Column) -> Column:
    """Compact text of an array or object within a record. Variants write floats otherwise, so records that hold one
    go through Arrow; all others are written by the JVM. here: the rows that need it."""
    floats = raw.rlike(r"[0-9][.eE]|-0|[0-9]{16}")
    return F.when(here & ~floats, F.to_json(part)).when(here, _part_text(path)(F.when(here & floats, raw)))
