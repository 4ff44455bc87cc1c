"""Records that a declared schema reads as they are: one typed parse in place of a variant.

A record is read within a frame, as the only element of an array that a key follows: whatever a line has behind its value breaks
the frame, makes a second element, or keeps the key from being seen. A text that could close the array and open another one
is left to the variant, and so is every record with a value that the typed parse refuses or that is not certain to
be the same either way: of text it cannot tell whether it was a string or another value's.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column as Col
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwright.functions import values as V
from formwright.plans.spec import Column

OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_BREAKS_OUT = r'\}\s*\]\s*,\s*"'
_NUMBER, _WHOLE = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", r"^(0|-?[1-9][0-9]{0,17})$"
#: Within an array, what is written otherwise when it is written again.
_REWRITTEN = r"[{\\]|[0-9][.eE]|-0|[0-9]{16}"
_TEXT, _WHOLE_TEXT = ("lowercase", "uppercase", "trim", "empty_to_null"), ("json_encode", "to_string")


def parsed_type(c: Column) -> T.DataType | None:
    """How a column's value is parsed; None where only a variant will do."""
    if c.transform == "dollars_to_cents":
        return T.DoubleType() if c.type in ("int64", "float64") else None
    if c.transform == "abs":
        return {"int64": T.LongType(), "float64": T.DoubleType()}.get(c.type)
    if c.transform in _WHOLE_TEXT and c.type not in ("string", "json"):
        return None
    return {"int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType()}.get(c.type, T.StringType())


def schema(columns: tuple[Column, ...]) -> T.StructType | None:
    """The columns' paths as nested fields; None if they cannot be: paths of digits, of the whole record, or one within another."""
    tree: dict = {}
    for c in columns:
        path, kind = V.segments(c.path), parsed_type(c)
        if kind is None or not path or any(p.isdigit() or not p or "'" in p or "?" in p for p in path):
            return None
        at = tree
        for p in path[:-1]:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                return None
        if path[-1] in at and at[path[-1]] != kind:
            return None
        at[path[-1]] = kind

    def struct(t: dict) -> T.StructType:
        return T.StructType([T.StructField(n, struct(x) if isinstance(x, dict) else x) for n, x in t.items()])

    return struct(tree)


def parse(raw: Col, fits: Col, own: T.StructType) -> Col:
    """The framed record: r, its only element; s, the key behind it; _bad, set if anything was refused."""
    frame = T.StructType([T.StructField("r", T.ArrayType(own)), T.StructField("s", T.IntegerType()), T.StructField("_bad", T.StringType())])
    return F.from_json(F.when(fits & ~raw.rlike(_BREAKS_OUT), F.concat(F.lit('{"r":['), raw, F.lit('],"s":1}'))), frame, OPTIONS)


def whole(f: Col) -> Col:
    """Whether the frame holds: the record is one object, and every value was taken."""
    return F.coalesce(f["_bad"].isNull() & (f["s"] == 1) & (F.size(f["r"]) == 1) & f["r"][0].isNotNull(), F.lit(False))


def at(f: Col, c: Column) -> Col:
    x = f["r"][0]
    for p in V.segments(c.path):
        x = x.getField(p)
    return x


def _value(c: Column, x: Col) -> V.Value:
    none = F.lit(None)
    empty = V.Value(F.lit(V.NULL), none.cast("boolean"), none.cast("long"), none.cast("double"), none.cast("string"), none.cast("string"), none.cast("decimal(38,0)"))
    name, kind = {T.LongType: ("i", V.INT), T.DoubleType: ("f", V.FLOAT), T.BooleanType: ("b", V.BOOL), T.StringType: ("s", V.STR)}[type(parsed_type(c))]
    return replace(empty, kind=F.when(x.isNull(), V.NULL).otherwise(kind), **{name: x})


def cell(c: Column, x: Col) -> Col:
    """A column's value by the same transforms and coercions as any other."""
    value = _value(c, x)
    if c.transform:
        value = V.TRANSFORMS[c.transform](value)
    return V.COERCIONS[c.type](value)


def certain(c: Column, x: Col, done: Col) -> Col:
    """Whether the variant would give the same: nothing there, or a value that was read without doubt."""
    kind = parsed_type(c)
    if isinstance(kind, T.DoubleType):
        sure = ~F.isnan(x) & (F.abs(x) != float("inf"))
    elif isinstance(kind, T.StringType):
        doubtful = x.rlike(_NUMBER) & (~x.rlike(_WHOLE) if c.type in ("string", "json") else F.lit(True))
        if c.type == "json" or c.transform in _WHOLE_TEXT:
            doubtful = doubtful | x.startswith("{") | (x.startswith("[") & x.rlike(_REWRITTEN))
        else:
            doubtful = doubtful | x.startswith("{") | x.startswith("[")
        if c.transform in _TEXT:
            doubtful = doubtful | x.isin("true", "false")
        sure = ~doubtful
    else:
        sure = F.lit(True)
    there = done.isNotNull() & sure
    if c.transform == "empty_to_null" and not c.required:
        there = there | (x == "")
    return F.coalesce(there, F.lit(False)) if c.required else F.coalesce(x.isNull() | there, F.lit(False))
