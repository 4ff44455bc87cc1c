"""JSON values as bundles of columns: paths, kinds, named transforms and coercions, all built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from formwright.errors import SpecError
from formwright.functions import jsontext

NULL, BOOL, INT, FLOAT, STR, ARRAY, OBJECT = "null", "bool", "int", "float", "str", "array", "object"
_EDGE = r"[\s\p{Z}\x{85}]+"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_CLOCK = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
_ZONED = rf"^{_CLOCK}([Zz]|[+-][0-9]{{2}}:[0-9]{{2}})$"
_LOCAL = rf"^{_CLOCK}$"
_FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
_MIN, _MAX = -(2.0**63), 2.0**63


def segments(path: str) -> tuple[str, ...]:
    """A dotted path in parts; a leading $ or $. stands for the record."""
    if path == "$":
        return ()
    path = path[2:] if path.startswith("$.") else path
    return tuple(path.split("."))


def quoted(key: str) -> str:
    if "'" in key and '"' in key:
        raise SpecError(f"path segment {key!r} holds both kinds of quotes")
    return f"$['{key}']" if '"' in key else f'$["{key}"]'


def get(v: Column, path: tuple[str, ...]) -> Column:
    """The variant at a path; SQL null if there is none."""
    for p in path:
        key = F.try_variant_get(v, quoted(p), "variant")
        v = F.coalesce(key, F.try_variant_get(v, f"$[{int(p)}]", "variant")) if p.isascii() and p.isdigit() else key
    return v


def kind_of(v: Column, s: Column | None = None) -> Column:
    """The JSON kind of a variant; s: its schema text, where that is a column already."""
    s = F.schema_of_variant(v) if s is None else s
    return (
        F.when(v.isNull() | F.is_variant_null(v), NULL)
        .when(s == "BOOLEAN", BOOL)
        .when(s == "BIGINT", INT)
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), FLOAT)
        .when(s == "STRING", STR)
        .when(s.startswith("ARRAY"), ARRAY)
        .otherwise(OBJECT)
    )


@dataclass(frozen=True)
class Value:
    """One column per way to hold it; kind says which counts. text: of arrays and objects."""

    kind: Column
    b: Column
    i: Column
    f: Column
    s: Column
    text: Column
    #: A whole number past 64 bits with a sign, of 38 digits at most: as text it keeps its digits.
    big: Column

    def parts(self) -> dict[str, Column]:
        return {name: getattr(self, name) for name in ("b", "i", "f", "s", "text", "big")}

    def json(self) -> Column:
        """Compact JSON text of anything but a string or null."""
        return (
            F.when(self.kind == BOOL, self.b.cast("string"))
            .when(self.kind == INT, self.i.cast("string"))
            .when((self.kind == FLOAT) & self.big.isNotNull(), self.big.cast("string"))
            .when(self.kind == FLOAT, jsontext.number_text(F.when(self.kind == FLOAT, self.f)))
            .when(self.kind.isin(ARRAY, OBJECT), self.text)
        )

    def number(self) -> Column:
        return F.when(self.kind == INT, self.i.cast("double")).when(self.kind == FLOAT, self.f)


def value(v: Column, kind: Column, raw: Column, path: tuple[str, ...], composite: bool = True) -> Value:
    none = F.lit(None).cast("string")
    f = F.try_variant_get(F.when(kind == FLOAT, v), "$", "double")
    wide = F.when(kind == FLOAT, F.schema_of_variant(v)).rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    big = F.try_variant_get(F.when(wide, v), "$", "decimal(38,0)")
    past = (big >= F.lit(str(1 << 63)).cast("decimal(38,0)")) | (big < F.lit(str(-(1 << 63))).cast("decimal(38,0)"))
    if path and not any("'" in p or "?" in p or p.isdigit() for p in path):
        # a variant has no negative zero, and none of a fraction of zeros; both are in the text
        token = F.get_json_object(F.when((f == 0) | past, raw), "$" + "".join(f"['{p}']" for p in path))
        f = F.when((f == 0) & token.startswith("-"), F.lit(-0.0)).otherwise(f)
        past = past & token.rlike("^-?[0-9]+$")
    return Value(
        kind,
        F.try_variant_get(F.when(kind == BOOL, v), "$", "boolean"),
        F.try_variant_get(F.when(kind == INT, v), "$", "bigint"),
        f,
        F.try_variant_get(F.when(kind == STR, v), "$", "string"),
        jsontext.part_text(raw, v, path, kind.isin(ARRAY, OBJECT)) if composite else none,
        F.when(past, big),
    )


def _strings(x: Value, f) -> Value:
    return replace(x, s=F.when(x.kind == STR, f(x.s)))


def _as_text(x: Value) -> Value:
    return replace(x, kind=F.when(x.kind == NULL, NULL).otherwise(STR), s=F.when(x.kind == STR, x.s).otherwise(x.json()))


def _cents(x: Value) -> Value:
    n = x.number()
    y = F.abs(n) * 100
    below = F.floor(y).cast("double")
    # halves away from zero; from 2^53 on a double is whole
    near = F.when(y >= 2.0**53, y).when(y - below >= 0.5, below + 1).otherwise(below) * F.signum(n)
    top, bottom = near >= _MAX, near <= _MIN
    whole = F.when(F.isnan(n), F.lit(0).cast("long")).when(top, F.lit((1 << 63) - 1)).when(bottom, F.lit(-(1 << 63))).otherwise(F.when(~top & ~bottom, near).try_cast("long"))
    numeric = x.kind.isin(INT, FLOAT)
    return replace(x, kind=F.when(numeric, INT).otherwise(x.kind), i=F.when(numeric, whole))


def _abs(x: Value) -> Value:
    lowest = (x.kind == INT) & (x.i == F.lit(-(1 << 63)))
    return replace(
        x,
        kind=F.when(lowest, FLOAT).otherwise(x.kind),
        i=F.when(~lowest, F.abs(F.when(~lowest, x.i))),
        big=F.abs(x.big),
        f=F.when(lowest, F.lit(2.0**63)).otherwise(F.abs(x.f)),
    )


#: Each takes and gives a Value; what it does not apply to passes through, and null never reaches it.
TRANSFORMS = {
    "lowercase": lambda x: _strings(x, F.lower),
    "uppercase": lambda x: _strings(x, F.upper),
    "trim": lambda x: _strings(x, lambda s: F.regexp_replace(s, rf"^{_EDGE}|{_EDGE}$", "")),
    "json_encode": _as_text,
    "to_string": _as_text,
    "dollars_to_cents": _cents,
    "abs": _abs,
    "empty_to_null": lambda x: replace(x, kind=F.when((x.kind == STR) & (x.s == ""), NULL).otherwise(x.kind)),
}


def _int64(x: Value) -> Column:
    whole = (x.kind == FLOAT) & (x.f == F.floor(x.f).cast("double")) & (x.f >= _MIN) & (x.f < _MAX)
    return F.when(x.kind == INT, x.i).when(whole, F.when(whole, x.f).try_cast("long")).when((x.kind == STR) & x.s.rlike("^[+-]?[0-9]+$"), x.s.try_cast("long"))


def _date(x: Value) -> Column:
    s, days = x.s, (x.kind == INT) & x.i.between(-(1 << 31), (1 << 31) - 1)
    moment = F.upper(s).try_cast("timestamp")
    return (
        F.when((x.kind == STR) & s.rlike(_DATE), s.try_cast("date"))
        .when((x.kind == STR) & s.rlike(_ZONED) & moment.isNotNull(), F.substring(s, 1, 10).try_cast("date"))
        .when(days, F.date_from_unix_date(F.when(days, x.i).try_cast("int")))
    )


def _timestamp(x: Value) -> Column:
    s, most = x.s, (1 << 63) // 1000
    millis = (x.kind == INT) & x.i.between(-most, most)
    return (
        F.when((x.kind == STR) & s.rlike(_ZONED), F.upper(s).try_cast("timestamp").cast("timestamp_ntz"))
        .when((x.kind == STR) & s.rlike(_LOCAL), F.upper(s).try_cast("timestamp_ntz"))
        .when(millis, F.timestamp_millis(F.when(millis, x.i)).cast("timestamp_ntz"))
    )


COERCIONS = {
    "bool": lambda x: F.when(x.kind == BOOL, x.b),
    "int64": _int64,
    "float64": lambda x: F.when(x.kind.isin(INT, FLOAT), x.number()).when((x.kind == STR) & x.s.rlike(_FLOAT), x.s.try_cast("double")),
    "string": lambda x: F.when(x.kind == STR, x.s).when(x.kind.isin(BOOL, INT, FLOAT), x.json()),
    "json": lambda x: F.when(x.kind == STR, x.s).otherwise(x.json()),
    "date": _date,
    "timestamp": _timestamp,
}
