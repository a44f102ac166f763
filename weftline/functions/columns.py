"""The functions of the language as typed Spark columns: name to (receiver, arguments) -> value.

All are built-in expressions but sanitize, CSV, XML, XLSX, Parquet and RSA, which Spark lacks in this form and which run as Arrow
functions over batches of text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import plain, times
from weftline.plans.typed import NULL, Row, Value, common, equal, is_array, is_null, is_number, is_text, is_time, is_whole, numeric, settled, structured, text, truth, typed, unified

TEXT, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


class Unsupported(Exception):
    """A function that this lane can't type here."""


def is_literal(x: Any) -> bool:
    return x.constant if isinstance(x, Value) else isinstance(x, Row) and all(map(is_literal, x.fields.values()))


def constant(v: Any, what: str) -> Any:
    if not is_literal(v):
        raise Unsupported(f"{what} must be a literal")
    return v.const if isinstance(v, Value) else {n: constant(x, n) for n, x in v.fields.items()}


def whole(v: Value) -> Column:
    return numeric(v).col.cast("int")


def cased(turn: Callable) -> Callable:
    def function(x: Value, args: list) -> Value:
        s = text(x)
        if not args:
            return Value(turn(s), TEXT)
        n = whole(args[0])
        return Value(F.concat(F.left(s, n - 1), turn(F.substring(s, n, F.lit(1))), F.substring(s, n + 1, F.length(s))), TEXT)

    return function


def trimmed(pattern: str, by: Callable) -> Callable:
    def function(x: Value, args: list) -> Value:
        return Value(by(text(x), text(args[0])) if args else F.regexp_replace(text(x), pattern, ""), TEXT)

    return function


def padded(by: Callable) -> Callable:
    def function(x: Value, args: list) -> Value:
        s, n = text(x), whole(args[0])
        sign = F.lit((constant(args[1], "the sign") or " ")[0] if len(args) > 1 else " ")
        return Value(F.when(F.length(s) >= n, s).otherwise(by(s, n, sign)), TEXT)

    return function


def found(by: Callable) -> Callable:
    return lambda x, args: Value(F.coalesce(by(F.lower(text(x)), F.lower(text(args[0]))) & x.col.isNotNull(), F.lit(False)), BOOL)


def literal(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replaced(x: Value, args: list) -> Value:
    if len(args) > 2 and constant(args[2], "the case option"):
        return Value(F.regexp_replace(text(x), "(?iu)" + literal(constant(args[0], "what is replaced")), constant(args[1], "the replacement").replace("\\", "\\\\").replace("$", "\\$")), TEXT)
    return Value(F.replace(text(x), text(args[0]), text(args[1])), TEXT)


def substring(x: Value, args: list) -> Value:
    s, start = text(x), whole(args[0])
    return Value(F.substring(s, start + 1, whole(args[1]) if len(args) > 1 else F.length(s)), TEXT)


def split(x: Value, args: list) -> Value:
    s = constant(args[0], "the delimiter")
    return Value(F.split(text(x), literal(s), -1) if s else F.array(text(x)), T.ArrayType(TEXT))


def texts(v: Value) -> Column:
    """An array's items as texts; a single value's as one."""
    if not is_array(v):
        return F.array(text(v))
    return F.transform(v.col, lambda e: text(Value(e, v.type.elementType)))


def joined(x: Value, args: list) -> Value:
    parts = [texts(x), *(texts(structured(a)) for a in args[1:])]
    return Value(F.array_join(F.concat(*parts) if len(parts) > 1 else parts[0], constant(args[0], "the separator") if args else "|"), TEXT)


def rounded(x: Value, args: list) -> Value:
    places = next((int(a.const) for a in args if a.constant and isinstance(a.const, (int, float))), 0)
    mode = next((a.const for a in args if a.constant and isinstance(a.const, str)), "awayFromZero")
    v = numeric(x).col.cast("double")
    if mode == "toZero":
        scale = 10.0**places
        out = F.when(v < 0, F.ceil(v * scale)).otherwise(F.floor(v * scale)) / scale
    else:
        out = (F.bround if mode == "toEven" else F.round)(v, places)
    return Value(out, DOUBLE)


def number(x: Value) -> Value:
    x = settled(x, DOUBLE)
    if is_number(x):
        return numeric(x)
    if isinstance(x.type, T.BooleanType):
        return Value(F.coalesce(x.col.cast("long"), F.lit(0)).cast("long"), LONG)
    if is_text(x):
        return Value(F.coalesce(F.replace(F.trim(x.col), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0)), DOUBLE)
    return Value(F.lit(0.0), DOUBLE)


def truncated(x: Value, args: list) -> Value:
    v = number(x).col
    return Value(F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"), DOUBLE)


def converted(x: Value, args: list) -> Value:
    kind = str(constant(args[0], "the type")).lower()
    if kind in ("int32", "int64"):
        return Value(truncated(x, []).col.cast("long"), LONG)
    if kind in ("double", "decimal", "single"):
        return Value(number(x).col.cast("double"), DOUBLE)
    if kind == "boolean":
        return Value(~F.lower(F.trim(text(x))).isin("", "false", "0") if is_text(x) else truth(x), BOOL)
    return Value(text(x), TEXT) if kind == "string" else x


def missing(test: Callable[[Any], Column]) -> Callable:
    def function(x: Any, args: list) -> Value:
        absent = test(x)
        if not args:
            return Value(absent, BOOL)
        (a, b), kind = unified([structured(x), structured(args[0])])
        return Value(F.when(absent, b).otherwise(a), kind)

    return function


def null(x: Any) -> Column:
    return (~x.exists if x.exists is not None else F.lit(False)) if isinstance(x, Row) else F.lit(True) if is_null(x) else x.col.isNull()


def empty(x: Any) -> Column:
    if isinstance(x, Value) and is_text(x):
        return x.col.isNull() | (x.col == "")
    return x.col.isNull() | (F.size(x.col) == 0) if is_array(x) else null(x)


def blank(x: Any) -> Column:
    return x.col.isNull() | x.col.rlike(r"^\s*$") if isinstance(x, Value) and is_text(x) else empty(x)


def moment(x: Value, pattern: str | None = None) -> Column:
    """A timestamp; null if the text isn't one."""
    if is_time(x):
        return x.col.cast("timestamp")
    iso = F.try_to_timestamp(text(x))
    return F.coalesce(F.try_to_timestamp(text(x), F.lit(times.java(pattern))), iso) if pattern else iso


def dated(x: Value, args: list) -> Value:
    pattern = times.java(str(constant(args[-1], "the format")))
    when = moment(x, str(constant(args[0], "the input format")) if len(args) > 1 else None)
    return Value(F.coalesce(F.date_format(when, pattern), text(x)), TEXT)


def added(x: Value, args: list) -> Value:
    if is_number(x):
        return Value(numeric(x).col + numeric(args[0]).col, DOUBLE)
    span = times.duration(str(constant(args[0], "the duration")))
    if span is None:
        return x
    when = moment(x) + F.make_dt_interval(F.lit(span.days), F.lit(0), F.lit(0), F.lit(span.seconds + span.microseconds / 1e6).cast("decimal(18,6)"))
    if is_time(x):
        return Value(when, T.TimestampType())
    zone = F.when(F.endswith(F.trim(text(x)), F.lit("Z")), F.lit("Z")).otherwise(F.lit(""))
    return Value(F.coalesce(F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), zone), text(x)), TEXT)


def unix_seconds(x: Value, args: list) -> Value:
    return Value(F.unix_seconds(moment(args[0] if args else x)).cast("string"), TEXT)


def formatted(x: Value, args: list) -> Value:
    if not args:
        return Value(text(x), TEXT)
    pattern = str(constant(args[0], "the format"))
    if not is_number(x):
        return dated(x, args)
    m = re.fullmatch(r"([FNfn])(\d*)", pattern)
    if m:
        places = int(m[2]) if m[2] else 2
        out = F.format_number(F.round(x.col.cast("double"), places), places)
        return Value(out if m[1] in "Nn" else F.replace(out, F.lit(","), F.lit("")), TEXT)
    if m := re.fullmatch(r"[Dd](\d*)", pattern):
        digits = F.abs(x.col.cast("long")).cast("string")
        width = int(m[1] or 0)
        return Value(F.concat(F.when(x.col < 0, F.lit("-")).otherwise(F.lit("")), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))), TEXT)
    return batched(lambda v, a: plain.as_text(v, a), TEXT, numeric_in=True)(x, args)


def kept(keep: bool) -> Callable:
    def function(x: Any, args: list) -> Any:
        names = {constant(a, "a property name") for a in args}
        if isinstance(x, Row):
            return Row({n: v for n, v in x.fields.items() if (n in names) == keep}, x.exists)
        if isinstance(x, Value) and isinstance(x.type, T.StructType):
            fields = [f for f in x.type.fields if (f.name in names) == keep]
            return Value(F.when(x.col.isNotNull(), F.struct(*[x.col.getField(f.name).alias(f.name) for f in fields])), T.StructType(fields))
        if is_array(x) and isinstance(x.type.elementType, T.StructType):
            inner = function(Value(F.lit(None), x.type.elementType), args).type
            return Value(F.transform(x.col, lambda e: function(Value(e, x.type.elementType), args).col), T.ArrayType(inner))
        if isinstance(x, Value) and isinstance(x.type, T.MapType):
            return Value(F.map_filter(x.col, lambda k, _: k.isin(*names) if keep else ~k.isin(*names)), x.type)
        return x

    return function


def without_nulls(x: Any, args: list) -> Any:
    """A struct's fields can't vary by row: its nulls stay, and JSON leaves them out. Maps lose theirs."""
    if isinstance(x, Value) and isinstance(x.type, T.MapType):
        return Value(F.map_filter(x.col, lambda _, v: v.isNotNull()), x.type)
    return x


def members(args: list) -> list[Value]:
    return [structured(a) for a in args]


def membership(x: Any, args: list) -> Value:
    v = structured(x)

    def among(a: Value) -> Column:
        return F.exists(a.col, lambda e: equal(v, Value(e, a.type.elementType)))

    tests = [among(a) if is_array(a) else equal(x, a) for a in members(args)]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return Value(out, BOOL)


def size(x: Any) -> Column:
    return F.coalesce(F.size(x.col), F.lit(1)).cast("long") if is_array(x) else F.lit(1).cast("long")


def length(x: Any, args: list) -> Value:
    return Value(size(x) if is_array(x) else F.length(text(structured(x))).cast("long"), LONG)


def total(x: Any, args: list) -> Value:
    if not is_array(x):
        return numeric(x)
    kind = x.type.elementType
    as_double = not isinstance(kind, T.IntegralType)
    zero = F.lit(0.0) if as_double else F.lit(0).cast("long")
    out = F.aggregate(x.col, zero, lambda a, e: a + numeric(Value(e, kind)).col.cast("double" if as_double else "long"))
    return Value(F.coalesce(out, zero), DOUBLE if as_double else LONG)


def extreme(by: Callable) -> Callable:
    return lambda x, args: Value(by(x.col), x.type.elementType) if is_array(x) else x


def edge(first: bool) -> Callable:
    def function(x: Any, args: list) -> Any:
        if is_array(x):
            return Value(F.get(x.col, F.lit(0)) if first else F.try_element_at(x.col, F.lit(-1)), x.type.elementType)
        return Value(F.left(text(x), F.lit(1)) if first else F.right(text(x), F.lit(1)), TEXT) if isinstance(x, Value) and is_text(x) else x

    return function


def part(x: Value, start: Column, n: Column) -> Value:
    """Items from an index on, so many at most."""
    return Value(F.slice(x.col, F.least(F.greatest(start, F.lit(0)), F.size(x.col)) + 1, F.greatest(n, F.lit(0))), x.type)


def listed(x: Any) -> Value:
    """A single value as an array of one."""
    if is_array(x):
        return x
    v = structured(x)
    return Value(F.array(v.col), T.ArrayType(v.type))


def numbers(x: Any, args: list) -> Value:
    start, n = (numeric(a).col.cast("long") for a in args[:2])
    return Value(F.when(n > 0, F.sequence(start, start + n - 1)).otherwise(F.array().cast("array<long>")), T.ArrayType(LONG))


def positions(x: Value, args: list) -> Value:
    return Value(F.transform(listed(x).col, lambda _, i: i.cast("long")), T.ArrayType(LONG))


def batched(function: Callable, kind: T.DataType, numeric_in: bool = False) -> Callable:
    """A function over plain values as an Arrow function; arguments must be literals."""

    def lowered(x: Any, args: list) -> Value:
        told = [constant(a, "an argument") if isinstance(a, Value) else {n: constant(v, n) for n, v in a.fields.items()} for a in args]
        v = structured(x)
        as_json = isinstance(v.type, (T.ArrayType, T.StructType, T.MapType))

        @F.pandas_udf(kind)
        def run(column: pd.Series) -> pd.Series:
            import json

            def one(s: Any) -> Any:
                if s is None or s != s:
                    return None
                return function(json.loads(s) if as_json else float(s) if numeric_in else s, told)

            return column.map(one, na_action=None)

        return Value(run(F.to_json(v.col, {"ignoreNullFields": "false"}) if as_json else v.col if numeric_in else text(v)), kind)

    return lowered


def from_csv(x: Value, args: list) -> Value:
    """An array of maps from column names to texts."""
    kind = T.ArrayType(T.MapType(TEXT, TEXT))
    return batched(lambda s, a: [{k: v if isinstance(v, str) else plain.text(v) for k, v in r.items()} for r in plain.METHODS["fromCsv"](s, a)], kind)(x, args)


def rows_of_text(name: str) -> Callable:
    kind = T.ArrayType(T.MapType(TEXT, TEXT))
    return batched(lambda s, a: [{k: None if v is None else plain.text(v) for k, v in r.items()} for r in plain.METHODS[name](s, a)], kind)


def lines(x: Value, args: list) -> Value:
    delimiter = args[0].fields["delimiter"].const if args and isinstance(args[0], Row) and "delimiter" in args[0].fields else "\n"
    return Value(F.transform(F.split(text(x), literal(delimiter), -1), lambda s: F.regexp_replace(s, r"\r+$", "")), T.ArrayType(TEXT))


def as_lines(x: Value, args: list) -> Value:
    delimiter = args[0].fields["delimiter"].const if args and isinstance(args[0], Row) and "delimiter" in args[0].fields else "\n"
    return Value(F.array_join(texts(listed(x)), delimiter), TEXT)


def xml_json(x: Value, args: list) -> Value:
    """A document as VARIANT: its shape is in the data."""
    out = batched(lambda s, a: plain.formats.json.dumps(plain.METHODS["fromXml"](s, a)), TEXT)(x, args)
    return Value(F.try_parse_json(out.col), T.VariantType())


def parsed_json(x: Value, args: list) -> Value:
    return Value(F.try_parse_json(F.nullif(F.trim(text(x)), F.lit(""))), T.VariantType())


def clock(x: Any, args: list) -> Value:
    when = F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), args[1].const if len(args) > 1 else "UTC")
    return Value(F.date_format(when, times.java(str(args[0].const)) if args else "yyyy-MM-dd'T'HH:mm:ss'Z'"), TEXT)


def url_encoded(x: Value, args: list) -> Value:
    out = F.url_encode(text(x))
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return Value(out, TEXT)


def url_decoded(x: Value, args: list) -> Value:
    return Value(F.coalesce(F.try_url_decode(F.replace(text(x), F.lit("+"), F.lit("%2B"))), text(x)), TEXT)


def hashed(x: Value, args: list) -> Value:
    return Value(F.left(F.md5(text(x).cast("binary")), whole(args[0]) if args else F.lit(32)), TEXT)


METHODS: dict[str, Callable[[Any, list], Any]] = {
    "toLower": cased(F.lower), "toUpper": cased(F.upper),
    "trim": trimmed(r"^\s+|\s+$", F.btrim), "trimStart": trimmed(r"^\s+", lambda s, c: F.ltrim(s, c)), "trimEnd": trimmed(r"\s+$", lambda s, c: F.rtrim(s, c)),
    "left": lambda x, a: Value(F.left(text(x), whole(a[0]) if a else F.lit(1)), TEXT), "right": lambda x, a: Value(F.right(text(x), whole(a[0]) if a else F.lit(1)), TEXT),
    "padLeft": padded(F.lpad), "padRight": padded(F.rpad), "length": length, "contains": found(F.contains), "startsWith": found(F.startswith), "endsWith": found(F.endswith),
    "replace": replaced, "substring": substring, "split": split, "regex": lambda x, a: Value(F.regexp_extract_all(text(x), text(a[0]), F.lit(0)), T.ArrayType(TEXT)),
    "toCharArray": lambda x, a: Value(F.filter(F.split(text(x), ""), lambda c: c != ""), T.ArrayType(TEXT)), "urlEncode": url_encoded, "urlDecode": url_decoded,
    "sanitize": batched(plain.sanitized, TEXT), "concat": joined, "hash": hashed, "rsaSign": batched(plain.rsa_sign, TEXT), "toString": formatted,
    "newGuid": lambda x, a: Value(F.uuid(), TEXT), "round": rounded, "floor": lambda x, a: Value(F.floor(number(x).col).cast("double"), DOUBLE), "ceiling": lambda x, a: Value(F.ceil(number(x).col).cast("double"), DOUBLE),
    "truncate": truncated, "abs": lambda x, a: Value(F.abs(number(x).col), number(x).type), "toNumber": lambda x, a: number(x), "convertTo": converted, "parseJson": parsed_json,
    "isNull": missing(null), "isEmpty": missing(empty), "isNullOrEmpty": missing(empty), "isNullOrWhiteSpace": missing(blank), "range": numbers,
    "dateFormat": dated, "tryDateFormat": dated, "add": added, "toUnixTimeSeconds": unix_seconds, "now": clock, "utcNow": lambda x, a: clock(x, a[:1]),
    "clone": lambda x, a: x, "keep": kept(True), "remove": kept(False), "omitNulls": without_nulls, "in": membership, "not": lambda x, a: Value(~truth(x), BOOL), "boolean": lambda x, a: Value(truth(x), BOOL),
    "count": lambda x, a: Value(size(x), LONG), "first": edge(True), "last": edge(False), "sum": total, "min": extreme(F.array_min), "max": extreme(F.array_max), "index": positions,
    "take": lambda x, a: part(listed(x), F.lit(0), whole(a[0])), "skip": lambda x, a: part(listed(x), whole(a[0]), F.size(listed(x).col)),
    "fromCsv": from_csv, "toCsv": batched(lambda r, a: plain.METHODS["toCsv"](r, a), TEXT), "fromText": lines, "toText": as_lines, "fromXml": xml_json, "toXml": batched(lambda r, a: plain.METHODS["toXml"](r, a), TEXT),
    "fromXlsx": rows_of_text("fromXlsx"), "toXlsx": batched(lambda r, a: plain.METHODS["toXlsx"](r, a), TEXT), "fromParquet": rows_of_text("fromParquet"), "toParquet": batched(lambda r, a: plain.METHODS["toParquet"](r, a), TEXT),
}
BY_NAME = {name.lower(): f for name, f in METHODS.items()}
__all__ = ["BY_NAME", "METHODS", "NULL", "Unsupported", "common", "is_whole", "typed"]
