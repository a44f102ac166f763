"""What an expression is while it is lowered: a typed column, a record, a frame, groups, or a function."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNIQUE = count()
_NONE = object()
#: Names of hidden columns: they hold the order of items, keys and joined values, and no result shows them.
HIDDEN = "__w_"


def fresh(what: str = "x") -> str:
    return f"{HIDDEN}{what}{next(_UNIQUE)}"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Value:
    """A column of known type; const: its value, where it is a literal."""

    col: Column
    type: T.DataType
    const: Any = _NONE

    @property
    def constant(self) -> bool:
        return self.const is not _NONE


@dataclass
class Row:
    """A record of known fields, in order; exists: whether it is there at all, where a join may have missed it."""

    fields: dict[str, Any]
    exists: Column | None = None


@dataclass
class Frame:
    """Items as rows. fields: names and types, or None for single values in the column `value`. order: hidden columns, and whether
    descending. natural: the rows still lie in their order, as read; they may then have no order columns yet."""

    df: DataFrame
    fields: dict[str, T.DataType] | None
    order: list[tuple[str, bool]]
    natural: bool = True
    value_type: T.DataType | None = None
    sorted: bool = False

    def with_order(self) -> Frame:
        """With a column that tells the order in which rows lie: added where it is asked for, behind the filters so far."""
        if self.order or not self.natural:
            return self
        name = fresh("o")
        return replace(self, df=self.df.withColumn(name, F.monotonically_increasing_id()), order=[(name, False)])

    def item(self) -> Any:
        if self.fields is None:
            return Value(quoted("value"), self.value_type)
        return Row({n: Value(quoted(n), t) for n, t in self.fields.items()})

    def columns(self) -> list[str]:
        return ["value"] if self.fields is None else list(self.fields)

    def sorting(self) -> list[Column]:
        return [quoted(n).desc() if down else quoted(n).asc() for n, down in self.order]


@dataclass
class Single:
    """A frame of one row, or none: the result of an aggregate or of first and last."""

    frame: Frame


@dataclass
class Groups:
    """Items of a frame by key, not yet aggregated: aggregates are gathered as they are asked for."""

    base: DataFrame
    frame: Frame
    keys: list[str]
    key: Any
    aggregates: dict[str, Column] = field(default_factory=dict)
    after: list = field(default_factory=list)

    def ask(self, column: Column, what: str = "a") -> Column:
        name = fresh(what)
        self.aggregates[name] = column
        return quoted(name)


@dataclass
class GroupItems:
    """The items of a group on their way through a pipe."""

    groups: Groups
    item: Any
    where: Column | None = None
    order: list[tuple[Column, bool]] = field(default_factory=list)
    distinct: bool = False


@dataclass
class GroupRow:
    """A group: key and items."""

    groups: Groups


@dataclass
class Function:
    params: list[str]
    body: Any
    scope: Any


def typed(x: Any) -> Value:
    """A literal."""
    kind = T.NullType() if x is None else T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()
    return Value(F.lit(x) if not isinstance(x, int) or isinstance(x, bool) else F.lit(x).cast("long"), kind, x)


class _Null(Value):
    """The null literal, whose column is made when there is a session."""

    def __init__(self) -> None:
        self.type, self.const = T.NullType(), None

    @property
    def col(self) -> Column:  # type: ignore[override]
        return F.lit(None)


NULL = _Null()


def is_text(v: Value) -> bool:
    return isinstance(v.type, (T.StringType, T.CharType, T.VarcharType))


def is_number(v: Value) -> bool:
    return isinstance(v.type, T.NumericType)


def is_whole(v: Value) -> bool:
    return isinstance(v.type, T.IntegralType)


def is_time(v: Value) -> bool:
    return isinstance(v.type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_array(v: Any) -> bool:
    return isinstance(v, Value) and isinstance(v.type, T.ArrayType)


def is_null(v: Value) -> bool:
    return isinstance(v.type, T.NullType)


def structured(x: Any) -> Value:
    """Any value as one column: records as structs."""
    if isinstance(x, Value):
        return x
    if isinstance(x, Row):
        parts = {n: structured(v) for n, v in x.fields.items()}
        col = F.struct(*[v.col.alias(n) for n, v in parts.items()]) if parts else F.struct()
        if x.exists is not None:
            col = F.when(x.exists, col)
        return Value(col, T.StructType([T.StructField(n, v.type) for n, v in parts.items()]))
    raise TypeError(f"{type(x).__name__} is no value of a row")


def unstructured(v: Value) -> Any:
    """A struct as a record of its fields."""
    if isinstance(v.type, T.StructType):
        return Row({f.name: Value(v.col.getField(f.name), f.dataType) for f in v.type.fields}, v.col.isNotNull())
    return v


def common(types: list[T.DataType]) -> T.DataType | None:
    """One type for all, if there is one."""
    rest = [t for t in types if not isinstance(t, T.NullType)]
    if not rest:
        return T.NullType()
    if all(t == rest[0] for t in rest):
        return rest[0]
    if all(isinstance(t, T.IntegralType) for t in rest):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in rest):
        return T.DoubleType()
    if all(isinstance(t, T.ArrayType) for t in rest):
        inner = common([t.elementType for t in rest])
        return None if inner is None else T.ArrayType(inner)
    return None


def unified(values: list[Value]) -> tuple[list[Column], T.DataType]:
    """Columns of one type: the common one, or text."""
    kind = common([v.type for v in values])
    if kind is None:
        return [text(v) for v in values], T.StringType()
    return [v.col if v.type == kind else v.col.cast(kind) for v in values], kind


def text(v: Value) -> Column:
    """The shortest text of numbers, JSON of arrays and records, ISO text of times; null is empty."""
    if v.constant and isinstance(v.const, str):
        return v.col
    if is_null(v):
        return F.lit("")
    if is_text(v):
        out = v.col
    elif isinstance(v.type, T.VariantType):
        out = F.try_variant_get(v.col, "$", "string")
    elif isinstance(v.type, (T.DoubleType, T.FloatType)):
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        out = F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    elif isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)):
        out = F.to_json(v.col)
    elif isinstance(v.type, T.TimestampType):
        out = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        out = v.col.cast("string")
    return F.coalesce(out, F.lit(""))


def settled(v: Value, kind: T.DataType) -> Value:
    """A VARIANT as a type, null where it is of another."""
    return Value(F.try_variant_get(v.col, "$", kind.simpleString()), kind) if isinstance(v.type, T.VariantType) else v


def truth(v: Any) -> Column:
    """Null, false, 0, empty text and empty arrays are false; records are true."""
    if isinstance(v, Value) and isinstance(v.type, T.VariantType):
        return F.coalesce(~text(v).isin("", "false", "0", "[]", "null"), F.lit(False))
    if isinstance(v, Row):
        return F.lit(True) if v.exists is None else v.exists
    if is_null(v):
        return F.lit(False)
    if isinstance(v.type, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if is_number(v):
        return F.coalesce(v.col != 0, F.lit(False))
    if is_text(v):
        return F.coalesce(v.col != "", F.lit(False))
    if isinstance(v.type, T.ArrayType):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def numeric(v: Value) -> Value:
    """For arithmetic: null and what is no number count as 0."""
    v = settled(v, T.DoubleType())
    if is_number(v):
        return v if v.constant else Value(F.coalesce(v.col, F.lit(0).cast(v.type)), v.type)
    return Value(F.lit(0).cast("long"), T.LongType(), 0)


def equal(a: Any, b: Any) -> Column:
    """Kinds must agree; null equals null; other than whole numbers within 1e-10."""
    if isinstance(a, Row) or isinstance(b, Row):
        a, b = structured(a), structured(b)
    if isinstance(a.type, T.VariantType) != isinstance(b.type, T.VariantType):
        a, b = settled(a, b.type), settled(b, a.type)
    if is_null(a) or is_null(b):
        return a.col.isNull() if is_null(b) else b.col.isNull()
    if is_number(a) and is_number(b):
        if is_whole(a) and is_whole(b):
            return a.col.eqNullSafe(b.col)
        # Within a filter the exact comparison of a column with a literal reaches the scan.
        if a.constant or b.constant:
            return a.col.eqNullSafe(b.col)
        return a.col.eqNullSafe(b.col) | F.coalesce(F.abs(a.col - b.col) < 1e-10, F.lit(False))
    if common([a.type, b.type]) is not None:
        return a.col.eqNullSafe(b.col)
    if is_time(a) or is_time(b):
        return text(a).eqNullSafe(text(b))
    return F.lit(False)
