"""Syntax trees to DataFrames and columns.

A pipe over a frame becomes DataFrame operators; inside an item, arrays become higher-order functions. What Catalyst can't see is
done here: aggregates of a group's items are fused into one aggregation, lookups and counts that depend on the item become left
joins with pre-aggregated tables, membership becomes semi and anti joins, and folds that are sums become sums. Row order is kept in
hidden columns that nothing reads unless it is asked for, so the optimizer drops them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import columns as library
from weftline.lang import tree as t
from weftline.lang.diagnostics import ScriptError, nearest
from weftline.operators.arrays import ArrayOperators
from weftline.operators.frames import FrameOperators
from weftline.operators.groups import GroupOperators
from weftline.operators.lookups import LookupOperators
from weftline.plans.context import BOOL, DOUBLE, LONG, TEXT, Context, Scope, arranged
from weftline.plans.typed import NULL, Frame, Function, GroupItems, GroupRow, Groups, Row, Single, Value, equal, fresh, is_array, is_number, is_text, is_time, is_whole, numeric, quoted, structured, text, truth, typed, unified, unstructured


def scanned(df: DataFrame) -> Frame:
    """A table as items: its rows in the order in which they are read."""
    return Frame(df, {f.name: f.dataType for f in df.schema.fields}, [])


class Lowering(FrameOperators, GroupOperators, LookupOperators, ArrayOperators):
    def __init__(self, spark: SparkSession, functions: dict | None = None) -> None:
        self.spark, self.extra = spark, {k.lower(): f for k, f in (functions or {}).items()}
        self.top = Context(spark.range(1))

    def run(self, script: t.Script, names: dict[str, Any]) -> Any:
        scope = Scope(dict(names))
        for name, node in script.lets:
            scope.names[name] = self.lower(node, scope, self.top)
        if script.result is None:
            return NULL
        return self.lower(script.result, scope, self.top)

    def result(self, x: Any, ordered: bool = False) -> DataFrame:
        """A script's value as a DataFrame: items as rows, a record as one, a single value as the column `value`. Rows are in order
        where the script sorts them, or all if asked for: that is a sort."""
        if isinstance(x, GroupItems):
            raise ScriptError("The items of a group stand outside of it.")
        if isinstance(x, Groups):
            x = self.ungrouped(x)
        if isinstance(x, Single):
            x = x.frame
        if isinstance(x, Frame):
            df = x.df.orderBy(*x.sorting()) if x.order and (x.sorted or ordered and not x.natural) else x.df
            return readable(df.select(*[quoted(c) for c in x.columns()]))
        x = unstructured(x) if isinstance(x, Value) else x
        if isinstance(x, Row):
            return readable(self.top.df.select(*[structured(self.scalar(v)).col.alias(n) for n, v in x.fields.items()]))
        return readable(self.top.df.select(structured(x).col.alias("value")))

    # Expressions

    def lower(self, node: t.Node, scope: Scope, ctx: Context) -> Any:
        try:
            return getattr(self, "on_" + type(node).__name__.lower())(node, scope, ctx)
        except library.Unsupported as e:
            raise ScriptError(f"{e}.", node.span) from e

    def value(self, node: t.Node, scope: Scope, ctx: Context) -> Any:
        """Not a frame: a value or record of the row."""
        return self.scalar(self.lower(node, scope, ctx), node)

    def scalar(self, x: Any, node: t.Node | None = None) -> Any:
        if isinstance(x, Single):
            frame = x.frame
            if frame.fields is None:
                return Value(frame.df.select(quoted("value")).scalar(), frame.value_type)
            whole = structured(frame.item())
            return unstructured(Value(frame.df.select(whole.col.alias("value")).scalar(), whole.type))
        if isinstance(x, GroupItems):
            return self.gathered(x)
        if isinstance(x, GroupRow):
            return Row({"key": x.groups.key, "items": self.gathered(GroupItems(x.groups, x.groups.frame.item()))})
        if isinstance(x, Frame):
            return self.collected(x)
        if isinstance(x, Groups):
            return self.collected(self.ungrouped(x))
        if isinstance(x, Function):
            raise ScriptError("A function stands where a value is needed.", node.span if node else t.Span())
        return x

    def collected(self, frame: Frame) -> Value:
        """A whole frame as an array within one row, in order."""
        frame = frame.with_order()
        item = structured(frame.item())
        row = F.struct(*[F.struct(quoted(n).alias("o")).alias(f"o{k}") for k, (n, _) in enumerate(frame.order)], item.col.alias("item"))
        array = arranged(F.collect_list(row), [down for _, down in frame.order])
        return Value(frame.df.agg(array.alias("value")).scalar(), T.ArrayType(item.type))

    def on_literal(self, node: t.Literal, scope: Scope, ctx: Context) -> Value:
        return typed(node.value)

    def on_name(self, node: t.Name, scope: Scope, ctx: Context) -> Any:
        if not scope.has(node.name):
            raise ScriptError(f"'{node.name}' is not defined.", node.span, nearest(node.name, scope.known()))
        return scope.get(node.name)

    def on_lambda(self, node: t.Lambda, scope: Scope, ctx: Context) -> Function:
        return Function(node.params, node.body, scope)

    def on_memo(self, node: t.Memo, scope: Scope, ctx: Context) -> Function:
        return Function(node.function.params, node.function.body, scope)

    def on_letin(self, node: t.LetIn, scope: Scope, ctx: Context) -> Any:
        scope = Scope({}, scope)
        for name, value in node.lets:
            scope.names[name] = self.lower(value, scope, ctx)
        return self.lower(node.body, scope, ctx)

    def on_member(self, node: t.Member, scope: Scope, ctx: Context) -> Any:
        return self.member(self.lower(node.target, scope, ctx), node)

    def member(self, x: Any, node: t.Member) -> Any:
        name = node.name
        if isinstance(x, dict):  # the bound tables, as $
            if name in x:
                return x[name]
            raise ScriptError(f"There is no table '{name}'.", node.span, nearest(name, x))
        if isinstance(x, GroupRow):
            if name == "key":
                return x.groups.key
            if name == "items":
                return GroupItems(x.groups, x.groups.frame.item())
        if isinstance(x, Single):
            found = self.member(x.frame.item(), node)
            v = structured(found)
            return Single(Frame(x.frame.df.select(v.col.alias("value"), *[quoted(n) for n, _ in x.frame.order]), None, x.frame.order, x.frame.natural, v.type))
        if isinstance(x, GroupItems):
            return GroupItems(x.groups, self.member(x.item, node), x.where, x.order, x.distinct)
        if isinstance(x, (Frame, Groups)):
            return self.select(x, lambda item, c: self.member(item, node))
        if isinstance(x, Row):
            if name in x.fields:
                v = x.fields[name]
                return Value(F.when(x.exists, v.col), v.type) if x.exists is not None and isinstance(v, Value) else v
            if node.strict and not node.optional:
                raise ScriptError(f"There is no property '{name}'; there are {', '.join(list(x.fields)[:10])}.", node.span, nearest(name, x.fields))
            return NULL
        if isinstance(x, Value):
            kind = x.type
            if isinstance(kind, T.StructType):
                found = next((f for f in kind.fields if f.name == name), None)
                if found is None and node.strict and not node.optional:
                    raise ScriptError(f"There is no property '{name}'.", node.span, nearest(name, kind.names))
                return Value(x.col.getField(name), found.dataType) if found else NULL
            if isinstance(kind, T.ArrayType):
                inner = self.member(Value(F.lit(None), kind.elementType), node)
                return Value(F.transform(x.col, lambda e: structured(self.member(Value(e, kind.elementType), node)).col), T.ArrayType(structured(inner).type))
            if isinstance(kind, T.MapType):
                return Value(F.try_element_at(x.col, F.lit(name)), kind.valueType)
            if isinstance(kind, T.VariantType):
                return Value(F.try_variant_get(x.col, "$['" + name.replace("'", "\\'") + "']", "variant"), kind)
        return NULL

    def on_descend(self, node: t.Descend, scope: Scope, ctx: Context) -> Any:
        """Every property of this name in the known shape, in its order."""
        found: list[Value] = []

        def walk(x: Any) -> None:
            x = unstructured(x) if isinstance(x, Value) else x
            if isinstance(x, Row):
                for n, v in x.fields.items():
                    if n == node.name:
                        found.append(library.listed(v) if not is_array(v) else Value(F.array(structured(v).col), T.ArrayType(structured(v).type)))
                    walk(v)
            elif is_array(x) and isinstance(x.type.elementType, T.StructType):
                for f in x.type.elementType.fields:
                    if f.name == node.name:
                        found.append(Value(F.transform(x.col, lambda e: e.getField(node.name)), T.ArrayType(f.dataType)))

        walk(self.value(node.target, scope, ctx))
        if not found:
            return Value(F.array(), T.ArrayType(T.NullType()))
        cols, kind = unified(found)
        return Value(F.concat(*cols), kind)

    def on_index(self, node: t.Index, scope: Scope, ctx: Context) -> Any:
        x, at = self.lower(node.target, scope, ctx), self.value(node.at, scope, ctx)
        if is_text(at):
            return self.member(x, t.Member(node.target, str(library.constant(at, "the property name")), span=node.span))
        if isinstance(x, (Frame, Groups)):
            frame = self.op_skip(x, t.Op("skip", [node.at]), scope, ctx)
            return Single(self.limited(frame, 1))
        x = self.scalar(x)
        return unstructured(Value(F.get(x.col, library.whole(at)), x.type.elementType)) if is_array(x) else x

    def on_slice(self, node: t.Slice, scope: Scope, ctx: Context) -> Any:
        x = self.lower(node.target, scope, ctx)
        low, high = (None if n is None else self.value(n, scope, ctx) for n in (node.low, node.high))
        if isinstance(x, (Frame, Groups)):
            a, b = (None if v is None else int(library.constant(v, "a bound")) for v in (low, high))
            if (a or 0) < 0 or (b is not None and b < 0):
                raise ScriptError("Bounds from the end need an array, not a table.", node.span)
            frame = self.frame(x).with_order()
            out = Frame(frame.df.orderBy(*frame.sorting()).offset(a or 0), frame.fields, frame.order, False, frame.value_type, frame.sorted)
            return out if b is None else self.limited(out, max(0, b - (a or 0)))
        x = library.listed(self.scalar(x))
        n = F.size(x.col)
        edge = lambda v, default: default if v is None else F.when(library.whole(v) < 0, F.greatest(n + library.whole(v), F.lit(0))).otherwise(F.least(library.whole(v), n))
        a, b = edge(low, F.lit(0)), edge(high, n)
        return library.part(x, a, b - a)

    def on_every(self, node: t.Every, scope: Scope, ctx: Context) -> Any:
        x = self.lower(node.target, scope, ctx)
        if isinstance(x, (Frame, Groups, GroupItems)):
            return x
        x = library.listed(self.scalar(x))
        return Value(F.flatten(x.col), x.type.elementType) if isinstance(x.type.elementType, T.ArrayType) else x

    def on_object(self, node: t.Object, scope: Scope, ctx: Context) -> Any:
        out: dict[str, Any] = {}
        dynamic: list[tuple[Value, Value]] = []
        maps: list[Value] = []
        for entry in node.entries:
            if isinstance(entry, t.Spread):
                x = self.value(entry.value, scope, ctx)
                if isinstance(x, Value) and isinstance(x.type, T.MapType):
                    maps.append(x)
                    continue
                x = unstructured(x) if isinstance(x, Value) else x
                for n in x.fields if isinstance(x, Row) else ():
                    out[n] = self.member(x, t.Member(entry.value, n))
                continue
            name, body = entry
            v = self.lower(body, scope, ctx)
            v = v if isinstance(v, Single) and ctx is self.top else self.scalar(v, body)
            if not isinstance(name, str):
                told = self.value(name, scope, ctx)
                if not told.constant:
                    dynamic.append((told, structured(v)))
                    continue
                name = str(told.const)
            out[name] = v
        if not dynamic and not maps:
            return Row(out)
        pairs = [(typed(n), structured(self.scalar(v))) for n, v in out.items()] + dynamic
        cols, kind = unified([v for _, v in pairs]) if pairs else ([], TEXT)
        parts = [m.col for m in maps] + ([F.create_map(*[c for (k, _), v in zip(pairs, cols) for c in (text(k), v)])] if pairs else [])
        return Value(parts[0] if len(parts) == 1 else F.map_concat(*parts), T.MapType(TEXT, maps[0].type.valueType if maps else kind))

    def on_array(self, node: t.Array, scope: Scope, ctx: Context) -> Any:
        parts = [(isinstance(x, t.Spread), self.lower(x.value if isinstance(x, t.Spread) else x, scope, ctx)) for x in node.items]
        if parts and all(s and isinstance(x, (Frame, Groups)) for s, x in parts):
            return self.union([self.frame(x) for _, x in parts])
        if not parts:
            return Value(F.array(), T.ArrayType(T.NullType()))
        arrays = [library.listed(self.scalar(x)) if s else Value(F.array(structured(self.scalar(x)).col), T.ArrayType(structured(self.scalar(x)).type)) for s, x in parts]
        cols, kind = unified([Value(F.lit(None), a.type.elementType) for a in arrays])

        def alike(a: Value) -> Column:
            return a.col if a.type.elementType == kind else F.transform(a.col, lambda e: text(Value(e, a.type.elementType)) if kind == TEXT else e.cast(kind))

        same = [alike(a) for a in arrays]
        out = Value(F.concat(*same) if len(same) > 1 else same[0], T.ArrayType(kind))
        if not any(s for s, _ in parts) and all(library.is_literal(x) for _, x in parts):
            out.const = [library.constant(x, "an item") for _, x in parts]
        return out

    def on_template(self, node: t.Template, scope: Scope, ctx: Context) -> Value:
        parts = [structured(self.value(p, scope, ctx)) for p in node.parts]
        if all(p.constant for p in parts):
            from weftline.functions.values import text as plain_text

            return typed("".join(plain_text(p.const) for p in parts))
        return Value(F.concat(*[text(p) for p in parts]), TEXT)

    def on_if(self, node: t.If, scope: Scope, ctx: Context) -> Any:
        test = truth(self.value(node.test, scope, ctx))
        then = structured(self.value(node.then, scope, ctx))
        other = structured(self.value(node.other, scope, ctx)) if node.other else NULL
        (a, b), kind = unified([then, other])
        return unstructured(Value(F.when(test, a).otherwise(b), kind))

    def on_unary(self, node: t.Unary, scope: Scope, ctx: Context) -> Value:
        x = self.value(node.value, scope, ctx)
        if node.sign == "!":
            return Value(~truth(x), BOOL)
        if x.constant:
            return typed(-x.const)
        return Value(-numeric(x).col, numeric(x).type)

    def on_binary(self, node: t.Binary, scope: Scope, ctx: Context) -> Value:
        a, b = self.value(node.left, scope, ctx), self.value(node.right, scope, ctx)
        if node.sign in ("&&", "||"):
            p, q = truth(a), truth(b)
            return Value(p & q if node.sign == "&&" else p | q, BOOL)
        if node.sign in ("==", "!="):
            same = equal(a, b)
            return Value(same if node.sign == "==" else ~same, BOOL)
        a, b = structured(a), structured(b)
        if node.sign in ("<", "<=", ">", ">="):
            return Value(self.compared(node.sign, a, b), BOOL)
        if node.sign == "+" and (is_text(a) or is_text(b)):
            return Value(F.concat(text(a), text(b)), TEXT)
        return self.arithmetic(node.sign, numeric(a), numeric(b))

    def compared(self, sign: str, a: Value, b: Value) -> Column:
        if is_time(a) or is_time(b):
            x, y = library.moment(a), library.moment(b)
        elif is_text(a) and is_text(b):
            x, y = a.col, b.col
        elif is_number(a) and b.constant or is_number(b) and a.constant:
            # A null counts as 0; where 0 would not pass, the bare column does, and the filter reaches the scan.
            x, y = a.col, b.col
            bare, zero = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign], None
            if a.constant != b.constant:
                left, right = (0, b.const) if b.constant else (a.const, 0)
                if isinstance(left, (int, float)) and isinstance(right, (int, float)):
                    zero = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]
            if zero is False:
                return bare
            x, y = numeric(a).col, numeric(b).col
        else:
            x, y = numeric(a).col, numeric(b).col
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]

    def arithmetic(self, sign: str, a: Value, b: Value) -> Value:
        if a.constant and b.constant and sign != "/":
            return typed({"+": a.const + b.const, "-": a.const - b.const, "*": a.const * b.const}[sign])
        both = is_whole(a) and is_whole(b) and sign != "/"
        kind = LONG if both else DOUBLE
        x, y = a.col.cast(kind) if a.type != kind else a.col, b.col.cast(kind) if b.type != kind else b.col
        return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[sign](), kind)

    # Calls

    def on_call(self, node: t.Call, scope: Scope, ctx: Context) -> Any:
        name = node.name.lower()
        if node.target is None:
            found = scope.get(node.name) if scope.has(node.name) else None
            if isinstance(found, Function):
                args = [self.lower(a, scope, ctx) for a in node.args]
                return self.lower(found.body, Scope(dict(zip(found.params, args)), found.scope), ctx)
            if name == "iterate":
                raise ScriptError("iterate ends with take n; it is endless here.", node.span)
            args = [self.lower(a, scope, ctx) for a in node.args]
            if name in ("not", "boolean") and args:
                return self.method(node, self.scalar(args[0]), args[1:], ctx)
            return self.method(node, NULL, args, ctx)
        target = self.lower(node.target, scope, ctx)
        if isinstance(target, (Frame, Groups, GroupItems)) and name in ("count", "sum", "min", "max", "first", "last", "take", "skip", "index", "concat", "length"):
            op = t.Op({"length": "count"}.get(name, name), node.args, span=node.span)
            return self.step(target, op, scope, ctx)
        if isinstance(target, (Frame, Groups)) and name not in ("tocsv", "totext", "toxlsx", "toparquet", "isnullorempty", "isempty", "isnull"):
            return self.select(target, lambda item, c: self.method(node, item, [self.lower(a, scope, c) for a in node.args], c))
        if isinstance(target, Single) and target.frame.fields is not None and name in ("keep", "remove", "omitnulls", "clone"):
            return Single(self.select(target.frame, lambda item, c: self.method(node, item, [self.lower(a, scope, c) for a in node.args], c)))
        return self.method(node, self.scalar(target), [self.lower(a, scope, ctx) for a in node.args], ctx)

    def method(self, node: t.Call, x: Any, args: list, ctx: Context) -> Any:
        name = node.name.lower()
        if name == "in" and any(isinstance(a, (Frame, Groups)) for a in args):
            return self.member_of(x, args, ctx)
        args = [self.scalar(a) for a in args]
        function = library.BY_NAME.get(name) or self.extra.get(name)
        if function is None:
            raise ScriptError(f"There is no function '{node.name}'.", node.span, nearest(node.name, library.METHODS))
        from weftline.functions.plain import WHOLE

        if is_array(x) and name not in WHOLE and name not in self.extra:
            inner = function(Value(F.lit(None), x.type.elementType), args)
            return Value(F.transform(x.col, lambda e: structured(function(Value(e, x.type.elementType), args)).col), T.ArrayType(structured(inner).type))
        if isinstance(x, Row) and name not in ("keep", "remove", "omitnulls", "clone", "isnull", "isempty", "isnullorempty", "isnullorwhitespace", "not", "boolean"):
            x = structured(x)
        return function(x, args)

    def member_of(self, x: Any, args: list, ctx: Context) -> Value:
        """Whether a value is in a table's: by a left join with its distinct values."""
        out = F.lit(False)
        for a in args:
            if not isinstance(a, (Frame, Groups)):
                out = out | library.membership(x, [a]).col
                continue
            right, name, flag = self.keyed(self.frame(a))
            ctx.attach(right.withColumn(flag, F.lit(True)), structured(x).col.eqNullSafe(quoted(name)))
            out = out | F.coalesce(quoted(flag), F.lit(False))
        return Value(out, BOOL)

    def keyed(self, frame: Frame) -> tuple[DataFrame, str, str]:
        name, flag = fresh("k"), fresh("f")
        return frame.df.select(structured(frame.item()).col.alias(name)).distinct(), name, flag

    # Pipes

    def on_pipeline(self, node: t.Pipeline, scope: Scope, ctx: Context) -> Any:
        if isinstance(node.source, t.Call) and node.source.target is None and node.source.name == "iterate" and not scope.has("iterate"):
            return self.iterated(node, scope, ctx)
        x = self.lower(node.source, scope, ctx)
        for op in node.ops:
            if isinstance(x, (Frame, Groups)) and ctx is not self.top:
                x = self.correlated(x, op, scope, ctx)
            else:
                x = self.step(x, op, scope, ctx)
        return x

    def step(self, x: Any, op: t.Op, scope: Scope, ctx: Context) -> Any:
        name = op.name.lower()
        if name == "match":
            return self.match(self.scalar(x), op, scope, ctx)
        if isinstance(x, dict):
            raise ScriptError("The tables stand where one of them is needed.", op.span)
        if isinstance(x, GroupItems):
            return self.group_step(x, op, scope)
        if isinstance(x, (Frame, Groups)):
            return getattr(self, "op_" + name)(x, op, scope, ctx)
        return self.array_step(library.listed(self.scalar(x)), op, scope, ctx)

    def match(self, x: Any, op: t.Op, scope: Scope, ctx: Context) -> Any:
        arms = [(None if p is None else equal(x, self.value(p, scope, ctx)), structured(self.value(r, Scope({"_": x}, scope), ctx))) for p, r in op.args]
        cols, kind = unified([v for _, v in arms])
        out = None
        for (test, _), col in zip(arms, cols):
            if test is None:
                return unstructured(Value(col if out is None else out.otherwise(col), kind))
            out = F.when(test, col) if out is None else out.when(test, col)
        return unstructured(Value(out, kind))

    def apply(self, function: t.Node, scope: Scope, ctx: Context, *args: Any) -> Any:
        """A function, or an expression about $, of an item."""
        if isinstance(function, t.Lambda):
            return self.lower(function.body, Scope(dict(zip(function.params, args)), scope), ctx)
        out = self.lower(function, Scope({"$": args[0], "_": args[0]}, scope), ctx)
        return self.lower(out.body, Scope(dict(zip(out.params, args)), out.scope), ctx) if isinstance(out, Function) else out


def readable(df: DataFrame) -> DataFrame:
    """Columns of VARIANT as JSON text."""
    found = {f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)}
    return df.select(*[F.to_json(quoted(c)).alias(c) if c in found else quoted(c) for c in df.columns]) if found else df
