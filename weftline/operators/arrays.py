"""Operators over arrays within an item, as higher-order functions."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import columns as library
from weftline.lang import tree as t
from weftline.lang.diagnostics import ScriptError
from weftline.plans.context import BOOL, TEXT, Context, Scope, arranged
from weftline.plans.typed import Row, Value, common, equal, is_null, structured, text, truth, unstructured


def _evaluated(node: t.Pipeline, seed: Value, kind: T.DataType) -> Column:
    """A pipe over the name `seed`, evaluated over plain values for each row's seed."""

    @F.pandas_udf(T.StringType())
    def run(seeds: pd.Series) -> pd.Series:
        import json

        from weftline.functions.values import dump
        from weftline.lang.evaluate import Evaluator
        from weftline.lang.evaluate import Scope as Names

        return seeds.map(lambda s: dump({"v": Evaluator().value(node, Names({"seed": json.loads(s).get("v")}))}))

    whole = T.StructType([T.StructField("v", kind)])
    return F.from_json(run(F.to_json(F.struct(seed.col.alias("v")))), whole)["v"]


class ArrayOperators:
    """Part of the lowering: steps of a pipe over an array."""

    def iterated(self, node: t.Pipeline, scope: Scope, ctx: Context) -> Any:
        """iterate(seed, f) | take n: n steps of an aggregate that appends. With takeWhile or first, whose steps only the values
        tell, the pipe's beginning is evaluated over plain values, an Arrow batch of seeds at a time."""
        call, first = node.source, node.ops[0]
        seed = structured(self.value(call.args[0], scope, ctx))

        def after(e: Column) -> Value:
            out = structured(self.scalar(self.apply(call.args[1], scope, Context(None), unstructured(Value(e, seed.type)))))
            return Value(out.col.cast(seed.type) if out.type != seed.type else out.col, seed.type)

        kind = T.ArrayType(seed.type)
        if first.name == "take":
            n = self.count_of(first, scope, ctx)
            start = F.array(seed.col).cast(kind)
            x: Any = Value(F.array().cast(kind), kind)
            if n > 0:
                x = Value(F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda a, k: F.when(k == 1, a).otherwise(F.concat(a, F.array(after(F.element_at(a, -1)).col)))), kind)
        elif first.name.lower() in ("takewhile", "first") and first.args:
            others = set().union(*map(t.free, [call.args[1], *first.args])) - {"$"}
            if others:
                raise ScriptError(f"Behind iterate, {first.name} may use its item only, not '{min(others)}'.", node.span)
            out = kind if first.name.lower() == "takewhile" else seed.type
            x = Value(_evaluated(replace(node, source=replace(call, args=[t.Name("seed"), call.args[1]]), ops=[first]), seed, out), out)
        else:
            raise ScriptError("iterate goes on with take, takeWhile or first here.", node.span)
        for op in node.ops[1:]:
            x = self.step(x, op, scope, ctx)
        return x

    def array_step(self, x: Value, op: t.Op, scope: Scope, ctx: Context) -> Any:
        name, kind = op.name.lower(), x.type.elementType
        inside = Context(None)

        def of(node: t.Node, *items: Column) -> Any:
            return self.scalar(self.apply(node, scope, inside, *(unstructured(Value(e, kind)) for e in items)))

        def shape(node: t.Node) -> T.DataType:
            return structured(of(node, F.lit(None))).type

        def test(e: Column) -> Column:
            return truth(of(op.args[0], e))

        if name == "where":
            return Value(F.filter(x.col, test), x.type)
        if name == "select":
            return Value(F.transform(x.col, lambda e: structured(of(op.args[0], e)).col), T.ArrayType(shape(op.args[0])))
        if name == "selectmany":
            inner = library.listed(of(op.args[0], F.lit(None))).type
            return Value(F.flatten(F.transform(x.col, lambda e: library.listed(of(op.args[0], e)).col)), inner)
        if name in ("any", "all") and op.args:
            return Value(F.coalesce((F.exists if name == "any" else F.forall)(x.col, test), F.lit(name == "all")), BOOL)
        if name == "any":
            return Value(F.coalesce(F.size(x.col) > 0, F.lit(False)), BOOL)
        if name == "all":
            return Value(F.lit(True), BOOL)
        if name in ("first", "last"):
            some = Value(F.filter(x.col, test), x.type) if op.args else x
            out = library.edge(name == "first")(some, [])
            return unstructured(out)
        if name in ("count", "sum", "min", "max", "index"):
            return library.BY_NAME[name](x, [])
        if name == "concat":
            return library.joined(x, [self.value(a, scope, ctx) for a in op.args])
        if name == "distinct":
            return Value(F.array_distinct(x.col), x.type)
        if name in ("take", "skip"):
            return library.BY_NAME[name](x, [self.value(op.args[0], scope, ctx)])
        if name == "takewhile":
            fails = F.array_position(F.transform(x.col, lambda e: ~test(e)), True)
            return library.part(x, F.lit(0), F.when(fails > 0, fails.cast("int") - 1).otherwise(F.size(x.col)))
        if name == "batch":
            n = self.count_of(op, scope, ctx)
            if n <= 0:
                raise ScriptError("batch takes a number above 0.", op.span)
            starts = F.filter(F.transform(x.col, lambda _, i: i), lambda i: i % n == 0)
            return Value(F.transform(starts, lambda i: F.slice(x.col, i + 1, F.lit(n))), T.ArrayType(x.type))
        if name == "orderby":
            keyed = F.transform(x.col, lambda e, i: F.struct(*[F.struct(structured(of(k, e)).col.alias("o")).alias(f"o{j}") for j, (k, _) in enumerate(op.args)], F.struct(i.alias("o")).alias(f"o{len(op.args)}"), e.alias("item")))
            return Value(arranged(keyed, [*(down for _, down in op.args), False]), x.type)
        if name == "groupby":
            key = shape(op.args[0])
            keys = F.array_distinct(F.transform(x.col, lambda e: structured(of(op.args[0], e)).col))
            group = T.StructType([T.StructField("key", key), T.StructField("items", x.type)])
            return Value(F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(x.col, lambda e: structured(of(op.args[0], e)).col.eqNullSafe(k)).alias("items"))), T.ArrayType(group))
        if name == "reduce":
            return self.fold(x, op, scope, ctx)
        raise ScriptError(f"{op.name} doesn't work on an array within an item.", op.span)

    def fold(self, x: Value, op: t.Op, scope: Scope, ctx: Context) -> Any:
        """A left fold; the state has one type, that of the start and of a step from it together."""
        kind, function = x.type.elementType, op.args[0]
        if len(op.args) > 1:
            start, rest = structured(self.value(op.args[1], scope, ctx)), x.col
        else:
            start, rest = Value(F.get(x.col, F.lit(0)), kind), library.part(x, F.lit(1), F.size(x.col)).col

        def after(state: Value, e: Column) -> Value:
            return structured(self.scalar(self.apply(function, scope, Context(None), unstructured(state), unstructured(Value(e, kind)))))

        if is_null(start):
            start = Value(start.col, kind)
        if isinstance(start.type, T.StructType) and not start.type.fields:
            return self.keyed_fold(x, lambda e: structured(self.scalar(self.apply(function, scope, Context(None), Row({}), unstructured(Value(e, kind))))))
        wide = common([start.type, after(start, F.lit(None)).type]) or TEXT
        begin = start.col if start.type == wide else text(start) if wide == TEXT else start.col.cast(wide)

        def step(a: Column, e: Column) -> Column:
            out = after(Value(a, wide), e)
            return out.col if out.type == wide else text(out) if wide == TEXT else out.col.cast(wide)

        return unstructured(Value(F.aggregate(rest, begin, step), wide))


    def keyed_fold(self, x: Value, entry) -> Value:
        """A fold from {} that adds computed keys: the entries of all items, the last of equal keys."""
        kind = entry(F.lit(None)).type
        if not isinstance(kind, T.MapType):
            raise ScriptError("A fold from {} adds [key]: value.")
        pairs = F.flatten(F.transform(x.col, lambda e: F.map_entries(entry(e).col)))
        numbered = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i")))
        last = F.filter(numbered, lambda p: ~F.exists(numbered, lambda q: (q["key"] == p["key"]) & (q["i"] > p["i"])))
        return Value(F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))), kind)
