"""Aggregates over the items of a group, fused into one aggregation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.lang import tree as t
from weftline.plans.context import BOOL, DOUBLE, LONG, TEXT, Context, Scope, arranged
from weftline.plans.typed import Frame, GroupItems, Groups, Row, Value, fresh, is_whole, numeric, quoted, structured, text, truth, unstructured


class GroupOperators:
    """Part of the lowering: steps of a pipe over the items of a group."""

    def op_groupby(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Groups:
        frame = self.frame(x).with_order()
        c = Context(frame.df)
        key = self.scalar(self.apply(op.args[0], scope, c, frame.item()))
        key = unstructured(key) if isinstance(key, Value) else key
        if isinstance(key, Row):
            parts = {n: structured(v) for n, v in key.fields.items()}
            names = {n: fresh("k") for n in parts}
            base = c.df.select("*", *[v.col.alias(names[n]) for n, v in parts.items()])
            whole: Any = Row({n: Value(quoted(names[n]), v.type) for n, v in parts.items()})
            keys = list(names.values())
        else:
            name = fresh("k")
            base, whole, keys = c.df.withColumn(name, key.col), Value(quoted(name), key.type), [name]
        return Groups(base, frame, keys, whole)

    def aggregated(self, g: Groups) -> Frame:
        """Keys and the aggregates asked for so far, and what follows them."""
        first = fresh("o")
        order = [quoted(n) for n, _ in g.frame.order]
        asked = [c.alias(n) for n, c in g.aggregates.items()]
        if any(down for _, down in g.frame.order) or not order:
            df = g.base.groupBy(*map(quoted, g.keys)).agg(*(asked or [F.count(F.lit(1)).alias(fresh("a"))])).withColumn(first, F.struct(*map(quoted, g.keys)))
        else:
            df = g.base.groupBy(*map(quoted, g.keys)).agg(*asked, F.min(F.struct(*order)).alias(first))
        for step in g.after:
            df = step(df)
        return Frame(df, None, [(first, False)], False)

    def ungrouped(self, g: Groups) -> Frame:
        return self.select(g, lambda item, c: item)

    def group_step(self, x: GroupItems, op: t.Op, scope: Scope) -> Any:
        name, c = op.name.lower(), Context(x.groups.base)

        def of(node: t.Node) -> Any:
            out = self.scalar(self.apply(node, scope, c, x.item))
            x.groups.base = c.df
            return out

        def also(test: Column) -> Column:
            return test if x.where is None else x.where & test

        if x.distinct and name != "count":
            return self.array_step(self.gathered(x), op, scope, Context(None, x.groups))
        if name == "where":
            return GroupItems(x.groups, x.item, also(truth(of(op.args[0]))), x.order)
        if name == "select":
            out = of(op.args[0])
            return GroupItems(x.groups, unstructured(out) if isinstance(out, Value) else out, x.where, x.order)
        if name == "orderby":
            return GroupItems(x.groups, x.item, x.where, [*((structured(of(k)).col, down) for k, down in op.args), *x.order])
        if name == "distinct":
            return GroupItems(x.groups, x.item, x.where, x.order, True)
        if name in ("first", "last", "any", "all") and op.args:
            test = truth(of(op.args[0]))
            if name == "all":
                return Value(F.coalesce(x.groups.ask(F.bool_and(test if x.where is None else F.when(x.where, test))), F.lit(True)), BOOL)
            x = GroupItems(x.groups, x.item, also(test), x.order)
        g, only = x.groups, lambda col: col if x.where is None else F.when(x.where, col)
        if name == "count":
            if x.distinct:
                v = structured(x.item).col
                there = v.isNotNull() if x.where is None else v.isNotNull() & x.where
                nulls = v.isNull() if x.where is None else v.isNull() & x.where
                return Value(g.ask(F.count_distinct(F.when(there, v))) + g.ask(F.coalesce(F.max(F.when(nulls, F.lit(1))), F.lit(0))), LONG)
            return Value(F.coalesce(g.ask(F.count(F.lit(1)) if x.where is None else F.count(F.when(x.where, F.lit(1)))), F.lit(0)), LONG)
        if name == "sum":
            v = numeric(structured(x.item))
            kind = LONG if is_whole(v) else DOUBLE
            return Value(F.coalesce(g.ask(F.sum(only(v.col))), F.lit(0)).cast(kind), kind)
        if name in ("min", "max"):
            v = structured(x.item)
            return Value(g.ask((F.min if name == "min" else F.max)(only(v.col))), v.type)
        if name == "any":
            return Value(F.coalesce(g.ask(F.max(F.lit(True)) if x.where is None else F.bool_or(x.where)), F.lit(False)), BOOL)
        if name == "all":
            return Value(F.lit(True), BOOL)
        if name in ("first", "last") and not x.order and not any(down for _, down in g.frame.order) and g.frame.order:
            v = structured(x.item)
            order = F.struct(*[quoted(n) for n, _ in g.frame.order])
            return unstructured(Value(g.ask((F.min_by if name == "first" else F.max_by)(v.col, only(order))), v.type))
        if name == "take":
            return self.topmost(x, self.count_of(op, scope, Context(None, g)))
        if name == "concat":
            parts = self.gathered(GroupItems(g, Value(text(structured(x.item)), TEXT), x.where, x.order))
            return Value(F.array_join(parts.col, self.separator(op, scope, Context(None))), TEXT)
        return self.array_step(self.gathered(x), op, scope, Context(None, g))

    def topmost(self, x: GroupItems, n: int) -> Value:
        """The first n items of each group as an array. They are ranked before they are collected, so a task keeps n rows of a group."""
        v, g = structured(x.item), x.groups
        kind = T.ArrayType(v.type)
        if n == 0:
            return Value(F.array().cast(kind), kind)
        order = [*x.order, *((quoted(name), down) for name, down in g.frame.order)]
        rank, out = fresh("r"), fresh("a")
        keys = {k: fresh("k") for k in g.keys}
        base = g.base if x.where is None else g.base.filter(x.where)
        by = [c.desc() if down else c.asc() for c, down in order] or [F.lit(0)]
        first = base.withColumn(rank, F.row_number().over(W.partitionBy(*map(quoted, g.keys)).orderBy(*by))).filter(quoted(rank) <= n)
        rows = F.array_sort(F.collect_list(F.struct(quoted(rank).alias("r"), v.col.alias("item"))))
        top = first.groupBy(*[quoted(k).alias(name) for k, name in keys.items()]).agg(F.transform(rows, lambda e: e["item"]).alias(out))
        on = F.lit(True)
        for k, name in keys.items():
            on = on & quoted(k).eqNullSafe(quoted(name))
        g.after.append(lambda df: df.join(top, on, "left").drop(*keys.values()))
        return Value(F.coalesce(quoted(out), F.array().cast(kind)), kind)

    def gathered(self, x: GroupItems) -> Value:
        """A group's items as an array in order. Rows are collected within structs, so that null items stay."""
        v = structured(x.item)
        order = [*x.order, *((quoted(n), down) for n, down in x.groups.frame.order)]
        row = F.struct(*[F.struct(c.alias("o")).alias(f"o{k}") for k, (c, _) in enumerate(order)], v.col.alias("item"))
        rows = F.collect_list(row if x.where is None else F.when(x.where, row))
        out = Value(x.groups.ask(arranged(rows, [down for _, down in order])), T.ArrayType(v.type))
        out = Value(F.coalesce(out.col, F.array().cast(out.type)), out.type)
        return Value(F.array_distinct(out.col), out.type) if x.distinct else out
