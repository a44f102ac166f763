"""Operators over tables, as DataFrame operators."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import columns as library
from weftline.lang import tree as t
from weftline.lang.diagnostics import ScriptError
from weftline.plans.context import BOOL, DOUBLE, LONG, TEXT, Context, Scope, arranged, conjuncts
from weftline.plans.typed import HIDDEN, Frame, GroupRow, Groups, Row, Single, Value, common, fresh, is_number, is_whole, numeric, quoted, structured, text, truth, unstructured


#: Ranges that the span of a numeric sort key is cut into.
RANGES = 4096


class FrameOperators:
    """Part of the lowering: steps of a pipe whose items are rows."""

    def frame(self, x: Any) -> Frame:
        return self.ungrouped(x) if isinstance(x, Groups) else x

    def item(self, x: Frame | Groups) -> Any:
        return GroupRow(x) if isinstance(x, Groups) else x.item()

    def context(self, x: Frame | Groups) -> Context:
        return Context(None, x) if isinstance(x, Groups) else Context(x.df, frame=x)

    def select(self, x: Frame | Groups, body) -> Frame:
        """Rows of what body(item, context) gives."""
        ctx = self.context(x)
        out = body(self.item(x), ctx)
        out = self.scalar(out)
        out = unstructured(out) if isinstance(out, Value) else out
        if isinstance(x, Groups):
            frame = self.aggregated(x)
            df, order, natural = frame.df, frame.order, False
        else:
            df, order, natural = ctx.df, ctx.order, ctx.natural
        keep = [quoted(n) for n, _ in order]
        if isinstance(out, Row):
            fields = {n: structured(self.scalar(v)) for n, v in out.fields.items()}
            return Frame(df.select(*[v.col.alias(n) for n, v in fields.items()], *keep), {n: v.type for n, v in fields.items()}, order, natural, sorted=getattr(x, "sorted", False))
        return Frame(df.select(out.col.alias("value"), *keep), None, order, natural, out.type, getattr(x, "sorted", False))

    def op_select(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        return self.select(x, lambda item, c: self.apply(op.args[0], scope, c, item))

    def op_where(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Any:
        return self.filtered(x, op.args[0], scope)

    def filtered(self, x: Frame | Groups, predicate: t.Node, scope: Scope) -> Any:
        if isinstance(x, Groups):
            c = self.context(x)
            test = truth(self.scalar(self.apply(predicate, scope, c, GroupRow(x))))
            x.after.append(lambda df: df.filter(test))
            return x
        lambda_, body = (predicate.params, predicate.body) if isinstance(predicate, t.Lambda) else (["$"], predicate)
        c, rest = Context(x.df, frame=x), []
        inner = Scope({lambda_[0]: x.item()} | ({"_": x.item()} if lambda_ == ["$"] else {}), scope)
        for part in conjuncts(body):
            found = self.semi(part, inner)
            if found is None:
                rest.append(part)
            else:
                key, right, name, mode = found
                c.shuffled()
                c.df = c.df.join(right, key.eqNullSafe(quoted(name)), mode)
        for part in rest:
            v = self.scalar(self.lower(part, inner, c))
            # A filter drops what is null by itself; a bare comparison can be pushed to the scan.
            c.df = c.df.filter(v.col if isinstance(v, Value) and isinstance(v.type, T.BooleanType) else truth(v))
        names = [quoted(n) for n in [*x.columns(), *(n for n, _ in c.order)]]
        return Frame(c.df.select(*names) if c.joined else c.df, x.fields, c.order, c.natural, x.value_type, x.sorted)

    def semi(self, node: t.Node, scope: Scope) -> tuple | None:
        """x.in(table) or !x.in(table) as a semi or anti join."""
        mode = "left_semi"
        if isinstance(node, t.Unary) and node.sign == "!":
            node, mode = node.value, "left_anti"
        if not (isinstance(node, t.Call) and node.name.lower() == "in" and node.target is not None and len(node.args) == 1):
            return None
        source = node.args[0]
        if not isinstance(source, (t.Name, t.Pipeline, t.Every)) or isinstance(source, t.Name) and not isinstance(scope.get(source.name), (Frame, Groups)):
            return None
        table = self.lower(source, scope, self.top)
        if not isinstance(table, (Frame, Groups)):
            return None
        right, name, _ = self.keyed(self.frame(table))
        return structured(self.value(node.target, scope, Context(None))).col, right, name, mode

    def op_selectmany(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        frame = self.frame(x).with_order()
        c = Context(frame.df, frame=frame)
        out = library.listed(self.scalar(self.apply(op.args[0], scope, c, frame.item())))
        at, item = fresh("o"), fresh("i")
        df = c.df.select(*[quoted(n) for n, _ in frame.order], F.posexplode(out.col).alias(at, item))
        order = [*frame.order, (at, False)]
        keep = [quoted(n) for n, _ in order]
        kind = out.type.elementType
        if isinstance(kind, T.StructType):
            return Frame(df.select(*[quoted(item).getField(f.name).alias(f.name) for f in kind.fields], *keep), {f.name: f.dataType for f in kind.fields}, order, c.natural, sorted=frame.sorted)
        return Frame(df.select(quoted(item).alias("value"), *keep), None, order, c.natural, kind, frame.sorted)

    def op_distinct(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        frame = self.frame(x).with_order()
        first = fresh("o")
        if any(down for _, down in frame.order):
            ranked = frame.df.withColumn(first, F.row_number().over(W.partitionBy(*map(quoted, frame.columns())).orderBy(*frame.sorting())))
            return Frame(ranked.filter(quoted(first) == 1).drop(first), frame.fields, frame.order, False, frame.value_type, frame.sorted)
        df = frame.df.groupBy(*map(quoted, frame.columns())).agg(F.min(F.struct(*[quoted(n) for n, _ in frame.order])).alias(first))
        return Frame(df, frame.fields, [(first, False)], False, frame.value_type, frame.sorted)

    def op_orderby(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Any:
        frame, order = self.frame(x).with_order(), []
        c = Context(frame.df, frame=frame)
        for node, down in op.args:
            v = structured(self.scalar(self.apply(node, scope, c, frame.item())))
            name = fresh("o")
            c.df = c.df.withColumn(name, v.col)
            order.append((name, down))
        return Frame(c.df, frame.fields, [*order, *frame.order], False, frame.value_type, True)

    def limited(self, frame: Frame, n: int) -> Frame:
        frame = frame.with_order()
        df = frame.df if frame.natural else frame.df.orderBy(*frame.sorting())
        return Frame(df.limit(n), frame.fields, frame.order, False, frame.value_type, frame.sorted)

    def count_of(self, op: t.Op, scope: Scope, ctx: Context) -> int:
        return max(0, int(library.constant(self.value(op.args[0], scope, ctx), f"the number behind {op.name}")))

    def op_take(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        return self.limited(self.frame(x), self.count_of(op, scope, ctx))

    def op_skip(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        frame = self.frame(x).with_order()
        return Frame(frame.df.orderBy(*frame.sorting()).offset(self.count_of(op, scope, ctx)), frame.fields, frame.order, False, frame.value_type, frame.sorted)

    def op_takewhile(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        """Rows before the first that fails, which one aggregate finds: no window over all rows."""
        frame = self.frame(x).with_order()
        c = Context(frame.df, frame=frame)
        test, ok = truth(self.scalar(self.apply(op.args[0], scope, c, frame.item()))), fresh("t")
        marked = c.df.withColumn(ok, test)
        stop = marked.filter(~quoted(ok)).orderBy(*frame.sorting()).limit(1).select(F.struct(*[quoted(n).alias(n) for n, _ in frame.order]).alias("s"))
        at = stop.scalar()
        before, same = F.lit(False), F.lit(True)
        for n, down in frame.order:
            mine, its = quoted(n), at.getField(n)
            # Nulls come first upwards and last downwards, as the sort has them.
            smaller = F.coalesce(mine < its, mine.isNull() & its.isNotNull())
            larger = F.coalesce(mine > its, its.isNull() & mine.isNotNull())
            before = before | (same & (larger if down else smaller))
            same = same & mine.eqNullSafe(its)
        return Frame(marked.filter(at.isNull() | before).drop(ok), frame.fields, frame.order, c.natural, frame.value_type, frame.sorted)

    def numbered(self, frame: Frame) -> tuple[DataFrame, str]:
        """A column of places from 0. Parts of the rows that lie behind one another each count their own, and the sizes of those
        before are added: input partitions in read order, after a sort ranges of its first key."""
        name, frame = fresh("n"), frame.with_order()
        part, before = fresh("p"), fresh("b")
        if frame.natural and len(frame.order) == 1:
            rows = frame.df.withColumn(part, F.shiftright(quoted(frame.order[0][0]), 33))
        else:
            at = self.stretch(frame)
            if at is None:
                return frame.df.withColumn(name, F.row_number().over(W.orderBy(*frame.sorting())) - 1), name
            rows = frame.df.withColumn(part, at)
        sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
        # A row for each part.
        ends = sizes.select(quoted(part), (F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias(before))
        local = F.row_number().over(W.partitionBy(part).orderBy(*frame.sorting())) - 1
        return rows.withColumn(name, local).join(ends, part).withColumn(name, quoted(name) + quoted(before)).drop(part, before), name

    def stretch(self, frame: Frame) -> Column | None:
        """A number for ranges of the first sort key, in the order of the sort, if the key's type has one: of the span of numbers and times, of the first bytes of texts."""
        first, down = frame.order[0]
        kind, key = frame.df.schema[first].dataType, quoted(first)
        if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            if isinstance(kind, (T.DateType, T.TimestampNTZType)):
                key = key.cast("timestamp")
            key = key.cast("double")
            span = frame.df.agg(F.struct(F.min(F.when(~F.isnan(key), key)).alias("a"), F.max(F.when(~F.isnan(key), key)).alias("b")).alias("s")).scalar()
            share = (key - span["a"]) / F.greatest(span["b"] - span["a"], F.lit(1e-300))
            at = F.when(F.isnan(key), F.lit(RANGES + 1)).otherwise(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * RANGES))
        elif isinstance(kind, T.StringType):
            at = F.conv(F.rpad(F.hex(F.substring(F.encode(key, "utf-8"), 1, 2)), 4, "0"), 16, 10)
        else:
            return None
        at = F.coalesce(at.cast("long"), F.lit(-1))
        return -at if down else at

    def op_index(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        frame = self.frame(x)
        df, name = self.numbered(frame)
        return Frame(df.select(quoted(name).cast("long").alias("value"), quoted(name).alias(HIDDEN + "o")), None, [(HIDDEN + "o", False)], False, LONG)

    def op_batch(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        frame, n = self.frame(x), self.count_of(op, scope, ctx)
        if n <= 0:
            raise ScriptError("batch takes a number above 0.", op.span)
        df, name = self.numbered(frame)
        item = structured(frame.item())
        batch = fresh("o")
        rows = df.groupBy(F.floor(quoted(name) / n).alias(batch)).agg(F.transform(F.array_sort(F.collect_list(F.struct(quoted(name).alias("n"), item.col.alias("item")))), lambda e: e["item"]).alias("value"))
        return Frame(rows, None, [(batch, False)], False, T.ArrayType(item.type))

    def single(self, df: DataFrame, col: Column, kind: T.DataType) -> Single:
        return Single(Frame(df.agg(col.alias("value")), None, [], False, kind))

    def op_count(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Single:
        return self.single(self.frame(x).df, F.count(F.lit(1)), LONG)

    def _aggregate(self, x: Frame | Groups, op: t.Op) -> Single:
        frame = self.frame(x)
        v = structured(frame.item())
        if op.name == "sum":
            v = numeric(v)
            kind = LONG if is_whole(v) else DOUBLE
            return self.single(frame.df, F.coalesce(F.sum(v.col), F.lit(0).cast(kind)).cast(kind), kind)
        return self.single(frame.df, (F.min if op.name == "min" else F.max)(v.col), v.type)

    def op_sum(self, x, op, scope, ctx) -> Single:
        return self._aggregate(x, op)

    def op_min(self, x, op, scope, ctx) -> Single:
        return self._aggregate(x, op)

    def op_max(self, x, op, scope, ctx) -> Single:
        return self._aggregate(x, op)

    def op_first(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Single:
        frame = self.frame(x)
        return Single(self.limited(self.filtered(frame, op.args[0], scope) if op.args else frame, 1))

    def op_last(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Single:
        frame = self.frame(x)
        frame = (self.filtered(frame, op.args[0], scope) if op.args else frame).with_order()
        back = Frame(frame.df, frame.fields, [(n, not down) for n, down in frame.order], False, frame.value_type)
        return Single(self.limited(back, 1))

    def op_any(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Single:
        frame = self.frame(x)
        frame = self.filtered(frame, op.args[0], scope) if op.args else frame
        # One row is enough, and an empty frame counts none.
        return self.single(frame.df.limit(1), F.count(F.lit(1)) > 0, BOOL)

    def op_all(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Single:
        frame = self.frame(x)
        if not op.args:
            return self.single(frame.df.limit(1), F.count(F.lit(1)) >= 0, BOOL)
        c = Context(frame.df)
        test = truth(self.scalar(self.apply(op.args[0], scope, c, frame.item())))
        return self.single(c.df.filter(~test).limit(1), F.count(F.lit(1)) == 0, BOOL)

    def op_concat(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Single:
        frame = self.frame(x).with_order()
        array = self.collected_in(frame, text(structured(frame.item())))
        return self.single(frame.df, F.array_join(array, self.separator(op, scope, ctx)), TEXT)

    def separator(self, op: t.Op, scope: Scope, ctx: Context) -> str:
        return str(library.constant(self.value(op.args[0], scope, ctx), "the separator")) if op.args else "|"

    def collected_in(self, frame: Frame, col: Column) -> Column:
        row = F.struct(*[F.struct(quoted(n).alias("o")).alias(f"o{k}") for k, (n, _) in enumerate(frame.order)], col.alias("item"))
        return arranged(F.collect_list(row), [down for _, down in frame.order])

    def op_reduce(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Any:
        frame = self.frame(x).with_order()
        fold, start = op.args[0], self.value(op.args[1], scope, ctx) if len(op.args) > 1 else None
        if isinstance(fold, t.Lambda) and isinstance(fold.body, t.Binary) and fold.body.sign == "+" and isinstance(fold.body.left, t.Name) and fold.body.left.name == fold.params[0] and fold.params[0] not in t.free(fold.body.right):
            c = Context(frame.df)
            term = structured(self.scalar(self.lower(fold.body.right, Scope({fold.params[1]: frame.item()}, scope), c)))
            if is_number(term) and (start is None or is_number(start)):
                kind = LONG if is_whole(term) and (start is None or is_whole(start)) else DOUBLE
                total = F.coalesce(F.sum(numeric(term).col), F.lit(0)).cast(kind)
                return self.single(c.df, total if start is None else (start.col + total).cast(kind), kind)
        array = Value(self.collected_in(frame, structured(frame.item()).col), T.ArrayType(structured(frame.item()).type))
        rows = frame.df.agg(array.col.alias("value"))
        out = structured(self.array_step(Value(quoted("value"), array.type), op, scope, Context(None)))
        return Single(Frame(rows.select(out.col.alias("value")), None, [], False, out.type))

    def op_join(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Frame:
        left = self.frame(x).with_order()
        source = self.lower(op.args[0], scope, self.top)
        if not isinstance(source, (Frame, Groups)):
            raise ScriptError("join needs a table.", op.span)
        right = self.frame(source).with_order()
        # Columns of both sides under names of their own.
        ln, rn = {n: fresh("l") for n in left.columns()}, {n: fresh("r") for n in right.columns()}
        lo, ro = [(fresh("o"), d) for _, d in left.order], [(fresh("o"), d) for _, d in right.order]
        lhit, rhit = fresh("h"), fresh("h")
        cl, cr = Context(left.df), Context(right.df)
        lkey = structured(self.scalar(self.apply(op.args[1], scope, cl, left.item())))
        rkey = structured(self.scalar(self.apply(op.args[2], scope, cr, right.item())))
        lk, rk = fresh("k"), fresh("k")
        ldf = cl.df.select(*[quoted(n).alias(m) for n, m in ln.items()], *[quoted(n).alias(m) for (n, _), (m, _) in zip(left.order, lo)], lkey.col.alias(lk), F.lit(True).alias(lhit))
        rdf = cr.df.select(*[quoted(n).alias(m) for n, m in rn.items()], *[quoted(n).alias(m) for (n, _), (m, _) in zip(right.order, ro)], rkey.col.alias(rk), F.lit(True).alias(rhit))
        same = quoted(lk).eqNullSafe(quoted(rk)) if common([lkey.type, rkey.type]) is not None else F.lit(False)
        mode = op.mode or "inner"
        df = ldf.join(rdf, same, mode)
        lrow = {n: Value(quoted(m), (left.fields or {"value": left.value_type})[n]) for n, m in ln.items()}
        rrow = {n: Value(quoted(m), (right.fields or {"value": right.value_type})[n]) for n, m in rn.items()}
        out: dict[str, Any] = dict(lrow) if left.fields is not None else {}
        if op.alias:
            there = quoted(rhit).isNotNull() if mode in ("left", "full") else None
            out[op.alias] = Row(rrow, there) if right.fields is not None else rrow["value"]
        else:
            for n, v in rrow.items() if right.fields is not None else ():
                out.setdefault(n, v)
        fields = {n: structured(v) for n, v in out.items()}
        missed = fresh("o")
        order = [(missed, False), *lo, *ro] if mode in ("right", "full") else [*lo, *ro]
        extra = [quoted(lhit).isNull().alias(missed)] if mode in ("right", "full") else []
        df = df.select(*[v.col.alias(n) for n, v in fields.items()], *extra, *[quoted(n) for n, _ in [*lo, *ro]])
        return Frame(df, {n: v.type for n, v in fields.items()}, order, False, sorted=left.sorted)

    def union(self, frames: list[Frame]) -> Frame:
        """All items of each, one table after the other; fields by name, missing ones null."""
        parts = []
        scalar = all(f.fields is None for f in frames)
        which, inner = fresh("o"), fresh("o")
        frames = [f.with_order() for f in frames]
        for k, f in enumerate(frames):
            order = F.struct(*[quoted(n) for n, _ in f.order]) if f.order else F.lit(0)
            parts.append(f.df.select(*map(quoted, f.columns()), F.lit(k).alias(which), F.to_json(F.struct(order)).alias(inner) if len({len(g.order) for g in frames}) > 1 else order.alias(inner)))
        kinds: dict[str, T.DataType] = {}
        for f in frames:
            for n, kind in (f.fields or {"value": f.value_type}).items():
                kinds[n] = kind if n not in kinds else common([kinds[n], kind]) or TEXT
        same = [p.select(*[quoted(n).cast(kinds[n]).alias(n) if n in f.columns() else F.lit(None).cast(kinds[n]).alias(n) for n in kinds], which, inner) for p, f in zip(parts, frames)]
        if len({p.schema[inner].dataType.simpleString() for p in parts}) > 1:
            same = [s.withColumn(inner, F.to_json(F.struct(inner))) for s in same]
        fixed = [s.withColumn(inner, F.struct(*[s[inner].getField(c).alias(f"c{i}") for i, c in enumerate(s.schema[inner].dataType.names)])) if isinstance(s.schema[inner].dataType, T.StructType) else s for s in same]
        df = fixed[0]
        for other in fixed[1:]:
            df = df.unionByName(other)
        return Frame(df, None if scalar else kinds, [(which, False), (inner, False)], False, kinds.get("value") if scalar else None)
