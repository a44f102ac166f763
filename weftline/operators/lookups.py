"""Tables that an item looks into: left joins with what the table gives for each key."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column

from weftline.lang import tree as t
from weftline.lang.diagnostics import ScriptError
from weftline.plans.context import Context, Scope, conjuncts
from weftline.plans.typed import NULL, Frame, GroupItems, GroupRow, Groups, Row, Value, equal, fresh, quoted, structured


class Looked(Groups):
    """Groups of a table's rows by the keys that an item asks for: aggregates are columns joined to the items."""

    outer: Context
    tests: list[Column]

    def ask(self, column: Column, what: str = "a") -> Column:
        name = fresh(what)
        names = [fresh("k") for _ in self.keys]
        right = self.base.groupBy(*[quoted(k).alias(n) for k, n in zip(self.keys, names)]).agg(column.alias(name))
        on = None
        for k, n, test in zip(self.keys, names, self.tests):
            right = right.withColumnRenamed(n, k)
            on = test if on is None else on & test
        renamed = {k: fresh("j") for k in self.keys}
        self.outer.attach(right, on)
        if self.outer.df is not None:
            for k in renamed:
                self.outer.df = self.outer.df.drop(k)
        return quoted(name)


class LookupOperators:
    """Part of the lowering: steps of a pipe over a table, inside an item."""

    def correlated(self, x: Frame | Groups, op: t.Op, scope: Scope, ctx: Context) -> Any:
        """A step of a pipe over a table inside an item. A predicate that compares the table's rows with the item makes the table's
        rows a group for each key, which is joined to the items once it is aggregated."""
        name = op.name.lower()
        if name not in ("where", "first", "last", "any") or not op.args or isinstance(x, Groups):
            return self.step(x, op, scope, ctx if name in ("take", "skip", "batch", "concat", "match") else self.top) if not (name == "select" and self.outer(op.args[0], scope)) else self.fail(op)
        predicate = op.args[0]
        param, body = (predicate.params[0], predicate.body) if isinstance(predicate, t.Lambda) else ("$", predicate)
        if not self.outer(predicate, scope):
            return self.step(x, op, scope, self.top)
        local, pairs = [], []
        for part in conjuncts(body):
            around = {n for n in t.free(part, frozenset([param])) if self.of_row(scope, n)}
            if not around:
                local.append(part)
                continue
            if isinstance(part, t.Binary) and part.sign == "==":
                for mine, its in ((part.left, part.right), (part.right, part.left)):
                    if not {n for n in t.free(mine, frozenset([param])) if self.of_row(scope, n)} and param not in t.free(its):
                        pairs.append((mine, its))
                        break
                else:
                    self.fail(op)
            else:
                self.fail(op)
        frame = x
        for part in local:
            frame = self.filtered(frame, t.Lambda([param], part), scope)
        frame = frame.with_order()
        inner = Scope({param: frame.item()}, scope)
        c = Context(frame.df)
        names, tests = [], []
        for mine, its in pairs:
            key, other = structured(self.value(mine, inner, c)), structured(self.value(its, scope, ctx))
            k = fresh("k")
            c.df = c.df.withColumn(k, key.col)
            names.append(k)
            tests.append(other.col.eqNullSafe(quoted(k)))
        groups = Looked(c.df, frame, names, NULL)
        groups.outer, groups.tests = ctx, tests
        items = GroupItems(groups, frame.item())
        return items if name == "where" else self.step(items, t.Op(op.name, [], span=op.span), scope, ctx)

    def of_row(self, scope: Scope, name: str) -> bool:
        found = scope.get(name) if scope.has(name) else None
        return isinstance(found, (Row, GroupRow, GroupItems)) or isinstance(found, Value) and not found.constant

    def outer(self, node: t.Node, scope: Scope) -> bool:
        return any(self.of_row(scope, n) for n in t.free(node))

    def fail(self, op: t.Op) -> Any:
        raise ScriptError(f"{op.name} depends on the item around it by more than equal keys; a join says that.", op.span)
