"""What lowering stands in: names, and the rows that lookups join columns to."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.lang import tree as t
from weftline.lang.diagnostics import ScriptError
from weftline.plans.typed import Frame, Groups, fresh

LONG, DOUBLE, BOOL, TEXT = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()


class Scope:
    def __init__(self, names: dict[str, Any], above: Scope | None = None) -> None:
        self.names, self.above = names, above

    def get(self, name: str) -> Any:
        return self.names[name] if name in self.names else self.above.get(name) if self.above else None

    def has(self, name: str) -> bool:
        return name in self.names or bool(self.above and self.above.has(name))

    def known(self) -> list[str]:
        return [*self.names, *(self.above.known() if self.above else [])]


class Context:
    """The rows that an expression stands in; lookups join further columns to them."""

    def __init__(self, df: DataFrame | None, groups: Groups | None = None, frame: Frame | None = None) -> None:
        self.df, self.groups, self.joined = df, groups, False
        self.order, self.natural = (frame.order, frame.natural) if frame else ([], False)

    def shuffled(self) -> None:
        """Before rows move: their order is put down, if nothing tells it yet."""
        if self.natural and not self.order:
            name = fresh("o")
            self.df, self.order = self.df.withColumn(name, F.monotonically_increasing_id()), [(name, False)]
        self.natural = False

    def attach(self, right: DataFrame, on: Column) -> None:
        if self.groups is not None:
            self.groups.after.append(lambda df: df.join(right, on, "left"))
        elif self.df is None:
            raise ScriptError("A lookup in a table stands inside an array's item.")
        else:
            self.shuffled()
            self.df = self.df.join(right, on, "left")
        self.joined = True


def conjuncts(node: t.Node) -> list[t.Node]:
    return [*conjuncts(node.left), *conjuncts(node.right)] if isinstance(node, t.Binary) and node.sign == "&&" else [node]


def arranged(rows: Column, downs: list[bool]) -> Column:
    """The items of structs (o0, o1, ..., item), sorted by the o's."""
    if not downs:
        return F.transform(rows, lambda e: e["item"])
    if not any(downs):
        keys = [f"o{k}" for k in range(len(downs))]
        by = lambda a, b: _order([(a[k], b[k], False) for k in keys])
    else:
        by = lambda a, b: _order([(a[f"o{k}"], b[f"o{k}"], down) for k, down in enumerate(downs)])
    return F.transform(F.array_sort(rows, by), lambda e: e["item"])


def _order(pairs: list[tuple[Column, Column, bool]]) -> Column:
    out = None
    for a, b, down in pairs:
        less, more = (1, -1) if down else (-1, 1)
        out = (F.when(a < b, F.lit(less)) if out is None else out.when(a < b, F.lit(less))).when(a > b, F.lit(more))
    return out.otherwise(F.lit(0))
