"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from weftline.lang.diagnostics import Span


@dataclass
class Node:
    span: Span = field(default=Span(), kw_only=True, compare=False)


@dataclass
class Literal(Node):
    value: object


@dataclass
class Name(Node):
    """A variable, a bound table, or $ for the document."""

    name: str


@dataclass
class Member(Node):
    """strict: a step of a path from $, where a missing name is an error."""

    target: Node
    name: str
    optional: bool = False
    strict: bool = False


@dataclass
class Descend(Node):
    target: Node
    name: str


@dataclass
class Index(Node):
    target: Node
    at: Node
    strict: bool = False


@dataclass
class Slice(Node):
    target: Node
    low: Node | None
    high: Node | None


@dataclass
class Every(Node):
    """target[*]"""

    target: Node


@dataclass
class Call(Node):
    """A method of target, or a function if there is none."""

    target: Node | None
    name: str
    args: list[Node]
    optional: bool = False


@dataclass
class Lambda(Node):
    params: list[str]
    body: Node


@dataclass
class Memo(Node):
    function: Lambda


@dataclass
class LetIn(Node):
    lets: list[tuple[str, Node]]
    body: Node


@dataclass
class Unary(Node):
    sign: str
    value: Node


@dataclass
class Binary(Node):
    sign: str
    left: Node
    right: Node


@dataclass
class If(Node):
    test: Node
    then: Node
    other: Node | None


@dataclass
class Spread(Node):
    value: Node


@dataclass
class Object(Node):
    """Entries: (key, value) with a text or a Node as key, or a Spread."""

    entries: list


@dataclass
class Array(Node):
    items: list[Node]


@dataclass
class Template(Node):
    parts: list[Node]


@dataclass
class Op(Node):
    """A step behind a pipe. args by operator; orderBy: (key, descending) pairs; match: (pattern or None, result) pairs."""

    name: str
    args: list
    mode: str | None = None
    alias: str | None = None


@dataclass
class Pipeline(Node):
    source: Node
    ops: list[Op]


@dataclass
class Script(Node):
    lets: list[tuple[str, Node]]
    result: Node | None


def children(node: object) -> list[Node]:
    """Nodes directly below one."""
    out: list[Node] = []
    stack = list(vars(node).values()) if isinstance(node, Node) else []
    while stack:
        x = stack.pop(0)
        if isinstance(x, Node):
            out.append(x)
        elif isinstance(x, (list, tuple)):
            stack = [*x, *stack]
    return out


def free(node: Node, bound: frozenset[str] = frozenset()) -> set[str]:
    """Names that a node takes from around it; $ among them."""
    if isinstance(node, Name):
        return {node.name} - bound
    if isinstance(node, Lambda):
        return free(node.body, bound | set(node.params))
    if isinstance(node, LetIn):
        out: set[str] = set()
        for name, value in node.lets:
            out |= free(value, bound)
            bound = bound | {name}
        return out | free(node.body, bound)
    out = set()
    for c in children(node):
        out |= free(c, bound)
    if isinstance(node, Call) and node.target is None and node.name not in bound:
        out.add(node.name)
    return out
