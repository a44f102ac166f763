"""What every function needs of plain values: kinds, truth, equality, text and numbers.

Values are None, bool, int, float, str, list and dict (ordered), as JSON has them.
"""

from __future__ import annotations

import json
import math
from typing import Any


def truthy(x: Any) -> bool:
    """Null, false, 0, empty text and empty lists are false; every object is true."""
    return True if isinstance(x, dict) else bool(x)


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def equal(a: Any, b: Any) -> bool:
    """Of the same kind; numbers within 1e-10; lists in order, objects by key."""
    if is_number(a) and is_number(b):
        return abs(a - b) < 1e-10
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def number_text(x: float) -> str:
    """The shortest text that reads back as the number, without a needless point."""
    if isinstance(x, int):
        return str(x)
    if math.isfinite(x) and x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return repr(x)


def text(x: Any) -> str:
    """Null is empty, numbers shortest, lists and objects JSON."""
    if x is None:
        return ""
    if isinstance(x, str):
        return x
    if isinstance(x, bool):
        return "true" if x else "false"
    if is_number(x):
        return number_text(x)
    return dump(x)


def dump(x: Any, indent: int | None = None) -> str:
    return json.dumps(plain(x), ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))


def plain(x: Any) -> Any:
    """Whole floats as integers, so that 6.0 is written 6."""
    if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 1e15:
        return int(x)
    if isinstance(x, list):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def key(x: Any) -> str:
    """What makes two values one group, distinct item or join key: exact numbers, keys in order."""
    return json.dumps(plain(x), ensure_ascii=False)


def number(x: Any) -> float:
    """A number as it is; text that reads as one, without thousands' commas; true is 1; else 0."""
    if isinstance(x, bool):
        return int(x)
    if is_number(x):
        return x
    if isinstance(x, str):
        try:
            value = float(x.strip().replace(",", ""))
        except ValueError:
            return 0
        return value if math.isfinite(value) else 0
    return 0


def numeric(x: Any) -> float:
    """For arithmetic and comparison: what is no number counts as 0."""
    return x if is_number(x) else 0


def items(x: Any) -> list:
    """A list as it is; any other value is a collection of one, null too."""
    return x if isinstance(x, list) else [x]
