"""Dates and durations: ISO text in, .NET format letters out."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

#: Format letters and what they are in Python and in Java, longest first. Fixed values.
LETTERS = [
    ("yyyy", "%Y", "yyyy"), ("yy", "%y", "yy"), ("MMMM", "%B", "MMMM"), ("MMM", "%b", "MMM"), ("MM", "%m", "MM"), ("M", "%-m", "M"),
    ("dddd", "%A", "EEEE"), ("ddd", "%a", "E"), ("dd", "%d", "dd"), ("d", "%-d", "d"), ("HH", "%H", "HH"), ("H", "%-H", "H"),
    ("hh", "%I", "hh"), ("h", "%-I", "h"), ("mm", "%M", "mm"), ("m", "%-M", "m"), ("ss", "%S", "ss"), ("s", "%-S", "s"),
    ("ffffff", "%f", "SSSSSS"), ("fff", "%3f", "SSS"), ("ff", "%2f", "SS"), ("f", "%1f", "S"), ("tt", "%p", "a"), ("zzz", "%:z", "XXX"), ("K", "%:z", "XXX"),
]
_PIECE = re.compile("|".join([r"'[^']*'", r"\\.", *(re.escape(a) for a, _, _ in LETTERS), "."]), re.S)
_NUMBERS = {"%Y": r"\d{4}", "%y": r"\d{2}", "%m": r"\d{2}", "%-m": r"\d{1,2}", "%d": r"\d{2}", "%-d": r"\d{1,2}", "%H": r"\d{2}", "%-H": r"\d{1,2}", "%I": r"\d{2}", "%-I": r"\d{1,2}", "%M": r"\d{2}", "%-M": r"\d{1,2}", "%S": r"\d{2}", "%-S": r"\d{1,2}"}


def pieces(pattern: str) -> list[tuple[str, str, bool]]:
    """Python's code, Java's letters, and whether it is a format letter, for each piece of a pattern."""
    known = {a: (p, j) for a, p, j in LETTERS}
    out = []
    for m in _PIECE.finditer(pattern):
        raw = m[0]
        if raw in known:
            out.append((*known[raw], True))
        else:
            plain = raw[1:-1] if len(raw) > 1 and raw[0] == "'" else raw[1:] if raw[0] == "\\" and len(raw) > 1 else raw
            out.append((plain, "'" + plain.replace("'", "''") + "'" if plain.isalpha() else plain.replace("'", "''"), False))
    return out


def java(pattern: str) -> str:
    """A pattern for Spark's date_format."""
    return "".join(j for _, j, _ in pieces(pattern)).replace("''", "")


def formatted(when: datetime, pattern: str) -> str:
    out = []
    for code, _, letter in pieces(pattern):
        if not letter:
            out.append(code)
        elif code[-1] == "f":
            out.append(f"{when.microsecond:06d}"[: int(code[1]) if code[1].isdigit() else 6])
        elif code == "%:z":
            offset = when.utcoffset() or timedelta()
            minutes = int(offset.total_seconds()) // 60
            out.append(f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}")
        else:
            out.append(when.strftime(code))
    return "".join(out)


def parsed(value: object, pattern: str | None = None) -> datetime | None:
    """By the pattern if there is one and it fits, else as ISO text."""
    if isinstance(value, datetime):
        return value
    if not isinstance(value, str):
        return None
    if pattern:
        told, fields = "", []
        for code, _, letter in pieces(pattern):
            if letter and code[-1] == "f":
                told += r"(\d{1,6})"
            elif letter and code == "%:z":
                told += r"(Z|[+-]\d\d:?\d\d)"
            elif letter:
                told += "(" + _NUMBERS.get(code, r"\w+") + ")"
            else:
                told += re.escape(code)
                continue
            fields.append(code)
        if m := re.fullmatch(told, value.strip()):
            try:
                codes = [("%f" if c[-1] == "f" else "%z" if c == "%:z" else c.replace("-", "")) for c in fields]
                return datetime.strptime(" ".join(x.replace("Z", "+00:00") if c == "%z" else x for x, c in zip(m.groups(), codes)), " ".join(codes))
            except ValueError:
                pass
    try:
        return datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return None


def duration(value: str) -> timedelta | None:
    """[-][d.]hh:mm[:ss[.f]] or whole days."""
    m = re.fullmatch(r"(-?)(?:(\d+)\.)?(\d+):(\d+)(?::(\d+)(?:\.(\d+))?)?", value.strip())
    if not m:
        return timedelta(days=int(value)) if re.fullmatch(r"-?\d+", value.strip()) else None
    d, h, mi, s = (int(x or 0) for x in m.groups()[1:5])
    out = timedelta(days=d, hours=h, minutes=mi, seconds=s, microseconds=int(((m[6] or "") + "000000")[:6]))
    return -out if m[1] else out


def iso(when: datetime, like: str) -> str:
    """Text as the input had it: with Z for UTC, an offset where there was one, fractions only if any."""
    out = when.replace(tzinfo=None).isoformat(timespec="microseconds" if when.microsecond else "seconds")
    if "." in out:
        out = out.rstrip("0")
    if like.strip().endswith("Z"):
        return out + "Z"
    return out + (formatted(when, "zzz") if when.tzinfo else "")


def now(pattern: str | None, zone: str | None = None) -> str:
    when = datetime.now(ZoneInfo(zone) if zone else timezone.utc)
    return formatted(when, pattern or ("yyyy-MM-ddTHH:mm:ssZ" if not zone else "yyyy-MM-ddTHH:mm:sszzz"))


def unix_seconds(value: object) -> str | None:
    when = parsed(value)
    return None if when is None else str(int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() // 1))
