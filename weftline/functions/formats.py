"""CSV, XML, text lines, XLSX and Parquet as values."""

from __future__ import annotations

import base64
import io
import json
import re
import zipfile
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from weftline.functions.values import items, text


def letters(n: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def csv_rows(s: str, delimiter: str = ",", quote: str = '"') -> list[list[str]]:
    """Cells of each line that is not blank; quoted ones may hold delimiters, line ends and doubled quotes."""
    rows, row, cell, inside, at = [], [], [], False, 0
    while at <= len(s):
        c = s[at] if at < len(s) else None
        if inside and c is not None:
            if c == quote and s[at + 1 : at + 2] == quote:
                cell.append(quote)
                at += 1
            elif c == quote:
                inside = False
            else:
                cell.append(c)
        elif c == quote and not cell:
            inside = True
        elif c == delimiter:
            row.append("".join(cell))
            cell = []
        elif c is None or c == "\n":
            last = "".join(cell)
            row.append(last[:-1] if last.endswith("\r") else last)
            if len(row) > 1 or row[0].strip():
                rows.append(row)
            row, cell = [], []
        else:
            cell.append(c)
        at += 1
    return rows


def from_csv(s: str, options: dict) -> list[dict]:
    rows = csv_rows(s, (options.get("delimiter") or ",")[0], (options.get("quote") or '"')[0])[int(options.get("skipRows") or 0) :]
    if not rows:
        return []
    if options.get("headers", True):
        names, rows = rows[0], rows[1:]
    else:
        names = [letters(k) for k in range(max(map(len, rows)))]

    def cell(x: str) -> Any:
        if options.get("parseJson") and x.strip()[:1] in ("{", "["):
            try:
                return json.loads(x)
            except ValueError:
                pass
        return x

    return [{n: cell(r[k]) if k < len(r) else "" for k, n in enumerate(names)} for r in rows]


def to_csv(rows: list, options: dict) -> str:
    delimiter, always = (options.get("delimiter") or ",")[0], bool(options.get("alwaysQuote"))
    names = list(dict.fromkeys(k for r in rows if isinstance(r, dict) for k in r))

    def cell(x: Any) -> str:
        out = text(x)
        return '"' + out.replace('"', '""') + '"' if always or any(c in out for c in (delimiter, '"', "\n", "\r")) else out

    lines = [delimiter.join(map(cell, names))] if options.get("headers", True) and names else []
    return "\n".join(lines + [delimiter.join(cell(r.get(n)) for n in names) if isinstance(r, dict) else cell(r) for r in rows])


def from_text(s: str, options: dict) -> list[str]:
    return [x.rstrip("\r") for x in s.split(options.get("delimiter") or "\n")]


def to_text(rows: list, options: dict) -> str:
    return (options.get("delimiter") or "\n").join(map(text, rows))


def from_xml(s: str, options: dict) -> Any:
    mark, strip = options.get("attributePrefix", "@"), options.get("stripNamespaces", True)
    try:
        root = ET.fromstring(s)
    except ET.ParseError:
        return None
    name = lambda tag: re.sub(r"^\{[^}]*\}", "", tag) if strip else tag

    def value(e: ET.Element) -> Any:
        out: dict[str, Any] = {mark + name(k): v for k, v in e.attrib.items()}
        for child in e:
            k, v = name(child.tag), value(child)
            if k in out:
                out[k] = out[k] + [v] if isinstance(out[k], list) else [out[k], v]
            else:
                out[k] = v
        plain = "".join([e.text or "", *(c.tail or "" for c in e)]).strip()
        if not out:
            return plain
        if plain:
            out["#text"] = plain
        return out

    return {name(root.tag): value(root)}


def to_xml(x: Any, options: dict) -> str:
    if not isinstance(x, dict):
        return ""
    mark, root = options.get("attributePrefix", "@"), options.get("rootElement")
    keys = [k for k in x if not k.startswith(mark)]
    if root is None and len(keys) == 1 and len(x) == 1 and not isinstance(x[keys[0]], list):
        root, x = keys[0], x[keys[0]]

    def element(name: str, v: Any, depth: int) -> list[str]:
        pad = "  " * depth
        if isinstance(v, list):
            return [line for y in v for line in element(name, y, depth)]
        if not isinstance(v, dict):
            return [f"{pad}<{name}>{escape(text(v))}</{name}>" if text(v) else f"{pad}<{name} />"]
        told = "".join(f" {k[len(mark) :]}={quoteattr(text(y))}" for k, y in v.items() if k.startswith(mark))
        inner = [line for k, y in v.items() if not k.startswith(mark) and k != "#text" for line in element(k, y, depth + 1)]
        if inner:
            return [f"{pad}<{name}{told}>", *([escape(text(v["#text"]))] if "#text" in v else []), *inner, f"{pad}</{name}>"]
        return [f"{pad}<{name}{told}>{escape(text(v['#text']))}</{name}>" if "#text" in v else f"{pad}<{name}{told} />"]

    out = "\n".join(element(root or "root", x, 0))
    return out if options.get("declaration", True) is False else '<?xml version="1.0" encoding="utf-8"?>\n' + out


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def from_xlsx(s: str, options: dict) -> list[dict]:
    """Base64 of a workbook to rows of text cells; gaps are empty text. sheet: a name, or an index from 0."""
    try:
        book = zipfile.ZipFile(io.BytesIO(base64.b64decode(s, validate=True)))
    except (ValueError, zipfile.BadZipFile):
        return []
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
    sheets = [(x.get("name"), x.get(_REL + "id")) for x in ET.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")]
    files = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    want = options.get("sheet", 0)
    found = next((r for n, r in sheets if n == want), None) if isinstance(want, str) else sheets[int(want)][1] if int(want) < len(sheets) else None
    if found is None:
        return []
    rows = []
    for row in ET.fromstring(book.read("xl/" + files[found].removeprefix("/xl/"))).iter(_MAIN + "row"):
        cells: dict[int, str] = {}
        for c in row.iter(_MAIN + "c"):
            column = 0
            for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                column = column * 26 + ord(ch) - 64
            at = column - 1 if column else len(cells)
            raw = c.findtext(_MAIN + "v") or ""
            cells[at] = shared[int(raw)] if c.get("t") == "s" and raw else "".join(t.text or "" for t in c.iter(_MAIN + "t")) if c.get("t") == "inlineStr" else raw
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    width = max(map(len, rows), default=0)
    if options.get("headers", True):
        names, rows = (rows[0] if rows else []), rows[1:]
    else:
        names = [letters(k) for k in range(width)]
    return [{n: r[k] if k < len(r) else "" for k, n in enumerate(names)} for r in rows]


def to_xlsx(rows: list, options: dict) -> str:
    """A workbook of one sheet, all cells text, as base64."""
    names = list(dict.fromkeys(k for r in rows if isinstance(r, dict) for k in r))
    lines = ([names] if options.get("headers", True) else []) + [[text(r.get(n)) for n in names] for r in rows if isinstance(r, dict)]
    sheet = escape(str(options.get("sheet") or "Sheet1"))
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{letters(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(line)) + "</row>" for i, line in enumerate(lines, 1))
    main, rel = _MAIN[1:-1], _REL[1:-1]
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + body)
    return base64.b64encode(out.getvalue()).decode()


#: Column types of a Parquet schema. Fixed values.
PARQUET = {"string": "string", "int": "int32", "long": "int64", "float": "float32", "double": "float64", "bool": "bool", "date": "date32", "datetime": "timestamp", "decimal": "decimal"}


def from_parquet(s: str, options: dict | None = None) -> list[dict]:
    """Base64 of a Parquet file to rows of its flat columns, dates as ISO text; nothing if it isn't one."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    try:
        table = pq.read_table(io.BytesIO(base64.b64decode(s, validate=True)))
    except (ValueError, OSError, pa.ArrowException):
        return []
    out = table.select([f.name for f in table.schema if not pa.types.is_nested(f.type)]).to_pylist()
    told = lambda v: v.isoformat() if hasattr(v, "isoformat") else base64.b64encode(v).decode() if isinstance(v, bytes) else float(v) if type(v).__name__ == "Decimal" else v
    return [{k: told(v) for k, v in r.items()} for r in out]


def to_parquet(rows: list, options: dict) -> str:
    """A Parquet file of the rows as base64, by the schema, which must be given."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from weftline.functions.times import parsed

    if not options.get("schema"):
        raise ValueError("toParquet needs a schema: [{ name, type, nullable }]")
    kinds = {"timestamp": pa.timestamp("us"), "decimal": pa.decimal128(38, 18), "date32": pa.date32()}
    columns, fields = [], []
    for c in options["schema"]:
        kind = PARQUET.get(str(c.get("type", "string")).lower(), "string")
        values = [r.get(c["name"]) if isinstance(r, dict) else None for r in rows]
        if kind == "string":
            values = [None if v is None else text(v) for v in values]
        elif kind in ("timestamp", "date32"):
            values = [None if (w := parsed(v)) is None else w.replace(tzinfo=None) if kind == "timestamp" else w.date() for v in values]
        elif kind == "decimal":
            from decimal import Decimal

            values = [None if v is None else Decimal(text(v)).quantize(Decimal(1).scaleb(-18)) for v in values]
        elif kind == "bool":
            values = [None if v is None else bool(v) for v in values]
        else:
            values = [None if v is None else (int if kind.startswith("int") else float)(v) for v in values]
        kind = kinds.get(kind) or getattr(pa, kind + "_" if kind == "bool" else kind)()
        fields.append(pa.field(c["name"], kind, bool(c.get("nullable", True))))
        columns.append(pa.array(values, kind))
    out = io.BytesIO()
    pq.write_table(pa.Table.from_arrays(columns, schema=pa.schema(fields)), out, compression=str(options.get("compression") or "snappy").lower().replace("none", "NONE"))
    return base64.b64encode(out.getvalue()).decode()


def options(args: list) -> dict:
    return args[0] if args and isinstance(args[0], dict) else {}


def rows(x: Any) -> list:
    return items(x)
