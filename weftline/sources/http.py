"""HTTP sources and destinations, from the driver, and for many rows as a Spark data source."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.functions.values import dump
from weftline.sources.files import CONTENT, format_of

_BACK = {v: k for k, v in CONTENT.items()}


@dataclass
class Request:
    url: str
    method: str = "GET"
    headers: dict[str, str] = field(default_factory=dict)
    user: str | None = None
    password: str | None = None
    body: Any = None
    timeout_ms: int = 30_000
    accepted: str = "2xx"

    def build(self) -> urllib.request.Request:
        data = None if self.body is None else self.body if isinstance(self.body, bytes) else (self.body if isinstance(self.body, str) else dump(self.body)).encode()
        headers = dict(self.headers)
        if data is not None and not any(k.lower() == "content-type" for k in headers):
            headers["Content-Type"] = "application/json"
        if self.user is not None:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password or ''}".encode()).decode()
        return urllib.request.Request(self.url, data, headers, method=self.method.upper())


def accepts(pattern: str, status: int) -> bool:
    """Whether a status is among patterns such as 2xx,404."""
    return any(len(p) == 3 and all(c.lower() == "x" or c == d for c, d in zip(p, str(status))) for p in pattern.replace(" ", "").split(","))


def send(request: Request) -> tuple[int, bytes, str]:
    """Status, body and format of the answer; an error if its status isn't accepted."""
    try:
        with urllib.request.urlopen(request.build(), timeout=request.timeout_ms / 1000) as answer:
            status, body, kind = answer.status, answer.read(), answer.headers.get("Content-Type", "")
    except urllib.error.HTTPError as e:
        status, body, kind = e.code, e.read(), e.headers.get("Content-Type", "")
    if not accepts(request.accepted, status):
        raise OSError(f"{request.method} {request.url}: status {status}")
    return status, body, format_of(request.url, kind or None)


def fetch(request: Request) -> Any:
    """The answer as a value: JSON parsed, text as it is, other bytes as base64."""
    _, body, kind = send(request)
    if kind == "json":
        return json.loads(body)
    return body.decode("utf-8", "replace") if kind in ("csv", "text", "xml") else base64.b64encode(body).decode()


def deliver(url: str, content: str, kind: str = "json", method: str = "POST", headers: dict[str, str] | None = None) -> int:
    return send(Request(url, method, {"Content-Type": _BACK.get(kind, "application/octet-stream"), **(headers or {})}, body=content))[0]


class _Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(u) for u in self.options["urls"].split() if u]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        status, body, kind = send(Request(partition.url, self.options.get("method", "GET"), accepted=self.options.get("accepted", "2xx"), timeout_ms=int(self.options.get("timeoutms", 30_000))))
        yield partition.url, status, kind, body.decode("utf-8", "replace")


class HttpSource(DataSource):
    """spark.read.format("http_pages").option("urls", "a b c"): one partition and row for each address."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, status int, format string, body string"

    def reader(self, schema: Any) -> DataSourceReader:
        return HttpReader(self.options)
