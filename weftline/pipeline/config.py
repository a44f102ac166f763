"""Pipelines in YAML, and their checks. Unknown keys are ignored; a script is text, or the name of a file of scripts."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


class PipelineError(Exception):
    pass


@dataclass
class Source:
    name: str
    trigger: str | None = None
    path: str | None = None
    map: str | None = None
    depends: list[str] = field(default_factory=list)
    input: dict[str, Any] | None = None
    content_type: str | None = None


@dataclass
class Output:
    name: str
    path: str | None = None
    map: str | None = None
    content_type: str = "json"
    response: bool = False
    status: str | None = None
    concurrency: int | None = None
    destinations: list[dict[str, Any]] = field(default_factory=list)


@dataclass
class Pipeline:
    name: str
    mode: str
    sources: list[Source]
    outputs: list[Output]
    warnings: list[str] = field(default_factory=list)


#: Destination keys and what they are here; two have no connector.
DESTINATIONS = {"fileshare": "file", "azurefileshare": "file", "file": "file", "http": "http", "restendpoint": "http", "sftp": "sftp", "blobstorage": "blob"}
_SCRIPTS = (".weft", ".script", ".dsl")


def _listed(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _script(x: Any, folder: Path, ends: tuple[str, ...]) -> str | None:
    """Text of a script; one word that ends as a script file does is a file's name."""
    if x is None:
        return None
    told = str(x).strip()
    if "\n" not in told and " " not in told and (told.endswith(ends) or (folder / told).suffix and (folder / told).is_file()):
        if not (folder / told).is_file():
            raise PipelineError(f"there is no script file {told}")
        return (folder / told).read_text("utf-8-sig")
    return told


def parse(text: str, folder: str | Path = ".", script_ends: tuple[str, ...] = _SCRIPTS) -> Pipeline:
    raw, folder = yaml.safe_load(text) or {}, Path(folder)
    warnings: list[str] = []
    sources, outputs = [], []
    for s in _listed(raw.get("sources")):
        given = next((v for k, v in s.items() if k in ("from", "input", "http", "fileShare", "file") and isinstance(v, dict)), None)
        kind = next((k for k in ("http", "fileShare", "file", "sftp") if k in s), None)
        sources.append(Source(str(s["name"]), s.get("trigger"), s.get("path"), _script(s.get("map"), folder, script_ends), [str(d) for d in _listed(s.get("depends"))], {"kind": kind, **given} if kind and given is not None else given, s.get("contentType")))
    for o in _listed(raw.get("outputs")):
        where = []
        for d in _listed(o.get("destinations") or o.get("destination")):
            for k, v in d.items():
                if k.lower() in DESTINATIONS:
                    where.append({"kind": DESTINATIONS[k.lower()], **(v or {})})
                else:
                    warnings.append(f"output {o.get('name')}: there is no destination {k}")
        outputs.append(Output(str(o.get("name", f"output{len(outputs)}")), o.get("path"), _script(o.get("map"), folder, script_ends), str(o.get("contentType") or "json"), bool(o.get("response")), o.get("responseStatusCode"), o.get("concurrency"), where))
    if raw.get("join"):
        warnings.append("join: use the pipe operator in a map")
    out = Pipeline(str(raw.get("name", "pipeline")), str(raw.get("mode", "file")), sources, outputs, warnings)
    check(out)
    return out


def check(p: Pipeline) -> None:
    names = [s.name for s in p.sources]
    if len(set(names)) < len(names):
        raise PipelineError("two sources have one name")
    answers = sum(o.response for o in p.outputs)
    if p.mode == "sync" and answers != 1:
        raise PipelineError("a sync pipeline has one output with response: true")
    if p.mode == "async" and answers:
        raise PipelineError("an async pipeline has no output with response: true")
    stages(p.sources)


def stages(sources: list[Source]) -> list[list[Source]]:
    """Sources by what they depend on: those of a stage only on earlier ones."""
    names, left, done, out = {s.name for s in sources}, list(sources), set(), []
    for s in sources:
        if missing := set(s.depends) - names:
            raise PipelineError(f"source {s.name} depends on {sorted(missing)[0]}, which there is not")
    while left:
        ready = [s for s in left if set(s.depends) <= done]
        if not ready:
            raise PipelineError("sources depend on each other: " + ", ".join(s.name for s in left))
        out.append(ready)
        done |= {s.name for s in ready}
        left = [s for s in left if s.name not in done]
    return out
