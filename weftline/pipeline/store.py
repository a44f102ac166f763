"""Pipelines with their revisions, the routes that lead to them, and what has become of runs: files in folders.

A file appears whole or not at all: it is written beside its place and renamed. Folders may be on a file system that several
processes share.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from weftline.pipeline.config import Pipeline, PipelineError, parse

#: Seconds for which a run is remembered.
LIFETIME = 3 * 24 * 3600


def put(path: Path, value: Any) -> None:
    """JSON at a path, at once."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.parent / f".{uuid.uuid4().hex}"
    beside.write_text(json.dumps(value), "utf-8")
    os.replace(beside, path)


def get(path: Path) -> Any:
    """What put() wrote, None if there is nothing."""
    try:
        return json.loads(path.read_text("utf-8"))
    except FileNotFoundError:
        return None


@dataclass
class Definition:
    """One revision: the pipeline's YAML, and its script files by name."""

    id: str
    revision: int
    text: str
    scripts: dict[str, str] = field(default_factory=dict)
    message: str = ""
    time: float = 0.0


class Definitions:
    """folder/<id>/<revision>/: pipeline.yaml, about.json and the scripts. A revision is never changed; a deleted pipeline ends in an empty one."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)

    def _home(self, id: str) -> Path:
        if not id or id != Path(id).name or id.startswith("."):
            raise PipelineError(f"'{id}' can't name a pipeline")
        return self.folder / id

    def ids(self) -> list[str]:
        return sorted(p.name for p in self.folder.iterdir() if self.revisions(p.name) and not self._gone(p.name)) if self.folder.is_dir() else []

    def _numbers(self, id: str) -> list[int]:
        home = self._home(id)
        return sorted(int(p.name) for p in home.iterdir() if p.name.isdigit()) if home.is_dir() else []

    def _about(self, id: str, revision: int) -> dict:
        return get(self._home(id) / f"{revision:06d}" / "about.json") or {}

    def _gone(self, id: str) -> bool:
        numbers = self._numbers(id)
        return not numbers or bool(self._about(id, numbers[-1]).get("deleted"))

    def revisions(self, id: str) -> list[Definition]:
        """The newest first, without their texts."""
        told = [(n, self._about(id, n)) for n in reversed(self._numbers(id))]
        return [Definition(id, n, "", {}, a.get("message", ""), a.get("time", 0.0)) for n, a in told]

    def save(self, id: str, text: str, scripts: dict[str, str] | None = None, message: str = "") -> int:
        """A new revision, once its text is found to be a pipeline."""
        return self._write(id, text, scripts or {}, {"message": message})

    def _write(self, id: str, text: str | None, scripts: dict[str, str], about: dict) -> int:
        home = self._home(id)
        home.mkdir(parents=True, exist_ok=True)
        beside = home / f".{uuid.uuid4().hex}"
        beside.mkdir()
        try:
            for name, script in scripts.items():
                if name != Path(name).name:
                    raise PipelineError(f"'{name}' can't name a script")
                (beside / name).write_text(script, "utf-8")
            if text is not None:
                (beside / "pipeline.yaml").write_text(text, "utf-8")
                parse(text, beside)
            put(beside / "about.json", about | {"time": time.time(), "scripts": sorted(scripts)})
            while True:
                number = (self._numbers(id) or [0])[-1] + 1
                try:
                    os.rename(beside, home / f"{number:06d}")
                    return number
                except OSError:  # another process was first
                    if not (home / f"{number:06d}").exists():
                        raise
        finally:
            shutil.rmtree(beside, ignore_errors=True)

    def load(self, id: str, revision: int | None = None) -> Definition:
        numbers = self._numbers(id)
        number = revision if revision is not None else (numbers or [0])[-1]
        about = self._about(id, number) if number in numbers else {"deleted": True}
        if about.get("deleted"):
            raise PipelineError(f"there is no pipeline {id}" + (f" of revision {revision}" if revision is not None else ""))
        at = self._home(id) / f"{number:06d}"
        return Definition(id, number, (at / "pipeline.yaml").read_text("utf-8"), {n: (at / n).read_text("utf-8") for n in about.get("scripts", [])}, about.get("message", ""), about.get("time", 0.0))

    def pipeline(self, id: str, revision: int | None = None) -> Pipeline:
        told = self.load(id, revision)
        return parse(told.text, self._home(id) / f"{told.revision:06d}")

    def restore(self, id: str, revision: int) -> int:
        """An earlier revision again, as a new one."""
        told = self.load(id, revision)
        return self.save(id, told.text, told.scripts, f"revision {revision} again")

    def delete(self, id: str) -> None:
        if self._gone(id):
            raise PipelineError(f"there is no pipeline {id}")
        self._write(id, None, {}, {"deleted": True})


class Routes:
    """Which pipeline a method and a path lead to. A part {name} of a path stands for any, and tells its value."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def all(self) -> dict[str, str]:
        return get(self.path) or {}

    def add(self, method: str, path: str, id: str) -> None:
        put(self.path, self.all() | {f"{method.upper()} /{path.strip('/')}": id})

    def remove(self, id: str) -> None:
        put(self.path, {k: v for k, v in self.all().items() if v != id})

    def find(self, method: str, path: str) -> tuple[str, dict[str, str]] | None:
        """The pipeline and the values of the path's parts; of several routes that with the fewest open parts."""
        asked, best = path.strip("/").split("/"), None
        for route, id in self.all().items():
            how, where = route.split(" ", 1)
            parts = where.strip("/").split("/")
            if how != method.upper() or len(parts) != len(asked):
                continue
            values = {p[1:-1]: a for p, a in zip(parts, asked) if p[:1] == "{" and p[-1:] == "}"}
            if all(p == a or p[1:-1] in values and p[:1] == "{" for p, a in zip(parts, asked)) and (best is None or len(values) < len(best[1])):
                best = id, values
        return best


class Runs:
    """What is known of runs, by id, for a time: get() of one that is over it gives nothing, and purge() deletes such."""

    def __init__(self, folder: str | Path, lifetime: float = LIFETIME) -> None:
        self.folder, self.lifetime = Path(folder), lifetime

    def _path(self, id: str, name: str = "run") -> Path:
        return self.folder / Path(id).name / f"{name}.json"

    def put(self, id: str, value: Any, name: str = "run") -> None:
        put(self._path(id, name), {"until": time.time() + self.lifetime, "value": value})

    def get(self, id: str, name: str = "run") -> Any:
        told = get(self._path(id, name))
        return told["value"] if told and told["until"] > time.time() else None

    def ids(self) -> list[str]:
        return sorted(p.name for p in self.folder.iterdir() if self.get(p.name) is not None) if self.folder.is_dir() else []

    def purge(self) -> int:
        """How many runs went."""
        gone = [p for p in self.folder.iterdir() if p.is_dir() and self.get(p.name) is None] if self.folder.is_dir() else []
        for p in gone:
            shutil.rmtree(p, ignore_errors=True)
        return len(gone)
