"""Settings from properties files: where services are, and which lookups stand for remote label services."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path


def properties(text: str) -> dict[str, str]:
    """key=value or key:value lines; # and ! begin remarks, a backslash at the end continues a line."""
    out: dict[str, str] = {}
    for line in re.sub(r"\\\r?\n[ \t]*", "", text).splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        m = re.match(r"((?:\\.|[^=:\s\\])+)\s*[=:\s]\s*(.*)", line)
        if m:
            out[re.sub(r"\\(.)", r"\1", m[1])] = re.sub(r"\\(.)", r"\1", m[2])
    return out


@dataclass(frozen=True)
class Lookup:
    """A label service: IRIs that contain `contains` are looked up at `endpoint`."""

    name: str
    contains: str
    endpoint: str
    query: str
    placeholder: str

    def text(self, iri: str) -> str:
        """The service's query for an IRI; the IRI is data, so nothing in it is a pattern."""
        if re.search(r"[<>\"{}|^`\\\s]", iri):
            raise ValueError(f"not an IRI: {iri}")
        return self.query.replace(self.placeholder, iri)


@dataclass(frozen=True)
class Config:
    base_path: str
    lookups: tuple[Lookup, ...]


def load(folder: str, name: str = "config.properties") -> Config:
    """The main file names services (comma-separated) with a properties file each, and the base path."""
    main = properties((Path(folder) / name).read_text("utf-8"))
    found = []
    for s in filter(None, (x.strip() for x in main.get("services", "").split(","))):
        p = properties(within(folder, f"{s}.properties").read_text("utf-8"))
        found.append(Lookup(s, p.get("contains", ""), p.get("endpoint", ""), p.get("query", ""), p.get("placeholder", "{{uri}}")))
    return Config(main.get("basepathuri", ""), tuple(found))


def within(folder: str, name: str) -> Path:
    """The file of that name in the folder, and nowhere else."""
    root = Path(folder).resolve()
    path = (root / name).resolve()
    if path.parent != root:
        raise ValueError(f"not a file of {folder}: {name}")
    return path
