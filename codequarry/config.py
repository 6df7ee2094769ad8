"""Settings as frozen dataclasses, read from and written to YAML (or JSON) on the driver."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.operators.search import BOOST_RULES, DEFAULT_LIMIT, FUSION_K

try:
    import yaml
except ImportError:  # JSON is a subset of YAML, so files without it stay readable
    yaml = None


@dataclass(frozen=True)
class Embedding:
    provider: str = "hashing"
    model: str = ""
    endpoint: str = ""
    dimensions: int = 64


@dataclass(frozen=True)
class Chunking:
    size: int = 512
    overlap: int = 50


@dataclass(frozen=True)
class Search:
    hybrid: bool = False
    k: int = FUSION_K
    limit: int = DEFAULT_LIMIT
    dedup: bool = True
    rules: tuple = BOOST_RULES


@dataclass(frozen=True)
class Repository:
    name: str
    path: str
    role: str = "library"


@dataclass(frozen=True)
class Config:
    ignore: tuple[str, ...] = ("node_modules", ".git", "vendor", "dist", "build")
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)
    repositories: tuple[Repository, ...] = ()

    def add(self, repo: Repository) -> Config:
        """With one more repository; a name or path in use is an error."""
        if any(r.name == repo.name or r.path == repo.path for r in self.repositories):
            raise ValueError(f"{repo.name} or its path is registered already")
        return dataclasses.replace(self, repositories=(*self.repositories, repo))

    def remove(self, name: str) -> Config:
        rest = tuple(r for r in self.repositories if r.name != name)
        if len(rest) == len(self.repositories):
            raise LookupError(name)
        return dataclasses.replace(self, repositories=rest)

    def compatible(self, other: Config) -> bool:
        """Whether vectors of both can be compared."""
        a, b = self.embedding, other.embedding
        return (a.provider, a.model, a.dimensions) == (b.provider, b.model, b.dimensions)


def same_vectors(a: str, b: str) -> Column:
    """The same of two rows with columns ``provider, model, dimensions`` under these prefixes."""
    out = F.lit(True)
    for c in ("provider", "model", "dimensions"):
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _make(cls, values: dict):
    known = {f.name: f for f in dataclasses.fields(cls)}
    out = {}
    for k, v in (values or {}).items():
        if k not in known or v is None:
            continue
        sub = {"embedding": Embedding, "chunking": Chunking, "search": Search}.get(k) if cls is Config else None
        if sub:
            v = _make(sub, v)
        elif k == "repositories":
            v = tuple(_make(Repository, r) for r in v)
        elif k == "rules":
            v = tuple((r[0], float(r[1])) for r in v)
        elif isinstance(v, list):
            v = tuple(v)
        out[k] = v
    return cls(**out)


def load_config(path: str) -> Config:
    """Settings of a file, defaults filled in; a missing file gives the defaults."""
    p = Path(path)
    if not p.exists():
        return Config()
    text = p.read_text()
    return _make(Config, (yaml.safe_load(text) if yaml else json.loads(text)) or {})


def save_config(config: Config, path: str) -> None:
    data = json.loads(json.dumps(dataclasses.asdict(config)))
    Path(path).write_text(yaml.safe_dump(data, sort_keys=False) if yaml else json.dumps(data, indent=2))
