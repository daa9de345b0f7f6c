"""Settings that live on the driver: retrieval knobs, chunk sizes, experiment files."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, fields, replace
from typing import Any

STRATEGIES = ("recursive", "section_aware", "semantic", "late", "medical", "medical_semantic")
RERANKING = ("none", "cross_encoder", "mmr", "both")


@dataclass(frozen=True)
class Retrieval:
    """Knobs of retrieval with their defaults."""

    search_mode: str = "rrf_hybrid"
    reranking_mode: str = "cross_encoder"
    enable_diversification: bool = True
    mmr_lambda: float = 0.75
    overfetch_multiplier: int = 4
    max_chunks_per_source_page: int = 2
    max_chunks_per_source: int = 3
    enable_hyde: bool = False
    hyde_max_length: int = 200

    def diversifies(self) -> bool:
        return self.enable_diversification and self.reranking_mode in ("mmr", "both")


def resolve_retrieval(overrides: dict[str, Any] | None = None) -> Retrieval:
    """Defaults under overrides: nulls and unknown names are passed over, values are clamped (PF22, PF25)."""
    known = {f.name for f in fields(Retrieval)}
    r = replace(Retrieval(), **{k: v for k, v in (overrides or {}).items() if k in known and v is not None})
    return replace(
        r,
        mmr_lambda=min(1.0, max(0.0, r.mmr_lambda)),
        overfetch_multiplier=max(1, r.overfetch_multiplier),
        max_chunks_per_source_page=max(1, r.max_chunks_per_source_page),
        max_chunks_per_source=max(1, r.max_chunks_per_source),
        hyde_max_length=min(500, max(50, r.hyde_max_length)),
        reranking_mode=r.reranking_mode if r.reranking_mode in RERANKING else Retrieval.reranking_mode,
    )


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 1024
    chunk_overlap: int = 128
    min_chunk_size: int = 100
    strategy: str = "recursive"


def check_chunking(c: Chunking, strict: bool = False) -> Chunking:
    """Values out of range are set back, or are an error if ``strict`` (PF23)."""
    bad = {}
    if not 64 <= c.chunk_size <= 8192:
        bad["chunk_size"] = Chunking.chunk_size
    if c.min_chunk_size < 10:
        bad["min_chunk_size"] = Chunking.min_chunk_size
    if not 0 <= c.chunk_overlap < c.chunk_size:
        bad["chunk_overlap"] = Chunking.chunk_overlap
    if c.strategy not in STRATEGIES:
        bad["strategy"] = Chunking.strategy
    if bad and strict:
        raise ValueError(f"out of range: {sorted(bad)}")
    return replace(c, **bad)


def scalar(text: str) -> Any:
    """A YAML scalar's value (SU19)."""
    t = text.strip()
    low = t.lower()
    if low in ("", "null", "none", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?", t):
        return float(t)
    if t[:1] == "[" and t[-1:] == "]":
        return [scalar(x) for x in t[1:-1].split(",") if x.strip()]
    return t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'" else t


def read_yaml(text: str) -> dict[str, Any]:
    """Nested mappings of scalars by indentation (SC21)."""
    root: dict[str, Any] = {}
    open_: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for raw in text.splitlines():
        line = re.sub(r"(?:^|\s)#.*$", "", raw).rstrip()
        if not line.strip() or ":" not in line:
            continue
        depth = len(line) - len(line.lstrip())
        name, _, value = line.strip().partition(":")
        while open_[-1][0] >= depth:
            open_.pop()
        if value.strip():
            open_[-1][1][name] = scalar(value)
        else:
            child: dict[str, Any] = {}
            open_[-1][1][name] = child
            open_.append((depth, child))
    return root


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Nested mappings, the second's values first."""
    both = base.keys() | over.keys()
    pick = lambda k: merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k))
    return {k: pick(k) for k in sorted(both)}


def config_hash(value: Any) -> str:
    """SU13."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def experiment_runs(config: dict[str, Any], variant: str | None = None) -> list[dict[str, Any]]:
    """The base, or each named variant over it, with the hash of its settings (CF8)."""
    base, variants = config.get("base", {}), config.get("variants", {})
    if variant is not None and variant not in variants:
        raise KeyError(variant)
    chosen = [variant] if variant else sorted(variants) or [None]
    made = [(v or "base", merge(base, variants.get(v) or {})) for v in chosen]
    return [{"name": n, "config": c, "hash": config_hash(c)} for n, c in made]


def needs_rebuild(policy: str, present: bool, stored_hash: str | None, wanted_hash: str) -> bool:
    """PF21."""
    if policy in ("always", "never"):
        return policy == "always"
    return not present or stored_hash != wanted_hash
