"""Settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from marginalia.errors import ConfigError


@dataclass(frozen=True)
class SearchConfig:
    semantic_weight: float = 0.6
    keyword_weight: float = 0.4
    semantic_limit: int = 100
    keyword_limit: int = 100
    final_limit: int = 20
    min_score: float = 0.05
    normalize: bool = True
    #: BM25 parameters.
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class RunConfig:
    """Where notes lie and results go, and how runs behave."""

    roots: str = ""
    sink: str = ""
    glob: str = "*.md"
    most_bytes: int = 50 * 1024 * 1024
    attempts: int = 5
    poll_seconds: int = 1200


def from_environment(kind: type, environment: dict[str, str] | None = None, **given):
    """Settings of a kind: given ones, else those of MARGINALIA_<NAME> in the environment, else the defaults. A value of a wrong form is an error."""
    env = os.environ if environment is None else environment
    found = {}
    for f in fields(kind):
        raw = env.get(f"MARGINALIA_{f.name.upper()}")
        if raw is None:
            continue
        try:
            found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else type(f.default)(raw)
        except ValueError as e:
            raise ConfigError(f"MARGINALIA_{f.name.upper()}={raw!r}") from e
    return replace(kind(), **{**found, **given})
