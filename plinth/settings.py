"""Parameters of corpus jobs: an immutable value, read from the environment once, clamped in smoke mode."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Fixed value: limits in smoke mode.
SMOKE_LIMIT = 40


@dataclass(frozen=True)
class Settings:
    grid: int = 1000
    max_json_chars: int = 100_000
    holdout: float = 0.03
    hash_holdout: float = 0.15
    negatives: float = 0.05
    sources: tuple[str, ...] = ("drawing", "raster", "scene", "config")
    limit: int | None = None
    rooms: bool = False
    fit_arcs: bool = False
    seed: int = 0
    smoke: bool = False

    @classmethod
    def of(cls, env: Mapping[str, str] | None = None, prefix: str = "PLINTH_") -> Settings:
        """From variables named after the fields; `none` is null, lists are comma-separated."""
        env = os.environ if env is None else env
        found = {f.name: _typed(env[prefix + f.name.upper()], getattr(cls, f.name)) for f in fields(cls) if prefix + f.name.upper() in env}
        made = cls(**found)
        return replace(made, limit=min(made.limit or SMOKE_LIMIT, SMOKE_LIMIT)) if made.smoke else made


def _typed(text: str, default):
    text = text.strip()
    if text.lower() == "none":
        return None
    if isinstance(default, bool):
        return text.lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return float(text) if isinstance(default, float) else int(text) if isinstance(default, int) or default is None else text
