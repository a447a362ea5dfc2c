"""Settings from the environment, with defaults; a value out of range is an error that names it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from siltstone.functions.constants import DEFAULT_DELAY_MS, POST_LIMIT


@dataclass(frozen=True)
class Settings:
    """SILTSTONE_<NAME>: the crawler's name for robots.txt, posts a site, its pause, and a local session's size."""

    robots_agent: str = "siltstone"
    post_limit: int = POST_LIMIT
    delay_ms: int = DEFAULT_DELAY_MS
    shuffle_partitions: int = 8
    driver_memory: str = "8g"
    log_level: str = "WARN"


_LEAST = {"post_limit": 1, "delay_ms": 0, "shuffle_partitions": 1}
_LEVELS = ("ALL", "DEBUG", "ERROR", "FATAL", "INFO", "OFF", "TRACE", "WARN")


def load(source: Mapping[str, str] | None = None) -> Settings:
    """The settings of an environment; ValueError names every value that isn't valid."""
    source, found, bad = os.environ if source is None else source, {}, []
    for field in fields(Settings):
        raw = source.get(f"SILTSTONE_{field.name.upper()}")
        if raw is None:
            continue
        value = int(raw) if field.type == "int" and raw.lstrip("-").isdigit() else raw.strip()
        fine = (isinstance(value, int) and value >= _LEAST[field.name]) if field.type == "int" else bool(value) and (field.name != "log_level" or value in _LEVELS)
        found[field.name] = value
        if not fine:
            bad.append(field.name)
    if bad:
        raise ValueError("invalid settings: " + ", ".join(bad))
    return Settings(**found)
