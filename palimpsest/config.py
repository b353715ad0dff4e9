"""Constants of the engine. All are defaults of parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

MISSING, UNKNOWN, NULL, EMPTY, TRUNCATED = "[MISSING]", "[UNKNOWN]", "[NULL]", "[EMPTY]", "...[TRUNCATED]"
DAY = 86_400_000_000  # microseconds


@dataclass(frozen=True)
class Timeline:
    """Observation window and what is replayed."""

    window_start: str = "2024-01-01T00:00:00+00:00"
    window_end: str = "2026-09-14T23:59:59+00:00"
    detail_types: tuple[str, ...] = ("CVSS V2", "CVSS V3", "CVSS V3.1", "CVSS V4.0")
    strict_events: tuple[str, ...] = ("CVE Modified", "Modified Analysis", "Reanalysis")
    administrative_events: tuple[str, ...] = (
        "Data Remediation",
        "CPE Deprecation Remap",
        "Initial Analysis",
        "CVE Translated",
        "CVE CISA KEV Update",
        "CVE Source Update",
    )
    aliases: dict[str, str] = field(default_factory=lambda: {"nvd@nist.gov": "NVD"})
    infer_first_removal: bool = True
    main_types: tuple[str, ...] = ("STRICT_SAME_CHANGE",)


@dataclass(frozen=True)
class Splits:
    train_years: tuple[int, ...] = (2024, 2025)
    test_years: tuple[int, ...] = (2026,)
    dev_fraction: float = 0.15
    seed: int = 20260915


@dataclass(frozen=True)
class Queries:
    seed: int = 20260916
    offset_days: int = 30
    fraction: float = 0.5
    min_seconds: int = 2
    forbidden: tuple[str, ...] = ("outdated", "superseded", "former", "previous", "replaced", "current", "stale")
    templates: tuple[str, ...] = ("base_severity", "base_vector", "combined", "cvssb_score")


@dataclass(frozen=True)
class Retrieval:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    top_k: int = 50
    dense_top_k: int = 100
    tie_seed: int = 20260918
    rrf_k: int = 60
    pool: int = 50


@dataclass(frozen=True)
class Statistics:
    replicates: int = 10_000
    seed: int = 20260924
    level: float = 0.95
    alpha: float = 0.05
    capacity: int = 10
    tolerance: float = 1e-12


def instant(value: str | datetime) -> str:
    """A configured time in UTC; one without a time zone is an error."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    if at.tzinfo is None:
        raise ValueError(f"a configured time needs a time zone: {value}")
    return at.astimezone(timezone.utc).isoformat()


def read(path: str | Path) -> dict[str, Any]:
    """A configuration file: JSON by its name, else YAML. An empty one has no settings."""
    given = Path(path).read_text(encoding="utf-8-sig")
    if str(path).endswith(".json"):
        return json.loads(given) or {}
    import yaml

    return yaml.safe_load(given) or {}


def load(kind: type, path: str | Path, section: str | None = None):
    """One of the classes above from a file or a section of it; what isn't given keeps its default, an unknown name is an error."""
    given = read(path)
    given = given if section is None else given[section]
    if unknown := sorted(set(given) - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown settings of {kind.__name__}: {unknown}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load_timeline(path: str | Path, aliases: str | Path | None = None) -> Timeline:
    """The timeline's settings from its file and that of the source aliases. The names of the settings in both."""
    given, names = read(path), read(aliases).get("aliases") or [] if aliases else None
    own = {
        "window_start": instant(given["observation_window"]["start"]),
        "window_end": instant(given["observation_window"]["end"]),
        "detail_types": tuple(given["timeline"]["supported_detail_types"]),
        "main_types": tuple(given["timeline"]["main_replacement_types"]),
    }
    if names is not None:
        own["aliases"] = {a["raw_identifier"]: a["normalized_source_key"] for a in names}
    return Timeline(**own)
