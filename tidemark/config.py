"""Settings: defaults, project file, explicit file, keywords, in that order."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .registry import LAYERS, SEVERITIES

PROFILES = {"ci": 0.60, "notebook": 0.30, "research": 0.0}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class DataConfig:
    text_threshold: float = 0.8
    numeric_distance: float = 0.05
    hash_distance: int = 4
    imbalance_ratio: float = 0.9
    target_score: float = 0.98
    mi_floor: float = 0.2
    mi_ratio: float = 1.5
    max_examples: int = 10
    sample_cap: int = 200_000
    folds: int = 5
    hash_include: tuple[str, ...] = ()
    hash_exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    select: tuple[str, ...] = ("ALL",)
    ignore: tuple[str, ...] = ()
    fail_on: str = "high"
    min_confidence: float | None = None
    gate_confidence: float = 0.75
    profile: str = "ci"
    exclude: tuple[str, ...] = ("tests/", "examples/", ".venv/", "build/", "dist/")
    layers: tuple[str, ...] = LAYERS
    severity: dict[str, str] = field(default_factory=dict)
    allow_partial: bool = False
    data: DataConfig = field(default_factory=DataConfig)

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ConfigError(f"no profile {self.profile!r}")
        if self.min_confidence is None:
            object.__setattr__(self, "min_confidence", PROFILES[self.profile])
        d = self.data
        for name, ok in (
            ("fail_on", self.fail_on in SEVERITIES),
            ("min_confidence", 0 <= self.min_confidence <= 1),
            ("gate_confidence", 0 <= self.gate_confidence <= 1),
            ("layers", set(self.layers) <= set(LAYERS)),
            ("severity", set(self.severity.values()) <= set(SEVERITIES)),
            ("data.text_threshold", 0 < d.text_threshold <= 1),
            ("data.numeric_distance", d.numeric_distance > 0),
            ("data.hash_distance", 0 <= d.hash_distance <= 64),
            ("data.imbalance_ratio", 0 < d.imbalance_ratio <= 1),
            ("data.target_score", 0 <= d.target_score <= 1),
            ("data.mi_ratio", d.mi_ratio >= 1),
            ("data.folds", d.folds >= 2),
            ("data.sample_cap", d.sample_cap > 0),
            ("data.max_examples", d.max_examples >= 0),
        ):
            if not ok:
                raise ConfigError(f"bad value of {name}")


def _merge(base: Config, raw: dict, where: str) -> Config:
    names = {f.name: f for f in fields(Config)}
    values = {}
    for k, v in raw.items():
        k = k.replace("-", "_")
        if k not in names:
            raise ConfigError(f"{where}: unknown key {k}")
        if k == "data":
            known = {f.name for f in fields(DataConfig)}
            if bad := {x.replace("-", "_") for x in v} - known:
                raise ConfigError(f"{where}: unknown key data.{sorted(bad)[0]}")
            v = replace(base.data, **{x.replace("-", "_"): tuple(y) if isinstance(y, list) else y for x, y in v.items()})
        values[k] = tuple(v) if isinstance(v, list) else v
    if "profile" in values and "min_confidence" not in values:
        values["min_confidence"] = None
    try:
        return replace(base, **values)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def load(root: str | Path = ".", file: str | Path | None = None, **overrides) -> Config:
    out = Config()
    for path, pick in ((Path(root) / "pyproject.toml", lambda d: d.get("tool", {}).get("tidemark", {})), (Path(root) / "tidemark.toml", dict), (Path(file) if file else None, dict)):
        if path is None or not path.exists():
            if file and path == Path(file):
                raise ConfigError(f"{path} is missing")
            continue
        try:
            out = _merge(out, pick(tomllib.loads(path.read_text())), str(path))
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e
    return _merge(out, {k: v for k, v in overrides.items() if v is not None}, "call")
