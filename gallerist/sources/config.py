"""Settings from a TOML file: every section and key may be missing, a malformed file is an error."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass

from gallerist.functions.kernels import BlurConfig as _Blur
from gallerist.operators.duplicates import DedupeConfig

from .listing import EXTENSIONS


@dataclass(frozen=True)
class IngestConfig:
    extensions: tuple[str, ...] = EXTENSIONS
    follow_symlinks: bool = False
    preview_max_long_edge: int = 2048
    preview_quality: int = 85


@dataclass(frozen=True)
class BlurConfig(_Blur):
    iqa_second_opinion: bool = True
    min_samples_for_bucket: int = 30


@dataclass(frozen=True)
class ExposureConfig:
    clipped_highlights_threshold: float = 0.05
    clipped_shadows_threshold: float = 0.10


@dataclass(frozen=True)
class DefectConfig:
    blur: BlurConfig = field(default_factory=BlurConfig)
    exposure: ExposureConfig = field(default_factory=ExposureConfig)


@dataclass(frozen=True)
class LookConfig:
    enable: bool = False
    guard_iqa: bool = True
    guard_margin: float = 0.02


@dataclass(frozen=True)
class DevelopConfig:
    finished_dir: str = "<library>/_finished"
    jpeg_quality: int = 92
    output_subdirs: str = "month"
    look: LookConfig = field(default_factory=LookConfig)


@dataclass(frozen=True)
class Config:
    ingest: IngestConfig = field(default_factory=IngestConfig)
    defect: DefectConfig = field(default_factory=DefectConfig)
    dedupe: DedupeConfig = field(default_factory=DedupeConfig)
    develop: DevelopConfig = field(default_factory=DevelopConfig)


def _fill(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    default = kind()
    given = {}
    for name, value in values.items():
        if name in known:
            inner = getattr(default, name)
            given[name] = _fill(type(inner), value) if is_dataclass(inner) else tuple(value) if isinstance(value, list) else value
    return kind(**given)


def load(path: str) -> Config:
    """The settings of a file; the defaults if it isn't there."""
    path = os.path.expanduser(path)
    if not os.path.exists(path):
        return Config()
    with open(path, "rb") as f:
        return _fill(Config, tomllib.load(f))


def substitute_library(template: str, root: str) -> str:
    return template.replace("<library>", root)
