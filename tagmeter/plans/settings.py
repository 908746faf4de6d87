"""Settings: names, defaults, ranges and units."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions import dsl

_TIME = {"us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0}
_BYTES = {"B": 1, "kB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def seconds(value: str | int | float, unit: str = "s") -> float:
    """A duration such as ``5min``; a bare number is in *unit*."""
    if isinstance(value, (int, float)):
        return value * _TIME[unit]
    m = re.fullmatch(r"\s*([0-9.]+)\s*(us|ms|s|min|h|d)?\s*", value)
    if not m:
        raise ValueError(f"invalid duration: {value!r}")
    return float(m[1]) * _TIME[m[2] or unit]


def size_bytes(value: str | int, unit: str = "B") -> int:
    """A size such as ``2kB``; a bare number is in *unit*."""
    if isinstance(value, int):
        return value * _BYTES[unit]
    m = re.fullmatch(r"\s*([0-9]+)\s*(B|kB|MB|GB|TB)?\s*", value)
    if not m:
        raise ValueError(f"invalid size: {value!r}")
    return int(m[1]) * _BYTES[m[2] or unit]


#: Fixed values: (least, most) of each numeric setting.
RANGES = {
    "scan_window": (64, 1 << 20),
    "bucket_count": (1, 10_000),
    "bucket_interval": (1, 86_400),
    "max_entries": (100, 1_073_741_823),
    "max_tags": (1, 64),
    "max_tag_value_len": (1, 4096),
    "max_tagset_bytes": (128, 8192),
    "exemplar_memory": (0, (1 << 31) * 1024),
    "cardinality_cap": (0, 1_000_000),
    "cardinality_cap_slots": (256, 1 << 26),
    "reclaim_worker_interval": (0.1, 86_400),
}
CHOICES = {
    "track": ("none", "top", "all"),
    "nested_tags": ("inherit", "scan", "none"),
    "untagged": ("skip", "record"),
    "cardinality_cap_scope": ("role", "database", "server"),
}


@dataclass(frozen=True)
class Settings:
    """Durations in seconds, sizes in bytes; list settings as text."""

    enabled: bool = True
    track: str = "top"
    track_utility: bool = True
    nested_tags: str = "inherit"
    untagged: str = "skip"
    tags: str = "action, controller, job"
    exclude_tags: str = "traceparent, tracestate, request_id"
    scan_window: int = 2048
    extractors: str = "sqlcommenter, marginalia"
    normalize: str = ""
    save: bool = True
    reclaim_worker: bool = False
    reclaim_worker_interval: float = 10.0
    cardinality_cap: int = 0
    cardinality_cap_overrides: str = ""
    cardinality_cap_slots: int = 16384
    cardinality_cap_scope: str = "role"
    max_entries: int = 10_000
    bucket_count: int = 12
    bucket_interval: int = 300
    max_tags: int = 8
    max_tag_value_len: int = 64
    max_tagset_bytes: int = 512
    exemplar_keys: str = ""
    exemplar_memory: int = 2048 * 1024
    server_major: int = 18
    parsed: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} = {getattr(self, name)} is outside {low} .. {high}")
        for name, choices in CHOICES.items():
            if getattr(self, name) not in choices:
                raise ValueError(f"{name} must be one of {', '.join(choices)}")
        self.parsed.update(
            extractors=dsl.parse_extractors(self.extractors, self.max_tags),
            normalize=dsl.parse_normalize(self.normalize),
            tags=dsl.parse_tag_list(self.tags, star=True),
            exclude=dsl.parse_tag_list(self.exclude_tags),
            caps=dsl.parse_caps(self.cardinality_cap_overrides),
            exemplars=dsl.parse_tag_list(self.exemplar_keys, limit=8),
        )

    @classmethod
    def parse(cls, **values) -> Settings:
        """Settings from text values with units."""
        out = {}
        for name, value in values.items():
            if name in ("bucket_interval", "reclaim_worker_interval"):
                value = seconds(value, "ms" if name.startswith("reclaim") else "s")
                value = int(value) if name == "bucket_interval" else value
            elif name in ("scan_window", "max_tag_value_len", "max_tagset_bytes"):
                value = size_bytes(value)
            elif name == "exemplar_memory":
                value = size_bytes(value, "kB")
            out[name] = value
        return cls(**out)

    def but(self, **values) -> Settings:
        return replace(self, parsed={}, **values)

    @property
    def exemplar_value_bytes(self) -> int:
        from .sizing import exemplar_layout

        return exemplar_layout(self.max_entries, self.exemplar_memory, len(self.parsed["exemplars"]))[0]
