"""Parameters of the detectors; values outside their bounds raise."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    def __post_init__(self):
        for f in fields(self):
            low, high = f.metadata.get("bounds", (None, None))
            value = getattr(self, f.name)
            if low is not None and not low <= value <= high:
                raise ValueError(f"{f.name} must lie between {low} and {high}, not {value}")


def _field(default, low, high):
    from dataclasses import field

    return field(default=default, metadata={"bounds": (low, high)})


@dataclass(frozen=True)
class ColumnParams(Params):
    min_overlap: int = _field(12, 8, 50)
    min_support: float = _field(0.98, 0.9, 1.0)
    cap: int = _field(200, 20, 500)


@dataclass(frozen=True)
class PairParams(Params):
    min_pairs: int = _field(8, 2, 100)
    min_support: float = _field(0.95, 0.5, 1.0)
    ratio_places: int = _field(4, 1, 8)
    max_offset: int = _field(80, 1, 500)
    cap: int = _field(50, 1, 500)
    min_width: int = _field(2, 2, 20)


@dataclass(frozen=True)
class CrossSheetParams(Params):
    min_overlap: int = _field(10, 5, 50)
    min_support_rate: float = _field(0.8, 0.5, 1.0)
    max_findings: int = _field(50, 10, 200)
    min_numeric_ratio: float = _field(0.5, 0.0, 1.0)


@dataclass(frozen=True)
class ImageParams(Params):
    hash_size: int = _field(8, 2, 8)
    max_distance: int = _field(8, 0, 32)
    max_candidates: int = _field(200, 1, 1000)
