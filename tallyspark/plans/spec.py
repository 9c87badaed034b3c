"""Metric spec: frozen dataclasses on the driver, compiled to DataFrame calls."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

GRAINS = ("day", "week", "month", "quarter")
SIMPLE_AGGS = ("count", "count_distinct", "sum", "avg", "min", "max", "percentile")


@dataclass(frozen=True)
class Measure:
    """Simple measure. ``agg`` in SIMPLE_AGGS, or an interval measure when
    ``from_field``/``to_field`` are set (agg: median, percentile, avg, min, max, sum)."""

    agg: str = "count"
    field: str | None = None
    percentile: float | None = None          # 0 < p < 100
    from_field: str | None = None
    to_field: str | None = None
    negative: str = "exclude"                # exclude | clamp_zero | allow
    approx: bool = False                     # opt-in approximate percentile/distinct

    def __post_init__(self):
        if self.is_interval:
            if self.agg not in ("median", "percentile", "avg", "min", "max", "sum"):
                raise ValueError(f"interval agg {self.agg!r}")
            if self.negative not in ("exclude", "clamp_zero", "allow"):
                raise ValueError(f"negative handling {self.negative!r}")
        elif self.agg not in SIMPLE_AGGS:
            raise ValueError(f"measure agg {self.agg!r}")
        if self.agg == "percentile" and not (self.percentile and 0 < self.percentile < 100):
            raise ValueError("percentile must be in (0, 100)")

    @property
    def is_interval(self) -> bool:
        return self.from_field is not None and self.to_field is not None

    @property
    def method(self) -> str:
        """Aggregation method after interval normalisation."""
        if self.agg == "median":
            return "percentile"
        return self.agg

    @property
    def pct(self) -> float | None:
        if self.agg == "median":
            return 50.0
        return self.percentile


@dataclass(frozen=True)
class Window:
    days: int
    step: str = "day"                        # day | week

    def __post_init__(self):
        if self.days < 1 or self.step not in ("day", "week"):
            raise ValueError("window needs days >= 1 and step day|week")

    @property
    def label(self) -> str:
        return f"rolling_{self.days}d"


@dataclass(frozen=True)
class MappedDim:
    """Virtual dimension ``name`` = mapping[from_field], else ``default``
    (``exclude`` drops unmapped rows)."""

    name: str
    from_field: str
    mapping: tuple[tuple[str, str], ...]
    default: str = "exclude"


@dataclass(frozen=True)
class Param:
    """Spec parameter bound to an extra filter ``field op value``."""

    name: str
    type: str                                # string | array<string> | integer | boolean
    field: str
    op: str
    default: Any = None
    has_default: bool = False


@dataclass(frozen=True)
class Metric:
    id: str
    entity: str | None = None
    time_field: str | None = None
    measure: Measure | None = None
    filters: tuple = ()
    grains: tuple[str, ...] = ("day",)
    windows: tuple[Window, ...] = ()
    dimensions: tuple[str, ...] = ()
    mapped: tuple[MappedDim, ...] = ()
    kind: str = "simple"                     # simple | ratio | formula
    numerator: "Metric | None" = None
    denominator: "Metric | None" = None
    numerator_filters: tuple = ()            # F17 per-operand overrides
    denominator_filters: tuple = ()
    zero_denominator: str = "null"           # null | zero
    inputs: tuple[tuple[str, "Metric"], ...] = ()
    expression: str | None = None
    params: tuple[Param, ...] = ()
    visibility: str = "team"                 # team | ic
    version: int = 1

    def __post_init__(self):
        for g in self.grains:
            if g not in GRAINS:
                raise ValueError(f"grain {g!r}")
        if self.kind == "simple" and (self.entity is None or self.measure is None or self.time_field is None):
            raise ValueError("simple metric needs entity, time_field and measure")
        if self.kind == "ratio" and (self.numerator is None or self.denominator is None):
            raise ValueError("ratio needs numerator and denominator")
        if self.kind == "formula" and (not self.inputs or not self.expression):
            raise ValueError("formula needs inputs and expression")
        if not self.grains and not self.windows:
            raise ValueError("metric needs a grain or a window")

    def with_(self, **kw) -> "Metric":
        return dataclasses.replace(self, **kw)


def _canon(obj):
    if dataclasses.is_dataclass(obj):
        return {f.name: _canon(getattr(obj, f.name)) for f in dataclasses.fields(obj)}
    if isinstance(obj, (list, tuple)):
        return [_canon(x) for x in obj]
    if isinstance(obj, dict):
        return {k: _canon(v) for k, v in sorted(obj.items())}
    return obj


def definition_version(metric: Metric) -> str:
    """Stable short hash of the canonical spec (same spec -> same version)."""
    blob = json.dumps(_canon(metric), sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(blob.encode()).hexdigest()[:12]


def bind_params(metric: Metric, values: dict | None) -> Metric:
    """Materialise declared params as filters (default when unset)."""
    values = dict(values or {})
    unknown = set(values) - {p.name for p in metric.params}
    if unknown:
        raise ValueError(f"unknown params {sorted(unknown)}")
    extra = []
    for p in metric.params:
        if p.name in values:
            v = values[p.name]
        elif p.has_default:
            v = p.default
        else:
            raise ValueError(f"param {p.name!r} has no value and no default")
        extra.append({"field": p.field, "op": p.op, "value": v})
    return metric.with_(filters=tuple(metric.filters) + tuple(extra), params=())
