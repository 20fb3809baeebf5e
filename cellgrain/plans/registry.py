"""Custom metrics: named functions from a table and a metric to a result frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cellgrain.operators.stats import Metric

Compute = Callable[[DataFrame, Metric, float | None], DataFrame]


@dataclass(frozen=True)
class MetricDef:
    id: str
    compute: Compute
    label: str = ""
    description: str = ""


@dataclass
class MetricRegistry:
    """Holds metric definitions by id; an unknown id can be made on first use."""

    _defs: dict[str, MetricDef] = field(default_factory=dict)

    def register(self, definition: MetricDef) -> None:
        self._defs[definition.id] = definition

    def get_or_create(self, metric_id: str, factory: Callable[[str], Compute]) -> MetricDef:
        if metric_id not in self._defs:
            self._defs[metric_id] = MetricDef(metric_id, factory(metric_id), metric_id)
        return self._defs[metric_id]

    def ids(self) -> list[str]:
        return list(self._defs)

    def compute(self, df: DataFrame, metric: Metric, user_value: float | None = None) -> DataFrame:
        return self._defs[metric.name].compute(df, metric, user_value)
