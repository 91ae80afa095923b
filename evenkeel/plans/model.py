"""What a corpus of repeated runs consists of: its key columns, its metrics and its levels."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MetricSpec:
    """A metric's value column and the flag that says on which runs it counts."""

    name: str
    value: str
    eligible: str
    unit: str = ""


@dataclass(frozen=True)
class CorpusSpec:
    cfg: tuple[str, ...]
    batch: str
    run: str
    time: str
    run_id: str
    metrics: tuple[MetricSpec, ...] = ()


METRICS = (
    MetricSpec("tps", "tps", "tps_point_valid", "1/s"),
    MetricSpec("latency", "latency", "latency_valid", "d"),
    MetricSpec("energy", "energy", "energy_valid_positive", "kWh"),
)
RUNS = CorpusSpec(("chain", "topology", "workload", "size"), "batch", "run", "ts", "run_id", METRICS)
