"""The measuring protocol: warm-ups, repetitions, validation of every one."""

from __future__ import annotations

import platform
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

WARMUPS = 3


def config_text(value: Any) -> str:
    """A setting as text: truth values in lower case, no value as the empty text, the rest as it prints."""
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


def experiment(spark: SparkSession, **settings: Any) -> dict[str, str]:
    """What was measured, for the record: the settings, and what it ran on."""
    context = spark.sparkContext
    ran = {"spark": spark.version, "python": platform.python_version(), "master": context.master, "cores": context.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    return {k: config_text(v) for k, v in (settings | ran).items()}


@dataclass
class Measurement:
    seconds: list[float]
    started: float

    @property
    def best(self) -> float:
        return min(self.seconds)

    @property
    def median(self) -> float:
        return statistics.median(self.seconds)

    @property
    def offsets(self) -> list[float]:
        """When each repetition had ended, in seconds from the first one's start."""
        total, out = 0.0, []
        for s in self.seconds:
            total += s
            out.append(total)
        return out

    def record(self) -> dict[str, Any]:
        return {"timestamp": self.started, "repetitions": len(self.seconds), "best_s": self.best, "median_s": self.median, "offsets_s": self.offsets}


def measure(run: Callable[[], Any], repetitions: int = 10, warmups: int = WARMUPS, validate: Callable[[Any], bool] | None = None) -> Measurement:
    """Times run(); a result that validate() refuses ends the measurement."""
    for _ in range(warmups):
        run()
    started, seconds = time.time(), []
    for _ in range(repetitions):
        begin = time.perf_counter()
        result = run()
        seconds.append(time.perf_counter() - begin)
        assert validate is None or validate(result), "the result is wrong"
    return Measurement(seconds, started)
