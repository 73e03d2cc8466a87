"""Runs of jobs: one at a time, each running, then completed or failed, with its result as JSON."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "id string, run_type string, status string, started_at string, finished_at string, result string, error string"


class AlreadyRunning(RuntimeError):
    """Another run has not ended."""


@dataclass(frozen=True)
class Run:
    id: str
    run_type: str
    status: str
    started_at: str
    finished_at: str | None = None
    result: str | None = None
    error: str | None = None


def _now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


class Runs:
    """Keeps runs on the driver; ``table`` shows them as a DataFrame."""

    def __init__(self, background: bool = True):
        self._runs: dict[str, Run] = {}
        self._lock, self._background = threading.Lock(), background

    def start(self, run_type: str, job: Callable[[], dict]) -> Run:
        with self._lock:
            if any(r.status == "running" for r in self._runs.values()):
                raise AlreadyRunning(run_type)
            run = self._runs.setdefault(key := str(uuid.uuid4()), Run(key, run_type, "running", _now()))
        if self._background:
            threading.Thread(target=self._execute, args=(run.id, job), daemon=True).start()
        else:
            self._execute(run.id, job)
        return self._runs[run.id]

    def _execute(self, key: str, job: Callable[[], dict]) -> None:
        try:
            end = {"status": "completed", "result": json.dumps(job(), ensure_ascii=False)}
        except Exception as e:  # a failed job is a result, told by the run
            end = {"status": "failed", "error": str(e)}
        with self._lock:
            self._runs[key] = replace(self._runs[key], finished_at=_now(), **end)

    def get(self, key: str) -> Run | None:
        return self._runs.get(key)

    def latest(self) -> Run | None:
        return next(reversed(self._runs.values()), None)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(r).values()) for r in self._runs.values()], COLUMNS)
