"""A registry of stages over DataFrames: layers of a run, resume from stored stages, a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Plan:
    """Stages in dependency order.  Each result is a Parquet table below ``path``, so a run can resume."""

    path: str
    stages: dict[str, Stage] = field(default_factory=dict)
    listeners: list[Callable[[str, str, float], None]] = field(default_factory=list)
    report: list[dict] = field(default_factory=list)

    def stage(self, name: str, needs: tuple[str, ...] = ()) -> Callable:
        def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.stages:
                raise ValueError(f"stage {name} is there already")
            self.stages[name] = Stage(name, run, needs)
            return run

        return add

    def layers(self) -> list[list[str]]:
        """Stages that can run side by side, layer by layer; a cycle or an unknown need is an error."""
        left, done, out = dict(self.stages), set(), []
        for s in left.values():
            for n in s.needs:
                if n not in self.stages:
                    raise ValueError(f"{s.name} needs {n}, which is no stage")
        while left:
            ready = sorted(n for n, s in left.items() if set(s.needs) <= done)
            if not ready:
                raise ValueError(f"a cycle among {', '.join(sorted(left))}")
            out.append(ready)
            done.update(ready)
            for n in ready:
                del left[n]
        return out

    def execute(self, spark: SparkSession, resume: bool = True) -> dict[str, DataFrame]:
        results: dict[str, DataFrame] = {}
        for names in self.layers():
            for name in names:
                began, state, target = time.time(), "stored", f"{self.path}/{name}"
                if not (resume and _stored(spark, target)):
                    state = "run"
                    stage = self.stages[name]
                    stage.run(spark, *[results[n] for n in stage.needs]).write.mode("overwrite").parquet(target)
                results[name] = spark.read.parquet(target)
                took = time.time() - began
                self.report.append({"stage": name, "state": state, "seconds": round(took, 3)})
                for listen in self.listeners:
                    listen(name, state, took)
        return results

    def mermaid(self) -> str:
        return "\n".join(["graph LR", *[f"  {n} --> {s.name}" for s in self.stages.values() for n in s.needs]])


def _stored(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
