"""A pipeline of named steps, each a DataFrame written as Parquet, skipped while what it came from is unchanged.

Steps form a graph by what they say they come after and by the step outputs they use. Plans are
static, so steps that only the data can name (a profile per label, say) come from ``expand``, which is
called after its step has run.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Run = Callable[..., DataFrame]


@dataclass
class Step:
    """``run(spark, **inputs, **options)``; inputs are outputs of other steps, by parameter name."""

    id: str
    run: Run
    inputs: dict[str, str] = field(default_factory=dict)
    after: list[str] = field(default_factory=list)
    options: dict[str, object] = field(default_factory=dict)
    expand: Callable[[DataFrame], list["Step"]] | None = None

    def needs(self) -> list[str]:
        return [*self.after, *self.inputs.values()]


def order(steps: list[Step]) -> list[Step]:
    """Steps so that each comes after what it needs, otherwise as given; repeated ids, unknown names and cycles are errors."""
    by = {s.id: s for s in steps}
    if len(by) < len(steps):
        raise ValueError("two steps have one id")
    if unknown := {n for s in steps for n in s.needs()} - set(by):
        raise ValueError(f"no step is called {sorted(unknown)}")
    out: list[Step] = []
    left = list(steps)
    while left:
        done = {s.id for s in out}
        ready = next((s for s in left if set(s.needs()) <= done), None)
        if ready is None:
            raise ValueError(f"a cycle among {sorted(s.id for s in left)}")
        out.append(ready)
        left.remove(ready)
    return out


class Pipeline:
    """Runs steps under a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ran: list[str] = []
        self.log: list[dict] = []

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fresh(self, name: str) -> bool:
        p = self._path(f"{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def provenance(self, step: Step, made: dict[str, str]) -> str:
        """A hash of the step's code, options and the provenance of what it needs."""
        try:
            code = inspect.getsource(step.run)
        except (OSError, TypeError):
            code = repr(step.run)
        text = json.dumps([step.id, code, step.options, {n: made[n] for n in step.needs()}], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def run(self, steps: list[Step], force: bool = False) -> dict[str, DataFrame]:
        """Every step's output. A step's folder carries its provenance: one that is there is not made again."""
        outputs: dict[str, DataFrame] = {}
        made: dict[str, str] = {}
        todo = order(steps)
        while todo:
            step = todo.pop(0)
            made[step.id] = mark = self.provenance(step, made)
            name = f"{step.id}-{mark}"
            if force or not self._fresh(name):
                step.run(self.spark, **{k: outputs[v] for k, v in step.inputs.items()}, **step.options).write.mode("overwrite").parquet(f"{self.folder}/{name}")
                self.ran.append(step.id)
            self.log.append({"step": step.id, "provenance": mark, "ran": step.id in self.ran})
            outputs[step.id] = self.spark.read.parquet(f"{self.folder}/{name}")
            if step.expand:
                fresh = step.expand(outputs[step.id])
                known = [Step(i, lambda spark: None) for i in outputs]
                todo = [s for s in order([*known, *todo, *fresh]) if s.id not in outputs]
        return outputs


def evaluate(expression: str, frames: dict[str, DataFrame], variables: dict[str, object] | None = None) -> object:
    """A variable's value: ``count:name`` rows, ``dim:name`` components of its vectors, ``${other}``, or the text itself."""
    known = variables or {}
    kind, _, name = expression.partition(":")
    if kind == "count" and name in frames:
        return frames[name].count()
    if kind == "dim" and name in frames:
        df = frames[name]
        column = next(c for c, k in df.dtypes if k.startswith("array<"))
        row = df.where(f"{column} IS NOT NULL").select(column).first()
        return len(row[0]) if row else 0
    if expression.startswith("${") and expression.endswith("}"):
        return known[expression[2:-1]]
    return expression


def require(frames: dict[str, DataFrame], names: list[str], least: int = 1) -> None:
    """An error unless every named output is there with at least so many rows."""
    for n in names:
        if n not in frames or frames[n].limit(least).count() < least:
            raise ValueError(f"{n} has fewer than {least} rows, or is not there")
