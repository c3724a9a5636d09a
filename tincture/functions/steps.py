"""Which refinement steps an evaluation uses, chosen from the log of largest q-errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strictly_descending(log: DataFrame) -> DataFrame:
    """The first row and each whose max_q_error is below all before it. A log has one row for each step of one run."""
    before = F.min("max_q_error").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_before", before).where("_before is null or max_q_error < _before").drop("_before")


def _ordered(log: DataFrame) -> DataFrame:
    """One row: the log as a sorted array, with the error of step 0."""
    rows = F.array_sort(F.collect_list(F.struct("step", "max_q_error")))
    return log.agg(rows.alias("rows"), F.max(F.when(F.col("step") == 0, F.col("max_q_error"))).alias("base"))


def _fold(ratio: float, allow_repeat: Column | bool) -> Column:
    """Walk the rows; where the error is at most the threshold take the step, and lower the threshold by the ratio once."""
    start = F.struct((F.col("base") * ratio).alias("threshold"), F.array(F.lit(0)).cast("array<int>").alias("anchors"))

    def walk(acc, row):
        new = (row["max_q_error"] <= acc["threshold"]) & (F.lit(allow_repeat) | (row["step"] != F.element_at(acc["anchors"], -1)))
        return F.when(new, F.struct((acc["threshold"] * ratio).alias("threshold"), F.array_append(acc["anchors"], row["step"].cast("int")).alias("anchors"))).otherwise(acc)

    return F.aggregate("rows", start, walk)["anchors"]


def anchors_by_ratio(log: DataFrame, ratio: float = 0.5, allow_duplicate_steps: bool = False) -> DataFrame:
    """(param, steps): step 0, then each step of the descending log that falls to the next power of ``ratio``; parameter i has the
    first i + 1 anchors. The last anchor is repeated only where duplicates are allowed."""
    return _prefixes(_ordered(strictly_descending(log)).select(_fold(ratio, allow_duplicate_steps).alias("anchors"), "rows"), False)


def anchors_by_halving(log: DataFrame, descending: bool = True, include_inbetween_steps: bool = False) -> DataFrame:
    """As ``anchors_by_ratio`` at one half, with duplicates; with ``include_inbetween_steps`` parameter i has the first i + 1 rows
    of the log (rows, not the rows up to an anchor)."""
    rows = strictly_descending(log) if descending else log
    return _prefixes(_ordered(rows).select(_fold(0.5, True).alias("anchors"), "rows"), include_inbetween_steps)


def _prefixes(anchored: DataFrame, rows: bool) -> DataFrame:
    source = F.transform("rows", lambda r: r["step"].cast("int")) if rows else F.col("anchors")
    return anchored.select(F.explode(F.sequence(F.lit(0), F.size("anchors") - 1)).alias("param"), source.alias("s")).select("param", F.slice("s", 1, F.col("param") + 1).alias("steps"))


def steps_by_position(log: DataFrame, grid: list[int], descending: bool = False) -> DataFrame:
    """(param, steps): for each i of the grid that is a row of the log, the steps of its first i + 1 rows."""
    rows = strictly_descending(log) if descending else log
    wanted = F.filter(F.array(*[F.lit(i) for i in grid]), lambda i: i < F.size("rows"))
    return _ordered(rows).select(F.explode(wanted).alias("param"), "rows").select("param", F.transform(F.slice("rows", 1, F.col("param") + 1), lambda r: r["step"].cast("int")).alias("steps"))


_KINDS: dict[str, tuple[dict[str, type], Callable]] = {
    "q_ratio": ({"q_ratio": float, "allow_duplicate_steps": bool}, lambda log, p: anchors_by_ratio(log, p["q_ratio"], p["allow_duplicate_steps"])),
    "h_grid": ({"h_grid": list, "q_strictly_descending": bool}, lambda log, p: steps_by_position(log, p["h_grid"], p["q_strictly_descending"])),
}


@dataclass
class StepSettings:
    """A checked choice of steps: ``q_ratio`` or ``h_grid`` with that method's parameters."""

    method: str
    method_params: dict[str, Any]

    def __post_init__(self):
        if self.method not in _KINDS:
            raise ValueError(f"no such method: {self.method}")
        for name, kind in _KINDS[self.method][0].items():
            if name not in self.method_params:
                raise ValueError(f"{self.method} needs {name}")
            value = self.method_params[name]
            if not isinstance(value, kind) or kind is list and not all(isinstance(i, int) for i in value):
                raise TypeError(f"{name} of {self.method} must be {'a list of int' if kind is list else kind.__name__}")

    def steps(self, log: DataFrame) -> list[tuple[int, list[int]]]:
        return [(r["param"], list(r["steps"])) for r in _KINDS[self.method][1](log, self.method_params).orderBy("param").collect()]

    def to_dirname(self) -> str:
        p = self.method_params
        if self.method == "q_ratio":
            return f"q_ratio__{p['q_ratio']}__{'with' if p['allow_duplicate_steps'] else 'no'}_duplicates"
        return f"h_grid__{'-'.join(map(str, p['h_grid']))}__{'desc' if p['q_strictly_descending'] else 'no_desc'}"


@dataclass
class QscEvaluationParameters:
    """The older settings: anchors by halving (``q_half``) or positions (``h_grid``), and whether steps between anchors count too."""

    method: str
    q_strictly_descending: bool = True
    include_inbetween_steps: bool = False
    h_grid: list[int] | None = None

    def __post_init__(self):
        if self.method not in ("q_half", "h_grid"):
            raise ValueError(f"no such method: {self.method}")
        if self.method == "h_grid" and self.h_grid is None:
            raise ValueError("h_grid needs a grid")

    def steps(self, log: DataFrame) -> list[tuple[int, list[int]]]:
        chosen = anchors_by_halving(log, self.q_strictly_descending, self.include_inbetween_steps) if self.method == "q_half" else steps_by_position(log, self.h_grid, self.q_strictly_descending)
        return [(r["param"], list(r["steps"])) for r in chosen.orderBy("param").collect()]

    def to_dirname(self, log: DataFrame) -> str:
        """The method, the parameters that the log has steps for, and both switches."""
        params = "-".join(str(p) for p, _ in self.steps(log))
        return f"{self.method}__{params}__{'with' if self.include_inbetween_steps else 'without'}_inbetween__{'with' if self.q_strictly_descending else 'without'}_desc"
