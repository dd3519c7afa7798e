"""Memory curves of a model, and the memory that an input needs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fits(points: DataFrame) -> DataFrame:
    """curve, slope, intercept and r2 of the lines through points (curve, x, y)."""
    return points.groupBy("curve").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def needed(points: DataFrame, input_size: int, new_tokens: int, gate: float = 0.95) -> tuple[float, bool]:
    """GB that an input needs, and whether all fits reach the gate. Without cache a poor line gives way to a parabola."""
    lines = {r.curve: r for r in fits(points).collect()}  # one row a curve
    good, value = True, {}
    for curve, at in (("without cache", input_size), ("with cache", input_size + new_tokens), ("cache size", input_size + new_tokens)):
        line = lines[curve]
        r2, value[curve] = line.r2, line.slope * at + line.intercept
        if curve == "without cache" and r2 < gate:
            mine = points.filter(F.col("curve") == curve)
            powers = [F.sum(F.pow("x", F.lit(k))).alias(f"x{k}") for k in range(5)] + [F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"y{k}") for k in range(3)]
            s = mine.agg(*powers, F.var_pop("y").alias("v"), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
            c = np.linalg.solve([[s[f"x{i + j}"] for j in range(3)] for i in range(3)], [s[f"y{i}"] for i in range(3)])
            rest = s.yy - sum(c[i] * s[f"y{i}"] for i in range(3))
            r2, value[curve] = 1 - rest / (s.v * s.x0), float(c @ [1, at, at * at])
        good &= r2 >= gate
    return max(value["without cache"], value["cache size"] + value["with cache"]), bool(good)


def usable(devices: DataFrame, total: str = "total_gb", allocated: str = "allocated_gb", share: float = 0.9) -> DataFrame:
    """usable_gb of a group of equal devices: a share of the first one's memory without what the fullest one holds."""
    return devices.agg((share * F.min_by(total, "device") - F.max(allocated)).alias("usable_gb"))


def parameter_count(tensors: DataFrame, shape: str = "shape") -> DataFrame:
    """billions: parameters of a model in 10^9, from the shapes of its tensors."""
    size = F.aggregate(shape, F.lit(1).cast("bigint"), lambda n, x: n * x)
    return tensors.agg((F.sum(size) / F.lit(1e9)).alias("billions"))
