"""The two feature maps over (cores, machines, input fraction), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODEL_TERMS = ["z0", "z1", "z2", "z3", "z4", "z5"]
DESIGN_TERMS = ["x0", "x1", "x2", "x3", "x4", "x5"]


def _machine_terms(machine: Column) -> list[Column]:
    machine = machine.cast("double")
    return [machine, F.ln(machine), machine * machine]


def model_terms(cores: Column, machine: Column, fraction: Column) -> dict[str, Column]:
    """Intercept, fraction per core, one over cores, and three machine terms."""
    cores = cores.cast("double")
    columns = [F.lit(1.0), fraction / cores, F.lit(1.0) / cores, *_machine_terms(machine)]
    return dict(zip(MODEL_TERMS, columns))


def design_terms(cores: Column, machine: Column, fraction: Column) -> dict[str, Column]:
    """As ``model_terms`` with the root of the fraction per core in third place."""
    cores = cores.cast("double")
    columns = [F.lit(1.0), fraction / cores, F.sqrt(fraction) / cores, *_machine_terms(machine)]
    return dict(zip(DESIGN_TERMS, columns))


def terms(kind: str, cores: Column, machine: Column, fraction: Column) -> dict[str, Column]:
    """``kind`` is "model" or "design"; both come back under the model's column names."""
    if kind == "model":
        return model_terms(cores, machine, fraction)
    if kind == "design":
        return dict(zip(MODEL_TERMS, design_terms(cores, machine, fraction).values()))
    raise ValueError(f"unknown feature map: {kind}")
