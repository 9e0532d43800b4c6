"""The time model and its prices as SQL functions, so that a plan can be written in SQL alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name(arguments) -> type, and the expression it stands for; later ones may use earlier ones
FUNCTIONS = {
    "model_terms(cores DOUBLE, machine DOUBLE, fraction DOUBLE) RETURNS ARRAY<DOUBLE>":
        "array(1D, fraction / cores, 1D / cores, machine, ln(machine), machine * machine)",
    "design_terms(cores DOUBLE, machine DOUBLE, fraction DOUBLE) RETURNS ARRAY<DOUBLE>":
        "array(1D, fraction / cores, sqrt(fraction) / cores, machine, ln(machine), machine * machine)",
    "model_dot(coef ARRAY<DOUBLE>, terms ARRAY<DOUBLE>) RETURNS DOUBLE":
        "get(coef, 0) * get(terms, 0) + get(coef, 1) * get(terms, 1) + get(coef, 2) * get(terms, 2)"
        " + get(coef, 3) * get(terms, 3) + get(coef, 4) * get(terms, 4) + get(coef, 5) * get(terms, 5)",
    "predicted_time(coef ARRAY<DOUBLE>, cores DOUBLE, machine DOUBLE, fraction DOUBLE) RETURNS DOUBLE":
        "model_dot(coef, model_terms(cores, machine, fraction))",
    "run_price(seconds DOUBLE, machine DOUBLE, hourly_price DOUBLE) RETURNS DOUBLE":
        "seconds / 3600 * machine * hourly_price",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session and give their names; they are expressions, inlined by the optimizer."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.partition("(")[0] for signature in FUNCTIONS]
