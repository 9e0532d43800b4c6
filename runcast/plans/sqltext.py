"""SQL fragments shared by the checking queries (standard SQL, run by another engine)."""

from __future__ import annotations

from collections.abc import Sequence

RUNS = """runs AS (
  SELECT l_orderkey, l_linenumber, workload, instance_type, machine, 2 * machine AS cores, fraction,
         CAST(5 AS DOUBLE) + 40 * fraction / (2 * machine) + CAST(0.3 AS DOUBLE) * machine
           + 2 * ln(machine) + l_discount AS time
  FROM (SELECT *, l_returnflag AS workload, CAST(l_linenumber % 3 AS INTEGER) AS instance_type,
               CAST(1 + l_suppkey % 16 AS DOUBLE) AS machine,
               CAST(1 + l_partkey % 64 AS DOUBLE) / 64 AS fraction
        FROM lineitem) t)"""

FEATURES = """features AS (
  SELECT *, CAST(1 AS DOUBLE) AS z0, fraction / cores AS z1, 1 / cores AS z2, machine AS z3,
         ln(machine) AS z4, machine * machine AS z5
  FROM runs)"""

PROBLEMS = """problems AS (
  SELECT p_partkey AS workload, 3 AS min_parts, 20 + p_size % 4 * 6 AS max_parts, 256 AS total_parts,
         1 AS min_machines, 6 + p_size % 5 AS max_machines, 2 AS cores_per_machine,
         CAST(5 + 5 * (p_size % 3) AS DOUBLE) AS budget, 16 AS steps
  FROM part)"""

CANDIDATES = PROBLEMS + """, grid AS (
  SELECT p.*, CAST(m.machine AS INTEGER) AS machine, s.step,
         CAST(min_parts AS DOUBLE) / total_parts
           + s.step * (CAST(max_parts AS DOUBLE) / total_parts - CAST(min_parts AS DOUBLE) / total_parts) / (steps - 1)
           AS fraction
  FROM problems p,
       LATERAL (SELECT unnest(range(min_machines, max_machines + 1)) AS machine) m,
       LATERAL (SELECT unnest(range(0, steps)) AS step) s),
candidates AS (
  SELECT *, fraction / (CAST(min_parts AS DOUBLE) / total_parts) / machine AS cost
  FROM grid WHERE round_even(fraction * total_parts, 0) >= cores_per_machine * machine),
design AS (
  SELECT *, CAST(1 AS DOUBLE) AS x0, fraction / (machine * cores_per_machine) AS x1,
         sqrt(fraction) / (machine * cores_per_machine) AS x2, CAST(machine AS DOUBLE) AS x3,
         ln(machine) AS x4, CAST(machine * machine AS DOUBLE) AS x5
  FROM candidates)"""


def pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def moment_sums(size: int = 6, prefix: str = "z") -> str:
    """Aggregates g_i_j and b_i over features prefix0.. and time."""
    grams = [f"sum({prefix}{i} * {prefix}{j}) AS g_{i}_{j}" for i, j in pairs(size)]
    return ", ".join(grams + [f"sum({prefix}{i} * time) AS b_{i}" for i in range(size)])


def elimination(source: str, keep: Sequence[str], size: int = 6, name: str = "s") -> str:
    """CTEs name0..name<size>: Gaussian elimination of a_i_j, b_i; the last one has c_0.., the solution,
    and p_0.., the pivots. ``source`` must offer a_i_j for all i, j and b_i."""
    kept = ", ".join(keep)
    entries = [f"a_{i}_{j}" for i in range(size) for j in range(size)] + [f"b_{i}" for i in range(size)]
    steps = [f"{name}0 AS (SELECT {kept}, {', '.join(entries)} FROM {source})"]
    for k in range(size - 1):
        columns = []
        for i in range(size):
            for j in range(size):
                changed = i > k and j >= k
                columns.append(f"a_{i}_{j} - a_{i}_{k} / nullif(a_{k}_{k}, 0) * a_{k}_{j} AS a_{i}_{j}"
                               if changed else f"a_{i}_{j}")
            columns.append(f"b_{i} - a_{i}_{k} / nullif(a_{k}_{k}, 0) * b_{k} AS b_{i}" if i > k else f"b_{i}")
        steps.append(f"{name}{k + 1} AS (SELECT {kept}, {', '.join(columns)} FROM {name}{k})")
    previous = f"{name}{size - 1}"
    for k in reversed(range(size)):
        rest = "".join(f" - a_{k}_{j} * c_{j}" for j in range(k + 1, size))
        current = f"{name}_back{k}"
        steps.append(f"{current} AS (SELECT *, (b_{k}{rest}) / nullif(a_{k}_{k}, 0) AS c_{k} FROM {previous})")
        previous = current
    solution = ", ".join([f"c_{k}" for k in range(size)] + [f"a_{k}_{k} AS p_{k}" for k in range(size)])
    steps.append(f"{name} AS (SELECT {kept}, {solution} FROM {previous})")
    return ",\n".join(steps)


def full_matrix(size: int = 6) -> str:
    """a_i_j and b_i from g_i_j and b_i."""
    return ", ".join([f"g_{min(i, j)}_{max(i, j)} AS a_{i}_{j}" for i in range(size) for j in range(size)]
                     + [f"b_{i}" for i in range(size)])
