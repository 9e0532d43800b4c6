"""Weights of an optimal design: Newton rounds on 22 numbers per design.

With M = sum w x x', maximise log det M (criterion "D") or minimise the trace of
the inverse of M ("A"), subject to 0 <= w <= 1 and sum c w <= B. With a small
entropy term of strength mu the best weights follow from the multipliers, a
symmetric 6 x 6 matrix P and a price q for the budget:

    w = 1 / (1 + exp(-(x'Px - q c) / mu))

so the convex dual  h(P) + q B + mu sum log(1 + exp((x'Px - q c) / mu))  has 22
unknowns whatever the number of candidates, and its value, slope and curvature
are plain sums over candidates. Here h(P) is -log det P for "D"; for "A" it is
-2 tr (R P R)^(1/2), R being ``root``, with a vanishing -mu log det P that keeps P
inside the cone. A round needs the sums at a few trial points; ``advance`` then
moves the unknowns or lowers mu. No candidate carries state between rounds.
"""

from __future__ import annotations

import numpy as np

SIZE = 6
UPPER = np.triu_indices(SIZE)
UNKNOWNS = len(UPPER[0]) + 1
CURVATURE = np.triu_indices(UNKNOWNS)
SUMS = 1 + UNKNOWNS + len(CURVATURE[0])
_TWICE = np.where(UPPER[0] == UPPER[1], 1.0, 2.0)
_UNIT = np.zeros((UNKNOWNS - 1, SIZE, SIZE))
_UNIT[np.arange(UNKNOWNS - 1), UPPER[0], UPPER[1]] = 1.0
_UNIT[np.arange(UNKNOWNS - 1), UPPER[1], UPPER[0]] = 1.0

FIRST_MU = 1.0
# the answer of a design is the optimum with an entropy term of this strength, which also decides between designs
# of equal worth; every route ends here, so weights do not depend on how a design was solved
LAST_MU = 1e-6
_MU_STEP = 3.0
_MOVE_ON = 0.3
_FINISH = 1e-9
_GOOD_ENOUGH = 1e-2
_TRUSTED = 1e-3
_SHORTEST = 1e-9
_MOST_ROUNDS = 1_000


def _matrix(point: np.ndarray) -> np.ndarray:
    full = np.zeros((SIZE, SIZE))
    full[UPPER] = point[:-1]
    full[UPPER[1], UPPER[0]] = point[:-1]
    return full


def _definite(point: np.ndarray) -> bool:
    return np.linalg.eigvalsh(_matrix(point))[0] > 0


def weights(x: np.ndarray, cost: np.ndarray, point: np.ndarray, mu: float) -> np.ndarray:
    """Weight of each candidate (features already in the basis of the design)."""
    margin = (((x @ _matrix(point)) * x).sum(1) - point[-1] * cost) / mu
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))


def candidate_sums(x: np.ndarray, cost: np.ndarray, points: np.ndarray, mu: float) -> np.ndarray:
    """Value, slope and curvature of the candidates' part of the dual, one row per trial point."""
    products = np.concatenate([x[:, UPPER[0]] * x[:, UPPER[1]] * _TWICE, -cost[:, None]], axis=1)
    sums = np.empty((len(points), SUMS))
    for row, point in zip(sums, points):
        margin = (((x @ _matrix(point)) * x).sum(1) - point[-1] * cost) / mu
        weight = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
        row[0] = mu * np.logaddexp(0, margin).sum()
        row[1:1 + UNKNOWNS] = weight @ products
        bend = (products * (weight * (1 - weight) / mu)[:, None]).T @ products
        row[1 + UNKNOWNS:] = bend[CURVATURE]
    return sums


def start(information: np.ndarray, total_cost: float, budget: float, criterion: str = "D") -> dict:
    """First state from the plain information matrix of all candidates (unit weights).

    ``basis`` maps features so that the first P is the identity. ``status`` is
    "all" when the budget covers everything and "singular" when no weights give
    an invertible matrix.
    """
    state = {"basis": np.eye(SIZE), "root": np.eye(SIZE), "points": np.zeros((1, UNKNOWNS)),
             "point": np.zeros(UNKNOWNS), "step": np.zeros(UNKNOWNS), "length": 1.0, "value": np.inf, "fall": 0.0,
             "mu": FIRST_MU, "budget": budget, "rounds": 0, "status": "running"}
    if total_cost <= budget:
        return state | {"status": "all"}
    spectrum, axes = np.linalg.eigh(information * min(0.5, budget / total_cost))
    if not spectrum[0] > 1e-13 * spectrum[-1]:
        return state | {"status": "singular"}
    point = np.append(np.eye(SIZE)[UPPER], SIZE / budget)
    if criterion == "D":
        return state | {"basis": (axes / np.sqrt(spectrum)) @ axes.T, "points": point[None], "point": point}
    share = SIZE / (1 / spectrum).sum()
    inverse = (axes / spectrum) @ axes.T
    return state | {"basis": np.sqrt(share) * inverse, "root": share * inverse, "points": point[None], "point": point}


def _matrix_part(point: np.ndarray, root: np.ndarray, mu: float, criterion: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, slope (a matrix) and curvature of h(P)."""
    matrix = _matrix(point)
    inverse = np.linalg.inv(matrix)
    turned = inverse @ _UNIT
    barrier = np.einsum("aij,bji->ab", turned, turned)
    log_det = np.linalg.slogdet(matrix)[1]
    if criterion == "D":
        return -log_det, -inverse, barrier
    spectrum, axes = np.linalg.eigh(root @ matrix @ root)
    half = np.sqrt(np.maximum(spectrum, 1e-300))
    axes = root @ axes
    bends = np.sqrt(1 / (np.outer(half, half) * (half[:, None] + half)))
    turned = (axes.T @ _UNIT @ axes) * bends
    curvature = np.einsum("aij,bij->ab", turned, turned)
    return -2 * half.sum() - mu * log_det, -(axes / half) @ axes.T - mu * inverse, curvature + mu * barrier


def _trials(state: dict, count: int) -> dict:
    length = state["length"]
    while length > _SHORTEST and not _definite(state["point"] + length * state["step"]):
        length /= 2
    lengths = length * 0.5 ** np.arange(count)
    return state | {"length": length, "points": state["point"] + lengths[:, None] * state["step"]}


def _rebased(state: dict) -> dict:
    """The same state in the basis where P is the identity, which keeps its products exact."""
    spectrum, axes = np.linalg.eigh(_matrix(state["point"]))
    half = (axes * np.sqrt(spectrum)) @ axes.T
    spectrum, axes = np.linalg.eigh(half @ state["root"] @ state["root"] @ half)
    root = (axes * np.sqrt(np.maximum(spectrum, 0))) @ axes.T
    point = np.append(np.eye(SIZE)[UPPER], state["point"][-1])
    return state | {"basis": state["basis"] @ half, "root": root, "point": point, "points": point[None],
                    "value": np.inf, "fall": 0.0}


def advance(state: dict, sums: np.ndarray, last_mu: float = LAST_MU, trials: int = 1, criterion: str = "D") -> dict:
    """Next state from the candidate sums at the trial points of this one."""
    state = state | {"rounds": state["rounds"] + 1}
    if state["rounds"] > _MOST_ROUNDS:
        return state | {"status": "stalled"}
    # so near the answer the value is all rounding: plain Newton steps go on while they get shorter
    trusted = state["mu"] <= last_mu * 1.0001 and state["fall"] <= _TRUSTED * state["mu"] and np.isfinite(state["value"])
    for place, (point, row) in enumerate(zip(state["points"], sums)):
        value, slope_matrix, curvature = _matrix_part(point, state["root"], state["mu"], criterion)
        value += point[-1] * state["budget"] + row[0]
        asked = state["value"] - 0.1 * state["length"] * 0.5 ** place * state["fall"]
        if trusted or value <= asked + 1e-12 * abs(value):
            break
    else:
        length = state["length"] * 0.5 ** len(sums)
        if length < _SHORTEST:  # rounding hides what is left to gain
            return state | {"status": "done" if state["fall"] <= _GOOD_ENOUGH * last_mu else "stalled"}
        return _trials(state | {"length": length}, trials)
    slope = row[1:1 + UNKNOWNS].copy()
    slope[:-1] += slope_matrix[UPPER] * _TWICE
    slope[-1] += state["budget"]
    bend = np.zeros((UNKNOWNS, UNKNOWNS))
    bend[CURVATURE] = row[1 + UNKNOWNS:]
    bend = bend + np.triu(bend, 1).T
    bend[:-1, :-1] += curvature
    scale = 1.0 / np.sqrt(np.diag(bend) + 1e-300)
    step = -scale * np.linalg.lstsq(bend * np.outer(scale, scale), slope * scale, rcond=1e-15)[0]
    fall = -float(slope @ step)
    if trusted and fall >= 0.25 * state["fall"]:  # no shorter any more
        return state | {"status": "done"}
    state = state | {"point": point, "value": value, "step": step, "fall": fall, "length": 1.0}
    finest = state["mu"] <= last_mu * 1.0001
    if fall > (_FINISH if finest else _MOVE_ON) * state["mu"]:
        return _trials(state, trials)
    if finest:
        return state | {"status": "done"}
    return _rebased(state) | {"mu": max(state["mu"] / _MU_STEP, last_mu)}


def solve(x: np.ndarray, cost: np.ndarray, budget: float, criterion: str = "D") -> tuple[np.ndarray, str]:
    """Weights of one design whose candidates are all at hand."""
    means = x.mean(0)
    x = x / np.where(means == 0, 1.0, means)
    state = start(x.T @ x, cost.sum(), budget, criterion)
    if state["status"] == "all":
        return np.ones(len(x)), "all"
    if state["status"] == "singular":
        return np.full(len(x), np.nan), "singular"
    while state["status"] == "running":
        sums = candidate_sums(x @ state["basis"], cost, state["points"], state["mu"])
        state = advance(state, sums, criterion=criterion)
    found = weights(x @ state["basis"], cost, state["point"], state["mu"])
    return found * min(1.0, budget / (found @ cost)), state["status"]
