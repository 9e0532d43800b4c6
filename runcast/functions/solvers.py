"""Least squares on moment sums: every function takes a stack of small systems, one per group."""

from __future__ import annotations

import itertools

import numpy as np

_PIVOT_FLOOR = 1e-11
_GROUPS_AT_ONCE = 2_000


def symmetric(upper: np.ndarray, size: int) -> np.ndarray:
    """Stack of upper triangles, row by row, to a stack of full matrices."""
    full = np.zeros((len(upper), size, size))
    rows, cols = np.triu_indices(size)
    full[:, rows, cols] = upper
    full[:, cols, rows] = upper
    return full


def _unit_diagonal(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    diagonal = np.einsum("gii->gi", gram)
    scale = 1.0 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    return gram * scale[:, :, None] * scale[:, None, :], scale


def _eliminate(matrix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve positive definite systems with a unit diagonal; the flag is False where one is singular."""
    matrix, right = matrix.copy(), right.copy()
    size = right.shape[-1]
    regular = np.ones(right.shape[:-1], dtype=bool)
    for k in range(size):
        pivot = matrix[..., k, k]
        regular &= pivot > _PIVOT_FLOOR
        pivot = np.where(pivot > _PIVOT_FLOOR, pivot, 1.0)
        factor = matrix[..., k + 1:, k] / pivot[..., None]
        matrix[..., k + 1:, :] -= factor[..., None] * matrix[..., None, k, :]
        right[..., k + 1:] -= factor * right[..., k, None]
    solution = np.zeros_like(right)
    for k in reversed(range(size)):
        pivot = np.where(matrix[..., k, k] > _PIVOT_FLOOR, matrix[..., k, k], 1.0)
        rest = (matrix[..., k, k + 1:] * solution[..., k + 1:]).sum(-1)
        solution[..., k] = (right[..., k] - rest) / pivot
    return solution, regular


def nonnegative_least_squares(gram: np.ndarray, moment: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Minimise |y - X b| with b >= 0 and b = 0 where ``allowed`` is False, from X'X and X'y.

    Exact for the handful of features a time model has: an optimum is the plain
    solution on some linearly independent subset, so the best feasible one is taken.
    """
    size = gram.shape[-1]
    subsets = np.array(list(itertools.product([False, True], repeat=size)))
    result = np.zeros_like(moment)
    for start in range(0, len(gram), _GROUPS_AT_ONCE):
        part = slice(start, start + _GROUPS_AT_ONCE)
        unit, scale = _unit_diagonal(gram[part])
        right = (moment[part] * scale)[:, None, :] * subsets
        both = subsets[:, :, None] & subsets[:, None, :]
        system = np.where(both, unit[:, None], np.eye(size))
        solution, regular = _eliminate(system, right)
        feasible = regular & (solution >= 0).all(-1)
        feasible &= ~(subsets[None] & ~allowed[part][:, None]).any(-1)
        gain = np.where(feasible, (right * solution).sum(-1), -np.inf)
        best = gain.argmax(1)
        result[part] = solution[np.arange(len(best)), best] * scale
    return result


def ordinary_least_squares(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Intercept and slopes from X'X and X'y, the first feature being the constant.

    Slopes come from the centred moments; a feature without variance gets 0.
    """
    count = gram[:, 0, 0]
    means = gram[:, 0, 1:] / count[:, None]
    target = moment[:, 0] / count
    spread = gram[:, 1:, 1:] / count[:, None, None] - means[:, :, None] * means[:, None, :]
    joint = moment[:, 1:] / count[:, None] - means * target[:, None]
    noise = 1e-12 * np.einsum("gii->gi", gram[:, 1:, 1:]) / count[:, None]
    flat = np.einsum("gii->gi", spread) <= noise
    spread = np.where(flat[:, :, None] | flat[:, None, :], 0.0, spread)
    joint = np.where(flat, 0.0, joint)
    unit, scale = _unit_diagonal(spread)
    slopes = (np.linalg.pinv(unit, rcond=1e-11, hermitian=True) @ (joint * scale)[:, :, None])[:, :, 0] * scale
    return np.concatenate([(target - (slopes * means).sum(1))[:, None], slopes], axis=1)
