"""Numeric helpers that one fold needs inside a grouped map.

Two small estimators on numpy arrays: an L2 logistic regression solved by Newton steps
and a boosted median regression on depth-two trees. Partitioning, fold membership,
fingerprints and everything after the scores are Spark's (``walkforward``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.config import ModelConfig

SAME_VALUE = 1e-7


def month_weights(months: pd.Series) -> np.ndarray:
    return 1.0 / months.map(months.value_counts()).to_numpy(dtype=float)


def medians(x: np.ndarray) -> np.ndarray:
    """Column medians of the known values; a column without any counts as 0."""
    out = np.zeros(x.shape[1])
    known = ~np.isnan(x).all(axis=0)
    if known.any():
        out[known] = np.nanmedian(x[:, known], axis=0)
    return out


def filled(x: np.ndarray, fill: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), fill, x)


class Scaler:
    """Median fill, missing indicators where training had gaps, population z-scores."""

    def __init__(self, train: np.ndarray) -> None:
        self.fill = medians(train)
        self.gaps = np.isnan(train).any(axis=0)
        raw = self._with_indicators(train)
        self.mean = raw.mean(axis=0)
        self.spread = raw.std(axis=0)
        self.scale = np.where(self.spread <= 10 * np.finfo(float).eps * np.abs(self.mean), 1.0, self.spread)

    def _with_indicators(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([filled(x, self.fill), np.isnan(x[:, self.gaps]).astype(float)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self._with_indicators(x) - self.mean) / self.scale


def sigmoid(score: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * score))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, steps: int) -> np.ndarray:
    """Coefficients (last one the unpenalised intercept) of the weighted L2 fit."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(design.shape[1], 1.0 / c)
    penalty[-1] = 0.0
    sign = np.where(y, 1.0, -1.0)

    def loss(beta: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0.0, -sign * (design @ beta)) + 0.5 * penalty @ beta**2)

    beta = np.zeros(design.shape[1])
    current = loss(beta)
    for _ in range(steps):
        p = sigmoid(design @ beta)
        gradient = design.T @ (weight * (p - y)) + penalty * beta
        curvature = (design * (weight * p * (1.0 - p))[:, None]).T @ design
        step = np.linalg.lstsq(curvature + np.diag(penalty), gradient, rcond=None)[0]
        size = 1.0
        while size > 1e-8 and loss(beta - size * step) > current:
            size /= 2.0
        beta = beta - size * step
        previous, current = current, loss(beta)
        if previous - current <= 1e-12 * max(1.0, abs(previous)):
            break
    return beta


def near_probability(train: pd.DataFrame, test: pd.DataFrame, features: list[str], config: ModelConfig) -> np.ndarray:
    """Probability of a near-best day; a one-class history gives that class outright."""
    y = train["near_optimal"].to_numpy(dtype=bool)
    if y.all() or not y.any():
        return np.full(len(test), float(y[0]))
    weight = month_weights(train["month"])
    share = np.array([weight[~y].sum(), weight[y].sum()])
    weight = weight * (weight.sum() / (2.0 * share))[y.astype(int)]
    scaler = Scaler(train[features].to_numpy(dtype=float))
    beta = logistic(scaler(train[features].to_numpy(dtype=float)), y, weight,
                    config.classifier_c, config.max_newton_steps)
    return sigmoid(scaler(test[features].to_numpy(dtype=float)) @ beta[:-1] + beta[-1])


def weighted_quantile(values: np.ndarray, weight: np.ndarray, level: float) -> float:
    """Smallest value whose cumulative weight reaches ``level`` of the total."""
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weight[order])
    return float(values[order[min(np.searchsorted(reached, level * reached[-1]), len(values) - 1)]])


def best_split(
    columns: np.ndarray, order: np.ndarray, pull: np.ndarray, weight: np.ndarray, leaf: int
) -> tuple[int, float] | None:
    """(feature, threshold) of the largest between-side gain, or None.

    ``columns`` is features by rows, ``order`` the node's rows sorted per feature, ``pull``
    the weighted slopes. Cuts between equal values do not count; few are best by chance,
    so only the leading candidates are looked at before all cuts are masked.
    """
    rows = order.shape[1]
    if rows < 2 * leaf:
        return None
    w, s = np.cumsum(weight.take(order), axis=1), np.cumsum(pull.take(order), axis=1)
    wl, sl = w[:, leaf - 1:rows - leaf], s[:, leaf - 1:rows - leaf]
    gain = sl * w[:, -1:]
    gain -= wl * s[:, -1:]
    gain *= gain
    gain /= wl * (w[:, -1:] - wl)
    tries = 8
    while True:
        feature, at = divmod(int(gain.argmax()), gain.shape[1])
        if gain[feature, at] < 0.0:
            return None
        low, high = columns[feature, order[feature, at + leaf - 1:at + leaf + 1]]
        if high - low > SAME_VALUE:
            break
        gain[feature, at] = -1.0
        tries -= 1
        if tries == 0:
            values = np.take_along_axis(columns, order[:, leaf - 1:rows - leaf + 1], axis=1)
            gain[np.diff(values, axis=1) <= SAME_VALUE] = -1.0
    middle = low / 2.0 + high / 2.0
    return feature, float(middle if middle < high else low)


def grow(columns: np.ndarray, order: np.ndarray, slope: np.ndarray, weight: np.ndarray, config: ModelConfig) -> list:
    """List of (rows, path) leaves of one tree; a path is a list of (feature, threshold, left)."""
    pull = slope * weight
    leaves, open_nodes = [], [(order, [])]
    while open_nodes:
        node, path = open_nodes.pop()
        split = None
        if len(path) < config.max_depth and np.ptp(slope[node[0]]) > 0.0:
            split = best_split(columns, node, pull, weight, config.min_leaf)
        if split is None:
            leaves.append((node[0], path))
            continue
        feature, threshold = split
        goes_left = columns[feature] <= threshold
        if len(path) + 1 == config.max_depth:
            node = node[:1]  # leaves need their rows only, not their sort orders
        inside = goes_left.take(node)
        for left in (True, False):
            child = node[inside if left else ~inside].reshape(len(node), -1)
            open_nodes.append((child, [*path, (feature, threshold, left)]))
    return leaves


def remaining_log_ratio(train: pd.DataFrame, test: pd.DataFrame, features: list[str], config: ModelConfig) -> np.ndarray:
    """Boosted median of the rest-of-month log ratio, clipped."""
    known = train[train["remaining_min_log_ratio"].notna()]
    if known.empty:
        raise ValueError("no training rows with a rest-of-month target")
    y = known["remaining_min_log_ratio"].to_numpy(dtype=float)
    weight = month_weights(known["month"])
    raw = known[features].to_numpy(dtype=float)
    fill = medians(raw)
    # Single precision for the split values, as tree libraries keep them.
    columns = filled(raw, fill).astype(np.float32).astype(float).T.copy()
    unseen = filled(test[features].to_numpy(dtype=float), fill).astype(np.float32).astype(float).T
    order = np.argsort(columns, axis=1, kind="stable")
    start = weighted_quantile(y, weight, config.quantile)
    fitted, predicted = np.full(len(y), start), np.full(len(test), start)
    for _ in range(config.trees):
        slope = np.where(y >= fitted, config.quantile, config.quantile - 1.0)
        for rows, path in grow(columns, order, slope, weight, config):
            step = config.learning_rate * weighted_quantile(
                y[rows] - fitted[rows], weight[rows], config.quantile)
            fitted[rows] += step
            here = np.ones(len(test), dtype=bool)
            for feature, threshold, left in path:
                here &= (unseen[feature] <= threshold) == left
            predicted[here] += step
    return np.clip(predicted, -config.clip, config.clip)


def fit_and_score(train: pd.DataFrame, test: pd.DataFrame, features: list[str], config: ModelConfig) -> pd.DataFrame:
    """Default estimator: both scores for the rows of one test month."""
    return pd.DataFrame({
        "near_probability": near_probability(train, test, features, config),
        "predicted_remaining_log_ratio": remaining_log_ratio(train, test, features, config),
    })
