"""Gradient boosting of split rules from moments.

Features are cut into bins at their training quantiles. What boosting needs of the rows is then a bounded
table: how often two bins meet and the label sums of each bin. One pass adds that table up in the tasks;
every round is arithmetic on it, so hundreds or thousands of rounds cost no further job. The split of a
round is the exact best one over all features and cuts, by prefix sums over the bins. The number of rounds
is the one with the least squared error on a validation fold, whose error is followed by its own table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.functions.scalars import clip, half_up

BINS, ROUNDS, RATE, LEAST_ROWS = 8, 360, 0.05, 20
#: Gains and errors are compared to so many digits of their total, so that noise decides nothing.
DIGITS = 9


def edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """The inner quantiles of each feature, to six places where a double has them (see :func:`half_up`); a
    feature without values has none."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = df.agg(*[F.percentile(F.col(f).cast("double"), at).alias(f) for f in features])
    row = found.select(*[F.transform(f, lambda x: half_up(x, 6)).alias(f) for f in features]).first()
    return {f: list(row[f] or []) for f in features}


def binned(cuts: dict[str, list[float]]) -> Column:
    """array<int>: for each feature the number of edges below its value; missing values are in the first bin."""
    values = F.array(*[F.col(f).cast("double") for f in cuts])
    limits = F.array(*[F.array(*map(F.lit, own)).cast("array<double>") for own in cuts.values()])
    return F.zip_with(values, limits, lambda x, own: F.size(F.filter(own, lambda e: x > e)))


class Moments(NamedTuple):
    meet: np.ndarray  # weight of the rows that are in both bins
    sums: np.ndarray  # weighted label sums of each bin
    weight: float
    total: float
    square: float


def moments(df: DataFrame, bins: Column, label: str, n: int, bins_of: int = BINS, weight: str | None = None) -> Moments:
    """The table of ``n`` features; rows without a label or a weight do not count."""
    k = n * bins_of
    rows = df.select(bins.alias("b"), F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")).na.drop(subset=["y", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet, sums, ends = np.zeros((k, k)), np.zeros(k), np.zeros(3)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array(batch.column(0).to_pylist(), np.int64) + np.arange(n) * bins_of
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i in range(0, len(y), 4096):
                x = np.zeros((len(y[i : i + 4096]), k))
                np.put_along_axis(x, at[i : i + 4096], 1.0, axis=1)
                wx = x * w[i : i + 4096, None]
                meet += x.T @ wx
                sums += wx.T @ y[i : i + 4096]
            ends += (w.sum(), (w * y).sum(), (w * y * y).sum())
        i, j = np.nonzero(meet)
        columns = [np.concatenate((i, np.arange(k), np.full(3, -2))), np.concatenate((j, np.full(k, -1), np.arange(3))), np.concatenate((meet[i, j], sums, ends))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "v"])

    table = rows.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
    meet, sums, ends = np.zeros((k, k)), np.zeros(k), np.zeros(3)
    meet[i[j >= 0][i[j >= 0] >= 0], j[j >= 0][i[j >= 0] >= 0]] = v[j >= 0][i[j >= 0] >= 0]
    sums[i[j == -1]] = v[j == -1]
    ends[j[i == -2]] = v[i == -2]
    return Moments(meet, sums, *ends.tolist())


class Boosted(NamedTuple):
    features: list[str]
    cuts: dict[str, list[float]]
    base: float
    values: np.ndarray  # of every bin after the best round
    path: list[tuple[int, str, int, float, float]]  # round, feature, cut, share of the squared error gained, validation error
    best: int

    def score(self, label: str = "predicted") -> Column:
        """The forecast, not below zero, as one expression."""
        per = len(self.values) // max(1, len(self.features))
        own = F.array(*[F.array(*map(F.lit, row)) for row in self.values.reshape(-1, per).tolist()])
        parts = F.zip_with(binned(self.cuts), own, lambda b, values: F.get(values, b))
        return clip(F.aggregate(parts, F.lit(float(self.base)), lambda total, x: total + x), lo=0).alias(label)

    def gain(self) -> list[tuple[str, float, int]]:
        """(feature, gain up to the best round, splits) of all features."""
        used = [p for p in self.path if 0 < p[0] <= self.best]
        return [(f, sum(p[3] for p in used if p[1] == f), sum(p[1] == f for p in used)) for f in self.features]


def boost(df: DataFrame, features: Sequence[str], label: str, fold: Column, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, least: int = LEAST_ROWS, weight: str | None = None) -> Boosted:
    """Fit to the rows outside ``fold``, the validation rows, and keep the best number of rounds.

    Edge cases: no rows to fit give a forecast of 0; without validation rows all rounds count; features
    without values are never split; ties go to the earlier feature and the lower cut.
    """
    features = list(features)
    fit, held = df.where(~fold), df.where(fold)
    cuts = edges(fit, features, bins)
    at, n = binned(cuts), len(features)
    m, v = (moments(x, at, label, n, bins, weight) for x in (fit, held))
    base = m.total / m.weight if m.weight else 0.0
    count, values = np.diag(m.meet).reshape(n, bins), np.zeros(n * bins)
    g, gv = m.sums - base * np.diag(m.meet), v.sums - base * np.diag(v.meet)
    spread = m.square - base * m.total
    error = first = v.square - 2 * base * v.total + base * base * v.weight
    digits = lambda x: np.floor(x * 10**DIGITS + 0.5) / 10**DIGITS
    path, best, lowest, kept = [(0, "", 0, 0.0, 1.0)], 0, 1.0, values.copy()
    left_n = np.cumsum(count, axis=1)[:, :-1]
    right_n = count.sum(axis=1, keepdims=True) - left_n
    usable = (left_n >= max(1, least)) & (right_n >= max(1, least))
    for r in range(1, rounds + 1):
        each = g.reshape(n, bins)
        whole = each.sum(axis=1, keepdims=True)
        left = np.cumsum(each, axis=1)[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = left**2 / left_n + (whole - left) ** 2 / right_n - whole**2 / (left_n + right_n)
        share = np.where(usable, digits(gains / spread) if spread > 0 else 0.0, 0.0)
        if share.max(initial=0.0) <= 0:
            break
        j, t = np.unravel_index(int(np.argmax(share)), share.shape)
        own = slice(j * bins, (j + 1) * bins)
        u = np.where(np.arange(bins) <= t, rate * left[j, t] / left_n[j, t], rate * (whole[j, 0] - left[j, t]) / right_n[j, t])
        error += -2 * u @ gv[own] + u @ v.meet[own, own] @ u
        g, gv = g - m.meet[:, own] @ u, gv - v.meet[:, own] @ u
        values[own] += u
        ratio = float(digits(error / first)) if first > 0 else 1.0
        path.append((r, features[j], int(t) + 1, float(share[j, t]), ratio))
        if ratio < lowest or not v.weight:
            best, lowest, kept = r, ratio, values.copy()
    return Boosted(features, cuts, base, kept, path, best)
