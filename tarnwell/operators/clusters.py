"""Failure clusters: each signature joins the nearest cluster or founds one."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR = 5.0
#: Cells that a cluster is named in at most, and the last ones that a float tells apart.
CELLS, LARGEST = 64, 2.0**52


@dataclass
class Cluster:
    cluster_id: str
    n: int
    centroid: dict[str, float]
    inverse_variance: dict[str, float] = field(default_factory=dict)

    def distance(self, point: dict[str, float]) -> float | None:
        """Squared, weighed by inverse variance, over shared keys; none without any."""
        shared = self.centroid.keys() & point.keys()
        return sum((point[k] - self.centroid[k]) ** 2 * self.inverse_variance.get(k, 1.0) for k in shared) if shared else None

    def add(self, point: dict[str, float]) -> None:
        """Running mean and variance."""
        n = self.n + 1
        for k in self.centroid.keys() & point.keys():
            gap = point[k] - self.centroid[k]
            squares = self.n / max(1e-9, self.inverse_variance.get(k, 1.0))
            self.centroid[k] += gap / n
            self.inverse_variance[k] = n / max(1e-9, squares + gap * (point[k] - self.centroid[k]))
        self.n = n


def numbered(founded: int) -> str:
    """The id of a cluster after so many others: the usual factory of ids."""
    return f"FC-{founded + 1:03d}"


def match_or_create(clusters: list[Cluster], point: dict[str, float], near: float = NEAR, name: Callable[[int], str] = numbered) -> Cluster:
    """The nearest cluster, which takes the point, or a new one, named by how many there are."""
    found = [(d, i) for i, c in enumerate(clusters) if (d := c.distance(point)) is not None]
    if found and min(found)[0] <= near:
        cluster = clusters[min(found)[1]]
        cluster.add(point)
        return cluster
    clusters.append(Cluster(name(len(clusters)), 1, dict(point), dict.fromkeys(point, 1.0)))
    return clusters[-1]


class Line:
    """The clusters of a single feature: match_or_create's, found by cells of the feature instead of asking every cluster.

    A cell has the clusters that come near enough to some value in it, with a tenth to
    spare; one is placed anew when what it took moves it, or its reach, beyond that.
    """

    def __init__(self, near: float) -> None:
        self.near, self.width = near, math.sqrt(near) / 2 or 1.0
        self.founded = 0
        self.number: list[int] = []
        self.n: list[int] = []
        self.centre: list[float] = []
        self.weight: list[float] = []
        self.low: list[float] = []
        self.high: list[float] = []
        self.cells: dict[float, list[int]] = {}
        self.wide: list[int] = []

    def _cells(self, i: int) -> list[list[int]]:
        """The lists that name cluster i: those of its cells or, of many, that of wide clusters."""
        first, last = self.low[i] // self.width, self.high[i] // self.width
        if last - first <= CELLS and abs(first) < LARGEST:
            return [self.cells.setdefault(c, []) for c in range(int(first), int(last) + 1)]
        return [self.wide]

    def _place(self, i: int) -> None:
        if i < len(self.low):
            for held in self._cells(i):
                held.remove(i)
        else:
            self.low.append(0.0)
            self.high.append(0.0)
        reach = 1.1 * math.sqrt(self.near / self.weight[i])
        self.low[i], self.high[i] = self.centre[i] - reach, self.centre[i] + reach
        for held in self._cells(i):
            insort(held, i)  # of clusters equally near the first one counts

    def numbers(self, values: list[float]) -> list[int]:
        """How many clusters were founded before each value's."""
        near, width, cells, wide, n, centre, weight, low, high = self.near, self.width, self.cells, self.wide, self.n, self.centre, self.weight, self.low, self.high
        least, most, none = near * (1 + 1e-6), near * 1.6, []
        out = []
        for x in values:
            if x - x != 0:  # missing or infinite: near to nothing, nor is anything to it
                out.append(self.founded)
                self.founded += 1
                continue
            asked = cells.get(x // width, none)
            if wide:
                asked = sorted(asked + wide)
            best, k = math.inf, -1
            for i in asked:
                gap = x - centre[i]
                d = gap * gap * weight[i]
                if d < best:
                    best, k = d, i
            if best <= near:
                gap = x - centre[k]
                squares = n[k] / max(1e-9, weight[k])
                n[k] += 1
                c = centre[k] = centre[k] + gap / n[k]
                w = weight[k] = n[k] / max(1e-9, squares + gap * (x - c))
                if not (least <= (c - low[k]) * (c - low[k]) * w <= most and least <= (high[k] - c) * (high[k] - c) * w <= most):
                    self._place(k)
            else:
                k = len(n)
                n.append(1)
                centre.append(x)
                weight.append(1.0)
                self.number.append(self.founded)
                self.founded += 1
                self._place(k)
            out.append(self.number[k])
        return out


class Space:
    """The clusters of several features, or of none."""

    def __init__(self, near: float) -> None:
        self.near = near
        self.clusters: list[Cluster] = []
        self.numbered: dict[int, int] = {}

    def numbers(self, points: list[dict[str, float]]) -> list[int]:
        found = (match_or_create(self.clusters, p, self.near) for p in points)
        return [self.numbered.setdefault(id(c), len(self.numbered)) for c in found]


def _runs(keys: pa.Array) -> list[tuple[object, int]]:
    """Each key with how many rows have it, of sorted keys: where the ends are equal all are."""
    name = lambda k: "NaN" if k != k else (k,)
    ends = [name(keys[i].as_py()) for i in (0, len(keys) - 1)] if len(keys) else []
    if ends and ends[0] == ends[1]:
        return [(ends[0], len(keys))]
    return [(k, sum(1 for _ in rows)) for k, rows in groupby(map(name, keys.to_pylist()))]


def cluster_rows(df: DataFrame, by: str, order: str, features: list[str], near: float = NEAR) -> DataFrame:
    """by, order and cluster_id, in order within each ``by``: the fold depends on order, so a group's rows pass through one task, which holds its clusters and a batch of rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, names = None, None, []
        for batch in batches:
            numbers, at = [], 0
            columns = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(features))]
            for key, n in _runs(batch.column(0)):
                if held is None or key != last:
                    held, last = (Line if len(features) == 1 else Space)(near), key
                parts = [c[at : at + n].tolist() for c in columns]
                if len(features) == 1:
                    numbers += held.numbers(parts[0])
                else:
                    numbers += held.numbers([{f: v for f, v in zip(features, row, strict=True) if v == v} for row in (zip(*parts, strict=True) if parts else [()] * n)])
                at += n
            names += [numbered(i) for i in range(len(names), max(numbers, default=-1) + 1)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([names[i] for i in numbers], pa.string())], [by, order, "cluster_id"])

    kinds = dict(df.dtypes)
    values = [F.col(f).cast("double").alias(f"__feature_{i}") for i, f in enumerate(features)]
    rows = df.select(by, order, *values).repartition(by).sortWithinPartitions(by, F.asc_nulls_last(order), *[f"__feature_{i}" for i in range(len(features))])
    return rows.mapInArrow(fold, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, cluster_id string")
