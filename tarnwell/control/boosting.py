"""Boosted trees on any loss over all rows: histograms of gradients, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.control.estimators import focal_gradient
from tarnwell.operators.running import counted, quantiles
from tarnwell.sources.saved import Saved

#: Rounds after which margins are written anew, so that a row never goes through more trees than these.
WRITTEN_EVERY = 10
LEAST_GAIN = 1e-9


@dataclass
class GrownTree:
    """Splits by node (feature and greatest bin of the lower side; children of i are 2 i + 1 and 2 i + 2) and values of leaves."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, coded: np.ndarray) -> np.ndarray:
        """The node that each row of bins has come to."""
        at = np.zeros(len(coded), np.int64)
        for node in sorted(self.splits):
            feature, cut = self.splits[node]
            here = at == node
            at[here] = 2 * node + 1 + (coded[here, feature] > cut)
        return at

    def predict(self, coded: np.ndarray) -> np.ndarray:
        at = self.nodes(coded)
        out = np.zeros(len(coded))
        for node, value in self.values.items():
            out[at == node] = value
        return out


@dataclass
class BoostedOnAllRows:
    """Trees of second-order gains over quantile bins, fitted on every row.

    A level of a tree is one pass: tasks add up gradients by node, feature and bin, Spark
    adds up what tasks found, and the driver, which gets nodes x features x bins sums,
    splits. gradient gives first and second derivatives of the loss by the margin.
    """

    gradient: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = focal_gradient
    rounds: int = 60
    rate: float = 0.2
    depth: int = 3
    bins: int = 32
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[GrownTree] = field(default_factory=list)

    def learn_edges(self, df: DataFrame, features: Sequence[str]) -> None:
        """Exact quantiles of each feature, from counts of its values."""
        at = np.linspace(0, 1, self.bins + 1)[1:-1].tolist()
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("c")).select("c.*")
        found = {r["feature"]: r["quantiles"] for r in quantiles(counted(long, ["feature", "v"]), "v", "n", at, by=["feature"]).collect()}
        self.edges = [np.unique(np.array(found.get(i, []), float)) for i in range(len(features))]

    def coded(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(self.edges)])

    def _histograms(self, rows: DataFrame, trees: list[GrownTree], growing: GrownTree, k: int) -> dict[int, np.ndarray]:
        """For each open node sums of both derivatives by feature and bin; growing's leaves are open."""
        gradient, rate, bins = self.gradient, self.rate, self.bins

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                coded = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, k)
                margin = batch.column(2).to_numpy() + rate * sum((t.predict(coded) for t in trees), np.zeros(len(coded)))
                derivatives = gradient(batch.column(1).to_numpy(), margin)
                at = growing.nodes(coded)
                for node in np.unique(at).tolist():
                    here = at == node
                    table = sums.setdefault(node, np.zeros((2, k, bins)))
                    for d, values in enumerate(derivatives):
                        for c in range(k):
                            table[d, c] += np.bincount(coded[here, c], values[here], bins)
            cells = [(node, i, v) for node, table in sums.items() for i, v in enumerate(table.ravel().tolist()) if v]
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in cells], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["node", "cell", "total"])

        found: dict[int, np.ndarray] = {}
        for r in rows.mapInArrow(add, "node int, cell int, total double").groupBy("node", "cell").agg(F.sum("total").alias("total")).collect():
            found.setdefault(r["node"], np.zeros(2 * k * bins))[r["cell"]] = r["total"]
        return {node: table.reshape(2, k, bins) for node, table in found.items()}

    def _split(self, table: np.ndarray) -> tuple[int, int] | None:
        best, found = LEAST_GAIN, None
        for c, edges in enumerate(self.edges):
            g, h = (np.cumsum(t)[: len(edges)] for t in table[:, c])
            all_g, all_h = table[:, c].sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):  # an empty side without ridge
                gain = np.nan_to_num(g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge), nan=-np.inf, posinf=-np.inf)
            if len(gain) and gain.max() > best:
                best, found = float(gain.max()), (c, int(gain.argmax()))
        return found

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> BoostedOnAllRows:
        k = len(features)
        with Saved(df.sparkSession) as saved:
            rows = saved(df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y")))
            self.learn_edges(rows.select(*[F.col("x")[i].alias(c) for i, c in enumerate(features)]), features)
            code = self.coded

            def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x = np.array(batch.column(0).to_pylist(), float).reshape(-1, k)
                    bins = code(x).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(1), pa.array(np.zeros(len(x)))], names=["bins", "y", "margin"])

            table = saved(rows.mapInArrow(prepared, "bins binary, y double, margin double"))
            recent: list[GrownTree] = []
            for i in range(self.rounds):
                tree = GrownTree()
                for level in range(self.depth + 1):
                    for node, sums in self._histograms(table, recent, tree, k).items():
                        if node in tree.values:
                            continue
                        split = self._split(sums) if level < self.depth else None
                        if split is None:
                            g, h = sums[:, 0].sum(axis=1)
                            tree.values[node] = -g / (h + self.ridge)
                        else:
                            tree.splits[node] = split
                self.trees.append(tree)
                recent.append(tree)
                if len(recent) == WRITTEN_EVERY and i + 1 < self.rounds:
                    table, recent = saved(self._moved(table, recent, k)), []
        return self

    def _moved(self, table: DataFrame, trees: list[GrownTree], k: int) -> DataFrame:
        rate = self.rate

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, k)
                margin = batch.column(2).to_numpy() + rate * sum((t.predict(coded) for t in trees), np.zeros(len(coded)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin)], names=["bins", "y", "margin"])

        return table.mapInArrow(run, table.schema)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, of a margin's logistic."""
        coded = self.coded(x)
        margin = self.rate * sum((t.predict(coded) for t in self.trees), np.zeros(len(coded)))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def column(self, features: Sequence[str]) -> Column:
        """The prediction as a column."""
        model = self

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack(x.to_list()).astype(float)) if len(x) else np.zeros(0))

        return predicted(F.array(*[F.col(c).cast("double") for c in features]))
