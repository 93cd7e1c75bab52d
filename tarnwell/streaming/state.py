"""Failure clusters kept as state of a stream: what was founded in one micro-batch takes rows of the next, after restarts too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tarnwell.operators.clusters import NEAR, Cluster, match_or_create, numbered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "cluster_id string, n long, centroid map<string, double>, inverse_variance map<string, double>"


class ClusterProcessor(StatefulProcessor):
    """A key's clusters as a map from their number; a row joins the nearest or founds one, and only clusters that a batch changed are written.

    With a time to live a cluster that took no row for so long is forgotten, and its
    number is not used again: the count of founded clusters is a value of its own.
    """

    def __init__(self, by: str, order: str, features: list[str], near: float, name: Callable[[int], str], live_ms: int | None) -> None:
        self.by, self.order, self.features, self.near, self.name, self.live_ms = by, order, features, near, name, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "number long", _STATE, self.live_ms)
        self.founded = handle.getValueState("founded", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {number: Cluster(name, n, dict(centre), dict(spread)) for (number,), (name, n, centre, spread) in self.clusters.iterator()}
        founded = self.founded.get()[0] if self.founded.exists() else 0
        numbers = sorted(held)
        known = [held[i] for i in numbers]
        changed: set[int] = set()
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        ids = []
        for row in batch[self.features].itertuples(index=False):
            point = {f: float(v) for f, v in zip(self.features, row, strict=True) if v is not None and v == v}
            before = len(known)
            cluster = match_or_create(known, point, self.near, lambda _, n=founded: self.name(n))
            if len(known) > before:
                numbers.append(founded)
                founded += 1
            changed.add(next(i for i, c in enumerate(known) if c is cluster))
            ids.append(cluster.cluster_id)
        for i in changed:
            c = known[i]
            self.clusters.updateValue((numbers[i],), (c.cluster_id, c.n, c.centroid, c.inverse_variance))
        self.founded.update((founded,))
        yield pd.DataFrame({self.by: [key[0]] * len(ids), self.order: batch[self.order].to_numpy(), "cluster_id": ids})

    def close(self) -> None:
        pass


def clustered(events: DataFrame, by: str, order: str, features: list[str], near: float = NEAR, name: Callable[[int], str] = numbered, live: int | None = None) -> DataFrame:
    """by, order and cluster_id of each row of a stream (or table): rows stand by order within a micro-batch and micro-batches as they come.

    name makes a cluster's id of how many were founded before it; live is the seconds
    after which a cluster that takes no row is forgotten. State is kept in RocksDB, so a
    key's clusters may outgrow memory; the session must say so before the query starts:
    spark.sql.streaming.stateStore.providerClass = ROCKS.
    """
    schema = events.schema
    out = StructType([StructField(by, schema[by].dataType), StructField(order, schema[order].dataType), StructField("cluster_id", StringType())])
    processor = ClusterProcessor(by, order, features, near, name, None if live is None else 1000 * live)
    return events.select(by, order, *features).groupBy(by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None" if live is None else "ProcessingTime")


