"""Nearest vectors of a query set: cells around pivots, pruned by the triangle inequality, in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.sources.saved import Saved

#: Pivots, rows and queries of a tile, digits of scores that are compared, and what rounding may hide in distances.
PIVOTS, TILE_ROWS, TILE_QUERIES, DIGITS, SLACK = 64, 8192, 256, 9, 1e-4


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """query_id, id, place and similarity of the k rows of greatest cosine for each query; ties (to 9 digits) by id. Null vectors and ones of length 0 have no neighbours."""
    return _joined(queries, rows, id_col, vector_col, k, True, PIVOTS).withColumnRenamed("score", "similarity")


def knn_join(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """query_id, id, place and distance of the k rows nearest to each query by Euclid; ties (to 9 digits) by id. Null vectors have no neighbours."""
    return _joined(queries, rows, id_col, vector_col, k, False, pivots).withColumn("distance", -F.col("score")).drop("score")


def _matrix(column: pa.ListArray, unit: bool) -> np.ndarray:
    """Vectors as rows, scaled to length 1 if unit; not a number for length 0."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    if not unit:
        return x
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T))


def _joined(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, unit: bool, pivots: int) -> DataFrame:
    """The exact join: a table in the shared folder with query_id, id, place and score (cosine, or distance below 0).

    Rows lie in the cell of their nearest pivot, pivots being some rows by hash. A cell's
    pivot with its k nearest rows bounds from above how far a query's k-th neighbour is; a
    query goes to the cells that may hold something nearer, by their radius and by the
    plane between pivots, and to no other. Cells are cut into tiles of TILE_ROWS, so a cell
    that holds a third of all rows is many tasks'. A tile is one product of matrices and
    keeps k rows a query. The driver gets pivots and a few numbers of each cell.
    """
    id_kind, query_kind = rows.schema[id_col].dataType, queries.schema[id_col].dataType
    vector = F.col(vector_col).cast("array<double>")
    given = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), vector.alias("v"))
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), vector.alias("q"))
    if unit:
        given, asked = (df.where(F.exists(c, lambda x: x != 0)) for df, c in ((given, "v"), (asked, "q")))
    with Saved(rows.sparkSession) as saved:
        drawn = given.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).select("v").collect()
        out = T.StructType([T.StructField("query_id", query_kind), T.StructField("id", id_kind), T.StructField("score", T.DoubleType())])
        if not drawn:
            return rows.sparkSession.createDataFrame([], out.add("place", T.IntegerType())).withColumnRenamed("id", id_col)
        centres = _matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())), unit)

        def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gaps = _gaps(_matrix(batch.column(1), unit), centres)
                cell = gaps.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(gaps[np.arange(len(cell)), cell])], names=["id", "v", "cell", "far"])

        kind = T.StructType([T.StructField("id", id_kind), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
        placed = saved(given.mapInArrow(celled, kind))
        sizes = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
        close = placed.select("cell", "far").withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("i") == k)
        reach = {r["cell"]: r["far"] for r in close.collect()}
        every = np.arange(len(centres))
        radius = np.array([sizes.get(c, (0, -np.inf))[1] for c in every])
        within = np.array([reach.get(c, np.inf) for c in every])
        tiles = {c: -(-n // TILE_ROWS) for c, (n, _) in sizes.items()}

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gaps = _gaps(_matrix(batch.column(1), unit), centres)
                bound = (gaps + within).min(axis=1, initial=np.inf) + SLACK
                plane = (gaps - gaps.min(axis=1, initial=np.inf)[:, None]) / 2
                query, cell = np.nonzero((np.isfinite(radius)) & (gaps - radius <= bound[:, None]) & (plane <= bound[:, None]))
                took = pa.array(query)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(cell, pa.int32())], names=["query_id", "q", "cell"])

        kind = T.StructType([T.StructField("query_id", query_kind), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
        going = saved(asked.mapInArrow(sent, kind))
        parts = F.create_map(*[F.lit(x) for c, n in tiles.items() for x in (c, n)])[F.col("cell")]
        blocks = placed.withColumn("tile", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).groupBy("cell", "tile").agg(F.collect_list(F.struct("id", "v")).alias("data"))
        shares = going.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).alias("shares"))  # a row for each pivot at most
        dealt = going.join(F.broadcast(shares), "cell").withColumn("share", F.pmod(F.monotonically_increasing_id(), F.col("shares")))
        groups = dealt.groupBy("cell", "share").agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
        groups = groups.withColumn("tile", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        met = groups.join(blocks, ["cell", "tile"]).select("queries", "data")

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    of, data = batch.column(0)[i].values, batch.column(1)[i].values
                    x, y = (_matrix(side.field(1), unit) for side in (of, data))
                    score = np.round(x @ y.T if unit else -_gaps(x, y), DIGITS)
                    found = [(q, j) for q in range(len(x)) for j in _least(-score[q], k).tolist()]
                    at, near = (np.array([f[c] for f in found], np.int64) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([of.field(0).take(pa.array(at)), data.field(0).take(pa.array(near)), pa.array(score[at, near])], names=["query_id", "id", "score"])

        best = met.mapInArrow(scored, out)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return saved(best.withColumn("place", place).where(F.col("place") <= k), keep=True).withColumnRenamed("id", id_col)


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """Places of all values up to the k-th least, with its ties."""
    if len(values) <= k:
        return np.arange(len(values))
    return np.flatnonzero(values <= np.partition(values, k - 1)[k - 1])
