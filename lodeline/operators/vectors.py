"""Nearest vectors by matrix products: exact within a key, or approximate through a partitioned index of cells.

Vectors and queries with the same key meet in blocks of ROWS by ROWS rows, each
in a task that holds one block of queries with their best hits so far and sees
the vectors batch by batch; neither a hot key nor many queries fill a task. An
index adds the nearest of a set of centroids to the key. These are trained on a
bounded sample; every row gets its cell, and a query looks into the nearest few.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: Queries, and vectors, that meet in a task; vectors at a time there.
ROWS, BATCH = 2048, 4096
DECIMALS = 6
#: Vectors on which centroids are trained at most, cells at most, cells that a query looks into, and queries by which that number is chosen.
SAMPLE, CELLS, PROBES, TRIED = 20_000, 1024, 8, 256


def matrix(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of an array that have ``d`` finite entries (None: as many as the first) and aren't zero, and these as unit rows."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    d = d if d is not None else int(lengths[lengths > 0][0]) if (lengths > 0).any() else 0
    at = np.flatnonzero((lengths == d) & (d > 0))
    if not len(at):
        return at, np.zeros((0, d))
    rows = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    size = np.sqrt((rows * rows).sum(axis=1))
    ok = np.isfinite(size) & (size > 0)
    return at[ok], rows[ok] / size[ok][:, None]


class Best:
    """The ``most`` best hits of each of some queries, the earlier of equals, among vectors that come in order."""

    def __init__(self, queries: np.ndarray, most: int):
        self.queries, self.most, self.count = queries, most, 0
        self.row, self.score, self.place = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.ids: list = []
        self.floor = np.full(len(queries), -np.inf)

    def see(self, vectors: np.ndarray, ids: list) -> None:
        scores = np.round(self.queries @ vectors.T, DECIMALS)
        row, column = np.nonzero(scores > self.floor[:, None])
        if not len(row):
            return
        # only hits are kept, so the ids held are at most ``most`` a query and those of one batch
        row, score = np.concatenate((self.row, row)), np.concatenate((self.score, scores[row, column]))
        place = np.concatenate((self.place, len(self.ids) + column))
        held = self.ids + ids
        order = np.lexsort((place, -score, row))
        row, score, place = row[order], score[order], place[order]
        begins = np.concatenate(([True], row[1:] != row[:-1]))
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0))
        ok = rank < self.most
        self.row, self.score = row[ok], score[ok]
        self.floor[row[rank == self.most - 1]] = score[rank == self.most - 1]
        used, self.place = np.unique(place[ok], return_inverse=True)
        self.ids = [held[i] for i in used.tolist()]


def _scored(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: tuple | None = None
        asked: list[tuple[list, np.ndarray]] = []
        best: Best | None = None
        waiting: list[tuple[np.ndarray, list]] = []
        names: list = []
        kinds: list = []

        def flush() -> None:
            if best is not None and waiting:
                best.see(np.concatenate([v for v, _ in waiting]), [i for _, ids in waiting for i in ids])
                waiting.clear()

        def result() -> Iterator[pa.RecordBatch]:
            flush()
            if best is not None and len(best.row):
                ids = pa.array([best.ids[i] for i in best.place.tolist()], kinds[1])
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in best.row.tolist()], kinds[0]), ids, pa.array(best.score)], ["query_id", "id", "similarity"])

        for batch in batches:
            kinds = [batch.schema.field(4).type, batch.schema.field(5).type]
            held = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            low = 0
            while low < len(held):
                high = low + 1
                while high < len(held) and held[high] == held[low]:
                    high += 1
                key, side = held[low][:3], held[low][3]
                if key != part:
                    yield from result()
                    part, asked, best, names = key, [], None, []
                    waiting.clear()
                rows = batch.slice(low, high - low)
                if side == 0:
                    at, unit = matrix(rows.column(6), asked[0][1].shape[1] if asked else None)
                    if len(at):
                        asked.append((rows.column(4).take(pa.array(at)).to_pylist(), unit))
                elif asked:
                    if best is None:
                        best, names = Best(np.concatenate([u for _, u in asked]), most), [i for ids, _ in asked for i in ids]
                    at, unit = matrix(rows.column(6), best.queries.shape[1])
                    if len(at):
                        waiting.append((unit, rows.column(5).take(pa.array(at)).to_pylist()))
                    if sum(len(i) for _, i in waiting) >= BATCH:
                        flush()
                low = high
        yield from result()

    return run


def _met(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, similarity): the best of each block, for vectors (key, id, v) and queries (key, query_id, v); a null key meets nothing."""
    count = lambda df, name: df.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias(name))
    sizes = count(vectors, "nv").join(count(queries, "nq"), "key").select("key", F.ceil(F.col("nv") / ROWS).cast("int").alias("nv"), F.ceil(F.col("nq") / ROWS).cast("int").alias("nq"))
    kind = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    dealt = lambda df, salt, own, other: df.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(salt), own).cast("int")).withColumn("all", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = dealt(queries, "query_id", F.col("nq"), "nv").select("key", F.col("all").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(kind[0]).alias("id"), "v")
    right = dealt(vectors, "id", F.col("nv"), "nq").select("key", F.col("own").alias("i"), F.col("all").alias("j"), F.lit(1).alias("side"), F.lit(None).cast(kind[1]).alias("query_id"), "id", "v")
    both = left.select("key", "i", "j", "side", "query_id", "id", "v").unionByName(right.withColumn("id", F.col("id").cast(kind[0])))
    rows = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
    return rows.mapInArrow(_scored(most), f"query_id {kind[1]}, id {kind[0]}, similarity double")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query_id", "category").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most).select("query_id", "category", "id", "similarity", "rank")


def _named(df: DataFrame, id_col: str, vector: str, category: str | None, as_: str) -> DataFrame:
    return df.select(F.col(id_col).alias(as_), F.col(vector).alias("v"), (F.col(category) if category else F.lit(0)).alias("category"))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, category: str | None, query_id: str, query_vector: str, most: int = 15) -> DataFrame:
    """(query_id, category, id, similarity, rank): the exact nearest vectors by cosine, to DECIMALS, within each query's category.

    A query's own row counts among its hits; of equals the smaller id comes first.
    Vectors that are null, zero, of another length than the query's, or hold an
    entry that isn't finite, and null categories, are nowhere a hit. A query_id
    has one category; there may be as many queries as vectors.
    """
    q = _named(queries, query_id, query_vector, category, "query_id")
    found = _met(_named(vectors, id_col, vector, category, "id").withColumnRenamed("category", "key"), q.withColumnRenamed("category", "key"), most)
    return _ranked(found.join(q.select("query_id", "category").distinct(), "query_id"), most)


@dataclass(frozen=True)
class Index:
    """Rows (id, v, category, cell), partitioned by cell where they were written, and the centroids of the cells."""

    rows: DataFrame
    centroids: np.ndarray


def train_cells(vectors: DataFrame, id_col: str, vector: str, cells: int | None = None, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids, by spherical k-means on about ``sample`` vectors drawn by the hash of their id.

    ``cells`` is the square root of the rows, and CELLS at most, unless given.
    """
    able = vectors.where(F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda t, x: t + x * x).between(1e-300, 1e300))
    n = able.count()
    if not n:
        return np.zeros((0, 0))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) * F.lit(2.0**-53)
    # vectors of another length than most have no place among the centroids
    lengths = able.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    held = able.where((u < sample / n) & (F.size(vector) == lengths["d"]))
    count = held.count()
    if not count:
        return np.zeros((0, lengths["d"]))
    k = max(1, min(cells or int(n**0.5), CELLS, count))
    if k == 1:
        means = held.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
        centres = [[r.m for r in means]]
    else:
        told = held.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("x"))
        centres = KMeans(k=k, seed=seed, maxIter=15, distanceMeasure="cosine", featuresCol="x").fit(told).clusterCenters()
    rows = np.array(centres)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-300)[:, None]


def with_cells(rows: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """``rows``, which have a column v, with a column cell: the nearest centroid, a row for each of the nearest ``probes``.

    Vectors that have no place (see nearest()) get cell -1.
    """
    names, at_v = [*rows.columns, "cell"], rows.columns.index("v")
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at, unit = matrix(batch.column(at_v), held.shape[1]) if len(held) else (np.zeros(0, np.int64), None)
            k = max(1, min(probes, len(held)))
            cells = np.full((batch.num_rows, k), -1, np.int32)
            if len(at):
                scores = unit @ held.T
                cells[at] = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < len(held) else np.arange(len(held))
            keep = np.ones((batch.num_rows, k), bool)
            keep[:, 1:] = cells[:, 1:] >= 0
            own = np.nonzero(keep)[0]
            out = batch.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells[keep])], names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int")


def build(vectors: DataFrame, id_col: str, vector: str, category: str | None, path: str, cells: int | None = None, seed: int = 42, sample: int = SAMPLE) -> Index:
    """Train centroids, give every row its cell, and write rows and centroids under ``path``; a crowded cell is written by several tasks."""
    spark = vectors.sparkSession
    centroids = train_cells(vectors, id_col, vector, cells, seed, sample)
    rows = with_cells(_named(vectors, id_col, vector, category, "id"), centroids)
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    # without a row there is no file to tell the columns
    spark.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that build() has written."""
    held = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()["schema"]))
    return Index(spark.read.schema(schema).parquet(f"{path}/rows"), np.array([r.v for r in held]) if held else np.zeros((0, 0)))


def search(index: Index, queries: DataFrame, category: str | None, query_id: str, query_vector: str, most: int = 15, probes: int = PROBES) -> DataFrame:
    """As nearest(), but only among the vectors of the ``probes`` cells whose centroids are nearest to a query; with all cells it is exact."""
    q = _named(queries, query_id, query_vector, category, "query_id")
    asked = with_cells(q, index.centroids, probes).where("cell >= 0")
    key = F.concat_ws(",", F.col("cell"), F.col("category").cast("string"))
    whole: Column = F.when(F.col("category").isNotNull(), key)
    # the cells that are asked for prune the index's partitions
    rows = index.rows.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")
    found = _met(rows.select("id", "v", whole.alias("key")), asked.select("query_id", "v", whole.alias("key")), most)
    return _ranked(found.join(q.select("query_id", "category").distinct(), "query_id"), most)


def probes_for(index: Index, queries: DataFrame, category: str | None, query_id: str, query_vector: str, most: int = 15, recall: float = 0.9) -> int:
    """How many cells a query has to look into for this recall, by the exact hits of about TRIED queries drawn by the hash of their id.

    A hit is found if its cell is among the query's nearest, so the share of the
    hits' cells up to a rank is the recall of so many probes; a twentieth of what
    may still be missed is asked for on top, for what the draw doesn't tell.
    """
    q = _named(queries, query_id, query_vector, category, "query_id")
    n = q.count()
    u = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("query_id")), 11) * F.lit(2.0**-53)
    tried = q.where(u < TRIED / max(n, 1)).limit(4 * TRIED)
    rows = index.rows.select("id", "v", "category")
    hits = nearest(rows, tried, "id", "v", "category", "query_id", "v", most).select("query_id", "id")
    found = hits.join(index.rows.select("id", "cell"), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).join(tried.dropDuplicates(["query_id"]), "query_id").select("cells", "v").collect()
    ranks: list[int] = []
    for row in found:
        v = np.array(row.v, np.float64)
        order = np.argsort(-(index.centroids @ v), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        ranks += place[np.array(row.cells)].tolist()
    if not ranks:
        return min(PROBES, max(len(index.centroids), 1))
    return int(np.quantile(ranks, min(1.0, recall + (1 - recall) / 20), method="higher"))
