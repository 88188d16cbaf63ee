"""Vector search for a table of queries on a stored index of coarse lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from crewlake.session import kept, new_folder

#: Rows the lists' centres are fitted on, and the most lists there are; every row is indexed.
SAMPLE, LISTS = 20_000, 4096
#: Vectors and queries that meet in one group; small lists share a group, larger lists and more queries are split.
SHARD, TOGETHER = 4096, 8192
#: Queries of a group whose products are held at once, and products of them that are computed again in full at once.
HELD, AGAIN = 256, 1 << 15
#: Sampled rows and queries among them on which the number of lists to look into is measured, and the recall it must reach.
MEASURED, ASKED, RECALL = 5_000, 200, 0.95
#: More than twice what a product of two unit vectors can be off by, per dimension.
ROUNDING = 1e-14
#: Lists in the first wave of an exact search, and how many times more lists each further wave looks into.
WAVE, GROWTH = 16, 16


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without NULLs as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _probes(m: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """Lists to look into so that ``RECALL`` of the nearest rows of a sample are found.

    Neighbours in a sample are farther apart than in all rows, so all rows do no worse.
    """
    if not len(m):
        return 1
    m = _unit(m)
    home, asks = (m @ centres.T).argmax(axis=1), m[:ASKED]
    near = np.argsort(-(asks @ m.T), axis=1)[:, 1: k + 1]
    place = np.argsort(np.argsort(-(asks @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], 1).reshape(-1)) + 1
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) if len(needed) else 1


def _usable(v: Column, width: int) -> Column:
    """Vectors of the index's width that have a direction."""
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return (F.size(v) == width) & (size > 0) & (size < float("inf"))


class VectorIndex:
    """Vectors in lists around centres.

    ``vectors`` (list, shard, item, v), sorted by list and shard; ``lists`` (list, n, shards, radius, centre), the radius being
    the widest angle of a list's vectors to its centre; ``fit`` (probes), the lists that an approximate search looks into.  Vectors that are NULL, without length or of another width than the first
    ones are similar to nothing and are in no list.  A list of very many (or equal) vectors is split into shards.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.vectors, self.lists = (spark.read.parquet(f"{root}/{name}") for name in ("vectors", "lists"))
        rows = self.lists.orderBy("list").toArrow()  # at most LISTS rows
        self.centres, self.radius = _matrix(rows.column("centre")), rows.column("radius").to_numpy()
        self.names = rows.column("list").to_numpy()
        self.bands = self._bands(rows.column("n").to_numpy(), rows.column("shards").to_numpy())
        self.probes = spark.read.parquet(f"{root}/fit").first().probes

    @classmethod
    def build(cls, items: DataFrame, item: str, vector: str, lists: int | None = None, root: str | None = None) -> VectorIndex:
        """Fit ``lists`` centres (by default the square root of the rows, ``LISTS`` at most) and put every row into its list."""
        spark = items.sparkSession
        root = root or new_folder(spark, "vectors")
        all_rows = items.select(F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
        width, n = all_rows.agg(F.coalesce(F.mode(F.size("v")), F.lit(0)), F.count("*")).first()
        rows = all_rows.filter(_usable(F.col("v"), width))
        fitted = rows.orderBy(F.xxhash64("item", "v"), "v").limit(SAMPLE)
        k = max(1, min(lists or int(n ** 0.5), LISTS))
        if fitted.isEmpty():
            centres = np.zeros((0, max(width, 1)))
        else:
            model = KMeans(k=max(k, 2), seed=1, distanceMeasure="cosine", maxIter=10).fit(fitted.select(array_to_vector("v").alias("features")))
            centres = _unit(np.array(model.clusterCenters()))
        tried = _matrix(fitted.select("v").limit(MEASURED).toArrow().column("v"))
        spark.createDataFrame([(_probes(tried, centres),)], "probes int").coalesce(1).write.parquet(f"{root}/fit")
        shared = spark.sparkContext.broadcast(centres)  # at most LISTS vectors
        schema = StructType([StructField("list", IntegerType()), StructField("angle", DoubleType()), StructField("turn", IntegerType()), *rows.schema.fields])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in batches:
                if batch.num_rows:
                    near = _unit(_matrix(batch.column("v"))) @ shared.value.T
                    best = near.argmax(axis=1)
                    turn, seen = (seen + np.arange(len(best))) % (1 << 30), seen + len(best)
                    angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(angle), pa.array(turn.astype(np.int32)), *batch.columns], schema.names)

        placed = kept(rows.mapInArrow(place, schema))
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        at = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        known = kept(sizes.withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int")).join(at, "list").select(
            "list", "n", "shards", "radius", "centre"), f"{root}/lists")
        dealt = placed.join(known.select("list", "shards"), "list").select(
            "list", F.pmod("turn", "shards").cast("int").alias("shard"), "item", "v")  # stored turns: a rerun deals alike
        dealt.repartitionByRange("list", "shard").sortWithinPartitions("list", "shard").write.parquet(f"{root}/vectors")
        return cls(spark, root)

    def _bands(self, sizes: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Per number of a list its band: neighbouring lists of ``SHARD`` vectors together, or a list that is split."""
        bands, band, filled = np.zeros(int(self.names.max()) + 1 if len(self.names) else 1, np.int32), -1, SHARD
        for name, n, parts in zip(self.names, sizes.tolist(), shards.tolist()):
            if parts > 1 or filled + n > SHARD:
                band, filled = band + 1, 0
            bands[name], filled = band, SHARD if parts > 1 else filled + n
        return bands

    def _plan(self, asked: DataFrame, exact: bool) -> DataFrame:
        """Each query's lists, the most promising first, with the greatest similarity that a vector of the list can have."""
        shared = self.spark.sparkContext.broadcast((self.centres, self.radius, self.names))
        schema = StructType([*asked.schema.fields, StructField("lists", ArrayType(IntegerType())), StructField("most", ArrayType(FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius, names = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = np.clip(_unit(_matrix(batch.column("q"))) @ centres.T, -1, 1)
                most = np.cos(np.maximum(np.arccos(near) - radius, 0.0)) + 1e-6  # above any rounding
                order = np.argsort(-(most if exact else near), axis=1, kind="stable")
                ends = pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(names[order].astype(np.int32).reshape(-1))),
                     pa.ListArray.from_arrays(ends, pa.array(np.take_along_axis(most, order, 1).astype(np.float32).reshape(-1)))], schema.names)

        return asked.mapInArrow(run, schema)

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int = 5, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, item, rank, score): the ``k`` most similar items of each query, those of similarity above 0 only.

        All similarities are computed in full; equal ones rank by item.  ``probes`` lists are looked into,
        by default as many as the sample asked for; with ``exact`` waves of
        further lists follow until the angle between a query and what is left of a list cannot beat the ``k``-th item, so that the
        result equals a scan.  Queries are rows with different ids; those without a direction or of another width have no hits.
        """
        width = self.centres.shape[1]
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).filter("q IS NOT NULL").filter(
            _usable(F.col("q"), width))
        left = kept(self._plan(asked, exact).withColumn("least", F.lit(0.0)))
        schema = StructType([left.schema["query_id"], self.vectors.schema["item"], StructField("raw", DoubleType())])
        best, ranked = self.spark.createDataFrame([], schema), Window.partitionBy("query_id").orderBy(F.desc("raw"), "item")
        first, wave = 0, probes or (min(WAVE, self.probes) if exact else self.probes)
        while first < len(self.names):
            found = kept(self._meet(kept(self._looks(left, first, wave)), k, schema))
            best = kept(best.unionByName(found).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= int(k)))
            first, wave = first + wave, wave * GROWTH
            if not exact:
                break
            last = best.filter(F.col("rank") == int(k)).select("query_id", F.col("raw").alias("kth"))
            left = left.join(last, "query_id", "left").withColumn("least", F.coalesce("kth", F.lit(0.0))).drop("kth")
            left = kept(left.filter(F.get("most", F.lit(first)) >= F.col("least")))
            if left.isEmpty():
                break
            best = best.drop("rank")
        return best.select("query_id", "item", F.row_number().over(ranked).alias("rank"), F.round("raw", 4).alias("score"))

    def _looks(self, left: DataFrame, first: int, wave: int) -> DataFrame:
        """(query_id, q, least, band, lists): the next ``wave`` lists of every query that can still matter, by band."""
        shared = self.spark.sparkContext.broadcast(self.bands)
        schema = StructType([*left.select("query_id", "q", "least").schema.fields, StructField("band", IntegerType()), StructField("lists", ArrayType(IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists, most = (_matrix(batch.column(c))[:, first:first + wave] for c in ("lists", "most"))
                row, at = np.nonzero(most >= batch.column("least").to_numpy()[:, None])
                name = lists[row, at]
                band = shared.value[name]
                order = np.lexsort((name, band, row))
                row, name, band = row[order], name[order], band[order]
                edge = np.flatnonzero(np.concatenate(([True] * (len(row) > 0), (row[1:] != row[:-1]) | (band[1:] != band[:-1]))))
                some = batch.select(["query_id", "q", "least"]).take(pa.array(row[edge]))
                asked = pa.ListArray.from_arrays(pa.array(np.append(edge, len(row)).astype(np.int32)), pa.array(name.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(band[edge]), asked], schema.names)

        return left.mapInArrow(run, schema)

    def _meet(self, looks: DataFrame, k: int, schema: StructType) -> DataFrame:
        """The best ``k`` items of every query, as good as its ``least``, among the vectors of each band and shard it looks into."""
        asked = looks.groupBy("band").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups"))
        bands = self.spark.createDataFrame([(int(n), int(self.bands[n])) for n in self.names], "list int, band int")  # at most LISTS rows
        lists = self.lists.select("list", "shards").join(bands, "list").join(asked, "band")
        shards = lists.groupBy("band").agg(F.max("shards").alias("shards"), F.first("groups").alias("groups"))
        right = looks.join(shards, "band").select("band", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(
            F.xxhash64("query_id"), F.col("groups")).cast("int").alias("part"), "query_id", "q", "least", "lists")
        left = self.vectors.join(lists.select("list", "band", "groups"), "list").select(
            "band", "shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "list", "item", "v")

        def meet(items: pa.Table, queries: pa.Table) -> pa.Table:
            kinds = queries.schema.field("query_id").type, items.schema.field("item").type, pa.float64()
            picked = [pa.table([pa.array([], kind) for kind in kinds], names=schema.names)]
            if not items.num_rows or not queries.num_rows:
                return picked[0]
            items = items.take(pc.sort_indices(items.column("item"), null_placement="at_start"))
            names, own = items.column("item").combine_chunks(), items.column("list").to_numpy()
            m = _matrix(items.column("v"))
            long = np.sqrt((m * m).sum(axis=1))
            for start in range(0, queries.num_rows, HELD):
                some = queries.slice(start, HELD)
                asks, least = _matrix(some.column("q")), some.column("least").to_numpy()
                size = np.sqrt((asks * asks).sum(axis=1))
                wanted = some.column("lists").combine_chunks()
                open_lists = np.zeros((len(asks), int(own.max()) + 1), bool)
                at = wanted.flatten().to_numpy()
                there = at < open_lists.shape[1]
                open_lists[np.repeat(np.arange(len(asks)), wanted.value_lengths().to_numpy())[there], at[there]] = True
                # the products of all with all tell which items may be among the best, whatever was rounded
                near = asks @ m.T / long
                near[~open_lists[:, own]] = -np.inf
                floor = np.partition(near, len(m) - k, axis=1)[:, len(m) - k] if k < len(m) else np.full(len(asks), -np.inf)
                slack = np.where(size * long.min() < 1e-280, 1e300, ROUNDING * m.shape[1] * size)  # digits are lost near zero
                row, at = np.nonzero(near >= np.maximum(np.maximum(floor, least * size) - slack, -1e301)[:, None])
                raw = np.concatenate([np.zeros(0)] + [  # row sums: equal vectors have equal similarities wherever they are
                    (m[a] * asks[r]).sum(axis=1) / (long[a] * size[r]) for r, a in ((row[x:x + AGAIN], at[x:x + AGAIN]) for x in range(0, len(row), AGAIN))])
                order = np.lexsort((at, -raw, row))
                row, at, raw = row[order], at[order], raw[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                good = (rank < k) & (raw > 0) & (raw >= least[row])
                picked.append(pa.table([some.column("query_id").take(pa.array(row[good])), names.take(pa.array(at[good])), pa.array(raw[good])], names=schema.names))
            return pa.concat_tables(picked)

        keys = ["band", "shard", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
