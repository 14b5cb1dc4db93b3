"""Nearest neighbours by cosine with multiprobe p-stable hashing.

Vectors are scaled to unit length, so that cosine and Euclidean nearness
agree. A table projects them on a few Gaussian directions and cuts each
projection into cells of one width; a bucket is one cell of each. For a query,
a neighbour at the calibrated cosine has a known normal distribution around
the query's own projections; so each bucket's chance of holding it is a product
of interval probabilities. The buckets of all tables are visited in one order,
from the best chance down, until the tables together reach the wanted recall.
The candidates are scored exactly on the original vectors in double precision
and merged.

The neighbours' cosine is calibrated on at most SAMPLE_QUERIES queries, held
against all rows. The numbers of tables and of directions are those that score
the fewest rows by the model above: the nearer the neighbours, the smaller the
buckets. Vectors without near neighbours need most buckets whatever the
numbers. There is no size under which rows are not hashed.

Buckets are read in blocks of bounded size, whatever they hold. Equal vectors
are searched once: a class of copies is one entry, and its smallest ids are
put in at the end. Vectors are compared with those of their own length. A
query that finds too few neighbours is compared with all rows, in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_QUERIES = 128
CELL_WIDTH = 1.1
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
CELLS_EACH_SIDE = 5
#: Visiting a bucket costs about as much as scoring so many rows.
PROBE_ROWS = 60
TABLES = (2, 3, 4)
MAX_DIRECTIONS = 10
#: Scores nearer than this are taken for ties until they are computed exactly.
TOLERANCE = 1e-9


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2.0)))


def _chances(p: np.ndarray, offset: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(log chances, cells), best first, of the cells around the projections p (queries, directions) of a neighbour at a cosine."""
    mean, sd = cosine * p + offset, math.sqrt(1.0 - cosine**2)
    near = np.floor(mean / CELL_WIDTH).astype(np.int64)[:, :, None] + np.arange(-CELLS_EACH_SIDE, CELLS_EACH_SIDE + 1)
    edges = (np.concatenate([near, near[:, :, -1:] + 1], axis=2) * CELL_WIDTH - mean[:, :, None]) / sd
    chance = np.diff(_normal_cdf(edges), axis=2)
    order = np.argsort(-chance, axis=2, kind="stable")
    return np.log(np.maximum(np.take_along_axis(chance, order, axis=2), 1e-300)), np.take_along_axis(near, order, axis=2)


def visits(log: list[list[list[float]]], recall: float, most: float = math.inf) -> list[tuple[int, tuple[int, ...]]]:
    """(table, place in each direction's list) of buckets in falling order of chance, until the tables together reach the recall.

    log[t][j] has the log chances of the cells of direction j of table t, best first.
    """
    m, width = len(log[0]), len(log[0][0])
    heap = [(-sum(row[0] for row in log[t]), t, 0, (0,) * m) for t in range(len(log))]
    heapq.heapify(heap)
    got, total = [], [0.0] * len(log)
    while heap and len(got) < most and 1.0 - math.prod(max(0.0, 1.0 - x) for x in total) < recall:
        cost, t, at, pick = heapq.heappop(heap)
        got.append((t, pick))
        total[t] += math.exp(-cost)
        for j in range(at, m):
            if pick[j] + 1 < width:
                heapq.heappush(heap, (cost + log[t][j][pick[j]] - log[t][j][pick[j] + 1], t, j, (*pick[:j], pick[j] + 1, *pick[j + 1 :])))
    return got


def shape_for(rows: int, recall: float, cosine: float, seed: int) -> tuple[int, int]:
    """(tables, directions) with the least expected work a query for so many rows, by the model on drawn projections."""
    rng, most = np.random.default_rng(seed), 3000
    best = (math.inf, TABLES[0], 1)
    for tables in TABLES:
        for m in range(1, MAX_DIRECTIONS + 1):
            work = []
            for _ in range(6):
                offset = rng.uniform(0, CELL_WIDTH, (tables, m))
                log, cells = _chances(rng.standard_normal((tables, m)), offset, cosine)
                got = visits(log.tolist(), recall, most)
                edge = cells * CELL_WIDTH - offset[:, :, None]
                mass = _normal_cdf(edge + CELL_WIDTH) - _normal_cdf(edge)
                work.append(PROBE_ROWS * len(got) + rows * sum(math.prod(mass[t, j, x] for j, x in enumerate(pick)) for t, pick in got) if len(got) < most else math.inf)
            best = min(best, (float(np.mean(work)), tables, m))
            if work[-1] > 4 * best[0]:
                break  # more directions cost more visits
    return best[1:]


class Tables:
    """Directions and offsets of all tables, for vectors of any length."""

    def __init__(self, rows: int, recall: float, cosine: float, seed: int):
        self.recall, self.seed = recall, seed
        self.cosine = min(max(cosine, 0.0), 0.9999)
        self.tables, self.m = shape_for(max(rows, 1), recall, self.cosine, seed)
        rng = np.random.default_rng(seed)
        self.offset = rng.uniform(0, CELL_WIDTH, (self.tables, self.m))
        self.weight = rng.integers(1, 1 << 62, (self.tables, self.m + 1), dtype=np.int64) | 1
        self._direction: dict[int, np.ndarray] = {}

    def direction(self, dim: int, t: int) -> np.ndarray:
        if dim not in self._direction:
            self._direction[dim] = np.random.default_rng([self.seed, dim]).standard_normal((self.tables, dim, self.m))
        return self._direction[dim][t]

    def keys(self, cells: np.ndarray, dim: int, t: int) -> np.ndarray:
        """One 64-bit key for each row of cells of table t."""
        out = np.full(len(cells), self.weight[t, self.m] ^ (dim << 20), dtype=np.int64)
        for j in range(self.m):
            out = (out ^ (cells[:, j] + 1_000_003) * self.weight[t, j]) * np.int64(0x2545F4914F6CDD1D)
        return out

    def bucket(self, unit: np.ndarray, t: int) -> np.ndarray:
        dim = unit.shape[1]
        return self.keys(np.floor((unit @ self.direction(dim, t) + self.offset[t]) / CELL_WIDTH).astype(np.int64), dim, t)

    def probes(self, unit: np.ndarray) -> list[np.ndarray]:
        """Keys to visit for each query, of all tables."""
        dim = unit.shape[1]
        log, cells = zip(*(_chances(unit @ self.direction(dim, t), self.offset[t], self.cosine) for t in range(self.tables)))
        log, out = [x.tolist() for x in log], []
        every = np.arange(self.m)
        for i in range(len(unit)):
            got = visits([x[i] for x in log], self.recall)
            own = []
            for t in range(self.tables):
                pick = np.array([p for u, p in got if u == t], dtype=np.int64).reshape(-1, self.m)
                own.append(self.keys(cells[t][i][every, pick], dim, t))
            out.append(np.concatenate(own))
        return out


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of binary vectors, for each length."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, _stacked(column.take(pa.array(at)))


def _stacked(column: pa.Array) -> np.ndarray:
    """Binary vectors of one length as rows of a matrix; never of no rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / big
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part; vec is their doubles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0), batch.column(1)):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    ids.append(i.as_py())
                    out.append((x + 0.0).tobytes())  # -0.0 and 0.0 are one
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(run, "vec_id long, vec binary")


def _best_of(near: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries that reach the m-th best of their row, ties included."""
    if near.shape[1] > m:
        least = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
        return np.nonzero(near >= least[:, None] - TOLERANCE)
    return tuple(x.reshape(-1) for x in np.indices(near.shape))


def _calibrated(classes: DataFrame, asks: DataFrame, count: int, k: int) -> float:
    """A low cosine of the k-th neighbour over a bounded sample of the queries, held against all rows."""
    part = min(1.0, SAMPLE_QUERIES / max(count, 1))
    got = asks.where(F.pmod(F.xxhash64("query", F.lit(7)), F.lit(1 << 20)) < part * (1 << 20)).select("vec").limit(2 * SAMPLE_QUERIES).collect()
    by: dict[int, np.ndarray] = {}
    for d in {len(r["vec"]) for r in got}:
        by[d] = _unit(np.stack([np.frombuffer(bytes(r["vec"])) for r in got if len(r["vec"]) == d]))
    if not by:
        return 0.0
    sent = classes.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {d: np.full((len(q), k + 1), -2.0) for d, q in sent.value.items()}
        for batch in batches:
            if batch.num_rows:
                for _, x in _by_length(batch.column(0)):
                    d = 8 * x.shape[1]
                    if d in top:
                        both = np.concatenate([top[d], sent.value[d] @ _unit(x).T], axis=1)
                        top[d] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -(k + 1) :]
        for d, x in top.items():
            at, _ = np.nonzero(x > -2.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d)), pa.array(at), pa.array(x[x > -2.0])], names=["d", "q", "c"])

    place = F.row_number().over(Window.partitionBy("d", "q").orderBy(F.desc("c")))
    kth = classes.select("vec").mapInArrow(run, "d long, q long, c double").withColumn("r", place).where(F.col("r") == k + 1).select("c").collect()
    return float(np.quantile([r["c"] for r in kth], 0.2)) if kth else 0.0


def _searched(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): the k best of each query in each block of (key) buckets that it visits."""
    rows = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    asks = probes.groupBy("key").agg(F.count(F.lit(1)).alias("q"))
    # stored, so that a bucket that holds a large part of all rows can be split in the joins
    blocks = common.stored(rows.join(asks, "key").select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("nb"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("qb")), "blocks")
    one = lambda col, n: F.pmod(F.xxhash64(col, F.lit(3)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(blocks, "key").withColumn("b", one("rep", "nb")).select("key", "b", all_of("qb").alias("c"), "rep", "vec")
    right = probes.join(blocks, "key").withColumn("c", one("query", "qb")).select("key", all_of("nb").alias("b"), "c", "query", F.col("vec").alias("qvec"))

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not have.num_rows or not ask.num_rows:
            return empty
        x, q = _stacked(have.column("vec").combine_chunks()), _stacked(ask.column("qvec").combine_chunks())
        rep, query = have.column("rep").to_numpy(), ask.column("query").to_numpy()
        near = _unit(q) @ _unit(x).T
        near[query[:, None] == rep[None, :]] = -9.0
        at, pick = _best_of(near, k + 1)
        score = cosines(q[at], x[pick])
        order = np.lexsort((rep[pick], -score, at))
        at, pick, score = at[order], pick[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = (place < k + 1) & (rep[pick] != query[at])
        return pa.table({"query": query[at[keep]], "rep": rep[pick[keep]], "score": score[keep]})

    return left.groupBy("key", "b", "c").cogroup(right.groupBy("key", "b", "c")).applyInArrow(run, "query long, rep long, score double")


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, query_modulus: int = 50, recall: float = 0.95, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by query_modulus.

    Every row is indexed and is a candidate but for the query itself. Null,
    zero and non-finite vectors and null ids take no part; vectors of another
    length are no candidates. Ties go to the smaller id. Rows that share an id
    and a vector count once; rows that share an id with other vectors are
    separate candidates of that id, and the best one counts. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    points = common.stored(_clean(df, id_col, vec_col).distinct(), "points")
    classes = common.stored(points.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    asks = points.where(F.pmod("vec_id", F.lit(query_modulus)) == 0).join(classes.select("vec", "rep", "copies"), "vec").select(F.col("vec_id").alias("query_id"), "rep", "copies", "vec")
    asks = common.stored(asks, "queries")
    ask_classes = asks.select(F.col("rep").alias("query"), "vec").distinct()
    model = Tables(classes.rows, recall, _calibrated(classes, ask_classes, asks.rows, k), seed)
    sent = spark.sparkContext.broadcast(model)
    # copies of one vector: its rep stands for it in the search, its k + 1 smallest ids return at the end
    salted = points.join(classes.where("copies > 1").select("vec", "rep"), "vec").select("rep", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("s"))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("rep", "s").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("rep", "vec_id")
    named = common.stored(classes.select("rep", F.col("rep").alias("vec_id")).unionByName(few).distinct(), "named")


    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for places, x in _by_length(batch.column(1)):
                    own = batch.take(pa.array(places))
                    for t in range(sent.value.tables):
                        yield pa.RecordBatch.from_arrays([pa.array(sent.value.bucket(_unit(x), t)), own.column(0), own.column(1)], names=["key", "rep", "vec"])

    def probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                for places, x in _by_length(batch.column(1)):
                    keys = sent.value.probes(_unit(x))
                    at = pa.array(np.repeat(places, [len(y) for y in keys]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "query", "vec"])

    index = common.stored(classes.select("rep", "vec").mapInArrow(index_rows, "key long, rep long, vec binary"), "index")
    probes = common.stored(ask_classes.select("query", "vec").mapInArrow(probe_rows, "key long, query long, vec binary"), "probes")
    found = common.stored(_searched(index, probes, k).groupBy("query", "rep").agg(F.max("score").alias("score")), "found")
    others = classes.groupBy(F.length("vec").alias("size")).agg((F.count(F.lit(1)) - 1).alias("others"))
    enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    short = ask_classes.withColumn("size", F.length("vec")).join(others, "size").join(enough, "query", "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), "others"))
    rest = common.stored(short.select("query", "vec", "size"), "rest")
    if rest.rows:
        parts = max(1, classes.rows // BLOCK_ROWS)
        key = lambda block, size: F.xxhash64(block, size)
        every_row = classes.select("rep", "vec").withColumn("key", key(F.pmod(F.xxhash64("rep"), F.lit(parts)), F.length("vec")))
        every_ask = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).cast("long")).select(key(F.col("block"), F.col("size")).alias("key"), "query", "vec")
        found = common.stored(found.unionByName(_searched(every_row, every_ask, k)).groupBy("query", "rep").agg(F.max("score").alias("score")), "found")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1).select("query", F.col("rep").alias("other"), "score")
    own = ask_classes.select("query", F.col("query").alias("other"), F.lit(1.0).alias("score"))
    lists = best.unionByName(own).join(named, F.col("other") == named.rep).select("query", "vec_id", "score")
    pairs = asks.select("query_id", "rep").join(lists, F.col("rep") == F.col("query")).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
