"""Helpers shared by the corpus operators: tables between steps, fixed-size
bitmaps and counters gathered from all rows, connected components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDER = "/tmp/driftline"

#: Rows of plain longs that a task takes at least.
TASK_ROWS = 20_000

_written: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset, a folder of our own if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _LOCAL_FOLDER).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, so that later
    steps neither compute it again nor depend on the executors that made it.
    The result has `rows`, their number (or more, where tasks ran twice)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    seen = Observation()
    with small_batches(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at, out.rows = path, int(seen.get["rows"])
    _written.append(out)
    return out


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than `rows` rows deserve; never in more than it has."""
    return df.coalesce(max(4, -(-rows // TASK_ROWS)))


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes on leaving all tables that stored() wrote inside; results must have been written or counted by then."""
    before = len(_written)
    try:
        yield
    finally:
        discard(*_written[before:])


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that stored() wrote, once nothing that is still to be computed reads them."""
    for t in tables:
        if t is not None:
            remove(t.sparkSession, t.stored_at)
            _written[:] = [w for w in _written if w is not t]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow and Parquet batches of few rows while an action runs: rows here hold whole texts or sets."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.columnarReaderBatchSize": "512"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() or an index wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of an id written as decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """docs joined with about `sample` rows of labels, chosen by a hash of the id.

    The chosen labels are a table of bounded size, so Spark can broadcast it
    and no text is shuffled. Labels with a null id are left out.
    """
    labels = labels.where(F.col(id_col).isNotNull())
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    return docs.join(stored(chosen.coalesce(1), "labels"), id_col)


# --- arrays of a fixed size, gathered from all rows -------------------------

_PARTS = 16


def gathered(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, kind: str, join: str) -> np.ndarray:
    """One numpy array of a fixed size made from all rows of df.

    fill(array, batch) updates a task's own array. The tasks' arrays are cut
    into parts, and the parts are combined by join ("add" or "or") on the
    executors before the driver gets them, so the driver receives `size`
    elements whatever the number of rows. size must be a multiple of 16.
    """
    step = size // _PARTS
    spread = 64  # ways that tasks share the first round of combining

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=kind)
        seen = False
        for b in batches:
            if b.num_rows:
                seen = True
                fill(own, b)
        if seen:
            salt = TaskContext.get().partitionId() % spread  # the same when a lost task runs again
            for k in range(_PARTS):
                part = own[k * step : (k + 1) * step]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "s": pa.array([salt], pa.int32()), "v": pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(2)):
                part = np.frombuffer(pa.decompress(v.as_py(), step * np.dtype(kind).itemsize, codec="zstd"), dtype=kind)
                if k not in total:
                    total[k] = part.copy()
                elif join == "or":
                    total[k] |= part
                else:
                    total[k] += part
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "s": pa.array([0], pa.int32()), "v": pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    shape = "k int, s int, v binary"
    parts = df.mapInArrow(local, shape)
    parts = parts.repartition(_PARTS, "k", "s").mapInArrow(combine, shape).repartition(_PARTS, "k").mapInArrow(combine, shape)
    out = np.zeros(size, dtype=kind)
    with small_batches(df.sparkSession):
        got = parts.collect()
    for row in got:
        part = np.frombuffer(pa.decompress(bytes(row.v), step * np.dtype(kind).itemsize, codec="zstd"), dtype=kind)
        view = out[row.k * step : (row.k + 1) * step]
        if join == "or":
            view |= part
        else:
            view += part
    return out


class Bloom:
    """A Bloom filter over 64-bit keys with three probes.

    Its size is a power of two of bits between 2**16 and `max_bits`, so that
    what is broadcast is bounded. A full filter lets more keys pass, never
    fewer: it saves work and decides nothing.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size_for(keys: int, max_bits: int) -> int:
        return int(min(max_bits, max(1 << 16, 1 << int(max(1, 10 * keys) - 1).bit_length())))

    @staticmethod
    def _places(keys: np.ndarray, n_bits: int) -> list[np.ndarray]:
        h = keys.astype(np.uint64)
        out = []
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25):
            x = h * np.uint64(c)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out.append((x >> np.uint64(64 - (n_bits.bit_length() - 1))).astype(np.int64))
        return out

    @classmethod
    def of(cls, df: DataFrame, *keys: str, max_bits: int = 1 << 26) -> Bloom:
        """A filter of the values of long columns of a stored table, made by a few tasks.

        Of so many values that the filter would be more than half full, it is
        one that passes everything.
        """
        values = df.rows * len(keys)
        if 5 * values > max_bits:
            return cls(np.full(1 << 13, 255, dtype=np.uint8))
        n_bits = cls.size_for(values, max_bits)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(n_bits // 8, dtype=np.uint8)
            for batch in batches:
                for column in batch.columns:
                    for at in cls._places(column.drop_null().to_numpy(zero_copy_only=False), n_bits):
                        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([pa.compress(own.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["v"])

        bits = np.zeros(n_bits // 8, dtype=np.uint8)
        for row in df.select(*keys).coalesce(max(1, min(16, values >> 20))).mapInArrow(local, "v binary").collect():
            bits |= np.frombuffer(pa.decompress(bytes(row.v), len(bits), codec="zstd"), dtype=np.uint8)
        return cls(bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self._places(keys, len(self.bits) * 8):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def filtered(df: DataFrame, bloom: Bloom, id_col: str, inside: bool) -> DataFrame:
    """The rows of df whose id passes the filter, or the others; a null id never passes."""
    sent = df.sparkSession.sparkContext.broadcast(bloom)
    place = df.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(place)
            hit = sent.value.has(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(run, df.schema)


# --- connected components ---------------------------------------------------


#: Links that one task settles, at 16 bytes each.
LOCAL_LINKS = 1 << 22


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of links a[i], b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame, name: str = "links", max_rounds: int = 60, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) for each node of links (a long, b long), a stored
    table: component is the smallest node that it reaches.

    Up to `local` links, at 16 bytes each, are settled by one task. More go
    through rounds of the large-star and small-star steps of Kiveris et al.
    (2014) until no link changes. Each step is an aggregation by node with a
    join back, and each round's links are a table in the shared folder;
    nothing of the graph comes to the driver but a count and a checksum. The
    least neighbours are stored before they join back: a join of two plain
    shuffles can split a node that holds a large part of all links, one with
    an aggregate below it can not.
    """
    if links.rows <= local:

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                a, b = (np.concatenate([x.column(c).to_numpy() for x in got]) for c in ("a", "b"))
                nodes, label = least_labels(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["node", "component"])

        own = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
        return stored(own.coalesce(1).mapInArrow(settle, "node long, component long"), "components")

    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), name)
        large = stored(both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        low2 = stored(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"), name)
        small = large.join(low2, large.a == low2.n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, edges = edges, stored(small, name)
        discard(before, low, large, low2)
        got = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        now = (got["n"], got["s"])
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
