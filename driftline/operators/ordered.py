"""Order-dependent primitives: previous and next rows, running sums, last and next valid values.

Usually the number of series is the parallel axis and a window over a series is
one task of bounded size (a sensor's record). Where one series is too long for
a task, chunks cut it: with chunk_us, or the setting driftline.chunk_us of the
session, work inside a chunk of time is a window over (series, chunk), and what
must pass from chunk to chunk (the last row, the last valid value, a sum) is
one summary row a chunk; only those rows meet in a window over the series. A
chunked step reads its input twice, so the input is written to the shared
folder first, which also keeps plans of several steps short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

DAY_US = 86_400_000_000


def with_micros(df: DataFrame, ts: str = "ts") -> DataFrame:
    """df with `us`, microseconds since 1970 (UTC), of a timestamp column with or without zone."""
    return df.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))


class Ordered:
    """Rows of (series, us) in order; each method returns a new Ordered with one more column.

    series: key columns; us: a bigint that orders a series (ties break by `tie`
    columns); chunk_us: length of a chunk, None for whole series.
    """

    def __init__(self, df: DataFrame, series: list[str], us: str = "us", tie: list[str] | None = None, chunk_us: int | None = None):
        setting = df.sparkSession.conf.get("driftline.chunk_us", None)
        self.series, self.us, self.tie = list(series), us, list(tie or [])
        self.chunk_us = chunk_us or (int(setting) if setting else None)
        self.df = df.withColumn("__chunk", F.floor(F.col(us) / F.lit(self.chunk_us)).cast("long")) if self.chunk_us else df

    def _with(self, df: DataFrame) -> Ordered:
        out = Ordered.__new__(Ordered)
        out.__dict__.update(self.__dict__)
        out.df = df
        return out

    @property
    def _key(self) -> list[str]:
        return [*self.series, "__chunk"]

    @property
    def _local(self):
        return Window.partitionBy(*(self._key if self.chunk_us else self.series)).orderBy(self.us, *self.tie)

    @property
    def _chunks(self):
        return Window.partitionBy(*self.series).orderBy("__chunk")

    def _added(self, local: dict[str, Column], summary: dict[str, Column], carried: Column, name: str, value: Callable[[Column | None], Column]) -> Ordered:
        """name: value, from the columns local and, of chunks, __carry: `carried` over the chunks' summaries."""
        df = self.df.withColumns(local)
        if not self.chunk_us:
            return self._with(df.withColumn(name, value(None)).drop(*local))
        df = materialized(df)
        carry = df.groupBy(*self._key).agg(*(c.alias(n) for n, c in summary.items())).withColumn("__carry", carried).drop(*summary)
        out = df.join(carry, self._key, "left").withColumn(name, value(F.col("__carry")))
        return self._with(out.drop("__carry", *local))

    @property
    def _rank(self) -> Column:
        return F.struct(self.us, *self.tie)

    def done(self) -> DataFrame:
        return self.df.drop("__chunk")

    def previous(self, column: str, name: str) -> Ordered:
        """name: column's value in the row before, null in a series' first row."""
        near = F.lag(F.struct(column)).over(self._local)
        value = lambda carry: F.col(f"__n.{column}") if carry is None else F.when(F.col("__n").isNull(), carry[column]).otherwise(F.col(f"__n.{column}"))
        return self._added({"__n": near}, {"__v": F.max_by(F.struct(column), self._rank)}, F.lag("__v").over(self._chunks), name, value)

    def following(self, column: str, name: str) -> Ordered:
        """name: column's value in the row after, null in a series' last row."""
        near = F.lead(F.struct(column)).over(self._local)
        value = lambda carry: F.col(f"__n.{column}") if carry is None else F.when(F.col("__n").isNull(), carry[column]).otherwise(F.col(f"__n.{column}"))
        return self._added({"__n": near}, {"__v": F.min_by(F.struct(column), self._rank)}, F.lead("__v").over(self._chunks), name, value)

    def running_sum(self, column: Column | str, name: str, peers: bool = False) -> Ordered:
        """name: sum of an integer column up to and with the row; with peers, also with all rows that share its place in the order."""
        x = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(0))
        df = self._with(self.df.withColumn("__x", x))
        upto = self._local.rangeBetween if peers else self._local.rowsBetween
        local = F.sum("__x").over(upto(Window.unboundedPreceding, Window.currentRow))
        value = lambda carry: F.col("__n") if carry is None else F.col("__n") + F.coalesce(carry, F.lit(0))
        out = df._added({"__n": local}, {"__v": F.sum("__x")}, F.sum("__v").over(self._chunks.rowsBetween(Window.unboundedPreceding, -1)), name, value)
        return out._with(out.df.drop("__x"))

    def index(self, name: str) -> Ordered:
        """name: 0, 1, ... along each series."""
        out = self.running_sum(F.lit(1), name)
        return out._with(out.df.withColumn(name, F.col(name) - 1))

    def last_valid(self, columns: list[str], valid: Column, name: str) -> Ordered:
        """name: struct of columns of the last row up to and with this one where valid holds, or null."""
        df = self._with(self.df.withColumn("__h", F.when(valid, F.struct(*columns))))
        local = F.last("__h", ignorenulls=True).over(self._local.rowsBetween(Window.unboundedPreceding, 0))
        ends = F.max_by("__h", F.when(F.col("__h").isNotNull(), self._rank))
        value = lambda carry: F.col("__n") if carry is None else F.coalesce("__n", carry)
        out = df._added({"__n": local}, {"__v": ends}, F.last("__v", ignorenulls=True).over(self._chunks.rowsBetween(Window.unboundedPreceding, -1)), name, value)
        return out._with(out.df.drop("__h"))

    def next_valid(self, columns: list[str], valid: Column, name: str) -> Ordered:
        """name: struct of columns of the first row from this one on where valid holds, or null."""
        df = self._with(self.df.withColumn("__h", F.when(valid, F.struct(*columns))))
        # backwards: a frame that ends with the partition would be computed anew for each row
        keys = self._key if self.chunk_us else self.series
        back = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in (self.us, *self.tie))).rowsBetween(Window.unboundedPreceding, 0)
        local = F.last("__h", ignorenulls=True).over(back)
        begins = F.min_by("__h", F.when(F.col("__h").isNotNull(), self._rank))
        value = lambda carry: F.col("__n") if carry is None else F.coalesce("__n", carry)
        out = df._added({"__n": local}, {"__v": begins}, F.last("__v", ignorenulls=True).over(Window.partitionBy(*self.series).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)), name, value)
        return out._with(out.df.drop("__h"))


def first_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by order. An aggregation, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{c}").alias(c) for c in rest)).select(df.columns)


def with_halo(df: DataFrame, at: str, length: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """df in chunks of `length` along the bigint column `at`, each with copies of the rows up to back before and ahead after it.

    Adds __chunk, and __own, false for copies. A window over (series, __chunk)
    then has all rows that a frame of back and ahead can reach, and no task
    needs a whole series. length must be at least back and ahead.
    """
    if max(back, ahead) > length:
        raise ValueError("a chunk must be as long as the frame")
    own = F.floor(F.col(at) / F.lit(length)).cast("long")
    into = F.col(at) - own * length
    chunks = F.array(own, F.when(into >= length - back, own + 1) if back else F.lit(None).cast("long"), F.when(into < ahead, own - 1) if ahead else F.lit(None).cast("long"))
    out = df.withColumn("__chunk", F.explode(F.filter(chunks, lambda c: c.isNotNull())))
    return out.withColumn("__own", F.col("__chunk") == own)
