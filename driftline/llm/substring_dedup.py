"""Removal of repeated word windows with a log-structured fingerprint index.

A window is W consecutive words of one document. A word goes when a window
that covers it has the same words as a window of a document with a smaller id.

The index consists of immutable runs: tables bucketed and sorted by their keys,
so that runs are merge-joined with each other and with a new batch's run
without a shuffle or a sort of history. FANOUT runs of one level are merged
into one of the next. There are three such indexes:

* documents: digest of a whole document's words -> least id,
* anchors: an anchor -> least and greatest id that have it. A window's anchor
  is the least hash of the K-word stretches inside it (winnowing, Schleimer et
  al. 2003): equal windows have equal anchors, and there are only about
  2 / (W - K + 2) anchors a window,
* windows: digest of a window's words -> least id, of every window whose anchor
  two documents have.

A new batch is

1. fingerprinted; whole documents that repeat an earlier one are set aside,
2. merge-joined with the runs of anchors, which gives those that two documents
   share by now,
3. verified: its windows with a shared anchor are digested from their words
   (128 bits, cryptographic), and so are those of the one earlier document of
   an anchor that was not shared before; the others of history are in the
   index of windows already,
4. merge-joined with the runs of windows: the least id of each digest decides.

Of history only those single documents are read again. No pair of documents is
ever listed, and no list of an anchor's documents is kept: a passage that many
documents share costs one row for each of its windows in a batch.
Broadcast are Bloom filters of bounded size; one that would be too full lets
everything pass and changes no result.

Nulls, repeats: a null or empty text has no words. A null id takes no part
and keeps its words. Rows with equal id never remove each other's words.
Documents of under W words stay whole. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textkernel import Words, list_array, slices, sliding_min, window_hashes

FANOUT = 2


class FingerprintIndex:
    """Immutable runs of (keys, lo, hi): the least and greatest document id of each key.

    Each run is a Parquet table of one file a bucket, sorted by the keys; all
    runs of an index have the same buckets. The list of runs is a small JSON
    table, written anew with each change, so an index can be opened again and
    a run is never changed in place.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...]):
        self.spark, self.root, self.keys = spark, root, keys
        self.runs: list[dict] = []
        self.version = 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # one file a bucket: its order holds

    @classmethod
    def open(cls, spark: SparkSession, root: str, keys: tuple[str, ...]) -> FingerprintIndex:
        """The index at root, as its last list of runs has it; empty if there is none."""
        index = cls(spark, root, keys)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path):
            lists = [int(name[5:]) for f in files.listStatus(path) if (name := f.getPath().getName()).startswith("list-")]
            if lists:
                index.version = max(lists)
                index.runs = json.loads(spark.read.text(f"{root}/list-{index.version}").first()[0])
                index.buckets = index.runs[0]["buckets"] if index.runs else index.buckets
        return index

    def _commit(self, runs: list[dict]) -> None:
        self.version += 1
        self.spark.createDataFrame([(json.dumps(runs),)], "value string").coalesce(1).write.text(f"{self.root}/list-{self.version}")
        self.runs = runs

    def _table(self, run: dict) -> DataFrame:
        """A run as a table that Spark knows the buckets and order of."""
        if not self.spark.catalog.tableExists(run["name"]):
            keys = ", ".join(self.keys)
            shape = ", ".join(f"{c} long" for c in (*self.keys, "lo", "hi"))
            self.spark.sql(f"create table {run['name']} ({shape}) using parquet clustered by ({keys}) sorted by ({keys}) into {run['buckets']} buckets location '{run['path']}'")
        return self.spark.table(run["name"])

    def write(self, rows: DataFrame, level: int = 0) -> dict:
        """A run of rows, which have each key once; not yet listed."""
        path = common.new_path(self.spark, "run")
        run = {"name": f"run_{uuid.uuid4().hex}", "path": path, "level": level, "buckets": self.buckets}
        with common.small_batches(self.spark):
            rows.select(*self.keys, "lo", "hi").repartition(self.buckets, *self.keys).write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).saveAsTable(run["name"])
        return run

    def looked_up(self, run: dict) -> DataFrame:
        """keys, lo, hi of an unlisted run, with past_lo and past_hi of the listed ones (null where none has the key)."""
        out = self._table(run)
        past: dict[str, list[str]] = {"lo": [], "hi": []}
        for k, older in enumerate(self.runs):
            own = self._table(older).select(*self.keys, *(F.col(c).alias(f"{c}{k}") for c in past))
            out = out.hint("merge").join(own, list(self.keys), "left")
            for c in past:
                past[c].append(f"{c}{k}")
        of = lambda f, c: F.col(past[c][0]) if len(past[c]) == 1 else f(*past[c]) if past[c] else F.lit(None).cast("long")
        return out.select(*self.keys, "lo", "hi", of(F.least, "lo").alias("past_lo"), of(F.greatest, "hi").alias("past_hi"))

    def _merged(self, runs: list[dict]) -> DataFrame:
        """The runs as one; all have the same buckets, so nothing is shuffled."""
        out = self._table(runs[0])
        for run in runs[1:]:
            other = self._table(run).select(*(F.col(c).alias(f"{c}_") for c in (*self.keys, "lo", "hi")))
            same = [F.col(k) == F.col(f"{k}_") for k in self.keys]
            out = out.hint("merge").join(other, same, "full").select(
                *(F.coalesce(k, f"{k}_").alias(k) for k in self.keys), F.least("lo", "lo_").alias("lo"), F.greatest("hi", "hi_").alias("hi")
            )
        return out

    def read(self) -> DataFrame | None:
        """All runs as one."""
        return self._merged(self.runs) if self.runs else None

    def append(self, run: dict) -> None:
        """List a run, then merge full levels."""
        self._commit([*self.runs, run])
        level = 0
        while any(r["level"] >= level for r in self.runs):
            full = [r for r in self.runs if r["level"] == level]
            if len(full) >= FANOUT:
                self._commit([r for r in self.runs if r["level"] != level] + [self.write(self._merged(full), level + 1)])
            level += 1


def _anchors(words: Words, h: np.ndarray, window: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, anchor) of each window that lies in one document."""
    if len(h) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = sliding_min(window_hashes(h, stretch), window - stretch + 1)
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))
    start = np.arange(len(h) - window + 1)
    inside = start + window <= last[: len(start)]
    return start[inside], least[inside]


def _profiles(docs: DataFrame, window: int, stretch: int) -> DataFrame:
    """doc_id, n_words, fp1, fp2, anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1)):
                h = words.hashes()
                start, anchor = _anchors(words, h, window, stretch)
                doc = np.searchsorted(words.bounds, start, side="right") - 1
                new = np.ones(len(start), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                fp1, fp2 = words.digests()
                n = words.last - words.first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, n), pa.array(np.diff(words.bounds)), pa.array(fp1), pa.array(fp2),
                     list_array(anchor[new].view(np.int64), np.bincount(doc[new], minlength=n), pa.int64())],
                    names=["doc_id", "n_words", "fp1", "fp2", "anchors"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, fp1 long, fp2 long, anchors array<long>")


def _window_digests(words: Words, at: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a cryptographic digest of the words of each window; at rises, doc is the window's document."""
    out = bytearray()
    now = -1
    for s, d in zip(at.tolist(), doc.tolist()):
        if d != now:
            now, low = d, int(words.bounds[d])
            text = memoryview(words.plain(d))
            size = words.end[low : words.bounds[d + 1]] - words.start[low : words.bounds[d + 1]] + 1
            begin = np.concatenate([[0], np.cumsum(size)]).tolist()
        out += hashlib.blake2b(text[begin[s - low] : begin[s - low + window] - 1], digest_size=16).digest()
    halves = np.frombuffer(bytes(out), dtype=np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _full_windows(docs: DataFrame, wanted: DataFrame, window: int, stretch: int) -> DataFrame:
    """h1, h2, doc_id, fp1, fp2, pos of the windows of docs whose (doc_id, hash of the anchor) is in a stored table."""
    some = common.filtered(docs.where("doc_id is not null"), common.Bloom.of(wanted, "doc_id"), "doc_id", inside=True)
    lists = wanted.groupBy("doc_id").agg(F.collect_set("hash").alias("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1)):
                own = batch.slice(words.first, words.last - words.first)
                h = words.hashes()
                start, anchor = _anchors(words, h, window, stretch)
                doc = np.searchsorted(words.bounds, start, side="right") - 1
                limits = np.searchsorted(doc, np.arange(own.num_rows + 1))
                good = np.zeros(len(start), dtype=bool)
                for i, held in enumerate(own.column(2)):
                    part = slice(limits[i], limits[i + 1])
                    good[part] = np.isin(anchor[part], held.values.to_numpy().view(np.uint64))
                at, doc = start[good], doc[good]
                if not len(at):
                    continue
                fp1, fp2 = words.digests()
                ids = own.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*_window_digests(words, at, doc, window), ids[doc], fp1[doc], fp2[doc], (at - words.bounds[doc]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "fp1", "fp2", "pos"],
                )

    return some.join(lists, "doc_id").select("doc_id", "text", "anchors").mapInArrow(run, "h1 long, h2 long, doc_id long, fp1 long, fp2 long, pos int")


def _touched(docs: DataFrame, touched: common.Bloom) -> DataFrame:
    """doc_id, text, fp1, fp2 of the rows whose id passes the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(touched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sent.value.has(batch.column(0).to_numpy(zero_copy_only=False))))
            for words in slices(batch.column(1)):
                n = words.last - words.first
                fp1, fp2 = words.digests()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, n), batch.column(1).slice(words.first, n), pa.array(fp1), pa.array(fp2)], names=["doc_id", "text", "fp1", "fp2"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, text string, fp1 long, fp2 long")


def _without(docs: DataFrame, window: int, touched: common.Bloom | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text; docs has `gone`, the starts of windows to remove (-1: the whole text) or null.

    touched: leave out the rows whose id passes this filter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(touched) if touched else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent:
                ids = batch.column(0)
                batch = batch.filter(pa.array(~(sent.value.has(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))))
            gone = batch.column(2)
            for words in slices(batch.column(1)):
                n = words.last - words.first
                kept = np.ones(len(words.start) + 1, dtype=bool)
                for i in range(n):
                    if gone[words.first + i].is_valid:
                        at = np.asarray(gone[words.first + i].values)
                        lo, hi = words.bounds[i], words.bounds[i + 1]
                        if (at < 0).any():
                            kept[lo:hi] = False
                        else:
                            change = np.zeros(hi - lo + 1, dtype=np.int64)
                            np.add.at(change, at, 1)
                            np.add.at(change, np.minimum(at + window, hi - lo), -1)
                            kept[lo:hi] = np.cumsum(change)[:-1] <= 0
                kept = kept[:-1]
                doc = np.repeat(np.arange(n), np.diff(words.bounds))
                total = np.bincount(doc, minlength=n)
                stays = np.bincount(doc[kept], minlength=n)
                # one space follows each kept word but the last of its document
                s, e, d = words.start[kept], words.end[kept], doc[kept]
                tail = np.ones(len(d), dtype=bool)
                tail[:-1] = d[1:] != d[:-1]
                stop = e + ~tail
                edge = np.zeros(len(words.buf) + 1, dtype=np.int8)
                edge[s] += 1
                np.subtract.at(edge, stop, 1)
                mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
                out = words.buf.copy()
                out[e[~tail]] = 0x20
                out = out[mask]
                sizes = np.bincount(d, weights=stop - s, minlength=n).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, n), pa.array(total), pa.array(total - stays), text], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


class SubstringDeduplicator:
    """Incremental removal of repeated windows.

    add(batch, history) judges a batch against itself and all batches before
    it; history holds the texts of those (None at first), of which only the
    single holders of anchors that the batch shares are hashed again. Batches
    given in the order of their ids give the same rows as one batch of
    everything.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = 50, stretch: int = 25):
        if not 1 <= stretch <= window:
            raise ValueError("stretch must be 1 to window")
        root = root or common.new_path(spark, "fingerprints")
        self.spark, self.window, self.stretch = spark, window, stretch
        self.anchors = FingerprintIndex.open(spark, f"{root}/anchors", ("hash",))
        self.documents = FingerprintIndex.open(spark, f"{root}/documents", ("fp1", "fp2"))
        self.windows = FingerprintIndex.open(spark, f"{root}/windows", ("h1", "h2"))

    def add(self, batch: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of each row of batch."""
        narrow = lambda df: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        ends = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
        docs = narrow(batch)
        rows = common.stored(_profiles(docs, self.window, self.stretch), "profiles")
        rows = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= self.window))

        document_run = self.documents.write(rows.groupBy("fp1", "fp2").agg(*ends))
        first = self.documents.looked_up(document_run).select("fp1", "fp2", F.least("lo", "past_lo").alias("rep"), F.col("past_lo").isNull().alias("new"))
        first = common.stored(first, "first")
        marked = rows.join(first, ["fp1", "fp2"]).select("doc_id", "fp1", "fp2", "rep", F.when(F.col("new") & (F.col("doc_id") == F.col("rep")), F.col("anchors")).alias("anchors"))
        marked = common.stored(marked, "marked")
        held = marked.select("doc_id", F.explode("anchors").alias("hash"))

        anchor_run = self.anchors.write(held.groupBy("hash").agg(*ends))
        shared = self.anchors.looked_up(anchor_run).where(F.least("lo", "past_lo") < F.greatest("hi", "past_hi"))
        shared = common.stored(shared.select("hash", F.when(F.col("past_lo") == F.col("past_hi"), F.col("past_lo")).alias("single")), "shared")
        # stored, so that an anchor or passage that a large part of all documents share can be split in the joins
        wanted = common.stored(held.join(shared, "hash").select("doc_id", "hash"), "wanted")
        found = common.stored(_full_windows(docs, wanted, self.window, self.stretch), "windows")
        both = found.select("h1", "h2", "doc_id")
        if history is not None:
            earlier = common.stored(shared.where("single is not null").select(F.col("single").alias("doc_id"), "hash"), "wanted")
            both = both.unionByName(_full_windows(narrow(history), earlier, self.window, self.stretch).select("h1", "h2", "doc_id"))

        window_run = self.windows.write(both.groupBy("h1", "h2").agg(*ends))
        least = self.windows.looked_up(window_run).select("h1", "h2", F.least("lo", "past_lo").alias("lo"), "hi").where("lo < hi")
        least = common.stored(least.select("h1", "h2", "lo"), "least")
        repeats = found.join(least, ["h1", "h2"]).where("doc_id > lo").select("doc_id", "fp1", "fp2", "pos")
        gone = repeats.unionByName(marked.where("doc_id > rep").select("doc_id", "fp1", "fp2", F.lit(-1).alias("pos")))
        gone = common.stored(gone.groupBy("doc_id", "fp1", "fp2").agg(F.collect_list("pos").alias("gone")), "gone")
        common.discard(marked, first, shared, wanted, found, least)

        touched = common.Bloom.of(gone, "doc_id")
        same = docs.withColumn("gone", F.lit(None).cast("array<int>"))
        changed = _touched(docs, touched).join(gone, ["doc_id", "fp1", "fp2"], "left")
        out = _without(same, self.window, touched).unionByName(_without(changed, self.window))

        for index, run in ((self.documents, document_run), (self.anchors, anchor_run), (self.windows, window_run)):
            index.append(run)
        return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of df, taken as batches of rising ids."""
    ends = df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    spark = df.sparkSession
    index = SubstringDeduplicator(spark, window=window)
    if ends["lo"] is None or batches < 2 or ends["lo"] == ends["hi"]:
        return index.add(df, None, id_col, text_col)
    width = (int(ends["hi"]) - int(ends["lo"])) // batches + 1
    limits = [int(ends["lo"]) + k * width for k in range(1, batches)]
    out, key = None, F.col(id_col)
    for k in range(batches):
        part = df if k == batches - 1 else df.where((key < limits[k]) | key.isNull() if k == 0 else key < limits[k])
        if k:
            part = part.where(key >= limits[k - 1])
        got = index.add(part, df.where(key < limits[k - 1]) if k else None, id_col, text_col)
        out = got if out is None else out.unionByName(got)
    return out
