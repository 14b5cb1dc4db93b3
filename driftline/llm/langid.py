"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text's letters, lower-cased, with each other run of characters as one space,
give its character n-grams (1 to MAX_GRAM). Their hashes index a matrix of
log probabilities, one column for each language, which is broadcast: BUCKETS
rows by the number of languages, whatever the corpus. More than
BLOCK_LANGUAGES languages are cut into blocks, each with a matrix of its own,
that score one after another. A batch is scored as a sparse matrix with one
entry for each n-gram: its rows of the matrix are gathered and summed by
document in numpy. A long text is read in parts. The prior of a language is its
share of all labelled rows.

The matrix is fitted on at most about `sample` texts of each language, chosen
by a hash of the id; a language with fewer labelled rows gives all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_GRAM = 4
BUCKETS = 1 << 16
#: Characters scored at a time.
CHUNK_CHARS = 1 << 18
#: Languages of one matrix.
BLOCK_LANGUAGES = 128
#: Entries of the matrix gathered at a time.
GATHERED = 1 << 23


def _letter_table() -> np.ndarray:
    """The lower-case letter of each code point of the basic plane; 0 for what isn't a letter."""
    out = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_letters: np.ndarray | None = None


def letters_of(points: np.ndarray) -> np.ndarray:
    """Lower-case letters of code points, 0 for what isn't a letter; letters beyond the basic plane stay as they are."""
    global _letters
    if _letters is None:
        _letters = _letter_table()
    out = _letters[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        out[far] = [c if chr(c).isalpha() else 0 for c in points[far].tolist()]
    return out


def _parts(texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, start, stop) of parts of about CHUNK_CHARS: texts first..last-1, or characters start..stop of one."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_CHARS):
            size += len(texts[hi])
            hi += 1
        if hi == lo + 1:
            for start in range(0, max(1, size), CHUNK_CHARS):
                yield lo, hi, start, start + CHUNK_CHARS
        else:
            yield lo, hi, 0, size
        lo = hi


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of all n-grams of texts, in parts."""
    tail, letter_before = np.zeros(0, dtype=np.uint64), False
    for lo, hi, start, stop in _parts(texts):
        if start == 0:
            tail, letter_before = tail[:0], False
        if hi == lo + 1:
            joined, sizes = texts[lo][start:stop], None
            if start + CHUNK_CHARS >= len(texts[lo]):
                joined += "\n"
        else:
            joined, sizes = "\n".join(texts[lo:hi]) + "\n", [len(t) + 1 for t in texts[lo:hi]]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        doc = np.full(len(points), lo) if sizes is None else np.repeat(np.arange(lo, hi), sizes)
        low = letters_of(points)
        keep = low > 0
        last = bool(keep[-1]) if len(keep) else letter_before
        keep[1:] |= keep[:-1]  # the first character after a run of letters stands for the gap
        if len(keep):
            keep[0] |= letter_before
        old = len(tail)
        low, doc = np.concatenate([tail, low[keep].astype(np.uint64)]), np.concatenate([np.full(old, lo), doc[keep]])
        tail, letter_before = (low[max(0, len(low) - MAX_GRAM + 1) :], last) if sizes is None else (tail[:0], False)
        h = np.zeros(len(low), dtype=np.uint64)
        for n in range(1, MAX_GRAM + 1):
            m = len(low) - n + 1
            if m <= 0:
                break
            h = (h[:m] + low[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            inside = doc[:m] == doc[n - 1 :]
            inside[: max(0, old - n + 1)] = False  # given with the part before
            yield doc[:m][inside], (h[inside] >> np.uint64(64 - 16)).astype(np.int64)


@dataclass
class Block:
    """The matrix of some languages."""

    languages: list[str]
    log_prob: np.ndarray  # BUCKETS x languages, float32
    log_prior: np.ndarray

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log prior and likelihood of each language for each text, and whether the text has a letter."""
        total = np.tile(self.log_prior, (len(texts), 1))
        seen = np.zeros(len(texts), dtype=bool)
        step = max(1, GATHERED // len(self.languages))
        for docs, buckets in grams(texts):
            for lo in range(0, len(docs), step):
                doc, bucket = docs[lo : lo + step], buckets[lo : lo + step]
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                total[doc[first]] += np.add.reduceat(self.log_prob[bucket], first, axis=0, dtype=np.float64)
                seen[doc[first]] = True
        return total, seen


@dataclass
class Model:
    languages: list[str]
    blocks: list  # broadcast Blocks


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 1000, smoothing: float = 0.05) -> Model:
    """A model of the rows of df whose language is not null; about `sample` rows of each language are read.

    Raises ValueError without labelled rows.
    """
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError("no labelled rows")
    names, total = sorted(sizes), sum(sizes.values())
    blocks = [_fit_block(rows, names[k : k + BLOCK_LANGUAGES], sizes, total, sample, smoothing) for k in range(0, len(names), BLOCK_LANGUAGES)]
    return Model(names, blocks)


def _fit_block(rows: DataFrame, names: list[str], sizes: dict[str, int], total: int, sample: int, smoothing: float):
    shares = F.create_map(*(F.lit(x) for name in names for x in (name, min(1.0, sample / sizes[name]))))
    place = {name: k for k, name in enumerate(names)}
    key = F.xxhash64(F.coalesce(F.col("i").cast("string"), F.col("t")))
    chosen = rows.where(F.col("l").isin(names)).where(F.pmod(key, F.lit(1 << 20)) < shares[F.col("l")] * (1 << 20)).select("t", "l")

    def fill(own: np.ndarray, batch: pa.RecordBatch) -> None:
        texts, langs = [t or "" for t in batch.column(0).to_pylist()], np.array([place[x] for x in batch.column(1).to_pylist()])
        for doc, bucket in grams(texts):
            np.add.at(own, langs[doc] * BUCKETS + bucket, 1)

    counts = common.gathered(chosen, fill, len(names) * BUCKETS, "int32", "add").reshape(len(names), BUCKETS).astype(np.float64) + smoothing
    log_prob = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
    return rows.sparkSession.sparkContext.broadcast(Block(names, log_prob, np.log([sizes[n] / total for n in names])))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of df.

    lang_pred is a learned language, or `und` with score 0 where the text is
    null or has no letter; equal scores give the first language by name. score
    is the posterior probability. Only id and text are read; ids may be null
    or repeat.
    """
    def scored(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block.value
            names = np.array(own.languages, dtype=object)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    total, seen = own.totals([t or "" for t in part.column(1).to_pylist()])
                    # the best language so far, its logarithm, and the sum of all in units of it
                    best, log = names[total.argmax(axis=1)], total.max(axis=1)
                    mass = np.exp(total - log[:, None]).sum(axis=1)
                    before = part.column(3).to_numpy(zero_copy_only=False)
                    top = np.maximum(log, before)
                    mass = mass * np.exp(log - top) + part.column(4).to_numpy(zero_copy_only=False) * np.exp(before - top)
                    older = before >= log
                    best = np.where(older, np.array(part.column(2).to_pylist(), dtype=object), best)
                    best[~seen] = "und"
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(best.tolist(), pa.string()), pa.array(top), pa.array(mass), pa.array(seen)],
                        names=["doc_id", "text", "lang_pred", "log", "mass", "seen"],
                    )

        return run

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", "text", F.lit("").alias("lang_pred"), F.lit(-1e300).alias("log"), F.lit(0.0).alias("mass"), F.lit(False).alias("seen"))
    for k, block in enumerate(model.blocks):
        docs = docs.mapInArrow(scored(block), "doc_id long, text string, lang_pred string, log double, mass double, seen boolean")
        if k < len(model.blocks) - 1:
            docs = common.stored(docs, "languages")  # so that one matrix at a time is in memory
    return docs.select("doc_id", "lang_pred", F.when(F.col("seen"), 1.0 / F.col("mass")).otherwise(0.0).alias("score"))
