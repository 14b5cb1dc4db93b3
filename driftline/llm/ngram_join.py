"""N-gram Jaccard self-join by rare-first prefix filtering.

Documents are sets of distinct word n-grams; two link when
100 * |intersection| >= percent * |union|. Every document gets the smallest id
that it reaches by links.

Plan, for any number of rows:

1. All n-grams of all texts are counted exactly, by range of their hashes. The
   HEAVY most frequent ones give a table of levels of fixed size, which is
   broadcast: the global order goes by level, then by hash, so that every
   n-gram that is not among the most frequent comes before those that are.
   Any fixed order gives right results; this one gives short posting lists.
2. One pass makes each document's size, digest of its words, prefix in that
   order and a histogram of its hashes. Equal texts become one representative.
3. Prefix n-grams held by two or more representatives give candidates: first
   only pairs with one hub for each n-gram, so that a group of G near copies
   gives about G pairs and not G * G; then, for n-grams whose holders are still
   in different components, further hubs; last every remaining pair of
   different components. A hub has met all holders of its n-gram, so it leaves
   the n-gram after its round; one with two holders is done after the first. A pair passes the length filter, the positional filter
   at its first common n-gram and the suffix filter on histograms before it is
   verified once, on the sets of its words. Pairs inside a component need no
   check, so components lose no link.

Cost: linear in text plus verified pairs. In the last step the smaller text of
a pair must hold the n-gram in the first part of its prefix, about half of it;
a group whose members share such rare n-grams but do not link is compared pair
by pair, after the filters; nothing is capped.

Hashes only find candidates: texts are equal when a 128-bit cryptographic
digest of their words is, and a link is confirmed on the words themselves.

Nulls, ties, repeats: a null, empty or blank text has size 0 and links with
nothing. A null id keeps its row, with a null component, and takes no part.
Ids should be unique. Of rows that share an id each is judged by its own text;
a link of one is not carried over to the others.
Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .textkernel import list_array, ngram_hashes, slices

#: Places of the table of levels, as a power of two, and how many n-grams have a place in it.
LEVEL_BITS = 24
HEAVY = 1 << 21
#: Text in one range of n-gram hashes, and most ranges.
RANGE_BYTES = 1 << 22
MAX_RANGE_BITS = 16
CHUNK = 1 << 20
HISTOGRAM_BINS = 32
#: A pair with its texts weighs as much as so many rows of longs.
TEXT_WEIGHT = 40
#: Cross-component pairs are listed in full once there are at most this many per posting row.
FULL_LIST_FACTOR = 4
MAX_HUB_ROUNDS = 8
#: A round of hubs that leaves more than this share of the pairs ends the rounds: the holders differ, and the filters drop most of their pairs.
LEAST_PROGRESS = 0.8


def document_sets(words, n: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) for each document of a slice."""
    h = words.hashes(lower)
    b = words.bounds
    grams = ngram_hashes(h, n) if len(h) >= n else h[:0]
    for i in range(len(b) - 1):
        lo, hi = b[i], b[i + 1]
        if hi - lo >= n:
            s = np.sort(grams[lo : hi - n + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield words.first + i, s[keep]
        elif hi > lo:
            yield words.first + i, ngram_hashes(h[lo:hi], int(hi - lo))
        else:
            yield words.first + i, h[:0]


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set that it links to."""
    return -(-percent * size // 100)


def _levels(docs: DataFrame, n: int, lower: bool) -> np.ndarray:
    """A level (0: rare) for each of 2**LEVEL_BITS ranges of n-gram hashes, from exact counts over all text.

    Tasks send the leading bytes of the n-gram hashes of about CHUNK words at
    a time, sorted, a block for each range of hashes. One range, of about
    RANGE_BYTES of text, is counted at a time, and returns its part of the
    table: the places of its share of the HEAVY most frequent n-grams.
    """
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = min(MAX_RANGE_BITS, max(3, (total // RANGE_BYTES).bit_length()))
    width = min(8, max(4, -(-(total.bit_length() + 6) // 8)))  # so many bytes tell almost all n-grams apart
    shift = np.uint64(64 - 8 * width)
    limits = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        cut = [0, *np.searchsorted(h, limits).tolist(), len(h)]
        raw = (h >> shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        some = [k for k in range(1 << bits) if cut[k] < cut[k + 1]]
        size = [cut[k + 1] - cut[k] for k in some]
        data = [pa.compress(raw[cut[k] : cut[k + 1]].T.tobytes(), codec="lz4_raw", asbytes=True) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["k", "size", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for words in slices(batch.column(0)):
                h = words.hashes(lower)
                if len(h) >= n:
                    inside = np.ones(len(h) - n + 1, dtype=bool)
                    for j in range(1, n):
                        at = words.bounds[1:-1] - j
                        inside[at[(at >= 0) & (at < len(inside))]] = False
                    held.append(ngram_hashes(h, n)[inside])
                    count += len(held[-1])
                if count >= CHUNK:
                    yield send(held)
                    held, count = [], 0
        if count:
            yield send(held)

    def part(values: list[np.ndarray]) -> np.ndarray:
        """Levels of one range."""
        v = np.concatenate(values)
        v.sort()
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        count = np.diff(np.append(first, len(v)))
        v, most = v[first], HEAVY >> bits
        v, count = v[count > 1], count[count > 1]
        if len(v) > most:
            keep = count > np.partition(count, len(v) - most)[len(v) - most]
            v, count = v[keep], count[keep]
        out = np.zeros(1 << (LEVEL_BITS - bits), dtype=np.uint8)
        place = (v << shift) >> np.uint64(64 - LEVEL_BITS) if width < 8 else v >> np.uint64(64 - LEVEL_BITS)
        np.maximum.at(out, place.astype(np.int64) & (len(out) - 1), np.minimum(255, 8 * np.log2(count)).astype(np.uint8))
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = -1, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pa.compress(part(values).tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["k", "data"])

        for batch in batches:
            for k, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != now and values:
                    yield done()
                    values = []
                now = k
                raw = np.zeros((size, 8), dtype=np.uint8)
                raw[:, :width] = np.frombuffer(pa.decompress(data.as_py(), size * width, codec="lz4_raw"), dtype=np.uint8).reshape(width, size).T
                values.append(raw.view("<u8").reshape(-1))
        if values:
            yield done()

    got = docs.select("text").mapInArrow(blocks, "k int, size int, data binary").repartition("k").coalesce(1 << bits).sortWithinPartitions("k").mapInArrow(count, "k int, data binary")
    out = np.zeros((1 << bits, 1 << (LEVEL_BITS - bits)), dtype=np.uint8)
    with common.small_batches(docs.sparkSession):
        for row in got.collect():
            out[row.k] = np.frombuffer(pa.decompress(bytes(row.data), out.shape[1], codec="zstd"), dtype=np.uint8)
    return out.reshape(-1)


def _profiles(docs: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2, prefix, hist for each row."""
    spread = docs.sparkSession.sparkContext.broadcast(_levels(docs, n, lower))
    shift = np.uint64(64 - LEVEL_BITS)
    bin_shift = np.uint64(64 - (HISTOGRAM_BINS.bit_length() - 1))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = spread.value
        for batch in batches:
            for words in slices(batch.column(1)):
                sizes, prefixes, lengths, hists = [], [], [], []
                for _, s in document_sets(words, n, lower):
                    sizes.append(len(s))
                    k = len(s) - needed(len(s), percent) + 1 if len(s) else 0
                    order = np.argsort(level[(s >> shift).astype(np.int64)], kind="stable")[:k]
                    prefixes.append(s[order])
                    lengths.append(k)
                    hists.append(np.bincount((s >> bin_shift).astype(np.int64), minlength=HISTOGRAM_BINS).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, words.last - words.first),
                        pa.array(sizes, pa.int64()),
                        *(pa.array(x) for x in words.digests(lower)),
                        list_array(np.concatenate(prefixes).view(np.int64), np.array(lengths), pa.int64()),
                        pa.array(hists, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "prefix", "hist"],
                )

    return docs.mapInArrow(profile, "doc_id long, n_shingles long, fp1 long, fp2 long, prefix array<long>, hist binary")


def with_digests(df: DataFrame, text_col: str = "text", lower: bool = True) -> DataFrame:
    """df with __fp1 and __fp2, the digest of each text's words that similarity_classes gives."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(place)):
                own = batch.slice(words.first, words.last - words.first)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x) for x in words.digests(lower))], names=[*own.schema.names, "__fp1", "__fp2"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("__fp1", LongType()), StructField("__fp2", LongType())]))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of documents that ids has in its columns a and b, and of few others."""
    wanted = common.Bloom.of(ids, "a", "b")
    return common.filtered(docs.where("doc_id is not null"), wanted, "doc_id", inside=True).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _suffix_filter(pairs: DataFrame, reps: DataFrame, percent: int, rows: int) -> DataFrame:
    """Pairs whose histograms by hash range still allow the needed overlap; rows: about how many pairs there are."""
    hist = lambda key: reps.select(F.col("rep").alias(key), F.col("hist").alias(f"hist_{key}"))
    both = common.narrowed(common.narrowed(pairs.join(hist("a"), "a"), rows).join(hist("b"), "b"), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.int32).reshape(-1, HISTOGRAM_BINS) for c in ("hist_a", "hist_b"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            total = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
            batch = batch.filter(pa.array(100 * most >= percent * (total - most)))
            yield batch.select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _links(both: int, x: int, y: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (x + y - both)


def word_sets(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The distinct n-grams of a list of words, as words."""
    return set(zip(*(words[j:] for j in range(n)))) if len(words) >= n else {tuple(words)} - {()}


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """The links among pairs (a, b), each checked once on whole sets.

    Texts travel and not sets: they are smaller, and both sets of a pair are
    made where it is checked. Sets of hashes sort out the pairs that do not
    link; the others are confirmed on the words.
    """
    texts = _texts(docs, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                coded = [pc.dictionary_encode(batch.column(c)) for c in ("text_a", "text_b")]
                cut = [[(words, i) for words in slices(c.dictionary) for i in range(words.last - words.first)] for c in coded]
                sets = [[s for words in slices(c.dictionary) for _, s in document_sets(words, n, lower)] for c in coded]
                exact: list[dict[int, set]] = [{}, {}]
                at = [c.indices.to_numpy(zero_copy_only=False) for c in coded]
                good = np.zeros(batch.num_rows, dtype=bool)
                for i in np.argsort(at[1], kind="stable"):
                    x, y = sets[0][at[0][i]], sets[1][at[1][i]]
                    if len(x) > len(y):
                        x, y = y, x
                    if len(x) and 100 * len(x) >= percent * len(y):
                        place = np.searchsorted(y, x)
                        place[place == len(y)] = 0
                        if _links(int(np.count_nonzero(y[place] == x)), len(x), len(y), percent):
                            for side in (0, 1):
                                k = at[side][i]
                                if k not in exact[side]:
                                    words, j = cut[side][k]
                                    exact[side] = {k: word_sets(words.plain(j, lower).split(), n)}  # the last one of each side is kept
                            x, y = exact[0][at[0][i]], exact[1][at[1][i]]
                            good[i] = _links(len(x & y), len(x), len(y), percent)
                yield batch.filter(pa.array(good)).select(["a", "b"])

    side = lambda key: texts.select(F.col("id").alias(key), F.col("text").alias(f"text_{key}"))
    rows = TEXT_WEIGHT * pairs.rows
    met = common.narrowed(common.narrowed(pairs.join(side("a"), "a"), rows).join(side("b"), "b"), rows)
    return common.stored(met.mapInArrow(run, "a long, b long"), "links")


def _fits(na: Column, nb: Column, pa: Column, pb: Column, percent: int) -> Column:
    """Length and positional filters of one common prefix n-gram.

    The first common n-gram of a pair that links passes: all that the pair has
    in common beside it comes later in both. Overlap o must satisfy
    100 * o >= percent * (na + nb - o).
    """
    long_enough = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return long_enough & ((100 + percent) * (1 + F.least(na - pa - 1, nb - pb - 1)) >= percent * (na + nb))


def _banded(postings: DataFrame, percent: int) -> DataFrame:
    """Postings with a band of sizes; sizes that can link lie in one band or in two that touch."""
    width = math.log(100 / percent) if percent < 100 else 0.01
    return postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width * (1 + 1e-9))))


def _small_side(percent: int) -> Column:
    """Whether a posting can be the smaller set's side of a first common n-gram: the positional filter at the best, with an equal size."""
    return (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")


def _shared_postings(reps: DataFrame, percent: int) -> DataFrame:
    """token, rep, n, pos, hub, hn, hp of the prefix n-grams that two or more representatives hold; the hub is the least of them."""
    held = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    # by columns of plain longs, so that the aggregation hashes and does not sort
    hubs = held.groupBy(F.col("token").alias("at")).agg(
        F.count(F.lit(1)).alias("c"), F.max(_small_side(percent).cast("int")).alias("small"), F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hn"), F.min_by("pos", "rep").alias("hp")
    )
    hubs = common.stored(hubs.where("c > 1 and small = 1").drop("c", "small"), "hubs")
    out = common.stored(held.join(hubs, held.token == hubs["at"]).select("token", "rep", "n", "pos", "hub", "hn", "hp"), "postings")
    common.discard(hubs)
    return out


def _crossing(postings: DataFrame, links: DataFrame, seed: int) -> DataFrame:
    """Postings of the n-grams whose holders, without the hubs of rounds before, lie in different components, with `comp` and a hub chosen by seed, and the hub's hcomp."""
    comp = common.components(links)
    rows = postings.rows
    postings = common.stored(postings.where("rep <> hub").select("token", "rep", "n", "pos").join(comp, postings.rep == comp.node, "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("comp")).transform(common.narrowed, rows), "postings")
    ranked = postings.withColumn("rank", F.xxhash64("rep", F.lit(seed)))
    mixed = ranked.groupBy(F.col("token").alias("at")).agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), *(F.min_by(c, "rank").alias(name) for c, name in (("rep", "hub"), ("n", "hn"), ("pos", "hp"), ("comp", "hcomp")))
    )
    mixed = common.stored(mixed.where("lo < hi").drop("lo", "hi").transform(common.narrowed, rows), "hubs")
    out = common.stored(postings.join(mixed, postings.token == mixed["at"]).drop("at").transform(common.narrowed, rows), "postings")
    common.discard(mixed, postings)
    return out


def _cross_pairs(postings: DataFrame, percent: int) -> int:
    """At most how many pairs of different components and like sizes share an n-gram, counted once for each n-gram."""
    own = _banded(postings, percent).groupBy("token", "band", "comp").agg(F.count(F.lit(1)).alias("c")).transform(common.narrowed, postings.rows)
    both = own.unionByName(own.withColumn("band", F.col("band") - 1)).groupBy("token", "band", "comp").agg(F.sum("c").alias("c")).transform(common.narrowed, postings.rows)
    one = both.groupBy("token", "band").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc")).transform(common.narrowed, postings.rows)
    return int(one.agg(F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2)).first()[0] or 0)


def _all_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Every pair of different components that one prefix n-gram allows; y is the smaller set, or the smaller id of equal ones."""
    own = _banded(postings.select("token", "rep", "n", "pos", "comp"), percent)
    x = own.select(*(F.col(c).alias(f"x_{c}") for c in own.columns))
    y = own.where(_small_side(percent)).withColumn("at", F.explode(F.array("band", F.col("band") + 1)))
    y = y.select(*(F.col(c).alias(f"y_{c}") for c in y.columns))
    larger = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_rep") > F.col("y_rep")))
    met = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_band") == F.col("y_at")) & larger & (F.col("x_comp") != F.col("y_comp"))
                 & _fits(F.col("x_n"), F.col("y_n"), F.col("x_pos"), F.col("y_pos"), percent))
    return _distinct(met.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")))


def _hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of each n-gram's hub with its holders, in other components where those are known."""
    other = (F.col("comp") != F.col("hcomp")) if "comp" in postings.columns else F.lit(True)
    met = postings.where((F.col("rep") != F.col("hub")) & other & _fits(F.col("n"), F.col("hn"), F.col("pos"), F.col("hp"), percent))
    return _distinct(met.select(F.col("rep").alias("a"), F.col("hub").alias("b")))


def _distinct(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once; a is the larger id."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, fp1, fp2) for each row of df; fp1 and fp2 are the digest of its words. See the module's text.

    n: words in an n-gram; percent: least Jaccard similarity in hundredths
    (1 to 100); lower: A-Z count as a-z. A document with fewer than n words is
    one n-gram, its whole sequence.
    """
    if not (1 <= percent <= 100 and n >= 1):
        raise ValueError("percent must be 1 to 100 and n at least 1")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = common.stored(_profiles(docs, n, percent, lower), "profiles")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    one = real.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct(F.col("n_shingles").alias("n"), "prefix", "hist"), "doc_id").alias("own"))
    reps = common.stored(one.select("fp1", "fp2", "rep", "own.*"), "reps")

    postings = _shared_postings(reps, percent)
    links: DataFrame | None = None
    tried: DataFrame | None = None
    before = math.inf
    for seed in range(MAX_HUB_ROUNDS + 1):
        size = postings.rows
        if size == 0:
            break
        open_pairs = _cross_pairs(postings, percent) if seed else math.inf
        last = seed == MAX_HUB_ROUNDS or open_pairs <= FULL_LIST_FACTOR * size or (before < math.inf and open_pairs > LEAST_PROGRESS * before)
        before = open_pairs
        pairs = _all_pairs(postings, percent) if last else _hub_pairs(postings, percent)
        pairs = common.narrowed(pairs, size)
        if tried is not None:
            pairs = common.narrowed(pairs.join(tried, ["a", "b"], "left_anti"), size)
        pairs = common.stored(_suffix_filter(pairs, reps, percent, size), "pairs")
        found = _verified(pairs, docs, n, percent, lower)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else common.stored(links.unionByName(found).coalesce(max(1, (links.rows + found.rows) >> 20)), "links")
        if last:
            break
        before_, postings = postings, _crossing(postings, links, seed + 1)
        common.discard(before_)
    common.discard(postings)

    first = reps.select("fp1", "fp2", "rep")
    if links is not None:
        comp = common.components(links)
        first = first.join(comp, first.rep == comp.node, "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("rep"))
    first = common.stored(common.narrowed(first, reps.rows), "first")
    out = rows.select("doc_id", "n_shingles", "fp1", "fp2").join(first, ["fp1", "fp2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "fp1", "fp2")
