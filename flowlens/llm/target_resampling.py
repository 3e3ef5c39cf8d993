"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

Features of a text are its runs of 1 to 3 words (A-Z lowered, words of digits, letters and characters beyond ASCII), joined by one
space; a feature's bucket is the CRC-32 of its bytes modulo `BUCKETS`. The gain of a bucket is the smoothed log ratio of its
share in the target texts to its share in the documents, in thousandths, rounded down. A document's weight is the sum of its gains
(one gather from the array of gains), its score the weight plus a Gumbel number that follows from the doc_id: the documents with
the highest scores are a sample without replacement in proportion to the weights.

CRC-32 is linear: that of a joined text is that of its first part, moved over the length of the second (a table look-up for each of
its four bytes), combined with that of the second. So words are hashed once and runs are combined from them, in arrays.

Ranks. Every task writes its scores as a sorted run. Every `step`-th row of a run is a sample; regular samples of the sorted
samples are the splitters. Each run is cut at the splitters; the counts of the pieces, summed per segment, give the number of rows
ahead of every segment. The pieces of a segment meet in one task, are merged, and the prefix count plus the place in the segment
is the exact rank. Segments behind the last drawn row need no rank and stay where they are.

Defined results: null and empty texts have no words, no features and weight 0; a document without a doc_id has that of an empty one
in its random number and ranks behind equal scores; rows that repeat a doc_id are ranked each, in the order of their weight, number of
features and words; extra columns are ignored by `rank` and kept by `draw`; without target texts the target's counts are 0; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm import kernels as K
from flowlens.llm.exchange import staged, tidy

BUCKETS = 10_000
WORDS_EACH = 3
LONG_WORD = 48  # bytes; features with a longer word are hashed from their text
LEAST_WORDS = 20
PERCENT = 5
SALT = 42
SEGMENTS_PER_PARTITION = 4
SAMPLES_EACH = 32

# Bytes of words: digits, letters, and all bytes of characters beyond ASCII. A-Z are lowered before.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def _shift_tables(longest: int) -> np.ndarray:
    """[n, k, byte]: the register with `byte` as its k-th byte after n zero bytes."""
    state = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    made = [state]
    for _ in range(longest):
        state = CRC[state & np.uint32(255)] ^ (state >> np.uint32(8))
        made.append(state)
    return np.stack(made)


SHIFT = _shift_tables(LONG_WORD + 1)


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The register after n more zero bytes."""
    low = np.uint32(255)
    return (SHIFT[n, 0, crc & low] ^ SHIFT[n, 1, (crc >> np.uint32(8)) & low]
            ^ SHIFT[n, 2, (crc >> np.uint32(16)) & low] ^ SHIFT[n, 3, crc >> np.uint32(24)])


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers (started at zero, not inverted) after the bytes of each word of up to LONG_WORD bytes."""
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    size = np.where(size > LONG_WORD, 0, size)  # these stand first and are left out
    skip = int((lengths > LONG_WORD).sum())
    crc = np.zeros(len(order), np.uint32)
    for k in range(int(size.max(initial=0))):
        to = skip + int(np.searchsorted(-size[skip:], -k, side="left"))  # words longer than k
        now = crc[skip:to] ^ data[begin[skip:to] + k]
        crc[skip:to] = CRC[now & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and the number of words before each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | first[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | first[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 and 3 words: text number and bucket of each."""
    data = K.LOWER[data]
    starts, lengths, bounds = words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    crc = word_crcs(data, starts, lengths)
    long_ = lengths > LONG_WORD
    spaced = CRC[(crc ^ np.uint32(32)) & np.uint32(255)] ^ (crc >> np.uint32(8))  # with a space behind
    state, size = crc, lengths
    odd = long_
    begun = np.full(len(state), 0xFFFFFFFF, np.uint32)  # the inverted start of the register, moved over the whole run
    begun = moved(begun, np.minimum(lengths, LONG_WORD))
    for n in range(1, WORDS_EACH + 1):
        if n > 1:
            lead = len(starts) - n + 1
            if lead <= 0:
                return
            # words i .. i+n-2 with a space, then word i+n-1
            last = np.minimum(lengths[n - 1:], LONG_WORD)
            with_space = CRC[(state[:lead] ^ np.uint32(32)) & np.uint32(255)] ^ (state[:lead] >> np.uint32(8)) if n > 2 else spaced[:lead]
            state = moved(with_space, last) ^ crc[n - 1:]
            begun = moved(begun[:lead], last + 1)
            odd = odd[:lead] | long_[n - 1:]
        total = state ^ begun ^ np.uint32(0xFFFFFFFF)
        where = np.flatnonzero(text[n - 1:] == text[:len(total)]) if n > 1 else np.arange(len(total))
        total = total[where]
        for i in np.flatnonzero(odd[where]).tolist():
            at = int(where[i])
            total[i] = zlib.crc32(b" ".join(data[s:s + m].tobytes() for s, m in zip(
                starts[at:at + n].tolist(), lengths[at:at + n].tolist(), strict=True)))
        yield text[where], (total % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n over all features of all texts; a task sends at most one row per bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                for _, bucket in features(data, offsets):
                    total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select(text).mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain of every bucket."""
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    s, t = (bucket_counts(df).withColumnRenamed("n", name) for df, name in ((docs, "s"), (target, "t")))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # BUCKETS rows at any size
    all_s, all_t = F.sum("s").over(whole).cast("double"), F.sum("t").over(whole).cast("double")
    ratio = (F.col("t") + 1.0) * (all_s + float(BUCKETS)) / ((F.col("s") + 1.0) * (all_t + float(BUCKETS)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def luck(doc_id: Column, salt: int = SALT) -> Column:
    """A Gumbel number in thousandths that follows from the doc_id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, gains: DataFrame, salt: int = SALT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score. `gains` is one row per bucket, BUCKETS in all, and travels as an array."""
    array = np.zeros(BUCKETS, np.int64)
    for bucket, gain in gains.select("bucket", "gain").collect():  # BUCKETS rows at any size
        array[bucket] = gain

    def run(batches):
        for batch in batches:
            made = np.zeros((3, len(batch)), np.int64)
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                for n, (text, bucket) in enumerate(features(data, offsets)):
                    count = np.bincount(text, minlength=hi - lo)
                    if n == 0:
                        made[0, lo:hi] = count
                    made[1, lo:hi] += count
                    sums = np.concatenate([[0], np.cumsum(array[bucket])])
                    ends = np.cumsum(count)
                    made[2, lo:hi] += sums[ends] - sums[ends - count]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m) for m in made]],
                                             ["doc_id", "n_words", "n_features", "weight"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(run), "doc_id long, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + luck(F.col("doc_id"), salt))


COLUMNS = ("doc_id", "n_words", "n_features", "weight", "score")
LAST_ID = (1 << 63) - 1  # a missing doc_id stands behind all others


def _keys(batch) -> tuple[np.ndarray, ...]:
    """The order of ranks, most significant first."""
    ids = batch.column("doc_id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    return (-batch.column("score").to_numpy(zero_copy_only=False), ids, *(
        batch.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "n_features", "n_words")))


def segment_of(score: np.ndarray, doc_id: np.ndarray, splitters: list[tuple[int, int]]) -> np.ndarray:
    """Number of splitters (negated score, doc_id), in order, that do not stand behind each row."""
    if not splitters:
        return np.zeros(len(score), np.int64)
    first, second = np.array(splitters, np.int64).T
    out = np.searchsorted(first, score, side="left")
    for value in np.unique(first[np.minimum(out, len(first) - 1)]):  # rows that share the score of splitters
        rows = np.flatnonzero(score == value)
        lo, hi = np.searchsorted(first, value, side="left"), np.searchsorted(first, value, side="right")
        out[rows] = lo + np.searchsorted(second[lo:hi], doc_id[rows], side="right")
    return out


def _merge(table: pa.Table, before: dict[int, int]) -> pa.Table:
    """The pieces of one segment, merged, with their ranks."""
    table = table.combine_chunks()
    segment = table["segment"][0].as_py()
    order = np.lexsort(_keys(table)[::-1])  # a merge sort of sorted pieces
    rank = before[segment] + 1 + np.arange(len(order), dtype=np.int64)
    return table.take(pa.array(order)).select(COLUMNS).append_column("rank", pa.array(rank))


def rank(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, salt: int = SALT,
         segments: int | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null for what is not drawn) of every document.

    Of the N documents with at least `least_words` words, `percent` percent are drawn, rounded down. `segments` follows the number
    of shuffle partitions, which the user sizes by the data.
    """
    spark = docs.sparkSession
    segments = segments or SEGMENTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    gains = staged(lambda: bucket_gains(docs, target), "resample-gains", spark)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features", "n_words"]
    in_run = F.monotonically_increasing_id()  # run in the upper bits, place in the run in the lower 33
    runs = staged(lambda: score(docs, gains, salt).withColumn("_small", F.col("n_words") < least_words).sortWithinPartitions(
        "_small", *order).withColumn("_place", in_run), "resample-runs", spark)
    some = runs.where(~F.col("_small"))
    total = some.count()
    drawn = percent * total // 100
    step = max(1, total // (segments * SAMPLES_EACH))
    samples = some.where(F.col("_place").bitwiseAND((1 << 33) - 1) % step == 0).select(
        (-F.col("score")).alias("score"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"))
    # SAMPLES_EACH samples a segment and one a run are ordered in one task, and about `segments` of them reach the driver
    every = max(1, samples.count() // segments)
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "doc_id"))
    chosen = samples.withColumn("_nth", nth).where(F.col("_nth") % every == 0)
    splitters = [(r.score, r.doc_id) for r in chosen.orderBy("_nth").collect()]

    def place(batches):
        for batch in batches:
            keys = _keys(batch)
            yield batch.append_column("segment", pa.array(segment_of(keys[0], keys[1], splitters)))

    kinds = ", ".join(f"{c} long" for c in COLUMNS)
    cut = some.select(*COLUMNS).mapInArrow(tidy(place), f"{kinds}, segment long")
    before, so_far = {}, 0
    for segment, n in sorted(tuple(r) for r in cut.groupBy("segment").agg(F.count("*")).collect()):
        before[segment], so_far = so_far, so_far + n
    last = max((s for s, n in before.items() if n < drawn), default=-1)
    merged = cut.where(F.col("segment") <= last).groupBy("segment").applyInArrow(
        tidy(lambda t: _merge(t, before)), f"{kinds}, rank long")
    merged = merged.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = cut.where(F.col("segment") > last).select(*COLUMNS).unionByName(runs.where("_small").select(*COLUMNS))
    return merged.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose doc_id is drawn, with all their columns; rows that repeat a drawn doc_id come along."""
    found = rank(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
