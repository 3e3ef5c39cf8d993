"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are identical), at least max(LEAST_LENGTH, LEAST_PERIODS * q) long,
that no neighbouring word extends.

Synchronising set at scale t. Every window of t words has a hash; windows of period t/3 or less have none. Place i belongs to the
set if the smallest hash of the windows i .. i+t is that of window i or of window i+t, so membership depends on the 2t words from
i on only: equal contexts are chosen alike. A stretch of 3t-1 words without a small period has a place among its first t.

Proposals. In a run of period q, 3t <= q < 6t, some place of the set and the place q words later lie in the run and have equal
contexts of 2t words. So the places of a scale are ordered by context, and pairs of equal context 3t to 6t words apart propose
their distance. Equal contexts stand more than t/3 apart, so a place meets few others. Scales double from FIRST_SCALE on, up to a
ninth of the text; periods below 3 * FIRST_SCALE come from the highly periodic stretches, which are found by direct comparison
at these distances and also tell which windows have no hash at the scales above.

Every proposal is extended to both sides (by halving, on hashes of spans) and counts if it is long enough; of proposals with the
same ends the smallest period is the run's. No run is found by its hash alone: its words are compared.

Texts of a chunk are worked on together; a word that occurs nowhere stands between them, so that no run leaves its text.

Defined results: null and empty texts have no words and no runs; repeated rows have the same result each; a row without a doc_id is like
any other; extra columns stay, except those named like a made one; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm import kernels as K
from flowlens.llm.exchange import give_rest, keep_rest, tidy

LEAST_LENGTH = 24
LEAST_PERIODS = 3
FIRST_SCALE = 4
MADE = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256")
NONE = np.zeros(0, np.int64)
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)


def stretches(word: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of at least `least` words whose words `period` apart are equal."""
    if len(word) <= period:
        return NONE, NONE
    edge = np.diff(np.concatenate([[0], (word[period:] == word[:-period]).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + period
    long_ = ends - starts >= least
    return starts[long_], ends[long_]


def smallest_periods(starts, ends, periods):
    """One of each stretch: the one with the smallest period."""
    order = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[order], ends[order], periods[order]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    return starts[new], ends[new], periods[new]


def synchronising_set(hashes: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Places of the set. `hashes`: of all windows of `scale` words; `periodic`: windows that have none."""
    ids = hashes.copy()
    ids[ids == NO_HASH] -= np.uint64(1)
    ids[periodic] = NO_HASH
    low = K.sliding_min(ids, scale + 1)
    return np.flatnonzero((low != NO_HASH) & ((low == ids[:len(low)]) | (low == ids[scale:scale + len(low)])))


def periodic_windows(n: int, scale: int, starts, ends, periods) -> np.ndarray:
    """Of n windows of `scale` words those with a period of a third of it or less."""
    some = (3 * periods <= scale) & (ends - starts >= scale)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, ends[some] - scale + 1, -1)
    return np.cumsum(edge)[:n] > 0


def pairs_of_context(places: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (low <= distance < high) of places with equal context."""
    order = np.argsort(context, kind="stable")
    places, context = places[order], context[order]
    found_at, found_by = [NONE], [NONE]
    left, step = np.arange(len(places)), 0
    while len(left):
        step += 1
        left = left[left < len(places) - step]
        left = left[context[left + step] == context[left]]
        apart = places[left + step] - places[left]
        left, apart = left[apart < high], apart[apart < high]  # later ones of the context stand further away
        wide = apart >= low
        found_at.append(places[left[wide]])
        found_by.append(apart[wide])
    return np.concatenate(found_at), np.concatenate(found_by)


def extend(word: np.ndarray, sums: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest stretches around the words [at, at + 2 * apart) whose words `apart` apart are equal."""
    n = len(word)

    def reach(limit, equal):
        """The largest k <= limit for which `equal` holds: it holds for all smaller ones too."""
        low, high = np.zeros(len(at), np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            ok = equal(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    ahead = reach(n - at - apart, lambda k: K.span_hash(sums, at, at + k) == K.span_hash(sums, at + apart, at + apart + k))
    behind = reach(at, lambda k: K.span_hash(sums, at - k, at) == K.span_hash(sums, at + apart - k, at + apart))
    return at - behind, at + apart + ahead


def is_run(word: np.ndarray, start: int, end: int, period: int) -> bool:
    same = np.array_equal(word[start:end - period], word[start + period:end])
    grows = (start > 0 and word[start - 1] == word[start - 1 + period]) or (end < len(word) and word[end] == word[end - period])
    return same and not grows


def all_runs(word: np.ndarray, sizes: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS):
    """Starts, ends and periods of all runs, by start, then period.

    `word`: 64-bit hash of every word of some texts, one text after another, a number of its own behind each text; `sizes`:
    words of each text.
    """
    found = [NONE], [NONE], [NONE]

    def keep(starts, ends, periods):
        for to, part in zip(found, (starts, ends, periods), strict=True):
            to.append(part)

    for q in range(1, 3 * FIRST_SCALE):
        starts, ends = stretches(word, q, 3 * q)
        keep(starts, ends, np.full(len(starts), q))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    scale = FIRST_SCALE
    while 9 * scale <= sizes.max(initial=0):
        # texts with room for three periods of this scale; a text moves to the front together with the number behind it
        large = np.flatnonzero(sizes >= 9 * scale)
        at = K.ranges(first[large], sizes[large] + 1)
        part = word[at]
        starts, ends, periods = smallest_periods(*(np.concatenate(c) for c in found))
        inside = np.searchsorted(first[large], starts, side="right") - 1
        shift = np.concatenate([[0], np.cumsum(sizes[large] + 1)])[:-1] - first[large]
        inside_ok = (inside >= 0) & (starts < first[large][np.maximum(inside, 0)] + sizes[large][np.maximum(inside, 0)])
        moved = shift[inside[inside_ok]]
        sums = K.prefix_sums(part)
        hashes = K.rolling_hash(sums, scale)
        periodic = periodic_windows(len(hashes), scale, starts[inside_ok] + moved, ends[inside_ok] + moved, periods[inside_ok])
        places = synchronising_set(hashes, scale, periodic)
        places = places[places + 2 * scale <= len(part)]
        where, apart = pairs_of_context(places, K.span_hash(sums, places, places + 2 * scale), 3 * scale, 6 * scale)
        if len(where):
            starts, ends = extend(part, sums, where, apart)
            long_ = ends - starts >= 3 * apart
            starts, ends, apart = smallest_periods(starts[long_], ends[long_], apart[long_])
            keep(at[starts], at[ends - 1] + 1, apart)
        scale *= 2
    starts, ends, periods = smallest_periods(*(np.concatenate(c) for c in found))
    long_ = ends - starts >= np.maximum(least_length, least_periods * periods)
    starts, ends, periods = starts[long_], ends[long_], periods[long_]
    true = np.array([is_run(word, *r) for r in zip(starts.tolist(), ends.tolist(), periods.tolist(), strict=True)], bool)
    starts, ends, periods = starts[true], ends[true], periods[true]
    order = np.lexsort((periods, starts))
    return starts[order], ends[order], periods[order]


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """Indices of the words of the test edit: some documents repeat a stretch from some word on. None: nothing changes."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def describe(words: list[bytes], starts, ends, periods) -> tuple:
    """The made columns of one text."""
    runs = list(zip(starts, (e - s for s, e in zip(starts, ends, strict=True)), periods, strict=True))
    best = None
    for r in runs:  # ordered by start, then period, so the first of equal exponents stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, listed,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def find_runs(docs: DataFrame, edit: bool = False, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """`docs` with n_words, n_runs, the run of the greatest length by period (start, length, period, exponent_milli), all runs as
    lines `start,length,period`, and the digests of these lines and of the words that no run drops.

    A word is dropped if a run has it behind its first period. `edit` changes the words of a tenth of the documents first (see `looped`).
    """
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods are not found")
    kept = keep_rest(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for lo, hi, data, offsets in K.chunks(batch.column("text")):
                begins, ends, bounds = K.words(data, offsets)
                hashes = K.span_hash(K.prefix_sums(K.byte_values(data)), begins, ends)
                raw = data.tobytes()
                texts, parts = [], []
                for i in range(hi - lo):
                    words = raw[offsets[i]:offsets[i + 1]].split()  # at the same six characters
                    own = hashes[bounds[i]:bounds[i + 1]]
                    order = looped(ids[lo + i], len(words)) if edit else None
                    if order is not None:
                        own, words = own[order], [words[k] for k in order.tolist()]
                    texts.append(words)
                    parts += [own, K.mix(np.array([i], np.uint64))]
                sizes = np.diff(bounds)
                starts, stops, periods = all_runs(np.concatenate(parts), sizes, least_length, least_periods)
                first = np.concatenate([[0], np.cumsum(sizes + 1)])
                cut = np.searchsorted(starts, first)
                for i, words in enumerate(texts):
                    s = slice(cut[i], cut[i + 1])
                    rows.append((len(words), *describe(words, (starts[s] - first[i]).tolist(), (stops[s] - first[i]).tolist(),
                                                       periods[s].tolist())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(MADE)
            kinds = [pa.string() if name.endswith(("runs", "sha256")) and name != "n_runs" else pa.int64() for name in MADE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), batch.column("_rest"),
                 *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "text", "_rest", *MADE])

    rest = kept.schema["_rest"].dataType.simpleString()
    kind = kept.schema["doc_id"].dataType.simpleString()
    made = ", ".join(f"{n} {'string' if n in ('runs', 'runs_sha256', 'collapsed_sha256') else 'long'}" for n in MADE)
    return give_rest(kept.mapInArrow(tidy(run), f"doc_id {kind}, text string, _rest {rest}, {made}"), *MADE)
