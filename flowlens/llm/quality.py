"""Quality rules on repetition inside a document, from the longest-common-prefix intervals of its suffix array.

Every suffix of a document's words is sorted; neighbours in that order share the longest prefixes. An interval of the
prefix lengths is a maximal repeated substring, and the longest repeat that starts at a word is the larger of the prefix
lengths towards its two neighbours. So the union of all maximal repeats of at least `min_words` words is the union of these
spans. A document is rejected when the union covers too large a share of its words or one repeat is too long.

Only words at which a repeat of `WINDOW` words starts enter the array (others have no repeat to report); the order comes from
prefix doubling: classes of equal 5, 10, 20, ... words, refined until every suffix stands alone.

Base rules: fewer than `min_doc_words` words, or more than `max_repeat_share` percent of the words in 5-word windows that occur
twice or more.

Defined results: null and empty texts have no words and fail the base rules; rows are judged one by one, so ties and repeated
rows are all kept or all rejected; extra columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm import kernels as K
from flowlens.llm.exchange import give_rest, keep_rest, tidy

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat",
        "kept")


def repeated(key: np.ndarray) -> np.ndarray:
    """Indices of the values that occur twice or more, ordered by value, then index."""
    if not len(key):
        return np.zeros(0, np.int64)
    packed = np.sort((key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64))
    high = packed >> np.uint64(32)
    same = high[1:] == high[:-1]
    some = np.zeros(len(key), bool)
    some[1:] |= same
    some[:-1] |= same
    at = (packed[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return at
    at = at[np.argsort(key[at], kind="stable")]
    value = key[at]
    same = value[1:] == value[:-1]
    some = np.zeros(len(at), bool)
    some[1:] |= same
    some[:-1] |= same
    return at[some]


def group_starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def longest_repeats(word: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a repeat of WINDOW words or more starts, and the length of the longest repeat that starts there.

    `word`: hash of every word, `text`: its text number, `bounds`: words before each text.
    """
    none = np.zeros(0, np.int64)
    gram = K.rolling_hash(K.prefix_sums(word), WINDOW)
    if not len(gram):
        return none, none
    inside = text[WINDOW - 1:] == text[:len(gram)]
    places = np.flatnonzero(inside)
    key = K.mix(gram[places] ^ K.mix(text[places].astype(np.uint64) + np.uint64(1)))
    found = repeated(key)
    if not len(found):
        return none, none
    pos, value = places[found], key[found]
    head = group_starts(value)
    m, n = len(pos), len(word)
    rank = np.arange(n, dtype=np.int64) + m  # words outside the array never tie
    rank[pos] = np.flatnonzero(head)[np.cumsum(head) - 1]
    end = bounds[text + 1]  # first word behind the text of each word
    levels, k, tied = [], WINDOW, pos
    while len(tied):
        levels.append((k, rank))
        ahead = tied + k
        second = np.where(ahead < end[tied], rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((second, rank[tied]))
        tied, second = tied[order], second[order]
        first = rank[tied]
        old, new = group_starts(first), group_starts(first, second)
        at = np.arange(len(tied))
        fresh = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        rank = rank.copy()
        rank[tied] = fresh
        alone = new & np.append(new[1:], True)
        tied, k = tied[~alone], 2 * k
    suffixes = pos[np.argsort(rank[pos])]
    a, b = suffixes[:-1], suffixes[1:]
    shared = np.zeros(len(a), np.int64)
    limit = np.minimum(end[a] - a, end[b] - b)
    limit[text[a] != text[b]] = 0
    for k, rank in reversed(levels):
        fits = shared + k <= limit
        equal = fits & (rank[np.minimum(a + shared, n - 1)] == rank[np.minimum(b + shared, n - 1)])
        shared[equal] += k
    for _ in range(WINDOW - 1):
        fits = shared < limit
        equal = fits & (word[np.minimum(a + shared, n - 1)] == word[np.minimum(b + shared, n - 1)])
        limit = np.where(equal, limit, shared)
        shared[equal] += 1
    longest = np.zeros(len(suffixes), np.int64)
    longest[:-1] = shared
    longest[1:] = np.maximum(longest[1:], shared)
    return suffixes, longest


def covered(starts: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text inside the union of spans."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return inside[bounds[1:]] - inside[bounds[:-1]]


def per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(data, offsets, sums, word_starts) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    cut = data == 10
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(cut) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & cut[np.maximum(ends - 1, 0)])
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    text = np.searchsorted(offsets, starts, side="right") - 1
    key = K.mix(K.span_hash(sums, starts, ends) ^ K.mix(text.astype(np.uint64) + np.uint64(1)))
    at = repeated(key)
    later = at[~group_starts(key[at])]
    return np.bincount(text[later], minlength=len(offsets) - 1)


def judge(data: np.ndarray, offsets: np.ndarray, rules: dict) -> dict[str, np.ndarray]:
    """All figures and verdicts of a run of texts."""
    starts, ends, bounds = K.words(data, offsets)
    sums = K.prefix_sums(K.byte_values(data))
    word = K.span_hash(sums, starts, ends)
    n_words = np.diff(bounds)
    text = np.repeat(np.arange(len(n_words)), n_words)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    in_word = ~K.IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)  # the first byte of a character that is no space
    pos, longest = longest_repeats(word, text, bounds)
    n_repeat = covered(pos, np.full(len(pos), WINDOW), bounds)
    counted = longest >= rules["min_words"]
    cover = covered(pos[counted], longest[counted], bounds)
    top = np.zeros(len(n_words), np.int64)
    np.maximum.at(top, text[pos], longest)
    failed = (n_words < rules["min_doc_words"]) | (100 * n_repeat > rules["max_repeat_share"] * n_words)
    kept = ~failed & (100 * cover <= rules["max_covered_share"] * n_words) & (top <= rules["max_longest"])
    return {
        "n_words": n_words, "word_chars": per_text(in_word[data], offsets), "n_symbols": per_text(is_symbol[data], offsets),
        "n_dup_lines": repeated_lines(data, offsets, sums, starts), "n_repeat_words": n_repeat, "base_failed": failed,
        "covered_words": cover, "longest_repeat": top, "kept": kept,
    }


# Clean prose rarely repeats ten words in a row; a tenth of a text or a passage of 100 words is a copy inside the text.
RULES = {"min_doc_words": 10, "max_repeat_share": 20, "min_words": 10, "max_covered_share": 15, "max_longest": 100}


def score(docs: DataFrame, **rules) -> DataFrame:
    """`docs` (text and any other columns) with the figures and `kept`."""
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    rules = RULES | rules
    kept = keep_rest(docs, "text")
    kinds = {"base_failed": (pa.bool_(), "boolean"), "kept": (pa.bool_(), "boolean")}

    def run(batches):
        for batch in batches:
            parts = [judge(data, offsets, rules) for _, _, data, offsets in K.chunks(batch.column("text"))]
            made = []
            for name in MADE:
                kind = kinds.get(name, (pa.int64(),))[0]
                made.append(pa.array(np.concatenate([p[name] for p in parts]) if parts else [], kind))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("_rest"), *made], ["text", "_rest", *MADE])

    made = ", ".join(f"{n} {kinds.get(n, (None, 'long'))[1]}" for n in MADE)
    rest = kept.schema["_rest"].dataType.simpleString()
    return give_rest(kept.mapInArrow(tidy(run), f"text string, _rest {rest}, {made}"), *MADE)
