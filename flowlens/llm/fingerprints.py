"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

A text's set is that of its shingles of `WORDS_EACH` words (`[^\\x20\\x09-\\x0D]+`); a text with fewer words has its whole
sequence as the only shingle. Every shingle is hashed once (MD5, as hexadecimal digits). The first two digits name one of `BINS`
bins, and a bin keeps its smallest hash.

Empty bins are filled by optimal densification: bin j probes the bins in the order of its own 2-universal hash
(a[j] * bin + b[j]) mod 65537 and copies the first one that a shingle filled, so a full bin is lent alike to all empty ones. The order
is a permutation, so the probing ends.

Of each bin the last digit (4 bits) is stored: a fingerprint is a text of `BINS` hexadecimal digits. Two different hashes share
their last digit once in 16, so a share m of equal digits stands for the likeness (m - 1/16) / (1 - 1/16), not below 0.

A text is never sent to another task for its fingerprint: words, hashes, sort and bins are array functions of the row.

Defined results: null counts as an empty text; a text without words has the empty fingerprint, which is like itself (1) and like no
other (0); equal texts have equal fingerprints; repeated rows are all returned; extra columns stay, except those named like a made
one; an empty table gives an empty table. In `with_edits` the next document of a row is that of the next larger doc_id, after the
last the first; of rows that repeat this doc_id it is the one with the longest text (then by hash of the text); a row
without a doc_id has no next document: its last half is cut off and `near_next` is 0.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.exchange import give_rest, keep_rest, staged

WORDS_EACH = 5
BINS = 256  # two hexadecimal digits
PRIME = 65_537
PROBES = 32  # so many are tried one by one; only then all full bins are compared, with the same result
EMPTY = "~"  # stands behind the digits of a bin without a shingle and sorts after every digit


def probe_factors(bins: int = BINS) -> list[tuple[int, int]]:
    """a and b of every bin's probing order."""
    return [tuple(int(hashlib.md5(f"{side}{j}".encode()).hexdigest()[:4], 16) + more for side, more in (("a", 1), ("b", 0)))
            for j in range(bins)]


def _numbers(values, kind: str = "int") -> Column:
    """A constant array, as one literal: the optimizer folds the split."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of one of its text columns."""
    names = [c for c in df.columns if c != out]
    kept = [F.col(f"`{c}`") for c in names]
    bins = _numbers(range(BINS))
    empty = F.transform(bins, lambda j: F.concat(F.lower(F.lpad(F.hex(j), 2, "0")), F.lit(EMPTY)))
    factors = probe_factors()
    a, b = _numbers((x for x, _ in factors), "long"), _numbers((x for _, x in factors), "long")
    orders = [sorted(range(BINS), key=lambda c: (x * c + y) % PRIME)[:PROBES] for x, y in factors]
    w, h, m, own, d = (F.col(c) for c in ("_words", "_hashes", "_least", "_own", "_full"))

    step = df.select(*kept, words_of(F.col(f"`{text}`")).alias("_words"))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS_EACH - 1), F.lit(1))),
                           lambda i: F.md5(F.array_join(F.slice(w, i, WORDS_EACH), " ").cast("binary")))
    # with one more entry for every bin, the first of each bin in sorted order is its smallest hash or the mark of an empty one
    step = step.select(*kept, F.when(F.size(w) > 0, F.sort_array(F.concat(shingles, empty))).alias("_hashes"))
    bin_of = lambda x: F.substring(x, 1, 2)
    bin_of = lambda x: F.substring(x, 1, 2)
    step = step.select(*kept, F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1)))).alias("_least"))
    # the last digit of each bin's smallest hash, null for an empty bin
    step = step.select(*kept, F.transform(m, lambda x: F.when(F.length(x) > 3, F.substring(x, 32, 1))).alias("_own"))
    step = step.select(*kept, own, F.filter(bins, lambda j: F.get(own, j).isNotNull()).alias("_full"))

    def lender(j):
        order = F.transform(d, lambda c: ((F.get(a, j) * c + F.get(b, j)) % PRIME) * BINS + c)
        return (F.array_min(order) % BINS).cast("int")

    first = [_numbers(order[t] for order in orders) for t in range(PROBES)]
    digits = F.transform(own, lambda x, j: F.coalesce(
        x, *[F.get(own, F.get(probe, j)) for probe in first], F.get(own, lender(j))))
    return step.select(*kept, F.when(F.size(d) > 0, F.array_join(digits, "")).otherwise("").alias(out))


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of the two sets, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(one, ""), F.split(other, ""), lambda x, y: x == y), lambda x: x))
    corrected = F.greatest((same / F.lit(BINS / 16.0) - 1) / 15, F.lit(0.0))
    return F.when(one == other, 1.0).when((one == "") | (other == ""), 0.0).otherwise(corrected)


def predecessors(docs: DataFrame) -> DataFrame:
    """_id, _before, _most: of every doc_id the one before it (of the first: the last) and the longest text there.

    The ids are spread over ranges; in a range the one before is the row before, and the ranges' ends are chained (one row per range).
    """
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.length(F.coalesce("text", F.lit("")))).alias("_long"))
    ranged = staged(lambda: ids.repartitionByRange("_id").select("_id", "_long", F.spark_partition_id().alias("_range")),
                    "fingerprint-ids", docs.sparkSession)
    last = F.struct("_id", "_long")
    chain, every = Window.partitionBy(F.lit(0)).orderBy("_range"), Window.partitionBy(F.lit(0))
    ends = ranged.groupBy("_range").agg(F.max(last).alias("_last")).select(
        "_range", F.coalesce(F.lag("_last").over(chain), F.max("_last").over(every)).alias("_chained"))
    inside = Window.partitionBy("_range").orderBy("_id")
    found = ranged.select("_id", "_range", F.lag(last).over(inside).alias("_inside")).join(ends, "_range")
    before = F.coalesce("_inside", "_chained")
    return found.select("_id", before["_id"].alias("_before"), before["_long"].alias("_most"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Every row with n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited and near_next.

    In the edited text the last n_chars / 2 code points are replaced by the first as many (or all) of the next document. A
    document goes to the place of its doc_id once, and from there its beginning to the one before it.
    """
    made = ("n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next")
    kept = keep_rest(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    kept = with_fingerprint(kept.withColumn("n_chars", F.length("text").cast("long")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    placed = kept.where("doc_id is not null").join(predecessors(docs).hint("merge"), F.col("doc_id") == F.col("_id")).drop("_id")
    repeats = Window.partitionBy("doc_id").orderBy(F.col("n_chars").desc(), F.xxhash64("text"))
    ahead = placed.withColumn("_nth", F.row_number().over(repeats)).where("_nth = 1").select(
        F.col("_before").alias("_at"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("_most") / 2).cast("int")).alias("_next"),
        F.col("fingerprint").alias("_next_fingerprint"))
    met = placed.join(ahead.hint("merge"), F.col("doc_id") == F.col("_at")).drop("_at", "_before", "_most")
    alone = kept.where("doc_id is null").withColumns({
        "_next": F.lit(""), "_next_fingerprint": F.lit(None).cast("string")})
    both = met.unionByName(alone)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
                      F.substring(F.col("_next"), F.lit(1), half))
    both = both.withColumn("_edited", edited)
    out = with_fingerprint(both, "_edited", "edited_fingerprint").withColumns({
        "edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256),
        "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
        "near_next": F.coalesce(likeness(F.col("fingerprint"), F.col("_next_fingerprint")), F.lit(0.0))})
    return give_rest(out.select("doc_id", "text", "_rest", *made), *made)
