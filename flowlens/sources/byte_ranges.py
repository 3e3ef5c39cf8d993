"""CSV files cut into byte ranges that tasks read on their own: what a range does to the state of its file is carried over its edges.

Characters. A range is judged as UTF-8 without the continuation bytes it starts with and the unfinished character it ends with; the two
pieces that meet at an edge are judged together.

Quotes. A run of r quotes does one of three things to the state (outside or inside a quoted field): an odd run behind a delimiter, a line
break or the file's start toggles it, another odd run ends a quoted field (outside it is part of the field), an even run changes nothing. These
compose, so each range is summed up without knowing its first state, and a prefix over the ranges of a file gives every first state. A run
belongs to the range where it starts. Records are cut at line breaks outside quotes; a record belongs to the range where it starts, and
its task reads on to its end.
"""

from __future__ import annotations

import codecs
import csv
import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import ship_package

RANGE_BYTES = 16 << 20
STEP = 1 << 20  # read at most at once behind the end of a range; the first step is small, each is twice the one ahead
FIRST_STEP = 4096
DELIMITERS = ",;\t|"
BOM = b"\xef\xbb\xbf"
BREAK, RETURN, QUOTE = 10, 13, 34
# Bytes without a character in code page 1252.
NOT_CP1252 = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")
SUMMARY = "struct<reset: boolean, odd: int, outside: long, inside: long>"


def cut(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, file_name, length, part, start, stop of every range. `files` has path, file_name, length."""
    last = F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0))
    parts = files.select("path", "file_name", "length", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("part"))
    return parts.select("*", (F.col("part") * range_bytes).alias("start"),
                        F.least(F.col("length"), (F.col("part") + 1) * range_bytes).alias("stop"))


def spread(ranges: DataFrame) -> DataFrame:
    """Ranges dealt to tasks one by one."""
    return ranges.repartition(F.xxhash64("path", "part"))


class Bytes:
    """The bytes of a range, with the byte ahead of it and as many behind it as asked for."""

    def __init__(self, path: str, start: int, stop: int, length: int):
        store, inner = fs.FileSystem.from_uri(path)
        self.file, self.length, self.step = store.open_input_file(inner), length, FIRST_STEP
        self.low = max(start - 1, 0)
        self.data = self._read(self.low, stop)
        self.start, self.stop = self._past_quotes(start), self._past_quotes(stop)

    def _read(self, low: int, high: int) -> bytes:
        self.file.seek(low)
        return self.file.read(high - low)

    def more(self) -> bool:
        """Reads on; false at the end of the file."""
        end = self.low + len(self.data)
        if end >= self.length:
            return False
        self.data += self._read(end, min(end + self.step, self.length))
        self.step = min(2 * self.step, STEP)
        return True

    def _past_quotes(self, at: int) -> int:
        """`at`, or the end of the run of quotes that it stands in."""
        while 0 < at < self.length:
            if at - self.low >= len(self.data) and not self.more():
                break
            if self.data[at - 1 - self.low] != QUOTE or self.data[at - self.low] != QUOTE:
                break
            at += 1
        return at

    def array(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)


def quote_runs(data: np.ndarray, first: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the runs of quotes that start in [first, stop) of `data`, their lengths, and the byte ahead of each."""
    at = np.flatnonzero(data[first:] == QUOTE) + first
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], np.diff(at) > 1])
    starts = at[new]
    sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
    keep = starts < stop
    starts, sizes = starts[keep], sizes[keep]
    ahead = np.where(starts > 0, data[np.maximum(starts - 1, 0)], BREAK)
    return starts, sizes, ahead


def states(sizes: np.ndarray, ahead: np.ndarray, delimiter: str, inside: int) -> np.ndarray:
    """Whether the text behind each run is inside quotes (1), if it was `inside` ahead of the first."""
    odd = sizes % 2 == 1
    opens = np.isin(ahead, [ord(delimiter), BREAK, RETURN])
    flips, resets = odd & opens, odd & ~opens
    total = inside + np.cumsum(flips)
    # what is summed up to the last reset does not count
    base = np.maximum.accumulate(np.where(resets, np.arange(1, len(sizes) + 1), 0))
    return np.where(base > 0, total - total[np.maximum(base - 1, 0)], total) % 2


def _summary(data: np.ndarray, first: int, stop: int, bom: bool, delimiter: str) -> tuple[bool, int, int, int]:
    """Whether a range ends what was open before, its toggles since (odd or even), and its line breaks inside quotes for both
    first states."""
    starts, sizes, ahead = quote_runs(data, first, stop)
    if bom and len(starts) and starts[0] == first:
        ahead = ahead.copy()
        ahead[0] = BREAK
    odd = sizes % 2 == 1
    reset = bool((odd & ~np.isin(ahead, [ord(delimiter), BREAK, RETURN])).any())
    breaks = np.flatnonzero(data[first:stop] == BREAK) + first
    counts = []
    for inside in (0, 1):
        after = np.concatenate([[inside], states(sizes, ahead, delimiter, inside)])
        counts.append(int(after[np.searchsorted(starts, breaks)].sum()))
    end = int(states(sizes, ahead, delimiter, 0)[-1]) if len(starts) else 0
    return reset, end, *counts


def _head(found: Bytes, least: int) -> bytes:
    """The bytes up to the end of the first record, `least` at least."""
    while True:
        quotes, end = 0, -1
        for m in re.finditer(rb'["\n]', found.data):
            if m[0] == b'"':
                quotes += 1
            elif quotes % 2 == 0:
                end = m.end()
                break
        if (end >= 0 and len(found.data) >= least) or not found.more():
            return found.data[:max(end, least)] if end >= 0 else found.data


def _scan(batches: Iterator[pd.DataFrame], head_bytes: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            found = Bytes(r.path, r.start, r.stop, r.length)
            own = found.data[r.start - found.low:r.stop - found.low]
            lead = 0
            while r.part and lead < min(3, len(own)) and own[lead] & 0xC0 == 0x80:
                lead += 1
            decoder = codecs.getincrementaldecoder("utf-8")()
            try:
                decoder.decode(own[lead:])
                valid, tail = True, decoder.getstate()[0]
            except UnicodeDecodeError:
                valid, tail = False, b""
            bom = r.part == 0 and own.startswith(BOM)
            first = found.start - found.low + (len(BOM) if bom else 0)
            data = found.array()
            told = [_summary(data, first, found.stop - found.low, bom, d) for d in DELIMITERS]
            rows.append((r.path, r.file_name, r.length, r.part, r.start, r.stop, valid, own[:lead], tail,
                         NOT_CP1252.search(own) is None, _head(found, head_bytes) if r.part == 0 else None,
                         [dict(zip(("reset", "odd", "outside", "inside"), t, strict=True)) for t in told]))
        yield pd.DataFrame(rows, columns=["path", "file_name", "length", "part", "start", "stop", "valid", "lead", "tail", "cp1252",
                                          "head", "quotes"])


def scan(files: DataFrame, head_bytes: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per range: what it says about the encoding, the start of the file, and its quotes for each delimiter."""
    ship_package(files.sparkSession)
    return spread(cut(files, range_bytes)).mapInPandas(
        lambda it: _scan(it, head_bytes),
        "path string, file_name string, length long, part long, start long, stop long, valid boolean, lead binary, tail binary, "
        f"cp1252 boolean, head binary, quotes array<{SUMMARY}>")


def judged(scanned: DataFrame) -> DataFrame:
    """path, file_name, utf8, cp1252, head of every file."""
    order = Window.partitionBy("path").orderBy("part")
    none = F.lit(b"")
    meet = F.concat(F.coalesce(F.lag("tail").over(order), none), F.col("lead"))
    rest = F.lead("part").over(order).isNull() & (F.length("tail") > 0)  # a character that the file does not finish
    ok = F.col("valid") & F.is_valid_utf8(meet.cast("string")) & ~rest
    return scanned.select("path", "file_name", "cp1252", "head", ok.alias("_ok")).groupBy("path", "file_name").agg(
        F.every("_ok").alias("utf8"), F.every("cp1252").alias("cp1252"), F.max("head").alias("head"))


def first_states(scanned: DataFrame, delimiters: DataFrame) -> DataFrame:
    """The ranges with `inside` (the state ahead of each) and `breaks` (line breaks inside quotes). `delimiters`: path, delimiter."""
    rows = scanned.select("path", "file_name", "length", "part", "start", "stop", "quotes").join(
        delimiters.select("path", "delimiter"), "path").withColumn("_q", F.element_at("quotes", F.instr(F.lit(DELIMITERS), F.col("delimiter"))))
    order = Window.partitionBy("path").orderBy("part")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_q.odd").over(ahead), F.lit(0)))
    base = F.last(F.when(F.col("_q.reset"), F.col("_before")), ignorenulls=True).over(ahead)
    rows = rows.withColumn("inside", ((F.col("_before") - F.coalesce(base, F.lit(0))) % 2).cast("int"))
    return rows.select("path", "file_name", "length", "part", "start", "stop", "delimiter", "inside", F.when(
        F.col("inside") == 1, F.col("_q.inside")).otherwise(F.col("_q.outside")).alias("breaks"))


def _outside_breaks(data: np.ndarray, first: int, inside: int, delimiter: str, bom: bool) -> np.ndarray:
    """Places of the line breaks outside quotes, from `first` on."""
    starts, sizes, ahead = quote_runs(data, first, len(data))
    if bom and len(starts) and starts[0] == first:
        ahead = ahead.copy()
        ahead[0] = BREAK
    after = np.concatenate([[inside], states(sizes, ahead, delimiter, inside)])
    breaks = np.flatnonzero(data[first:] == BREAK) + first
    return breaks[after[np.searchsorted(starts, breaks)] == 0]


def records(path: str, start: int, stop: int, length: int, inside: int, delimiter: str) -> Iterator[bytes]:
    """The records that start in a range, without their line breaks. `inside`: state ahead of the range."""
    found = Bytes(path, start, stop, length)
    bom = start == 0 and found.data.startswith(BOM)
    first, end = found.start - found.low + (len(BOM) if bom else 0), found.stop - found.low
    while True:
        data = found.array()
        breaks = _outside_breaks(data, first, inside, delimiter, bom)
        # a run of quotes at the end of what was read may go on, so a break counts once more is known behind it or the file ends
        behind = breaks[breaks >= end - 1]
        if len(behind) or not found.more():
            break
    begins = breaks[breaks < end - 1] + 1
    # ahead of the first byte stands a line break outside quotes, or the file starts
    at_start = start == 0 or (inside == 0 and first > 0 and data[first - 1] == BREAK)
    if at_start and first < end:
        begins = np.concatenate([[first], begins])
    stops = np.searchsorted(breaks, begins)
    for b, k in zip(begins.tolist(), stops.tolist(), strict=True):
        e = int(breaks[k]) if k < len(breaks) else len(data)
        raw = found.data[b:e]
        yield raw[:-1] if raw.endswith(b"\r") else raw


def _parse(batches: Iterator[pd.DataFrame], encoding: str, delimiter: str, width: int, rows_each: int = 20_000) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(sys.maxsize)
    names = ["file_name", "_start", "_at", "fields", "line"]
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            rows = []
            for at, raw in enumerate(records(r.path, r.start, r.stop, r.length, r.inside, delimiter)):
                text = raw.decode(encoding, "replace")
                if (r.start == 0 and at == 0) or not text.strip("\r\n "):
                    continue  # the header, empty lines
                try:
                    fields = next(csv.reader([text], delimiter=delimiter))
                except csv.Error:
                    fields = None
                if fields is None or len(fields) > width:
                    rows.append((r.file_name, r.start, at, None, text))
                else:
                    rows.append((r.file_name, r.start, at, [f or None for f in fields], None))
                if len(rows) == rows_each:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)


def parse(ranges: DataFrame, encoding: str, delimiter: str, columns: Sequence[str]) -> DataFrame:
    """file_name, _start, _at, one text column per name, and `line`: the record if it has too many fields, else null."""
    width = len(columns)
    ship_package(ranges.sparkSession)
    made = spread(ranges).mapInPandas(
        lambda it: _parse(it, encoding, delimiter, width),
        "file_name string, _start long, _at long, fields array<string>, line string")
    cells: list[Column] = [F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    return made.select("file_name", "_start", "_at", "line", *cells)
