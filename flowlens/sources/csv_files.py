"""Many mismatched CSV files to one table with a stable row order."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from flowlens.functions.local import local_table
from flowlens.session import staging_path
from flowlens.sources import byte_ranges

SAMPLE = 16_384  # bytes that the delimiter is judged by; the header and the encoding are judged by all that matters to them
REJECTED = "_rejected"
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = byte_ranges.DELIMITERS
# Names of the encodings as the JVM knows them.
JVM_CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, file_name, length of the CSV files directly in the folder. No content is read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "false")
        .load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )
    if found.isEmpty():
        raise FileNotFoundError(f"no CSV files under {folder}")
    return found.orderBy("file_name")


def pick_encoding(head: bytes, candidates: Sequence[str] = ENCODINGS) -> str:
    """The first candidate that decodes the sample; a character cut at its end does not count."""
    for name in candidates:
        try:
            codecs.getincrementaldecoder(name)().decode(head)
            return name
        except UnicodeDecodeError:
            continue
    return candidates[-1]


def pick_delimiter(text: str, candidates: str = DELIMITERS) -> str:
    try:
        return csv.Sniffer().sniff(text, candidates).delimiter
    except csv.Error:
        return ","


def raw_header(text: str, delimiter: str) -> list[str]:
    """Header names as a CSV reader would name them: blanks by position, repeats with a number."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader(io.StringIO(text), delimiter=delimiter), [])):
        name = name or f"Unnamed: {i}"
        n, made = 0, name
        while made in names:
            n += 1
            made = f"{name}.{n}"
        names.append(made)
    return names


def scan_files(spark: SparkSession, folder: str, range_bytes: int = byte_ranges.RANGE_BYTES) -> DataFrame:
    """What every byte range of every file says about its file; a large file is judged by as many tasks as it has ranges."""
    path = staging_path(spark, "file-ranges")
    byte_ranges.scan(list_files(spark, folder).select("path", "file_name", "length"), SAMPLE, range_bytes).write.parquet(path)
    return spark.read.parquet(path)


def profile_files(spark: SparkSession, folder: str, range_bytes: int = byte_ranges.RANGE_BYTES) -> DataFrame:
    """path, file_name, encoding, delimiter, header of every file: the encoding by all bytes, the rest by the first record."""
    return profiles_of(scan_files(spark, folder, range_bytes))


def profiles_of(scanned: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                encoding = "utf-8-sig" if r.utf8 else "cp1252" if r.cp1252 else "latin-1"
                text = codecs.getincrementaldecoder(encoding)("replace").decode(r.head or b"")
                delimiter = pick_delimiter(text)
                rows.append((r.path, r.file_name, encoding, delimiter, raw_header(text, delimiter)))
            yield pd.DataFrame(rows, columns=["path", "file_name", "encoding", "delimiter", "header"])

    return byte_ranges.judged(scanned).mapInPandas(
        run, "path string, file_name string, encoding string, delimiter string, header array<string>")


def header_table(profiles: DataFrame) -> DataFrame:
    """(file, pos, raw_name): the form the header operators work on."""
    return profiles.select(F.col("file_name").alias("file"), F.posexplode("header").alias("pos", "raw_name"))


def _normalized(spark: SparkSession, profiles: DataFrame) -> dict[str, list[str]]:
    from flowlens.operators.schema import disambiguate, normalize_headers

    rows = disambiguate(normalize_headers(header_table(profiles))).select("file", "pos", "column").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["file"], []).append((r["pos"], r["column"]))
    return {f: [name for _, name in sorted(cols)] for f, cols in out.items()}


def read_files(spark: SparkSession, folder: str, source: str = "source_file", row_id: str = "row_id",
               range_bytes: int = byte_ranges.RANGE_BYTES) -> DataFrame:
    """All files as one text table with the union of their columns, the source file and a row id.

    Files of equal encoding, delimiter and header are one scan. A line with fewer fields than the header is filled with
    nulls; one with more is left out here and listed by `rejected_lines`. Files with line breaks inside quotes are read in byte ranges
    by the state of their quotes, all others by Spark's reader.
    """
    parts, union = _scans(spark, folder, source, range_bytes)
    whole = None
    for scan, _ in parts:
        part = scan.where(F.col(REJECTED).isNull()).drop(REJECTED)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return number_rows(whole, source, row_id).select(row_id, *[c for c in union if c != source], source)


def rejected_lines(spark: SparkSession, folder: str, source: str = "source_file",
                   range_bytes: int = byte_ranges.RANGE_BYTES) -> DataFrame:
    """source_file, line, expected: the lines with more fields than their file's header."""
    parts, _ = _scans(spark, folder, source, range_bytes)
    out = None
    for scan, names in parts:
        part = scan.where(F.col(REJECTED).isNotNull()).select(source, F.col(REJECTED).alias("line"), F.lit(len(names)).alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out


def ingestion_report(spark: SparkSession, folder: str, source: str = "source_file",
                     range_bytes: int = byte_ranges.RANGE_BYTES) -> DataFrame:
    """Per file: rows, rejected lines, columns, and what it lacks of the columns of all files; with the totals of the run beside."""
    parts, union = _scans(spark, folder, source, range_bytes)
    canonical = [c for c in union if c != source]
    out = None
    for scan, names in parts:
        missing = [c for c in canonical if c not in names]
        part = scan.groupBy(source).agg(
            F.count_if(F.col(REJECTED).isNull()).alias("rows"), F.count_if(F.col(REJECTED).isNotNull()).alias("rejected")).select(
            source, "rows", "rejected", F.lit(len(names)).alias("columns"), F.lit(",".join(missing)).alias("missing_columns"))
        out = part if out is None else out.unionByName(part)
    every = Window.partitionBy(F.lit(0))  # one row per file
    return out.select(
        "*", F.sum("rows").over(every).alias("total_rows"), F.lit(len(canonical) + 1).alias("total_columns"),
        (F.max((F.col("missing_columns") != "").cast("int")).over(every) == 1).alias("schema_mismatch"))


def _scans(spark: SparkSession, folder: str, source: str,
           range_bytes: int) -> tuple[list[tuple[DataFrame, tuple[str, ...]]], list[str]]:
    """One scan per encoding, delimiter, header and kind of reader, and all columns. In `REJECTED` a scan has the raw line where it has
    too many fields, else null."""
    scanned = scan_files(spark, folder, range_bytes)
    stored = staging_path(spark, "file-profiles")
    profiles_of(scanned).write.parquet(stored)
    profiled = spark.read.parquet(stored)
    ranges = byte_ranges.first_states(scanned, profiled)
    broken = {r["path"] for r in ranges.groupBy("path").agg(F.sum("breaks").alias("n")).where("n > 0").collect()}
    profiles = profiled.collect()  # one row per file
    if any(JVM_CHARSETS[p["encoding"]] == "windows-1252" for p in profiles):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    table = spark.createDataFrame(
        [(p["file_name"], p["header"]) for p in profiles], "file_name string, header array<string>")
    columns = _normalized(spark, table)
    groups: dict[tuple, list[str]] = {}
    for p in profiles:
        key = (p["encoding"], p["delimiter"], tuple(columns[p["file_name"]]), p["path"] in broken)
        groups.setdefault(key, []).append(p["path"])
    union: list[str] = []
    for p in sorted(profiles, key=lambda p: p["file_name"]):
        union += [c for c in columns[p["file_name"]] if c not in union]
    parts = []
    for (encoding, delimiter, names, quoted), paths in groups.items():
        if quoted:
            named = local_table(spark, [(p,) for p in paths], "path string")
            scan = byte_ranges.parse(ranges.join(F.broadcast(named), "path"), encoding, delimiter, names)
            parts.append((scan.withColumnsRenamed({"file_name": source, "line": REJECTED}), names))
        else:
            parts.append((_plain_scan(spark, paths, JVM_CHARSETS[encoding], delimiter, names, source), names))
    return parts, union


def _plain_scan(spark: SparkSession, paths: Sequence[str], charset: str, delimiter: str, names: Sequence[str], source: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, REJECTED)])
    bare = F.regexp_replace(F.col(REJECTED), '"[^"]*"', "")  # a doubled quote is where two quoted parts meet
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    parsed = F.length(F.concat_ws("", names[0])) >= 0  # always true; Spark refuses scans of the raw line alone
    scan = spark.read.schema(schema).option("columnPruning", "false").csv(
        list(paths), sep=delimiter, encoding=charset, header=True, mode="PERMISSIVE", escape='"', columnNameOfCorruptRecord=REJECTED)
    return scan.select(
        *names, F.when((fields > len(names)) & parsed, F.col(REJECTED)).alias(REJECTED), F.col("_metadata.file_name").alias(source),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))


def number_rows(df: DataFrame, source: str, row_id: str) -> DataFrame:
    """Dense row id by source file, split start and place within the split.

    Splits are counted and the counts summed, per file and then over the files, so each task numbers only
    the rows of one split.
    """
    counts = df.groupBy(source, "_start").agg(F.count("*").alias("_n"))
    in_file = Window.partitionBy(source).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = counts.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    over_files = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = counts.groupBy(source).agg(F.sum("_n").alias("_f")).select(
        source, F.coalesce(F.sum("_f").over(over_files), F.lit(0)).alias("_base"))
    offsets = splits.join(files, source).select(source, "_start", (F.col("_before") + F.col("_base")).alias("_offset"))
    rn = F.row_number().over(Window.partitionBy(source, "_start").orderBy("_at"))
    # merged: the planner takes rows that Python parsed for as small as the list of their ranges and would send them through the driver
    return (
        df.hint("merge").join(offsets, [source, "_start"]).withColumn(row_id, F.col("_offset") + rn - 1)
        .drop("_start", "_at", "_offset")
    )


def write_table(df: DataFrame, path: str, row_id: str = "row_id") -> None:
    """Parquet in row order: range partitions, sorted inside, so that id ranges skip row groups."""
    df.repartitionByRange(row_id).sortWithinPartitions(row_id).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_rows(df: DataFrame, columns: Sequence[str], out: str = "line") -> DataFrame:
    """One JSON text per row."""
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def file_summary(df: DataFrame, source: str = "source_file") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("rows"))
