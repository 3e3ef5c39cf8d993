"""Files cut into byte ranges against readers that see the whole file."""

import codecs
import csv
import io

import numpy as np
import pytest

from flowlens.sources import byte_ranges, csv_files


def whole(text, delimiter, width):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)][1:]
    rows = [r for r in rows if any(f.strip() for f in r) or len(r) > 1]
    return ([tuple(f or None for f in [*r, *[""] * (width - len(r))]) for r in rows if len(r) <= width],
            sum(len(r) > width for r in rows))


def odd_text(rng, n, delimiter, width):
    """Lines with quoted breaks, doubled quotes, quotes inside plain fields, short and long lines."""
    kinds = ['plain', 'é–ü', 'a"b', '5"', '"q"', f'"x{delimiter}y"', '"two\nlines"', '"say ""hi"""', '""', '""""', '"a\n""b""\n\nc"', '', '"\n"',
             '"long ' + "w\n" * 40 + '"']
    lines = [delimiter.join(f"c{i}" for i in range(width))]
    for _ in range(n):
        k = width + int(rng.choice([0, 0, 0, 0, -1, 1]))
        lines.append(delimiter.join(kinds[i] for i in rng.integers(0, len(kinds), k)))
    return "\n".join(lines) + ("\n" if rng.integers(0, 2) else "")


@pytest.mark.parametrize("seed", range(6))
def test_records_of_ranges_are_those_of_the_file(seed, tmp_path):
    rng = np.random.default_rng(seed)
    delimiter = ",;\t|"[seed % 4]
    raw = odd_text(rng, 200, delimiter, 4).encode()
    if seed % 2:
        raw = byte_ranges.BOM + raw
    path = tmp_path / "a.csv"
    path.write_bytes(raw)
    uri, size, step, got, inside = f"file://{path}", len(raw), int(rng.integers(20, 90)), [], 0
    for start in range(0, size, step):
        stop = min(start + step, size)
        got += list(byte_ranges.records(uri, start, stop, size, inside, delimiter))
        found = byte_ranges.Bytes(uri, start, stop, size)
        bom = start == 0 and bool(seed % 2)
        reset, odd, *_ = byte_ranges._summary(found.array(), found.start - found.low + (3 if bom else 0), found.stop - found.low, bom, delimiter)
        inside = odd if reset else inside ^ odd
    text = raw.decode("utf-8-sig")
    want = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    assert [next(csv.reader([r.decode("utf-8-sig")], delimiter=delimiter), []) for r in got] == want


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_quoted_breaks_in_a_table(spark, tmp_path, range_bytes):
    rng = np.random.default_rng(7)
    texts = {"a.csv": odd_text(rng, 300, ",", 4), "b.csv": odd_text(rng, 100, ",", 4), "c.csv": "c0,c1,c2,c3\n1,2,3,4\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("cp1252" if name == "b.csv" else "utf-8"))
    table = csv_files.read_files(spark, str(tmp_path), range_bytes=range_bytes)
    report = {r["source_file"]: r for r in csv_files.ingestion_report(spark, str(tmp_path), range_bytes=range_bytes).collect()}
    rows = table.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(len(rows)))
    for name, text in texts.items():
        want, rejected = whole(text, ",", 4)
        assert [tuple(r)[1:5] for r in rows if r["source_file"] == name] == want
        assert (report[name]["rows"], report[name]["rejected"], report[name]["columns"]) == (len(want), rejected, 4)
    assert report["a.csv"]["total_rows"] == len(rows) and not report["a.csv"]["schema_mismatch"]
    lost = csv_files.rejected_lines(spark, str(tmp_path), range_bytes=range_bytes)
    assert lost.count() == sum(whole(t, ",", 4)[1] for t in texts.values()) and lost.where("expected <> 4").count() == 0


def whole_encoding(raw):
    for name in csv_files.ENCODINGS:
        try:
            codecs.decode(raw, name)
            return name
        except UnicodeDecodeError:
            continue


@pytest.mark.parametrize("range_bytes", [16, 61])
def test_encodings_of_ranges(spark, tmp_path, range_bytes):
    """Characters cut by ranges, late bytes of another encoding, a character that the file does not finish."""
    text = "a,b\n" + "é,–\n漢字,😀😀\n" * 40
    files = {
        "utf8.csv": text.encode(), "bom.csv": byte_ranges.BOM + text.encode(), "ascii.csv": b"a,b\n" * 50,
        "cp1252.csv": ("a,b\n" * 60 + "x,–\n").encode("cp1252"), "latin.csv": b"a,b\n" * 60 + b"\x81,\xe9\n",
        "cut.csv": text.encode() + "é".encode()[:1], "late.csv": text.encode() + b"\xe9\n", "lone.csv": text.encode() + b"\x80\x80\n",
        "over.csv": text.encode() + b"\xf0\x9f\x98\n"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["file_name"]: r["encoding"] for r in csv_files.profile_files(spark, str(tmp_path), range_bytes).collect()}
    assert got == {name: whole_encoding(raw) for name, raw in files.items()}


def broadcasts_of_parsed_rows(df):
    """Broadcasts in the plan as it ran whose rows come straight from the parser, not from an aggregate of them."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in lines]
    found = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                below.append(lines[j])
            text = "\n".join(below)
            found += "MapInPandas" in text and "HashAggregate" not in text
    return found


def test_parsed_rows_do_not_go_through_the_driver(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("".join(f'"{i}","two\nlines {i}"\n' for i in range(4000)))
    df = csv_files.read_files(spark, f"file://{tmp_path}", range_bytes=4096)
    assert len(df.collect()) == 2 * 3999
    assert broadcasts_of_parsed_rows(df) == 0


def test_a_small_range_reads_little_behind_its_end(tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'"1","x"\n' * 100_000)
    found = byte_ranges.Bytes(f"file://{path}", 1 << 16, 1 << 17, path.stat().st_size)
    assert len(found.data) <= (1 << 16) + 1 + 2 * byte_ranges.FIRST_STEP
