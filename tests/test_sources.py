import io
import struct

import duckdb
import pytest

from lexicask.__main__ import main
from lexicask.functions.text import format_bytes
from lexicask.plans import catalogue
from lexicask.sources import linedocs
from pyspark.sql import functions as F

ROWS = [("Title é", "the body of it", "lab", 5, 1700000000000), ("", "", "", 0, 0), ("t", "body body", "x", -1, -5)]


def raw(chunks, order="little"):
    out = io.BytesIO()
    linedocs.write_chunks(out, chunks, order)
    return out.getvalue()


def decoded(data, order="little"):
    file = io.BytesIO(data)
    out = []
    for at, length, docs in linedocs.chunk_headers(file, order):
        file.seek(at)
        out += linedocs.records(file.read(length), docs, order)
    return out


@pytest.mark.parametrize("order", ["little", "big"])
def test_round_trip(order):
    assert decoded(raw([ROWS[:2], [], ROWS[2:]], order), order) == ROWS


def test_surplus_payload_is_ignored():
    one = raw([ROWS[:1]])
    assert decoded(struct.pack("<ii", 1, len(one) - 8 + 3) + one[8:] + b"xyz") == ROWS[:1]


@pytest.mark.parametrize(
    "data",
    [
        raw([ROWS])[:-1],
        raw([ROWS]) + b"\x01\x00\x00",
        struct.pack("<ii", 1, 10) + b"0123456789",
        struct.pack("<ii", -1, 0),
        struct.pack("<ii", 1, 24) + struct.pack("<iiiiq", 5, 0, 0, 0, 0),
        struct.pack("<ii", 1, 24) + struct.pack("<iiiiq", -5, 0, 0, 0, 0),
        struct.pack("<ii", 1, 26) + struct.pack("<iiiiq", 2, 0, 0, 0, 0) + b"\xff\xfe",
    ],
)
def test_damage(data):
    with pytest.raises(linedocs.FormatError):
        decoded(data)


def test_spark_source(spark, tmp_path):
    path = tmp_path / "docs.bin"
    path.write_bytes(raw([ROWS[:2], [], ROWS[2:]] * 3))
    spark.dataSource.register(linedocs.LineDocs)
    df = spark.read.format("linedocs").option("partitionBytes", 1).load(str(path))
    rows = df.orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == ROWS * 3 and [r.doc_id for r in rows] == list(range(9))
    assert df.rdd.getNumPartitions() == 6
    assert linedocs.read(spark, f"file://{path}", limit=4).count() == 4
    path.write_bytes(b"")
    assert linedocs.read(spark, str(path)).count() == 0


def test_folders_and_patterns(spark, tmp_path):
    for k, name in enumerate(("b.bin", "a.bin", "_skip.bin", "c.txt")):
        (tmp_path / name).write_bytes(raw([[(f"{name}", "x", "", k, k)]]))
    assert [r.title for r in linedocs.read(spark, str(tmp_path)).orderBy("doc_id").collect()] == ["a.bin", "b.bin", "c.txt"]
    assert [(r.doc_id, r.title) for r in linedocs.read(spark, f"file://{tmp_path}/*.bin").orderBy("doc_id").collect()] == [(0, "a.bin"), (1, "b.bin")]
    assert linedocs.read(spark, f"{tmp_path}/?.bin", limit=1).count() == 1


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}", "é" * k, None, k, None) for k in range(700)], "doc_id long, title string, body string, random_label string, time_of_day_secs int, timestamp_ms long").repartition(3)
    linedocs.write(df, f"file://{tmp_path}/out")
    got = linedocs.read(spark, f"file://{tmp_path}/out").orderBy("doc_id").collect()
    assert [(r.doc_id, r.title, r.body, r.random_label, r.time_of_day_secs, r.timestamp_ms) for r in got] == [(k, f"t{k}", "é" * k, "", k, 0) for k in range(700)]


def test_command_line(spark, tmp_path, capsys):
    path, db = tmp_path / "docs.bin", f"{tmp_path}/db"
    path.write_bytes(raw([ROWS]))
    assert main(["stat", "--db", db], spark) == 1
    assert main(["ingest", "--db", db, "--bin-file", str(path), "--batch-size", "2"], spark) == 0
    assert main(["ingest", "--db", db, "--bin-file", str(path), "--limit", "1"], spark) == 0
    assert main(["stat", "--db", db], spark) == 0 and main(["compact", "--db", db], spark) == 0
    assert main(["drop", "--db", db], spark) == 0 and main(["drop", "--db", db], spark) == 0
    out = capsys.readouterr().out
    assert "3 documents" in out and "1 documents" in out and "3 generations to 1" in out and out.endswith("dropped\nskipped\n")


def test_format_bytes(spark):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (5 << 20, "5.00 MB"), (3 << 30, "3.00 GB")]
    df = spark.createDataFrame([(n,) for n, _ in sizes], "n long").select(format_bytes(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == [s for _, s in sizes]


def test_format_bytes_rounds_as_sql(spark):
    """Halves of a hundredth go to the even digit (31360 / 1024 = 30.625 is 30.62, not 30.63), values just beside them to the nearest, in every unit."""
    sizes = [31360] + [(m << bits - 3) + d for bits in (10, 20, 30) for m in [*range(8, 200), 8003, 8189, 8191] for d in (-1, 0, 1)]
    sizes += [k * 1103515245 % (1 << bits) for bits in (20, 30, 40, 62) for k in range(1, 400)] + [1 << 53, (1 << 53) + 1, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", format_bytes(F.col("n")).alias("s")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE b AS SELECT unnest($1)::BIGINT AS n", [sizes])
    sql = catalogue.ORACLE_SQL["byte_sizes"].split("SELECT doc_id, ")[-1]
    assert {(r.n, r.s) for r in rows} == set(con.execute(f"SELECT n, {sql}").fetchall())
    assert ("30.62 KB", "1024.00 MB") == tuple(dict((r.n, r.s) for r in rows)[n] for n in (31360, (1 << 30) - 1))
