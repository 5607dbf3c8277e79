"""CSV read in blocks against Spark's reader of whole files: quoted breaks, doubled quotes, byte-order mark, blocks that begin anywhere."""

import random

import pytest

from tagweave.sources import csv_blocks as B
from tagweave.sources import tables as TB

SCHEMA = "id long, a string, b string"
ROWS = [
    "id,a,b", "1,x,y", '2,"x\ny","a ""q"" b"', "", '3,"multi\nline\n\n\nend",z', '4,5" nail,q', '5,"abc"def,z', '6,"",', '7,,"last""\n"',
    '8," sp ", "not quoted"', '9,"' + "long\n" * 50 + '",w', '10,é日本,"é\n日本"', '11,"a,b\n,c","x"', '12,"""","""\n"""',
]


def whole(spark, path):
    rows = spark.read.csv(path, schema=SCHEMA, header=True, multiLine=True, escape='"', enforceSchema=False)
    return sorted(map(tuple, rows.collect()), key=str)


def blockwise(spark, path, size, **more):
    return sorted(map(tuple, TB.read_csv(spark, path, SCHEMA, block_bytes=size, **more).collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_block_size_gives_the_rows_of_the_whole_file(spark, tmp_path, end):
    path = str(tmp_path / "f.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("﻿" + end.join(r.replace("\n", end) for r in ROWS) + end)
    want = whole(spark, path)
    assert len(want) == 12
    for size in (None, 60):
        assert blockwise(spark, path, size) == want
    rows = TB.read_csv(spark, path, SCHEMA, block_bytes=100, position="at").orderBy("at").collect()
    assert [r.id for r in rows] == list(range(1, 13)) and rows[0].at.file.endswith("f.csv")


def test_random_cells_many_files_and_no_broadcast(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    bits = ["x", '"', "\n", ",", " ", "é", "word", "\n\n"]
    for k in range(3):
        lines = ["id,a,b"]
        for i in range(40):
            a, b = ("".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(2))
            lines.append(f'{100 * k + i},"' + a.replace('"', '""') + '","' + b.replace('"', '""') + '"')
        # The last file ends without a line break.
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + ("\n" if k < 2 else ""), encoding="utf-8")
    want = whole(spark, str(tmp_path))
    assert len(want) == 120
    assert blockwise(spark, str(tmp_path), 400) == want
    monkeypatch.setattr(TB, "BLOCKS_SENT", 0)
    assert blockwise(spark, str(tmp_path), 900) == want


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,a,b\n" + "".join(f'{i},"cell {i}\nof two lines",b\n' for i in range(1000)))
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    own.conf.set("spark.sql.files.openCostInBytes", "3000")
    blocks = B.csv_blocks(own, path, ",")
    assert blocks.count() > 8
    starts = B.block_starts(blocks).collect()
    assert {r.inside for r in starts} == {True, False} and sum(r.first for r in starts) == 1
    assert TB.read_csv(spark, path, SCHEMA, block_bytes=3000).agg({"id": "sum"}).first()[0] == sum(range(1000))


def test_small_blocks_share_tasks(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,a,b\n" + "".join(f'{i},"cell {i}\nof two lines",b\n' for i in range(3000)))
    lines = B.text_lines(spark, path, 1000)
    assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < lines.select("block").distinct().count()
    # What is stored on the way is not read in blocks that small either.
    rows = TB.read_csv(spark, path, SCHEMA, block_bytes=1000)
    assert rows.count() == 3000 and rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_state_of_a_line():
    for line, inside, want in [
        ("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('5" x,"y"', False, False), ('"a"b"c,"d', False, True), ("", True, True),
        ('"', True, False), ('"""', False, True), ('""', False, False), ('x","y', True, True),
    ]:
        assert B.inside_after(line, inside, ",") is want


def test_empty_files_have_no_header(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n\n")
    with pytest.raises(ValueError):
        TB.read_csv(spark, str(tmp_path), SCHEMA)
    (tmp_path / "f.csv").write_text("\n\r\nid,a,b\n")
    assert TB.read_csv(spark, str(tmp_path), SCHEMA).count() == 0
