import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tagweave.operators.resumable import read_by_parts, write_by_parts

SCHEMA = "product_sku string, n int"
ROWS = [(f"p{i % 40}", i) for i in range(200)] + [(None, 1), (None, 2), ("p1", 1)]


def total(df):
    return df.groupBy("product_sku").agg(F.sum("n").alias("s"))


def rows(df):
    return sorted(((r.product_sku, r.s) for r in df.collect()), key=str)


def test_stopped_job_is_taken_up(spark, tmp_path):
    todo, seen = spark.createDataFrame(ROWS, SCHEMA), []

    def stops(df):
        seen.append(df.count())
        if len(seen) == 3:
            raise RuntimeError("stop")
        return total(df)

    with pytest.raises(RuntimeError):
        write_by_parts(todo, stops, str(tmp_path / "o"), parts=16, batches=4)
    some = rows(read_by_parts(spark, str(tmp_path / "o")))
    assert 0 < len(some) < 41 and set(some) < set(rows(total(todo)))
    later = []

    def counted(df):
        later.append(df.count())
        return total(df)

    assert rows(write_by_parts(todo, counted, str(tmp_path / "o"), parts=16, batches=4)) == rows(total(todo))
    assert sum(later) == len(ROWS) - seen[0] - seen[1]
    # Nothing is done a second time.
    later.clear()
    assert rows(write_by_parts(todo, counted, str(tmp_path / "o"), parts=16)) == rows(total(todo)) and not later


def test_stop_inside_a_write(spark, tmp_path):
    path, todo = str(tmp_path / "o"), spark.createDataFrame(ROWS, SCHEMA)
    write_by_parts(todo, total, path, parts=4)

    def fails(df):
        return total(df).withColumn("s", F.when(F.col("product_sku") == "p7", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("s")))

    changed = spark.createDataFrame([(k, n + 1) for k, n in ROWS], SCHEMA)
    with pytest.raises(PySparkException):
        write_by_parts(changed, fails, path, parts=4, batches=2)
    # Back to the first input: what was being made when the job stopped is made again.
    assert rows(write_by_parts(todo, total, path, parts=4)) == rows(total(todo))


def test_changed_and_vanished_rows(spark, tmp_path):
    path, todo, sizes = str(tmp_path / "o"), spark.createDataFrame(ROWS, SCHEMA), []
    write_by_parts(todo, total, path, parts=16)

    def counted(df):
        sizes.append(df.count())
        return total(df)

    fewer = todo.where("product_sku <> 'p3' or product_sku is null").unionByName(spark.createDataFrame([("p5", 9)], SCHEMA))
    assert rows(write_by_parts(fewer, counted, path, parts=16)) == rows(total(fewer))
    assert 0 < sum(sizes) < len(ROWS)
    one = todo.where("product_sku = 'p1'")
    assert rows(write_by_parts(one, total, path, parts=16)) == rows(total(one))
    assert rows(write_by_parts(one.where("n < 0"), total, path, parts=16)) == []


def test_foreign_keys_are_refused(spark, tmp_path):
    todo = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(PySparkException):
        write_by_parts(todo, lambda df: total(df).withColumn("product_sku", F.concat(F.lit("q"), "product_sku")), str(tmp_path / "o"), parts=16)
