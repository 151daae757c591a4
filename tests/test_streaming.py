"""The streamed upsert under failures: a batch that stops on its way, one that is run again, readers in between."""

import shutil

from pyspark.sql import functions as F

from quorumlake.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def batch(spark, *values):
    return spark.createDataFrame(list(values), "k int, y int")


def test_a_batch_that_stops_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    jobs.create_table(batch(spark, (1, 1), (2, 2), (7, 7)), path, ["k"], 4)
    jobs.merge_batch(batch(spark, (1, 5), (3, 3)), 1, path, ["k"], ["y"], [F.desc("y")])
    before = rows(jobs.read_table(spark, path))
    assert before == [(1, 5), (2, 2), (3, 3), (7, 7)]

    write = jobs._write

    def stops(*args):
        write(*args)
        folder = tmp_path / "table" / f"_batch={args[-1]}"
        (folder / "_SUCCESS").unlink()  # part files are there, some folders are not, the marker neither
        shutil.rmtree(next(folder.glob("_bucket=*")))
        raise RuntimeError("executor lost")

    monkeypatch.setattr(jobs, "_write", stops)
    try:
        jobs.merge_batch(batch(spark, (1, 6), (2, 6), (9, 9)), 2, path, ["k"], ["y"], [F.desc("y")])
        raise AssertionError("the failure was swallowed")
    except RuntimeError:
        pass
    assert rows(jobs.read_table(spark, path)) == before  # readers don't see the unfinished batch
    monkeypatch.setattr(jobs, "_write", write)
    for _ in range(2):  # run again, and once more after it has been finished
        jobs.merge_batch(batch(spark, (1, 6), (2, 6), (9, 9)), 2, path, ["k"], ["y"], [F.desc("y")])
        assert rows(jobs.read_table(spark, path)) == [(1, 6), (2, 6), (3, 3), (7, 7), (9, 9)]
    assert rows(jobs.read_table(spark, path, before=2)) == before


def test_repeated_and_empty_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    jobs.create_table(batch(spark, (1, 1), (2, 2)), path, ["k"])
    jobs.merge_batch(batch(spark, (1, 9), (None, 4)), 1, path, ["k"], None, [F.desc("y")])
    once = rows(jobs.read_table(spark, path))
    files = sorted(map(str, (tmp_path / "table").rglob("*.parquet")))
    jobs.merge_batch(batch(spark, (1, 9), (None, 4)), 1, path, ["k"], None, [F.desc("y")])
    jobs.merge_batch(batch(spark, (1, 1)).limit(0), 2, path, ["k"], None, [F.desc("y")])
    assert rows(jobs.read_table(spark, path)) == once == [(1, 1), (2, 2), (None, 4)]
    assert sorted(map(str, (tmp_path / "table").rglob("*.parquet"))) == files


def test_buckets_follow_the_size_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "ROWS", 100)
    path = str(tmp_path / "table")
    jobs.create_table(spark.range(1000).selectExpr("cast(id as int) AS k", "0 AS y"), path, ["k"])
    assert jobs._layout(spark, path)[0] == 10
    for n in range(1, 5):
        jobs.merge_batch(spark.range(50).selectExpr("cast(id as int) AS k", f"{n} AS y"), n, path, ["k"], ["y"], [F.desc("y")])
    want = rows(jobs.read_table(spark, path))
    assert jobs.vacuum(spark, path) > 0 and rows(jobs.read_table(spark, path)) == want
    assert [r for r in want if r[1]] == [(k, 4) for k in sorted(range(50), key=lambda k: repr((k, 4)))]


def test_a_stream_makes_its_table_and_goes_on(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "table")
    batch(spark, (1, 5), (2, 6)).write.parquet(src)
    stream = spark.readStream.schema("k int, y int").parquet(src)
    for more in (None, (2, 8), (3, 1)):
        if more:
            batch(spark, more).write.mode("append").parquet(src)
        jobs.stream_upsert(stream, path, ["k"], ["y"], [F.desc("y")], str(tmp_path / "c")).awaitTermination(60)
    assert rows(jobs.read_table(spark, path)) == [(1, 5), (2, 8), (3, 1)]
