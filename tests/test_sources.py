"""Files read and written at their edges: short rows, quotes, nulls in keys, repeated keys, refusals, late rows."""

import random

import pytest

from panelwright.operators import temporal
from panelwright.sources import readers, writers
from panelwright.streaming import feeds

T = "k long, v string, n int"


def test_csv_at_its_edges(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b,c\r\n1,"x ""y"", z",3\r\n2,only\r\n\r\n3,"line\nend",\r\n4,"",NA\r\n')
    got = readers.typed(readers.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b", "c"]), {"a": "int", "c": "int"})
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == [(1, 'x "y", z', 3), (2, "only", None), (3, "line\nend", None), (4, "", None)]


def test_optional_and_first_present(spark):
    df = spark.createDataFrame([(1, "", "b"), (2, "a", "b"), (3, None, "")], "k int, one string, two string")
    got = df.select("k", readers.first_present(df, ["gone", "one", "two"]).alias("x"), readers.optional(df, "gone", "double").alias("g")).collect()
    assert [(r.k, r.x, r.g) for r in got] == [(1, "b", None), (2, "a", None), (3, "", None)]


def test_upserts_with_nulls_and_repeats(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "b", 2), (3, "c", 3)], T)
    new = spark.createDataFrame([(None, "x", 5), (None, "y", 4), (1, "z", None), (1, "z", 9), (4, None, None)], T)
    out = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert out(writers.upsert(old, new, ["k"], "n")) == sorted([(3, "c", 3), (None, "x", 5), (1, "z", 9), (4, None, None)], key=str)
    assert out(writers.upsert(old, new, ["k"])) == sorted([(3, "c", 3), (None, "y", 4), (1, "z", 9), (4, None, None)], key=str)
    assert out(writers.insert_new(old, new, ["k"], "n")) == sorted([(1, "a", 1), (None, "b", 2), (3, "c", 3), (4, None, None)], key=str)
    assert out(writers.upsert_known(old, new, ["k"])) == sorted([(3, "c", 3), (None, "y", 4), (1, "z", 9), (4, None, None)], key=str)
    known = spark.createDataFrame([(1, None, 7), (None, "q", None), (5, None, None)], T)
    assert out(writers.upsert_known(old, known, ["k"])) == sorted([(1, "a", 7), (None, "q", 2), (3, "c", 3), (5, None, None)], key=str)
    gone = spark.createDataFrame([(1, "z", 1), (1, "y", 1), (None, "w", 1)], T)
    got = out(writers.snapshot_replace(old.union(spark.createDataFrame([(7, "out", 99)], T)), gone, ["k"], writers.F.col("n") < 50))
    assert got == sorted([(7, "out", 99, 0), (1, "z", 1, 0), (None, "w", 1, 0), (3, "c", 3, 1)], key=str)
    for parts in (1, 3):
        assert out(writers.latest(new.repartition(parts), ["k"], "k")) == out(writers.latest(new, ["k"]))


def test_a_pull_of_nothing_is_refused(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, "a", 1)], T)
    assert writers.replace_table(df, path).count() == 1
    with pytest.raises(writers.RefusedWrite):
        writers.replace_table(df.limit(0), path)
    assert spark.read.parquet(path).count() == 1


def test_private_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 1)], T)
    assert writers.export_columns(df, ["k", "later"], ["v", "n"]).columns == ["k"]
    for allowed, private in ((["k", "v"], ["v", "n"]), (["k"], ["v"])):
        with pytest.raises(writers.RefusedWrite):
            writers.export_columns(df, allowed, private)


def test_overwritten_partitions_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], T).write.partitionBy("n").parquet(path)
    writers.overwrite_partitions(spark.createDataFrame([(9, "z", 1), (8, "y", 5)], T), path, ["n"])
    assert sorted((r.k, r.v, r.n) for r in spark.read.parquet(path).collect()) == [(3, "c", 2), (8, "y", 5), (9, "z", 1)]


def test_trailing_values_equal_a_plain_loop(spark):
    draw = random.Random(3)
    rows = [(k, t, None if draw.random() < 0.4 else float(draw.randint(0, 9))) for k in range(6) for t in range(draw.randint(1, 30))]
    got = {(r.k, r.t): (r.trail_mean, r.trail_sd) for r in temporal.prior_trailing(spark.createDataFrame(rows, "k int, t int, x double"), ["k"], ["t"], "x", 3).collect()}
    held: dict[int, list[float]] = {}
    for k, t, x in rows:
        last = held.setdefault(k, [])[-3:]
        mean = sum(last) / len(last) if last else None
        sd = (sum((v - mean) ** 2 for v in last) / len(last)) ** 0.5 if len(last) > 1 else None
        assert got[k, t] == (pytest.approx(mean) if last else None, pytest.approx(sd) if sd is not None else None)
        held[k] += [x] if x is not None else []


def test_a_log_is_only_added_to(spark, tmp_path):
    """What a batch has written stays as it is: the files of earlier batches don't change."""
    path = str(tmp_path / "in")
    for rows in ([(1, "a", 1)], [(1, "b", 2), (2, "c", 3), (2, "c", 1)], [(None, "n", 1), (None, "m", 2)], [(None, "z", 0)]):
        spark.createDataFrame(rows, T).coalesce(1).write.mode("append").parquet(path)
    sizes = []

    def keep(log, batch):
        sizes.append((0 if log is None else log.count(), batch.count()))
        fresh = batch if log is None else writers.anti_by(batch, log, ["k"])
        return writers.first_of(fresh, ["k"], "n")

    out = feeds.drain(feeds.stream_table(spark, path, 1), keep=keep)
    assert out.count() == 3 and sorted(b for _, b in sizes) == [1, 1, 2, 3] and [log for log, _ in sizes] == sorted(log for log, _ in sizes)


def test_append_once_over_batches(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "day timestamp, u long"
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    for rows in ([(day(1), 1), (day(1), 1), (day(2), 1)], [(day(1), 1), (day(2), 2)], [(day(20), 3)], [(day(20), 3), (day(21), 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    got = feeds.append_once(feeds.stream_table(spark, path), "day", ["u"])
    assert sorted((r.day.day, r.u) for r in got.collect()) == [(1, 1), (2, 1), (2, 2), (20, 3), (21, 3)]
