"""Ranged windows, sinks, folding, nulls in transforms, the cursor, scratch tables."""

import random

import pytest
from pyspark.sql import functions as F

from rillstone import pipeline, scratch, transform
from rillstone.operators import analytics, ranges, replay, sessions
from rillstone.operators.cursor import RecordCursor
from rillstone.plans import filter_lang as lang
from rillstone.sources import datasources, framing


@pytest.mark.parametrize("parts", [1, 7])
def test_running_values(spark, parts):
    """Series that lie in one range and series over many, a null one among them."""
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, *range(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        top = {r.o: r.top for r in ranges.running_max(df, ["k"], "o", "v", "top").collect()}
        number = {r.o: r.n for r in ranges.row_numbers(df, ["k"], "o", "n").collect()}
        whole = {r.o: r.n for r in ranges.row_numbers(df, [], "o", "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    seen, count = {}, {}
    for k, o, v in rows:
        seen[k] = max(filter(lambda x: x is not None, (seen.get(k), v)), default=None)
        count[k] = count.get(k, 0) + 1
        assert (top[o], number[o], whole[o]) == (seen[k], count[k], o + 1)
    assert ranges.row_numbers(df.where("false"), ["k"], "o", "n").count() == 0


def test_sinks_publish_on_commit(tmp_path):
    """What a task wrote twice, or a job that failed, is not read."""
    options = {"path": str(tmp_path / "out")}
    stream = framing.stream([framing.session_open(1)])
    writer = datasources.CaptureWriter(options)
    first, again = writer.write(iter([(1, stream)])), writer.write(iter([(1, stream)]))
    assert datasources._files(options["path"]) == [] and first != again
    writer.commit([again, None])
    assert [f.rpartition("/")[2] for f in datasources._files(options["path"])] == [again.name] and len(list((tmp_path / "out").iterdir())) == 1
    failed = datasources.CaptureWriter(options)
    failed.write(iter([(1, stream)]))
    failed.abort([])
    over = datasources.CaptureWriter(options, overwrite=True)
    over.commit([over.write(iter([]))])
    assert len(datasources._files(options["path"])) == 1 and len(list((tmp_path / "out").iterdir())) == 1


def test_streams_of_files_see_every_file(spark, tmp_path):
    """A file whose name sorts before those seen is read as well."""
    (tmp_path / "in").mkdir()
    stream = framing.stream([framing.session_open(1)])
    for n, name in enumerate(("m.cap", "a.cap", "z.cap")):
        (tmp_path / "in" / name).write_bytes(framing.capture([(1, stream)]))
        query = datasources.stream_captures(spark, str(tmp_path / "in")).select("type_name", "stream_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n + 1


def test_folding():
    a, b = lang.Compare("octets", ">", 1), lang.Compare("proto", "==", 6)
    true, false = lang.Const(True), lang.Const(False)
    assert lang.fold(lang.Not(lang.Not(a))) == a and lang.fold(lang.Not(true)) == false
    assert lang.fold(lang.And((a, true, b))) == lang.And((a, b)) and lang.fold(lang.And((a, false))) == false
    assert lang.fold(lang.Or((false, a))) == a and lang.fold(lang.Or((a, lang.Not(false)))) == true
    assert lang.fold(lang.And((true, true))) == true and lang.fold(lang.Or((false,))) == false
    nested = lang.And((lang.Or((false, lang.Not(lang.Not(lang.And((a, true)))))), true))
    assert lang.fold(nested) == a and lang.node_count(nested) == 9 and lang.node_count(a) == 1
    assert lang.fields(true) == []


def test_folded_constants_compile(spark):
    df = spark.createDataFrame([(1,), (None,)], "octets long")
    for tree, n in ((lang.Const(True), 2), (lang.Const(False), 0), (lang.Not(lang.Const(False)), 2), (lang.Or((lang.Const(True), lang.Compare("octets", ">", 5))), 2)):
        assert df.where(lang.compile_filter(tree, df)).count() == n


def test_null_inputs_read_as_zero_on_both_ways(spark):
    df = spark.createDataFrame([(None, 2), (3, None), (4, 5)], "a long, b long")
    straight = transform.assemble("load 0\nload 1\nadd\nret")
    jumping = transform.assemble("load 0\nload 1\nadd\npush 1\njz end\nret\nend:\nret")
    assert transform.to_column(jumping, {0: F.col("a"), 1: F.col("b")}) is None
    for code in (straight, jumping):
        assert [r.result for r in transform.transform(df, code, {0: "a", 1: "b"}).collect()] == [2, 3, 9]


def test_cursor(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    cursor = RecordCursor(df, "id")
    assert [r.id for r in cursor.limit(3).records.collect()] == [0, 1, 2]
    assert cursor.find_first(F.col("v") == 5).first().id == 5 and cursor.find_first(F.lit(False)).count() == 0
    assert cursor.count(F.col("v") == 5).first().n == 14 and cursor.count(most=10).first().n == 10


def test_broker_and_reaping(spark):
    rows = [(t, f"s{i}", i, "DATA_RECORD", None) for i, t in enumerate([1, 1, 2, 3, 3])] + [(2, "bad", 9, None, "cut")]
    found = sessions.session_totals(spark.createDataFrame(rows, "transport_id long, stream_id string, capture_ts_ms long, type_name string, error string"))
    assert tuple(sessions.broker_totals(found).first()) == (3, 5, 5, 1)
    assert {r.transport_id for r in sessions.reapable(found, 3, 5).collect()} == {1, 3}
    assert sessions.reapable(found, 4, 5).count() == 0 and sessions.reapable(found, 3, 6).count() == 1


def test_lossy_top_n_forgets(spark):
    rows = [(k, 1000 if k < 3 else 1) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, w long").coalesce(1)
    assert [(r.key, r.weight) for r in analytics.lossy_top_n(df, "k", "w", 3).collect()] == [(0, 1000), (1, 1000), (2, 1000)]


def test_template_outcomes(spark):
    """A cache of two: a, b, a hit, c drops b, b is gone."""
    df = spark.createDataFrame([(None, t, i) for i, t in enumerate([1, 2, 1, 3, 2])], "owner long, template long, ord long")
    assert [tuple(r) for r in replay.template_outcomes(df, "owner", 2).collect()] == [(None, 1, 4, 2)]


def test_scratch_tables(spark):
    df = scratch.materialize(spark.range(5), "five")
    assert df.count() == 5
    scratch.release(df)
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rpartition("/")[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_streams_of_several_files_are_sessions_of_their_own(spark, tmp_path):
    """The first stream of a file without a template is not resolved by the first stream of another."""
    record = framing.data_record(256, 1, 9, 8, 7, 6, 17, 100, 1, b"\0\0\0\1")
    whole = framing.stream([framing.session_open(1), framing.template_def(256, 1, [(8, "u32", 4)]), record])
    (tmp_path / "a.cap").write_bytes(framing.capture([(1, whole)]))
    (tmp_path / "b.cap").write_bytes(framing.capture([(2, framing.stream([record]))]))
    assert [(r.octets, r.records) for r in pipeline.flows_of(spark, str(tmp_path)).collect()] == [(100, 1)]


def test_capture_files_are_of_bounded_size(spark, tmp_path):
    datasources.register(spark)
    rows = spark.createDataFrame([(n, bytearray(framing.stream([framing.session_open(n)]))) for n in range(20)], "ts long, data binary").coalesce(1)
    rows.write.format("flow_capture").option("maxFileBytes", "100").mode("append").save(str(tmp_path / "out"))
    files = datasources._files(str(tmp_path / "out"))
    assert len(files) == 4 and len(list((tmp_path / "out").iterdir())) == 4
    for found in (spark.read.format("flow_capture").load(str(tmp_path / "out")), datasources.read_captures(spark, str(tmp_path / "out"))):
        assert sorted(r.capture_ts_ms for r in found.where("error is null").collect()) == list(range(20))


def test_least_after_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), o, rng.choice([None, o])) for o in range(400)]
    found = ranges.least_after(spark.createDataFrame(rows, "k long, o long, v long").repartition(3), ["k"], "o", F.col("v"), "next").collect()
    assert len(found) == 400
    for r in found:
        assert r.next == min((v for k, o, v in rows if k == r.k and o > r.o and v is not None), default=None)


def test_requests_read_no_frame_to_the_end(spark):
    """Spark reads a frame that ends at the last row anew for every row, which is the square of a session."""
    events = spark.createDataFrame([("s", "c", 1, "open"), ("s", "c", 2, "request"), ("s", "c", 3, "process"), ("s", "c", 4, "request")], "s string, conn string, ord long, kind string")
    found = sessions.served_requests(events, "s", "ord")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert sorted((r.ord, r.outcome) for r in found.collect()) == [(2, "served"), (4, "waiting")]
