"""Job states as a stream, the keyed sink, and the Python data sources."""

import io
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.operators import mutation
from quire.sources import connectors
from quire.streaming import jobs, sink

SCHEMA = "job_id long, event_id long, at timestamp, status string"
DAY = 24 * 3600


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, n, rows):
    """One file a batch, by the time of its writing."""
    frame = spark.createDataFrame([(j, e, s) for j, e, s, _ in rows], "job_id long, event_id long, status string").withColumn("at", F.timestamp_seconds(F.element_at(F.lit([r[3] for r in rows]), F.col("event_id").cast("int") - rows[0][1] + 1)))
    frame.select("job_id", "event_id", "at", "status").coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in jobs.STATE_STORE}
    for k, v in jobs.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, source, out, checkpoint):
    q = jobs.job_states(stream(spark, source), late="1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_job_stream_and_restart(spark, rocks, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    start = 1_700_000_000
    first = [(1, 1, "pending", start), (2, 2, "pending", start), (1, 3, "translating", start + 60), (3, 4, "pending", start), (3, 5, "completed", start + 30), (3, 6, "translating", start + 40)]
    second = [(1, 7, "completed", start + 200), (4, 8, "pending", start + 200), (2, 9, "error", start - 5), (5, 10, "pending", start + 5 * 3600)]
    third = [(6, 11, "pending", start + 3 * DAY)]
    put(spark, source, 1, first)
    run(spark, source, out, check)
    put(spark, source, 2, second)
    run(spark, source, out, check)
    put(spark, source, 3, third)
    run(spark, source, out, check)
    got = [tuple(r) for r in spark.read.parquet(out).select("job_id", "note", "status", "events").collect()]
    states = {}
    for job, note, status, events in got:
        if note == "state":
            states[job] = max(states.get(job, (0, "")), (events, status))
    everything = spark.read.schema(SCHEMA).parquet(source)
    assert {r.job_id: (r.events, r.status) for r in J.latest_state(everything, "job_id", ["at", "event_id"]).collect()} == states
    assert sorted((j, s) for j, n, s, _ in got if n == "illegal") == [(3, "translating")]
    created = everything.groupBy("job_id").agg(F.min("at").alias("created_at")).join(J.latest_state(everything, "job_id", ["at", "event_id"]), "job_id")
    late = {r.job_id for r in J.timed_out(created, F.timestamp_seconds(F.lit(start + 3 * DAY))).where("timed_out").collect()}
    assert {j for j, n, _, _ in got if n == "timed out"} == late == {2, 3, 4, 5}
    assert {j for j, n, _, _ in got if n == "stalled"} == {2, 3, 4, 5}


TABLE = "k long, x string, s int"


def table(spark, path):
    from pyspark.sql.types import StructType

    return sink.KeyedTable(spark, f"file://{path}", StructType.fromDDL(TABLE), ["k"], buckets=4)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_sink_applies_each_batch_once(spark, tmp_path):
    t, merge = table(spark, tmp_path), lambda old, new: mutation.upsert(old, new, ["k"], ["s"])
    assert t.read().count() == 0
    assert t.apply(spark.createDataFrame([(i, f"a{i}", i) for i in range(20)], TABLE), merge, "a", 0)
    before = t.read()
    change = spark.createDataFrame([(3, "new", None), (99, "z", 1)], TABLE)
    assert t.apply(change, merge, "a", 1) and not t.apply(change, merge, "a", 1) and not t.apply(change, merge, "a", 0)
    want = sorted([(i, "new" if i == 3 else f"a{i}", i) for i in range(20)] + [(99, "z", 1)], key=repr)
    assert rows_of(t.read()) == want
    # A reader of the version before still sees it whole, and another stream has batches of its own.
    assert rows_of(before) == sorted([(i, f"a{i}", i) for i in range(20)], key=repr) == rows_of(t.read(1))
    assert t.apply(spark.createDataFrame([(i, None, None) for i in range(20)], TABLE), lambda old, new: mutation.upsert_or_delete(old, new, ["k"], "x"), "b", 0)
    assert rows_of(t.read()) == [(99, "z", 1)] and t.manifest()["batches"] == {"a": 1, "b": 0}
    t.clear(1)
    assert rows_of(t.read()) == [(99, "z", 1)] and t._files() == ["000000000003.json"]


def test_sink_loses_no_race_and_shows_no_half(spark, tmp_path, monkeypatch):
    t, merge = table(spark, tmp_path), lambda old, new: mutation.replace_by_key(old, new, ["k"])
    t.apply(spark.createDataFrame([(1, "a", 1)], TABLE), merge, "a", 0)
    now = t.manifest()
    t.apply(spark.createDataFrame([(1, "b", 1)], TABLE), merge, "a", 1)
    with pytest.raises(RuntimeError):
        t._put(now | {"version": 2})
    # Lost between the data and the manifest: nothing is seen of it, and the batch is taken when it comes again.
    with monkeypatch.context() as m:
        m.setattr(sink.KeyedTable, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.apply(spark.createDataFrame([(1, "c", 1)], TABLE), merge, "a", 2)
    assert rows_of(t.read()) == [(1, "b", 1)]
    assert t.apply(spark.createDataFrame([(1, "c", 1)], TABLE), merge, "a", 2) and rows_of(t.read()) == [(1, "c", 1)]


def test_stream_into_the_sink(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    source = f"file://{tmp_path}/in"
    for i in range(3):
        spark.createDataFrame([(j, f"v{i}", i) for j in range(i, 5)], TABLE).coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(TABLE).option("maxFilesPerTrigger", 1).parquet(source)
    for check in ("c", "again"):  # the same batches again, from the start, under the same name
        q = rows.writeStream.foreachBatch(sink.upserting(t, lambda old, new: mutation.upsert(old, new, ["k"]), "s")).option("checkpointLocation", f"file://{tmp_path}/{check}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert rows_of(t.read()) == [(0, "v0", 0), (1, "v1", 1), (2, "v2", 2), (3, "v2", 2), (4, "v2", 2)] and t.manifest()["version"] == 3


# -- sources ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_items_of_an_array(chunk):
    items = [{"a": "é😀,]", "b": [1, {"c": None}]}, {"a": 'x"\\y'}, {}]
    data = json.dumps(items, ensure_ascii=False, indent=1).encode()
    assert list(connectors.array_items(io.BytesIO(data), chunk)) == items
    assert list(connectors.array_items(io.BytesIO(b" [ ] "), chunk)) == [] and list(connectors.array_items(io.BytesIO(b""), chunk)) == []
    for bad in (b"[{}", b'{"a": 1}', b'[{"a": }]'):
        with pytest.raises(ValueError):
            list(connectors.array_items(io.BytesIO(bad), chunk))


def test_exports_are_read_in_parts(spark, tmp_path):
    spark.dataSource.register(connectors.JsonArrays)
    for i in range(3):
        (tmp_path / f"e{i}.json").write_text(json.dumps([{"id": 10 * i + j, "x": None if j else {"é": j}, "more": 1} for j in range(4)]))
    (tmp_path / "other.txt").write_text("no")
    got = spark.read.format("json_arrays").schema("id long, x string, none string").load(f"{tmp_path}/*.json")
    assert sorted(map(tuple, got.collect())) == [(10 * i + j, None if j else '{"é": 0}', None) for i in range(3) for j in range(4)]
    assert got.rdd.getNumPartitions() == 3


def test_database_tables_are_read_in_ranges(spark, tmp_path):
    spark.dataSource.register(connectors.SqliteTable)
    db = sqlite3.connect(tmp_path / "books.db")
    db.execute('CREATE TABLE "odd ""name" (id INTEGER PRIMARY KEY, title TEXT)')
    db.executemany('INSERT INTO "odd ""name" VALUES (?, ?)', [(i, None if i % 7 == 0 else f"t{i}") for i in range(1, 2000) if i % 3])
    db.commit()
    got = spark.read.format("sqlite_table").schema("title string, id long").option("table", 'odd "name').option("rows", 500).option("page", 50).load(f"{tmp_path}/books.db")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None if i % 7 == 0 else f"t{i}", i) for i in range(1, 2000) if i % 3], key=repr)
    assert got.rdd.getNumPartitions() == 4


def test_objects_are_written_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(connectors.Objects)
    root = tmp_path / "store"
    root.mkdir()
    rows = [(f"a/{i}.bin", bytearray([i]), f'{{"n": {i}}}' if i % 2 else None) for i in range(10)]
    frame = spark.createDataFrame(rows, "key string, content binary, meta string")
    frame.repartition(3).write.format("objects").mode("append").save(str(root))
    read = lambda: sorted((r.key, r.content, r.meta) for r in spark.read.format("objects").option("files", 4).load(str(root)).collect())
    assert read() == rows
    spark.createDataFrame([("a/1.bin", bytearray(b"new"), None)], frame.schema).write.format("objects").mode("append").save(str(root))
    assert dict((k, (c, m)) for k, c, m in read())["a/1.bin"] == (b"new", None)
    for bad in ("../x", "/x", "", "a/../../x", "x.meta.json"):
        with pytest.raises(Exception, match="refused"):
            spark.createDataFrame([("fine", bytearray(b"1"), None), (bad, bytearray(b"2"), None)], frame.schema).coalesce(1).write.format("objects").mode("append").save(str(root))
    assert sorted(p.name for p in root.iterdir()) == ["a"] and len(read()) == 10


# -- structure of pages -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("html, want", [
    ("<head><title>T</title></head><body><h1 class='Big'>One &amp;lt; two</h1><p>first <b>bold</b> text</p></body>", [("chapter", "One &lt; two", "big", "h1", None), ("paragraph", "first bold text", None, "p", None)]),
    ("<p>no end<p>second one</p><div class='x'><p>inner<div>block</div> after</div>", [("paragraph", "no end", None, "p", None), ("paragraph", "second one", None, "p", None), ("paragraph", "inner", None, "p", None)]),
    ('<div class="Old Letter" style="a:b">Dear <div class="x">you</div> and <div>me</div>!</div><div class="none">no</div>', [("paragraph", "Dear you and me!", "old letter", "div", "a:b")]),
    ("<div class=poem>a line<div class=verse>a verse</div></div></div><p>tail", [("paragraph", "a linea verse", "poem", "div", None), ("paragraph", "a verse", "verse", "div", None), ("paragraph", "tail", None, "p", None)]),
    ("<h2>same<h3>same</h3><p>same</p><p>x</p><p>Copyright 1999 by</p><p>Next</p><script>var p='<p>no</p>'</script><!-- <p>no</p> --><p>1 < 2</p>", [("chapter", "same", None, "h2", None), ("paragraph", "1 < 2", None, "p", None)]),
    ("<blockquote><p>one</blockquote>two<p title='a>b' class=\"\">three</p>", [("paragraph", "one", None, "p", None), ("paragraph", "three", None, "p", None)]),
    ("", []), (None, []), ("plain", []),
])
def test_blocks_of_a_page(spark, html, want):
    from quire.operators import structure

    pages = spark.createDataFrame([(7, html)], "page long, html string")
    got = structure.blocks(pages, "page", "html").orderBy("n").collect()
    assert [(r.type, r.content, r.class_name, r.tag_name, r.styles) for r in got] == want and [r.n for r in got] == list(range(len(want)))


def test_head_of_a_page(spark):
    from quire.operators import structure

    pages = spark.createDataFrame([(1, "<title> A &amp; B </title><style>p{} </style><style>b{}</style>"), (2, None)], "page long, html string")
    assert sorted(map(tuple, structure.head(pages, "page", "html").collect())) == [(1, "A & B", "p{}\nb{}\n"), (2, "", "")]
