import io
import json
import random
import zipfile

import html_tree
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators import chapters as C
from quire.sources import epub, files, html
from quire.streaming import replay


BLOCKS = [
    ("<body><h1>Head</h1><p>One</p><p>Two</p></body>", [("/body[1]/h1[1]", "Head"), ("/body[1]/p[1]", "One"), ("/body[1]/p[2]", "Two")]),
    ("<table><tr><td>a one<br><br>b two<br/> <br/>c three</td></tr></table>", [(f"/body[1]/table[1]/tbody[1]/tr[1]/td[1]/p[{n}]", t) for n, t in ((1, "a one"), (2, "b two"), (3, "c three"))]),
    ("<p>a<br>b</p>", [("/body[1]/p[1]", "ab")]),
    ("<div><span><em>Just some inline text.</em></span></div>", [("/body[1]/div[1]", "Just some inline text.")]),
    ("<table><tr><td>xy</td></tr></table>", [("/body[1]/table[1]/tbody[1]/tr[1]/td[1]", "xy")]),
    ("<div>lost<p>kept</p></div>", [("/body[1]/div[1]/p[1]", "kept")]),
    ("<p>open<p>next", [("/body[1]/p[1]", "open"), ("/body[1]/p[2]", "next")]),
    ("", []), ("</p></div>", []),
]


def test_leaf_blocks(spark):
    rows = html.leaf_blocks(spark.createDataFrame([(i, s) for i, (s, _) in enumerate(BLOCKS)], "id int, html string"), ["id"], "html").orderBy("id", "order_index").collect()
    for i, (_, want) in enumerate(BLOCKS):
        assert [(r.xpath, r.text) for r in rows if r.id == i] == want


def by_tree(source):
    body = html_tree.body_of(source)
    html_tree.wrap_rows(body)
    html_tree.split_breaks(body)
    return [(*x, n) for n, x in enumerate(html_tree.long_enough(html_tree.leaves(body), 2))]


def soup(rnd):
    """A page of tags that open and close anyhow, with attributes, entities, notes, scripts and line breaks."""
    tags = ["p", "div", "li", "ul", "td", "tr", "tbody", "h1", "b", "a", "br", "span", "aside", "dt", "dl", "section", "img", "script", "style", "body", "blockquote"]
    attrs = ["", "", "", ' id="i%d"', ' name="n%d"', ' href="#x%d"', ' href="http://y/%d"', ' epub:type="noteref" href="n%d"', ' epub:type="footnote"', ' class="c" id=q%d', " hidden"]
    out = []
    for _ in range(rnd.randint(1, 60)):
        kind, tag = rnd.random(), rnd.choice(tags)
        if kind < 0.4:
            a = rnd.choice(attrs)
            out.append(f"<{tag}{a % rnd.randint(0, 9) if '%d' in a else a}>" + ("x</%s>" % tag if tag in ("script", "style") else ""))
        elif kind < 0.6:
            out.append(f"</{tag}>")
        elif kind < 0.7:
            out.append("<br><br/>" if rnd.random() < 0.7 else "<br>")
        else:
            out.append(rnd.choice(["text ", "a &amp;b", " ", "é\n", "x", "[1]", "&nbsp;z", "long words here"]))
    return rnd.choice(["", "<html><head><title>t</title></head>", "<body>"]) + "".join(out)


def test_rows_of_pages_are_those_of_the_tree(spark):
    """Hundreds of pages of tag soup: each column of each leaf as the other reading has it.  (Where a table has more than rows after its rows, the rows stay where they are.)"""
    rnd = random.Random(12)
    pages = [(i, soup(rnd)) for i in range(400)] + [(400, "<div>" * 300 + "deep"), (401, "<p>" + "<b>" * 3000 + "x y"), (402, "plain"), (403, None)]
    pages += [(404, "<table><caption>c</caption><tr><td>a b<td>c d<tr><td><table><tr><td>in in</table></table><table><thead><tr><th>h h<tbody><tr><td>x x</table>")]
    got = {}
    for r in html.leaf_blocks(spark.createDataFrame(pages, "id int, html string"), ["id"], "html").orderBy("id", "order_index").collect():
        got.setdefault(r.id, []).append((r.seq, r.xpath, r.tag, r.text, r.html, r.anchors, [tuple(x) for x in r.links], r.hidden, r.order_index))
    for i, source in pages:
        assert got.get(i, []) == (by_tree(source) if source is not None else []), source


def test_leaf_rows(spark):
    rows = spark.createDataFrame([(1, '<p>See<a epub:type="noteref" href="n.html#n1">1</a> it</p><aside epub:type="footnote" id="n1">Note text</aside>'), (2, None)], "id int, html string")
    got = html.leaf_blocks(rows, ["id"], "html").orderBy("seq").collect()
    assert [(r.text, r.hidden, r.order_index) for r in got] == [("See it", False, 0), ("Note text", True, 1)]
    assert got[0].links[0].href == "n.html#n1" and got[0].links[0].kind == "note" and got[1].anchors == ["n1"] and got[0].anchors == []


def test_anchors_outside_blocks_are_the_next_ones(spark):
    source = '<body><a id="top"></a><p>One</p><div id="d"><p id="q">Two</p></div><p id="gone">x</p><p>Last</p><a name="end"></a></body>'
    got = html.leaf_blocks(spark.createDataFrame([(1, source)], "id int, html string"), ["id"], "html").orderBy("seq").collect()
    assert [r.anchors for r in got] == [["top"], ["d", "q"], ["gone", "end"]]


def test_scripts_and_stores(spark, tmp_path):
    from quire.operators import shelf
    from quire.sources import scripts

    script = spark.createDataFrame([("-- head\nCREATE TABLE a (x);\n  -- inner; comment\nINSERT INTO a VALUES (1) ;\n;\n",)], "s string")
    assert script.select(scripts.split(F.col("s"))).first()[0] == ["CREATE TABLE a (x)", "INSERT INTO a VALUES (1)"]
    keys = ["a/b.png", "../x", "a/../../x", "/etc/x", "", None, "a/./b", "a\\..\\..\\x", "a/.."]
    got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", scripts.inside_store(F.col("key")).alias("ok")).collect()
    assert [r.key for r in got if r.ok] == ["a/b.png", "a/./b"]
    files_ = spark.createDataFrame([("a.png", b"1"), ("../b.png", b"2"), ("a.png.meta.json", b"{}")], "key string, content binary")
    metas = spark.createDataFrame([("a.png", '{"content_type":"image/png"}')], "key string, meta string")
    assert [(r.key, r.content_type) for r in scripts.objects(files_, metas).collect()] == [("a.png", "image/png")]
    (tmp_path / "kv.json").write_text(json.dumps({"x": "1", "y": "2"}))
    changed = files.with_values(files.key_values(spark, f"file://{tmp_path}/kv.json"), spark.createDataFrame([("y", "3"), ("z", "4")], "key string, value string"))
    files.write_key_values(changed, f"file://{tmp_path}/out")
    assert sorted(map(tuple, files.key_values(spark, f"file://{tmp_path}/out").collect())) == [("x", "1"), ("y", "3"), ("z", "4")]
    titles = spark.createDataFrame([("éa",), ("z",), ("Ea",), ("a",)], "t string")
    assert [r.t for r in titles.orderBy(shelf.locale_order("t")).collect()] == ["a", "Ea", "éa", "z"]
    (tmp_path / "b.mobi").write_bytes(b"x")
    assert [(r.format, r.supported) for r in epub.formats(spark, f"file://{tmp_path}/b.*").collect()] == [("mobi", False)]


def test_books_without_reading_order():
    source = book([("c10.html", "<p>ten</p>", True), ("c2.html", "<p>two</p>", True), ("note.html", "<p>no number</p>", True)], [])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(source)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, old.read(name).replace(b"itemref", b"other"))
    assert [r[5] for r in epub.spine_rows("b", out.getvalue())] == ["OEBPS/c2.html", "OEBPS/c10.html", "OEBPS/note.html"]


def test_deep_pages(spark):
    deep = "<div>" * 4000 + "<p>bottom</p>" + "</div>" * 4000 + "<p>after</p>"
    inline = "<p>" + "<b>" * 3000 + "bold" + "</b>" * 3000 + "</p>"
    got = html.leaf_blocks(spark.createDataFrame([(1, deep), (2, inline)], "id int, html string"), ["id"], "html").orderBy("id", "seq").collect()
    assert [(r.xpath.count("/"), r.text) for r in got] == [(4002, "bottom"), (2, "after"), (2, "bold")] and got[2].html.count("<b>") == 3000


def book(parts, toc, extra=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="{name}" media-type="application/xhtml+xml"/>' for n, (name, _, _) in enumerate(parts))
        spine = "".join(f'<itemref idref="i{n}"{"" if linear else " linear=" + chr(34) + "no" + chr(34)}/>' for n, (_, _, linear) in enumerate(parts))
        z.writestr("OEBPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Tales</dc:title><dc:creator>Doe, Jane</dc:creator><dc:language>en</dc:language></metadata><manifest>{items}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{spine}</spine>{extra}</package>')
        points = "".join(f"<navPoint><navLabel><text>{t}</text></navLabel><content src=\"{f}\"/></navPoint>" for f, t in toc)
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        for name, source, _ in parts:
            z.writestr(f"OEBPS/{name}", source)
    return out.getvalue()


LONG = "<p>" + "word " * 400 + "</p>"


def test_books(spark, tmp_path):
    parts = [
        ("ad.html", "<p>buy more</p>", True), ("half.html", "<p>10</p>", True), ("c1.html", "<h2>One Up</h2><p>text</p><p>see <a href='notes.html#n1'>1</a></p>" + LONG, True), ("c1b.html", LONG, True),
        ("c2.html", "<h1>Own Head</h1>" + LONG, True), ("c3.html", LONG, True), ("hidden.html", LONG, False), ("notes.html", "<h1>Notes</h1>" + "".join(f"<p id='n{i}'><a href='c1.html'>{i}</a>. The note {i}</p>" for i in range(1, 6)), True),
    ]
    (tmp_path / "a.epub").write_bytes(book(parts, [("half.html", "10 One Up Front"), ("c3.html", "Three"), ("notes.html", "Notes")]))
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    spine = epub.read_books(spark, f"file://{tmp_path}/*.epub")
    assert spine.count() == 8 and spine.first().author == "Doe, Jane"
    rows = html.leaf_blocks(spine, ["book", "spine_index", "file"], "html")
    chapters = C.titled(C.file_facts(spine, rows))
    titles = [(r.chapter, r.title) for r in chapters.orderBy("chapter").collect()]
    assert titles == [(1, "10 One Up Front"), (2, "10 One Up Front"), (3, "Own Head"), (4, "Three"), (5, "Notes")]
    notes = C.notes_pages(rows, chapters).where("is_notes")
    assert [r.title for r in notes.collect()] == ["Notes"]
    links = C.resolved(C.links(rows), rows, chapters, notes)
    got = links.where("file = 'OEBPS/c1.html'").first()
    assert (got.target_chapter, got.is_note) == (5, True) and got.target_xpath.endswith("p[1]")
    entries = C.note_entries(rows.where("file = 'OEBPS/notes.html'"))
    assert entries.count() == 5 and entries.first().section == "Notes"
    stored = rows.select("book", F.col("spine_index").alias("chapter"), "xpath")
    assert C.compatible(stored, stored).first().agree and not C.compatible(stored, stored.where("xpath not like '%h2%'")).first().agree


def test_damaged_books_fail_alone(spark, tmp_path):
    good = book([("a.html", LONG, True)], [("a.html", "One")])
    broken_toc = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(good)) as old, zipfile.ZipFile(broken_toc, "w") as new:
        for name in old.namelist():
            new.writestr(name, "<ncx><navMap>" if name.endswith(".ncx") else old.read(name))
    flipped = bytearray(good)
    at = good.index(b"<p>word word")
    flipped[at + 20] ^= 0xFF  # the member's checksum is wrong now
    for name, data in (("good", good), ("toc", broken_toc.getvalue()), ("flipped", bytes(flipped)), ("empty", b"")):
        (tmp_path / f"{name}.epub").write_bytes(data)
    got = {r.book: (r.toc_title, r.html is None) for r in epub.read_books(spark, f"file://{tmp_path}/*.epub").collect()}
    assert got == {"good.epub": ("One", False), "toc.epub": (None, False), "flipped.epub": ("One", True)}


def test_images(spark):
    images = spark.createDataFrame([("img/a.png", "s1"), ("b.png", "s2")], "path string, stored string")
    sources = spark.createDataFrame([("img/a.png",), ("../b.png",), ("x/y/a.png",), ("none.png",)], "src string")
    assert {r.src: r.stored for r in C.image_files(images, sources).collect()} == {"img/a.png": "s1", "../b.png": "s2", "x/y/a.png": "s1", "none.png": None}


def test_record_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"a","v":1}\nbroken\n{"id":"b","v":2}\n{"id":"a","v":3}\n{"v":4}\n')
    got = files.checkpoint(spark, f"file://{tmp_path}/c.jsonl", StructType.fromDDL("id string, v long"))
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("b", 2)]
    (tmp_path / "kv.json").write_text(json.dumps({"x": "1", "y": "2"}, indent=1))
    assert sorted(map(tuple, files.key_values(spark, f"file://{tmp_path}/kv.json").collect())) == [("x", "1"), ("y", "2")]
    rows = spark.createDataFrame([("b1", 1), ("b2", 2)], "uuid string, n int")
    files.replace_partitions(rows, f"file://{tmp_path}/out", "uuid")
    files.replace_partitions(spark.createDataFrame([("b1", 9)], "uuid string, n int"), f"file://{tmp_path}/out", "uuid")
    assert sorted((r.uuid, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("b1", 9), ("b2", 2)]
    assert files.schema_gaps({"t": ["a"]}, {"t": ["a", "b"], "u": []}) == ["t.b", "u"]


def test_streams_equal_batches(spark, tmp_path):
    from quire.operators import ledger, limits

    rows = [(i, i % 3, (i + 1) * 1_000_000, f"p{i % 7}") for i in range(60)]
    batch = spark.createDataFrame(rows, "event_id long, user_id long, t long, payment string").withColumn("ts", F.timestamp_micros("t"))
    batch.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    got = replay.run_to_end(replay.admission(stream.select("event_id", "user_id", "t"), 20_000_000, 2), "admitted", f"file://{tmp_path}/c1")
    want = limits.sliding_window(batch.select("event_id", "user_id", "t"), "user_id", "t", "event_id", 20_000_000, 2)
    assert sorted(map(tuple, got.select("event_id", "limited").collect())) == sorted(map(tuple, want.select("event_id", "limited").collect()))
    paid = replay.run_to_end(replay.credited_once(stream, "payment", "ts", "1 hour"), "paid", f"file://{tmp_path}/c2")
    assert sorted(r.payment for r in paid.collect()) == sorted(r.payment for r in ledger.once_each(batch, "payment", ["event_id"]).collect())
    counts = replay.run_to_end(replay.issued(stream, "user_id", "ts", "1 minute", "30 seconds"), "issued", f"file://{tmp_path}/c3", "complete")
    want = {}
    for _, user, t, _ in rows:
        want[user, t // 30_000_000] = want.get((user, t // 30_000_000), 0) + 1
    assert {(r.user_id, int(r.start.timestamp()) // 30): r.n for r in counts.select("user_id", "start", "n").collect()} == want
    bursts = replay.run_to_end(replay.sessions(stream.where("event_id < 10 OR event_id >= 30"), "user_id", "ts", "1 hour", "10 seconds"), "bursts", f"file://{tmp_path}/c4", "complete")
    assert sorted((r.user_id, r.n) for r in bursts.collect()) == [(0, 4), (0, 10), (1, 3), (1, 10), (2, 3), (2, 10)]


def test_idle_state_goes(spark, tmp_path):
    """Once the watermark is past a key's window, its state is gone, and its next event starts anew."""
    schema = "event_id long, user_id long, t long"
    for n, rows in enumerate([[(0, 1, 1_000_000), (1, 1, 2_000_000)], [(2, 2, 900_000_000)], [(3, 2, 901_000_000)], [(4, 1, 902_000_000)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = replay.admission(stream, 20_000_000, 2).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id: r.limited for r in spark.table("idle").collect()} == {i: False for i in range(5)}
    assert min(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[2:] if p["stateOperators"]) == 1
