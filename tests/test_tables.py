import json

import pytest
from pyspark.sql import functions as F

from newsloom.sources import pages, tables, tenants
from newsloom.sources import pages_out as po
from newsloom.sources.tables import SnapshotTable, read_posts, report_path, write_jsonl
from newsloom.streaming import ingest as st


def test_insert_and_upsert_are_idempotent(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1)], "k long, v string, n int")
    assert t.insert_new(rows, ["k"]).count() == 2
    assert t.insert_new(rows, ["k"]).count() == 0 and t.read().count() == 2
    for _ in range(2):
        t.upsert(spark.createDataFrame([(1, "z", 9)], "k long, v string, n int"), ["k"], [F.desc("n")])
    assert {r["v"] for r in t.read().collect()} == {"z", "c"}


def test_snapshots_survive_an_interrupted_write(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.version() is None
    t.append(spark.createDataFrame([(1, " a ")], "k long, v string"))
    first = t.folders()
    t.append(spark.createDataFrame([(2, "b")], "k long, v string").coalesce(1))
    assert t.folders()[:1] == first and len(t.folders()) == 2 and len(t._part(t.folders()[1:]).inputFiles()) == 1  # one row, one file
    monkeypatch.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.append(spark.createDataFrame([(3, "c")], "k long, v string"))
    monkeypatch.undo()
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "b")} and t.read(1).count() == 1
    with pytest.raises(RuntimeError):  # another writer was faster
        t._commit(1, first)
    t.upsert(spark.createDataFrame([(2, "z")], "k long, v string"), ["k"], [F.desc("v")])
    assert t.folders()[0] == first[0] and {r["v"] for r in t.read().collect()} == {"a", "z"}
    assert t.clean(1) == 2 and t.read().count() == 2


def test_feeds_listings_and_pages(spark):
    feed = "<rss><channel><item><title>T</title><link>https://n.example/a</link><pubDate>Fri, 02 Jan 2026 10:00:00 +0000</pubDate></item><item><title>U</title><guid>x</guid></item></channel></rss>"
    df = spark.createDataFrame([("s", feed), ("s", "<broken"), ("s", None)], "source_name string, xml string")
    assert [(r["url"], str(r["published_at"])[:4]) for r in pages.parse_feeds(df).collect()] == [("https://n.example/a", "2026")]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://n.example/b"/><updated>2026-02-01T00:00:00+05:30</updated></entry></feed>'
    guid = "<rss><channel><item><title>G</title><guid>https://n.example/g</guid><pubDate>no date</pubDate></item></channel></rss>"
    got = sorted((r["url"], str(r["published_at"])) for r in pages.parse_feeds(tables.feeds_of(spark, {"a": atom, "g": guid})).collect())
    assert got == [("https://n.example/b", "2026-01-31 18:30:00"), ("https://n.example/g", "None")]
    page = '<a href="/x/rss/2">A link below a feed of news</a>' + '<a href="/x/1">A long enough title</a><a href="/rss">Another long title</a><a href="https://o.example/y">Some other host here</a><a href="/x/1">A long enough title</a>'
    got = pages.parse_listings(spark.createDataFrame([(1, page, "https://n.example/")], "id long, p string, b string"), "id", "p", "b").collect()
    assert [(r["url"], r["rank"]) for r in got] == [("https://n.example/x/rss/2", 1), ("https://n.example/x/1", 2)]
    assert pages.article_text("<script>x</script><p>Hello &amp; bye</p>") == ("Hello & bye", True) and pages.article_text(None) == ("", False)
    long = "A paragraph of the article that is long enough to be one of its body. " * 2
    assert pages.article_text(f'<meta name="description" content="Short"><nav><p>{long}</p></nav><article><p>{long}</p><p>By me</p></article>') == (long.strip(), True)
    assert pages.article_text('<meta name="description" content="Short &amp; sweet"><p>x</p>') == ("Short & sweet", True)


def test_exports_and_names(spark, tmp_path):
    write_jsonl(spark.createDataFrame([("தமிழ்",)], "t string"), str(tmp_path / "j"))
    assert "தமிழ்" in "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "j").glob("part*"))
    assert report_path("/r", "2026-01-01").endswith(".md")
    for bad in ("../x", "a/b", ".."):
        with pytest.raises(ValueError):
            report_path("/r", bad)


def test_stream_equals_batch_and_runs_twice(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    items = [{"source_name": "s", "source_url": f"https://n.example/{i % 3}?utm_source=x", "title": None, "text": f"text {i % 3}", "published_at": "2026-01-01T00:00:00Z", "ingested_at": "2026-01-01T00:00:00Z"} for i in range(6)]
    (folder / "a.json").write_text("\n".join(map(json.dumps, [*items, {"text": " "}])))
    for _ in range(2):
        st.ingest(st.item_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = SnapshotTable(spark, str(tmp_path / "out")).read()
    assert st.daily(spark, str(folder), str(tmp_path / "day")) == {"seen": 3, "failed": 0, "saved": 3, "skipped": 0} and st.daily(spark, str(folder), str(tmp_path / "day")) == {}
    batch = st.prepared(spark.read.schema(st.ITEM).json(str(folder)))
    assert {r[0] for r in got.select("content_hash").collect()} == {r[0] for r in batch.select("content_hash").collect()} and got.count() == 3


def test_cursors(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id":"9","handle":"h","text":"a"}\n{"id":"10","handle":"h","text":""}\n{"id":"5","handle":"k","text":"b"}')
    posts = read_posts(spark, str(tmp_path / "p.json"))
    failed = spark.createDataFrame([("k",)], "handle string")
    st.advance_cursor(spark, str(tmp_path / "c"), posts, failed)
    cursors = SnapshotTable(spark, str(tmp_path / "c")).read()
    assert [(r["handle"], int(r["cursor"])) for r in cursors.collect()] == [("h", 10)]
    assert [r["id"] for r in st.since(posts, cursors).collect()] == ["5"]
    assert st.post_items(posts).count() == 2


def test_jobs_and_materialized_results(spark, tmp_path):
    job = st.Job()
    assert job.run(lambda: None) and job.state == "finished"
    assert job.run(lambda: 1 / 0) and job.state == "failed" and "zero" in job.error
    assert job.run(lambda: job.run(lambda: None) or setattr(job, "error", "refused")) and job.error == "refused"
    t, made = SnapshotTable(spark, str(tmp_path / "t")), []
    kept = st.Materialized(t, lambda df: made.append(1) or df.agg(F.count("*").alias("n")))
    assert kept.read() is None
    t.append(spark.range(3).toDF("id"))
    assert kept.read().first()["n"] == 3 and kept.read().first()["n"] == 3 and len(made) == 1
    t.append(spark.range(2).toDF("id"))
    assert kept.read().first()["n"] == 5 and len(made) == 2
    kept.invalidate()
    assert kept.read().first()["n"] == 5 and len(made) == 3


def test_tenants(spark, tmp_path):
    root = str(tmp_path / "t")
    path = tenants.provision(spark, root, "The  Post")
    assert tenants.provision(spark, root, "the post") == path and path.endswith("the-post")
    tenants.provision(spark, root, "Other")
    known = SnapshotTable(spark, f"{root}/tenants").read()
    SnapshotTable(spark, f"{path}/items").append(spark.range(4).toDF("id"))
    assert [tuple(r) for r in tenants.usage(spark, known, ("items", "labels")).collect()] == [("the-post", "items", 4)]
    users = spark.createDataFrame([("a@x", "the-post", "viewer"), ("a@x", "the-post", "owner"), ("b@x", "gone", "owner"), ("c@x", "other", "king")], "email string, slug string, role string")
    assert [tuple(r) for r in tenants.memberships(users, known).collect()] == [("a@x", "the-post", "owner")]
    keys = spark.createDataFrame([("k1", "the-post"), ("k2", "other")], "key_hash string, slug string")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key_hash string")
    held = known.withColumn("status", F.when(F.col("slug") == "other", "suspended").otherwise("active"))
    assert {(r["key_hash"], r["allowed"]) for r in tenants.allowed(keys, asked, held).collect()} == {("k1", True), ("k2", False), ("k3", False)}


def test_pages_maps_and_rosters(spark, tmp_path):
    rows = [("a", "A [x]", "person", "P", 3, 1, 1, 0, 1, "water", "Rosi")]
    made = spark.createDataFrame(rows, "slug string, name string, entity_type string, party string, mentions long, positive long, negative long, mixed long, neutral long, top_categories string, top_districts string").select("slug", po.dossier_page().alias("page"))
    root = str(tmp_path / "v")
    assert po.write_vault(spark, made, root) == 1 and po.write_vault(spark, made, root) == 0
    f = tmp_path / "v" / "a.md"
    f.write_text(f.read_text().replace(po.BEGIN, po.BEGIN + "\nmine"))
    assert po.write_vault(spark, made.withColumn("page", F.replace("page", F.lit("3 mentions"), F.lit("4 mentions"))), root) == 1
    assert "mine" in f.read_text() and "4 mentions" in f.read_text() and "[[a|A x]]" in f.read_text()
    with pytest.raises(ValueError):
        po.write_vault(spark, made.withColumn("slug", F.lit("../x")), root)
    ring = [[0.0, 0.0], [5.0, 0.001], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    rings = spark.createDataFrame([("d", ring), ("d", [[0.0, 0.0], [0.01, 0.0], [0.0, 0.01]]), ("e", None)], "district string, ring array<array<double>>")
    got = po.map_paths(rings, (0, 0, 10, 10)).collect()
    assert [(r["district"], r["path"].count("L")) for r in got] == [("d", 3)]
    wiki = '{| class="x"\n|-\n| rowspan="2" | North || 1 || [[A b|Ann]]\n|-\n| 2\n| Bo\n|}'
    assert po.table_rows(wiki) == [["North", "1", "Ann"], ["North", "2", "Bo"]] and po.table_rows(None) == []
    assert po.roster(spark.createDataFrame([(wiki,), (None,)], "t string"), "t", ("part", "no", "name", "party")).count() == 2
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "place int, title string")
    assert po.brief_text(lines, "2026-01-01") == "Brief of 2026-01-01\n1. a\n2. b\n"


def test_report_configs_and_transcripts(spark, tmp_path):
    items = spark.createDataFrame([(1, "S*", "T_1", None, None), (2, None, None, None, None)], "id long, source_name string, title string, published_at timestamp, ingested_at timestamp").withColumn("ingested_at", F.lit("2026-01-02").cast("timestamp"))
    said = spark.createDataFrame([(1, "positive", True), (1, "negative", False), (2, None, True)], "raw_item_id long, stance_toward_government string, needs_human_review boolean")
    text = tables.daily_report(items, said, "2026-01-02")
    assert "- positive: 1" in text and "S\\*: 1" in text and "T\\_1" in text
    (tmp_path / "c.json").write_text('[{"name": "a"}]')
    schema = spark.createDataFrame([], "name string").schema
    assert tables.read_config(spark, str(tmp_path / "c.json"), schema).count() == 1 and tables.read_config(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "v.json").write_text('{"video_id":"v","description":" ","transcript":"words"}')
    videos = tables.read_transcripts(spark, str(tmp_path / "v.json")).select(F.lit(1).alias("raw_item_id"), "description", "transcript")
    assert tables.transcript_items(videos).first()["text"] == "words"
    assert tables.posts_of(spark, [{"id": "1", "handle": "h"}]).count() == 1
