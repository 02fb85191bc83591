import random

from larkspur.llm import warc


def test_archives_round_trip_and_merge(spark):
    rows = [(i, f"http://h{i % 3}.example.org/p{i % 5}", ["<a>", "ü" * 5, "", None][i % 4] if i % 2 else f"<p>{i}\r\n\r\n{i}", i) for i in range(60)] + [(None, None, "<a>", 0), (7, "http://x\r\nX-Page-Id: 9/", "<a>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, urlkey int").selectExpr("*", "timestamp_seconds(1000 - urlkey) captured").repartition(4)
    got = warc.archive_and_index(pages, archive_bytes=600, range_rows=10).collect()
    assert len(got) == 62
    last = {}
    for i, _, html, _ in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", -1))
    html_of = {i: h or "" for i, _, h, _ in rows[:60]}
    for r in got:
        if r.page_id is not None and r.page_id != 7:
            html = html_of[r.page_id]
            want = None if last[html] == r.page_id else last[html]
            assert (r.payload_bytes, r.record_type, r.refers_to) == (len(html.encode()), "response" if want is None else "revisit", want)
    order = sorted(got, key=lambda r: (r.range_no, r.place))
    keys = [(r.urlkey, r.captured, r.page_id is not None, r.page_id or 0) for r in order]
    assert keys == sorted(keys) and len({r.range_no for r in got}) > 2 and len({r.run for r in got}) > 4
    assert [r.position for r in order] == list(range(62))
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(300):
        rows = [("r", 0, rng.choice("abc"), rng.randrange(3), rng.choice([None, 1, 2]), i) for i in range(rng.randrange(30))]
        runs: list[list] = [[] for _ in range(rng.randrange(1, 9))]
        for r in rows:
            rng.choice(runs).append(r)
        merged = list(warc.loser_tree(sorted(r, key=warc._key) for r in runs))
        assert [warc._key(r) for r in merged] == sorted(map(warc._key, rows))


def test_url_keys():
    assert warc.url_key("https://A.Example.org/x?y") == "org,example,a)/x?y"
    assert warc.url_key(None) == warc.url_key("") == ""


def test_archives_are_read_in_tasks_of_their_own(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 500 + str(i)) for i in range(40)], "page_id long, url string, html string").repartition(4)
    manifest = warc.materialise(warc.write_archives(warc.with_revisits(pages), warc.new_folder(spark, "warc-test"), 400), "warc-test-manifest")
    runs = warc.read_runs(manifest)
    assert manifest.count() > 4 and runs.rdd.getNumPartitions() == manifest.count() and runs.count() == 40


def test_record_ids_differ_for_repeated_rows():
    records = [warc.record(1, "http://a/", b"x", 0, None, f"archive:{i}") for i in range(2)] + [warc.record(2, None, b"x", 5, (1, "http://a/", 0), "archive:2")]
    heads = [h for data in records for _, _, h, _ in warc.parse(__import__("gzip").compress(data))]
    assert len({h["WARC-Record-ID"] for h in heads}) == 3
    assert heads[2]["WARC-Refers-To-Target-URI"] == "http://a/" and heads[2]["X-Refers-To-Page"] == "1"
