"""Crawls, ranks, layouts, sinks and streams on small fixtures, against brute force."""

from collections import deque
from datetime import datetime
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom import CMS_EXPORT, GENERIC
from webloom.operators import crawl, export, layout, ranking
from webloom.operators.attempts import retry_outcome
from webloom.operators.links import asset_rows, asset_table, link_rows, link_table, page_references
from webloom.plans import clone, derived
from webloom.plans.registry import QUERIES
from webloom.session import scratch_path, written
from webloom.sinks import exports, files, imports, snapshots
from webloom.sources import captures, seeds, sitemaps
from webloom.streaming import discover
from webloom.streaming.discover import CAPTURED, PAGES, discover_links, page_stream, run_stream, stream_discover_links

SF = "/root/testdata/sf0.001"


def brute_crawl(starts, edges, cap):
    """A queue and a set, one site at a time."""
    out = {}
    for site, first in starts.items():
        seen, queue = [], deque(first)
        while queue and len(seen) < cap:
            url = queue.popleft()
            if url in seen:
                continue
            seen.append(url)
            queue.extend(edges.get(url, []))
        out[site] = seen
    return out


def graph(spark):
    """Two sites with cycles, repeated links and dangling links; one is much larger."""
    links = {}
    for site, n in (("a", 60), ("b", 7)):
        for k in range(n):
            targets = [(3 * k + 1) % (n + 5), 0, (k * k) % n, (3 * k + 1) % (n + 5), (k + 1) % n]
            links[f"http://{site}/{k}"] = [f"http://{site}/{t}" for t in targets]
    rows = [(s, d, p) for s, ds in links.items() for p, d in enumerate(ds)]
    edges = spark.createDataFrame(rows, "src string, dst string, pos long")
    starts = {"a": ["http://a/0", "http://a/50"], "b": ["http://b/3"]}
    order = [(site, url, [i]) for site, urls in starts.items() for i, url in enumerate(urls)]
    return links, starts, edges.groupBy("src", "dst").agg(F.min("pos").alias("pos")), spark.createDataFrame(order, "site string, url string, order array<long>")


def test_rank_equals_a_queue(spark, monkeypatch):
    links, starts, edges, queue = graph(spark)
    edges = written(edges, "edges")
    for cap, rebase in ((1000, 16), (25, 16), (25, 1), (1000, 2), (6, 3)):
        monkeypatch.setattr(crawl, "REBASE", rebase)
        visited = crawl.crawl_reachability(queue, edges, max_pages=cap)
        assert visited.agg(F.max(F.size("order"))).first()[0] <= rebase + 1
        ranked = ranking.max_pages_cap(ranking.crawl_rank(visited), cap).collect()
        got = {site: [r.url for r in sorted((x for x in ranked if x.site == site), key=lambda x: x["rank"])] for site in starts}
        assert got == brute_crawl(starts, links, cap)
        assert sorted(r["rank"] for r in ranked if r.site == "a") == list(range(1, len(got["a"]) + 1))


def test_bucketed_edges_are_not_shuffled_again(spark):
    _, _, edges, queue = graph(spark)
    with crawl.stored_edges(edges, buckets=4) as stored:
        got = crawl.crawl_reachability(queue, stored)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = got.join(stored, got["url"] == stored["src"])._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
    assert got.count() == crawl.crawl_reachability(queue, written(edges, "edges")).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("webloom_edges")]


def test_visited_bits(spark):
    numbers = spark.createDataFrame([("a", n) for n in (0, 7, 8, 32_767, 32_768, 100_000, None)] + [("b", 7)], "site string, number long")
    first = crawl.folded(None, numbers.filter("site = 'a' and number < 9"))
    bits = crawl.folded(first, numbers)
    asked = spark.createDataFrame([(s, n, n) for s in "abc" for n in (0, 1, 7, 8, 9, 32_766, 32_767, 32_768, 100_000)], "site string, number long, x long")
    got = {(r.site, r.number) for r in crawl.not_in(asked, bits).collect()}
    have = {("a", n) for n in (0, 7, 8, 32_767, 32_768, 100_000)} | {("b", 7)}
    assert got == {(r.site, r.number) for r in asked.collect()} - have


def test_a_level_does_not_move_what_was_visited(spark, monkeypatch):
    """A long chain with links back to all pages: with bits the latest levels are all that is joined as rows."""
    monkeypatch.setattr(crawl, "FOLD_ROWS", 1)
    folds, plain = [], crawl.folded
    monkeypatch.setattr(crawl, "folded", lambda bits, numbers: folds.append(numbers.count()) or plain(bits, numbers))
    n = 14
    links = {f"http://a/{k}": [f"http://a/{t}" for t in range(min(k + 2, n))] for k in range(n)}
    edges = spark.createDataFrame([(s, d, p) for s, ds in links.items() for p, d in enumerate(ds)], "src string, dst string, pos long")
    queue = spark.createDataFrame([("a", "http://a/0", [0]), ("a", "http://a/alone", [1])], "site string, url string, order array<long>")
    ranked = ranking.crawl_rank(crawl.crawl_reachability(queue, written(edges, "edges"))).orderBy("rank").collect()
    assert [r.url for r in ranked] == brute_crawl({"a": ["http://a/0", "http://a/alone"]}, links, 99)["a"]
    assert [r.depth for r in ranked] == [0, 0, *range(1, n)]
    assert sum(folds) <= n + 2 and len(folds) >= n // 2 and max(folds) <= 3  # each number is folded once


def test_max_depth(spark):
    _, _, edges, queue = graph(spark)
    visited = crawl.crawl_reachability(queue, written(edges, "edges"), max_depth=1)
    assert visited.agg(F.max("depth")).first()[0] == 1


def test_rank_by_ranges_equals_the_window(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select(
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("site"), "event_id"
    )
    table = written(events, "events")
    a = ranking.rank_within(table, "site", ["event_id"])
    b = table.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("event_id")).cast("bigint"))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_retry_outcome_limits_before_the_exchange(spark):
    log = [("x", i, i, i == 4) for i in range(6)] + [("y", i, i, i >= 1) for i in range(4)] + [("z", 0, 0, False)]
    df = spark.createDataFrame(log, "url string, ts long, attempt_id long, ok boolean")
    got = {r.url: (r.attempts, r.first_success, r.exhausted) for r in retry_outcome(df, 3).collect()}
    assert got == {"x": (3, None, True), "y": (2, 2, False), "z": (1, None, False)}
    plan = retry_outcome(spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id url", "ts", "event_id attempt_id", "event_type <> 'error' ok"), 3)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_sitemaps(spark):
    head = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:i">'
    docs = [
        ("h", 0, head + "<url><loc> http://h/a?x=1&amp;y=2 </loc></url><url><i:image><i:loc>http://h/i.png</i:loc></i:image></url><!-- <loc>http://h/no</loc> --><url><loc><![CDATA[http://h/c&d]]></loc></url><url><loc/></url></urlset>"),
        ("h", 1, head + "<url><loc>http://h/cut</loc></url>"),
        ("h", 2, "not xml"),
        ("h", 3, ""),
        ("h", 4, "<sitemapindex><sitemap><loc>http://h/s.xml</loc></sitemap><x><loc>relative</loc></x></sitemapindex>"),
    ]
    df = spark.createDataFrame(docs, "site string, doc long, xml string")
    got = [(r.doc, r.url) for r in sitemaps.sitemap_urls(df).orderBy("doc", "pos").collect()]
    assert got == [(0, "http://h/a"), (0, "http://h/i.png"), (0, "http://h/c&d"), (4, "http://h/s.xml")]
    assert sitemaps.sitemap_count(df).first().n == 5


def test_endpoints_for_named_sites(spark):
    sites = spark.createDataFrame([("h", "http://h/WordPress/"), ("g", "http://g")], "site string, base_url string")
    got = {r.url for r in seeds.rest_endpoint_candidates(sites, GENERIC).collect()}
    assert got == {"http://h/wp-json/wp/v2/posts", "http://h/api/", "http://h/data/", "http://g/api/", "http://g/data/"}
    answers = spark.createDataFrame([("http://h/api/", 200, "application/json"), ("http://h/data/", 200, "Application/JSON"), ("http://g/api/", 201, "application/json")], "url string, status int, content_type string")
    hits = seeds.rest_endpoint_hits(seeds.rest_endpoint_candidates(sites, GENERIC), answers)
    assert [r.url for r in hits.collect()] == ["http://h/api/"]


def test_path_conflicts_and_winners(spark):
    rows = [("s", "a", "u1", 1), ("s", "a", "u2", 2), ("s", "a/b/c", "u3", 3), ("s", "a/b", "u4", 4), ("t", "a", "u5", 5)]
    df = spark.createDataFrame(rows, "site string, path string, url string, rank long")
    got = {(r.path, r.conflict, r.n) for r in layout.path_conflicts(df).collect()}
    assert got == {("a", "same_path", 2), ("a", "file_is_folder", 2), ("a/b", "file_is_folder", 1)}
    assert {(r.site, r.path, r.url) for r in layout.path_winner(df, "last").collect()} >= {("s", "a", "u2"), ("t", "a", "u5")}
    assert {(r.site, r.path, r.url) for r in layout.path_winner(df, "first").collect()} >= {("s", "a", "u1")}


def test_sinks(spark):
    out = scratch_path(spark, "assets")
    rows = [("s", f"p{i % 5}", f"u{i}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "site string, path string, url string, rank long")
    captured = df.filter("rank <> 0").select("url", F.encode("url", "UTF-8").alias("content"))
    files.asset_sink(df, captured, out)
    files.asset_sink(df, captured, out, existing=spark.read.parquet(out))
    stored = spark.read.parquet(out)
    # The first asset was never captured, so the next writer of its path counts.
    assert sorted((r.path, r.url) for r in stored.collect()) == [("p0", "u5")] + [(f"p{i}", f"u{i}") for i in range(1, 5)]
    assert all(bytes(r.content).decode() == r.url for r in stored.collect())
    one = files.of_site(stored, "s")
    assert one.count() == 5 and files.of_site(stored, "t").count() == 0
    assert "PartitionFilters: [isnotnull(site_bucket" in one._jdf.queryExecution().executedPlan().toString()
    pages = scratch_path(spark, "pages")
    files.site_files_sink(df.withColumn("content", F.col("url")), pages)
    assert sorted(r.content for r in spark.read.parquet(pages).collect()) == [f"u{i}" for i in range(15, 20)]


def test_snapshots_are_replaced_path_by_path(spark, monkeypatch):
    out = scratch_path(spark, "snapshots")

    def rows(run, *paths):
        return spark.createDataFrame([(f"s{p % 3}", f"p{p}", f"u{p}", p, f"{run} {p}") for p in paths], "site string, path string, url string, rank long, content string")

    def held(version=None):
        return {r.path: r.content for r in snapshots.read_snapshot(spark, out, version).collect()}

    assert snapshots.read_snapshot(spark, out) is None and snapshots.upsert_files(rows("none"), out) == 0
    assert snapshots.upsert_files(rows("a", *range(9)), out, buckets=8) == 1
    twice = rows("b", 3, 12).unionByName(rows("lost", 3).withColumn("rank", F.lit(1).cast("bigint")))
    assert snapshots.upsert_files(twice, out, buckets=8) == 2
    want = {f"p{p}": f"a {p}" for p in range(9)} | {"p3": "b 3", "p12": "b 12"}
    assert held() == want and held(1) == {f"p{p}": f"a {p}" for p in range(9)}
    # All of b's paths are of one site, so the buckets of the other sites are where they were.
    folders = {r["site_bucket"]: r["folder"] for r in snapshots.manifest(spark, out, 1)}
    assert sum(folders[r["site_bucket"]] == r["folder"] for r in snapshots.manifest(spark, out)) == len(folders) - 1
    with pytest.raises(ValueError, match="buckets"):
        snapshots.upsert_files(twice, out, buckets=9)

    # A run that fails before its commit, or in it, leaves the snapshot before.
    broken = rows("c", 1).withColumn("content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        snapshots.upsert_files(broken, out, buckets=8)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            snapshots.upsert_files(rows("d", 1), out, buckets=8)
    assert held() == want
    # Of two writers of one version the second fails.
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        snapshots._commit(spark, out, 2, [(2, 0, "x", 8)])
    assert held() == want


def test_assets_from_captured_files(spark, tmp_path):
    """Files below hosts are resources; their bytes are read by one scan and take part in one join."""
    for name in ("s/a/x.css", "s/b.js", "s/sub dir/é.png", "t/b.js", "s/unwanted.bin"):
        file = tmp_path / "captured" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(name.encode() * 1000)
    resources = captures.read_asset_files(spark, str(tmp_path / "captured"))
    assert {r.url for r in resources.select("url").collect()} == {"http://s/a/x.css", "http://s/b.js", "http://s/sub dir/é.png", "http://t/b.js", "http://s/unwanted.bin"}
    rows = [("s", "x.css", "http://s/a/x.css", 1), ("s", "b.js", "http://s/gone.js", 1), ("s", "b.js", "http://s/b.js", 2), ("s", "p", "http://s/sub dir/é.png", 3), ("t", "b.js", "http://t/b.js", 4)]
    assets = spark.createDataFrame(rows, "site string, path string, url string, rank long")
    out, seen, plain = scratch_path(spark, "assets"), [], files._write
    try:
        files._write = lambda rows, *rest: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or plain(rows, *rest)
        files.asset_sink(assets, resources, out)
        files.asset_sink(assets, resources, out, existing=spark.read.parquet(out))
    finally:
        files._write = plain
    got = {(r.site, r.path): bytes(r.content) for r in spark.read.parquet(out).collect()}
    assert got == {("s", "x.css"): b"s/a/x.css" * 1000, ("s", "b.js"): b"s/b.js" * 1000, ("s", "p"): "s/sub dir/é.png".encode() * 1000, ("t", "b.js"): b"t/b.js" * 1000}
    assert spark.read.parquet(out).count() == 4
    # One scan reads contents, and the aggregates are on names only.
    assert all(sum("Aggregate" in line and "content" in line for line in plan.splitlines()) == 0 for plan in seen)
    assert [plan.count("content:binary") for plan in seen] == [1, 1]


def site_pages(spark):
    link = "".join(f'<a href="{p}">x</a>' for p in ("/a", "/b/", "c.html", "/gone", "http://o/x"))
    rows = [
        (1, "http://s/", f"<title>Home</title><body>{link}<img src=/i/x.png></body>"),
        (2, "http://s/a", "<title>A \u0001 &lt;</title><main>m &amp; <b>n</b></main><script src='j/a.js'></script>"),
        (3, "http://s/b/", '<a href="/d">d</a>'),
        (4, "http://s/c.html", "<p>c"),
        (5, "http://s/d", ""),
        (6, "http://s/island", "<p>not linked"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sites = spark.createDataFrame([("s", "http://s/")], "site string, base_url string")
    return pages, sites


def test_export_job(spark):
    pages, sites = site_pages(spark)
    options = CMS_EXPORT.with_(seed_paths=())
    job = clone.export_cms_site(pages, sites, options)
    log = {r.url: (r["rank"], r.outcome) for r in clone.crawl_log(job.crawl, options).collect()}
    assert log == {
        "http://s/": (1, "saved"), "http://s/a": (2, "saved"), "http://s/b/": (3, "saved"), "http://s/c.html": (4, "saved"),
        "http://s/gone": (5, "failed"), "http://s/d": (6, "resource"),
    }
    assert {(r.path, r.kind) for r in job.files().collect()} == {
        ("index.php", "page"), ("a/index.html", "page"), ("b/index.html", "page"), ("c.html", "page"), ("d/index.html", "resource"),
        ("i/x.png", "images"), ("j/a.js", "js"),
    }
    contents = {r.path: r.content for r in job.page_files().collect()}
    assert 'src="i/x.png"' in contents["index.php"] and 'src="../j/a.js"' in contents["a/index.html"]
    out = scratch_path(spark, "wxr")
    exports.write_wxr(job.items(), job.channel(), out)
    items = spark.read.format("xml").option("rowTag", "item").load(f"{out}/items")
    got = {r.link: r for r in items.collect()}
    assert set(got) == {"http://s/a", "http://s/b/", "http://s/c.html"}  # a page without text is not exported
    assert {r.site for r in items.collect()} == {"s"} and len({r["wp:post_id"] for r in items.collect()}) == 3
    assert clone.export_cms_site(pages, sites, options.with_(generate_xml=False)).items().count() == 0
    page = got["http://s/a"]
    assert page.title == "A  <" and page["content:encoded"] == "<main>m &amp; <b>n</b></main>"
    assert page.guid._VALUE == "http://s/a" and page.guid._isPermaLink is False
    assert page.pubDate == "Mon, 01 Jan 2024 00:00:00 +0000" and page["wp:post_name"] == "a"
    assert set(items.columns) >= {"wp:post_id", "wp:status", "dc:creator"}
    channel = spark.read.format("xml").option("rowTag", "channel").load(f"{out}/channel").first()
    assert (channel.title, channel.link, channel.language) == ("s", "http://s/", "en-US")


def test_responses_gate_the_crawl(spark):
    pages, sites = site_pages(spark)
    answers = [("http://s/", 200, "Text/HTML"), ("http://s/b/", 404, "text/html"), ("http://s/a", 200, "text/html"), ("http://s/c.html", 200, "image/png")]
    responses = spark.createDataFrame(answers, "url string, status int, content_type string")
    options = CMS_EXPORT.with_(seed_paths=())
    log = {r.url: r.outcome for r in clone.crawl_log(clone.clone_cms_site(pages, sites, options, responses=responses).crawl, options).collect()}
    # The page behind the failed one is not reached.
    assert log == {"http://s/": "saved", "http://s/a": "saved", "http://s/b/": "failed", "http://s/c.html": "skipped", "http://s/gone": "failed"}


def test_sitemap_seeds_reach_islands(spark):
    pages, sites = site_pages(spark)
    maps = spark.createDataFrame([("s", 0, "<urlset><url><loc>http://s/island</loc></url><url><loc>http://o/x</loc></url></urlset>")], "site string, doc long, xml string")
    job = clone.clone_site(pages, sites, GENERIC.with_(generate_xml=True), sitemaps=maps)
    ranks = {r.url: r["rank"] for r in job.crawl.log.collect()}
    assert ranks["http://s/island"] == 2 and "http://o/x" not in ranks
    assert job.channel().count() == 1


def test_crawled_resources_are_files(spark):
    pages, sites = site_pages(spark)
    pages = pages.unionByName(spark.createDataFrame([(7, "http://s/e", '<a href="/x.js">j</a>')], pages.schema))
    answers = [("http://s/", 200, "text/html"), ("http://s/a", 200, "text/html"), ("http://s/b/", 0, None), ("http://s/b/", 200, "text/html"), ("http://s/d", 200, "text/html"), ("http://s/gone", 200, "application/pdf"), ("http://s/c.html", 200, "text/css")]
    responses = spark.createDataFrame(answers, "url string, status int, content_type string")
    options = CMS_EXPORT.with_(seed_paths=("e", "x.js"))
    more = spark.createDataFrame([("http://s/e", 200, "text/html"), ("http://s/x.js", 200, "text/javascript")], responses.schema)
    job = clone.clone_cms_site(pages, sites, options, responses=responses.unionByName(more))
    log = {r.url: r.outcome for r in job.crawl.log.collect()}
    assert log["http://s/x.js"] == log["http://s/d"] == "resource" and log["http://s/b/"] == "saved" and log["http://s/gone"] == "skipped"
    files_ = {r.path: r.kind for r in job.files().collect()}
    assert files_["x.js"] == files_["d/index.html"] == "resource"


def test_attempts_decide_failures(spark):
    pages, sites = site_pages(spark)
    log = [("http://s/a", i, i, i == 3) for i in range(4)] + [("http://s/b/", i, i, i == 1) for i in range(3)]
    attempts = spark.createDataFrame(log, "url string, ts long, attempt_id long, ok boolean")
    options = CMS_EXPORT.with_(seed_paths=())
    got = {r.url: r.outcome for r in clone.clone_cms_site(pages, sites, options, attempts=attempts).crawl.log.collect()}
    assert got["http://s/a"] == "failed" and got["http://s/b/"] == "saved"


def test_queue_log_equals_a_queue(spark):
    """Every entry of a first-in-first-out queue with a cap, in order."""
    pages, sites = site_pages(spark)
    log = [("http://s/a", i, i, i == 1) for i in range(3)] + [("http://s/b/", i, i, False) for i in range(5)]
    attempts = spark.createDataFrame(log, "url string, ts long, attempt_id long, ok boolean")
    options = CMS_EXPORT.with_(seed_paths=("a", "a", "island"), max_pages=5)
    job = clone.clone_cms_site(pages, sites, options, attempts=attempts)
    got = [(r.entry, r.parent, r.url, r.outcome, r.attempts) for r in job.queue_log().orderBy("entry").collect()]
    s = "http://s/"
    assert got == [
        (1, 0, s, "saved", None), (2, 0, s + "a", "saved", 2), (3, 0, s + "a", "duplicate", None), (4, 0, s + "island", "saved", None),
        (5, 1, s + "a", "duplicate", None), (6, 1, s + "b/", "failed", 3), (7, 1, s + "c.html", "saved", None), (8, 1, s + "gone", "cap_reached", None),
        (9, 1, "http://o/x", "off_site", None),
    ]


def test_text_moves_once(spark):
    """Of the exchanges of an export only the one that attaches the text carries it."""
    pages, sites = site_pages(spark)
    job = clone.export_cms_site(pages, sites, CMS_EXPORT.with_(seed_paths=()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = job.items()._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def nodes(node):
        node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    def columns(node):
        return {node.output().apply(i).name() for i in range(node.output().size())}

    wide = sum(1 for n in nodes(plan) if "Exchange" in n.nodeName() and columns(n) & {"html", "content"})
    assert wide == 1


def test_collision_rank(spark):
    df = spark.createDataFrame([("s", "l2", 5), ("s", "l1", 5), ("t", "l1", 5), ("s", "l3", 6)], "site string, link string, post_id long")
    got = {(r.site, r.link): r.collision_rank for r in export.with_collision_rank(df).collect()}
    assert got == {("s", "l1"): 1, ("s", "l2"): 2, ("t", "l1"): 1, ("s", "l3"): 1}


def test_page_index_takes_the_lowest_id_without_reading_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    index = captures.page_index(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000)))
    assert index.agg(F.max("page_id")).first()[0] < 1000
    plan = captures.page_index(pages)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_stream_equals_batch_and_continues(spark):
    folder, out = scratch_path(spark, "pages"), scratch_path(spark, "found")
    pages = derived.pages(spark, SF)
    pages.filter("page_id < 20").coalesce(1).write.parquet(folder)
    first = stream_discover_links(spark, folder, out=out, batch_files=1).count()
    pages.filter("page_id >= 20").repartition(3).write.mode("append").parquet(folder)
    both = stream_discover_links(spark, folder, out=out, batch_files=1)
    batch = QUERIES["distinct_urls"](spark, SF)
    assert 0 < first < both.count() == batch.count()
    assert both.exceptAll(batch).isEmpty()
    assert both.count() == both.distinct().count()


def test_stream_takes_its_default_batches(spark):
    folder = scratch_path(spark, "pages")
    derived.pages(spark, SF).repartition(3).write.parquet(folder)
    found = stream_discover_links(spark, folder)
    assert found.count() == QUERIES["distinct_urls"](spark, SF).count() > 0


def test_a_stream_with_a_horizon_forgets(spark):
    """State holds what was seen lately; late pages are left out; a URL is told again after the horizon."""
    folder, out = scratch_path(spark, "captured"), scratch_path(spark, "recent")

    def arrive(day, *pages):
        rows = [(i, f"http://s/{i}", "".join(f'<a href="/{k}">x</a>' for k in links), datetime(2024, 1, day + 1 if at is None else at)) for i, links, at in pages]
        spark.createDataFrame(rows, CAPTURED).coalesce(1).write.mode("append").parquet(folder)

    for day in range(12):
        arrive(day, (day, ["home", f"new{day}", f"new{day}"], None), *([(100 + day, [f"late{day}"], 1)] if day > 4 else []))
    query = run_stream(discover_links(page_stream(spark, folder, batch_files=1, schema=CAPTURED), horizon="1 hour"), out)
    found = [r.url.removeprefix("http://s/") for r in spark.read.parquet(f"{out}/urls").collect()]
    assert sorted(u for u in found if u != "home") == sorted(f"new{d}" for d in range(12))  # no late ones
    assert 2 < found.count("home") < 12
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) < 8 and sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"]) >= 8


def test_recent_links_take_a_batch_in_many_files(spark, monkeypatch):
    """No task writes or reads a whole batch, and a batch of several files is one micro-batch; a second drain in the process works like the first."""
    sf, drain, folders = scratch_path(spark, "given"), discover.stream_discover_links, set()
    rows = [(i, f"http://s/{i}", f'<a href="/home">x</a><a href="/new{i % 5}">x</a>' + '<a href="/late">x</a>' * (i == 18)) for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    monkeypatch.setattr(discover, "stream_discover_links", lambda spark, folder, *a, **k: folders.add(folder) or drain(spark, folder, *a, **k))
    for _ in range(2):
        found = {r.url.removeprefix("http://s/"): r.times for r in QUERIES["stream_recent_links"](spark, sf).collect()}
        assert found == {"home": 2, **{f"new{b}": 1 for b in range(5)}}  # told again three batches later; the late page not at all
        files = spark.read.parquet(*folders).selectExpr("page_id % 5 as batch", "input_file_name() as file").distinct().groupBy("batch").count().collect()
        assert len(files) == 5 and min(r["count"] for r in files) > len(folders)
    assert len(folders) == 2 and PAGES.fieldNames() == [f.name for f in PAGES.fields] and discover.URLS.fieldNames() == [f.name for f in discover.URLS.fields]


def test_dates(spark):
    record = spark.createDataFrame([("s", "u", "t", "c", "g")], "site string, url string, title string, content string, slug string")
    items = export.wxr_items(export.numbered(record), "2024-02-29 23:05:06").first()
    assert items.pub_date == "Thu, 29 Feb 2024 23:05:06 +0000" and items.post_date == "2024-02-29 23:05:06"


def test_import_files_are_whole_documents(spark):
    """A standard parser reads every file: header, items in order, parts of a bounded size."""
    pages, sites = site_pages(spark)
    odd = ' "q" & <x> \r\n\t]]> é\u0001 &amp;'
    more = [(20 + k, f"http://s/k{k}.html", f"<title>T{k}{odd}</title><main>{odd}{k}</main>") for k in range(7)]
    hub = [(10, "http://s/e", "".join(f'<a href="/k{k}.html">x</a>' for k in range(7)))]
    pages = pages.unionByName(spark.createDataFrame(more + hub, pages.schema))
    sites = sites.unionByName(spark.createDataFrame([("empty", "http://empty/")], sites.schema))
    job = clone.export_cms_site(pages, sites, CMS_EXPORT.with_(seed_paths=("e",)))
    out = scratch_path(spark, "import")
    imports.write_import_files(job.import_items(), job.channel(), out, per_file=4)
    found = sorted(Path(out.removeprefix("file:")).rglob("part-*"))
    assert len(found) == 3  # of ten or eleven items
    want = {r.link: r for r in job.items().collect()}
    order = [r.url for r in job.records().orderBy("rank").collect()]
    links = []
    for k, file in enumerate(found):
        assert file.parent.name == f"part={k}" and file.parent.parent.name == "site=s"
        root = ElementTree.parse(file).getroot()
        assert root.tag == "rss" and root.get("version") == "2.0" and len(root) == 1
        channel = root[0]
        assert [channel.findtext(t) for t in ("title", "link", "language")] == ["s", "http://s/", "en-US"]
        for item in channel.findall("item"):
            link = item.findtext("link")
            links.append(link)
            assert len(item) == 19 and item.find("guid").get("isPermaLink") == "false" and item.findtext("guid") == link
            assert item.findtext(f"{{{export.NAMESPACES['content']}}}encoded") == (want[link].content_encoded or "").replace("\u0001", "")
            assert item.findtext("title") == want[link].title.replace("\u0001", "")
    assert links == order and len(links) == len(want)
    imports.write_import_files(job.import_items(), job.channel().limit(0), scratch_path(spark, "none"))


def test_sitemap_indexes_are_followed(spark):
    """Nested, cyclic, missing and bad documents; addresses keep their query, and lose their fragment."""
    index = "<?xml version='1.0'?><!-- <urlset> --><s:sitemapindex xmlns:s='urn:s'>{}</s:sitemapindex>"
    maps = lambda *to: index.format("".join(f"<s:sitemap><s:loc> {a} </s:loc></s:sitemap>" for a in to))
    page = "<urlset><url><loc>{}</loc></url><url><loc>not a url</loc></url></urlset>"
    docs = [
        ("h", 0, maps("http://h/i?n=1&amp;x", "http://h/a.xml#f", "http://h/gone.xml", "http://h/sitemap.xml"), "http://h/sitemap.xml"),
        ("h", 1, maps("http://h/sitemap.xml", "http://h/b.xml", "http://h/bad.xml", "http://h/a.xml"), "http://h/i?n=1&x"),
        ("h", 2, page.format("http://h/a"), "http://h/a.xml"),
        ("h", 9, page.format("http://h/later"), "http://h/a.xml"),
        ("h", 3, page.format("http://o/b"), " http://h/b.xml"),
        ("h", 4, "<sitemapindex><sitemap>", "http://h/bad.xml"),
        ("h", 5, page.format("http://h/unreached"), "http://h/u.xml"),
        ("h", 6, page.format("http://h/nowhere"), None),
        ("h", 7, None, "http://h/null.xml"),
    ]
    df = spark.createDataFrame(docs, "site string, doc long, xml string, address string")
    roots = spark.createDataFrame([("h", "http://h/sitemap.xml"), ("h", None), ("g", "http://g/sitemap.xml")], "site string, address string")
    tree = sitemaps.sitemap_tree(df, roots)
    assert {tuple(r) for r in tree.documents.collect()} == {
        ("h", "http://h/sitemap.xml", 0, "index"), ("h", "http://h/i?n=1&x", 1, "index"), ("h", "http://h/a.xml", 1, "urls"), ("h", "http://h/gone.xml", 1, "missing"),
        ("h", "http://h/b.xml", 2, "urls"), ("h", "http://h/bad.xml", 2, "bad"), ("g", "http://g/sitemap.xml", 0, "missing"),
    }
    assert {(r.address, r.doc, r.pos, r.url) for r in tree.urls().collect()} == {("http://h/a.xml", 2, 0, "http://h/a"), ("http://h/b.xml", 3, 0, "http://o/b")}
    assert [r.url for r in tree.urls(internal_only=True).collect()] == ["http://h/a"]
    assert sitemaps.sitemap_tree(df, roots, max_depth=1).documents.count() == 5
    assert sitemaps.sitemap_tree(df.limit(0), roots).documents.filter("outcome = 'missing'").count() == 2


def test_path_conflicts_at_any_depth(spark):
    """Against brute force, and with two rows a file where it lies deep."""
    paths = ["/".join("ab"[n >> k & 1] for k in range(1 + n % 9)) + ("/" if n % 11 == 0 else "") for n in range(400)]
    paths += ["a b", "a!", "a/", "a//b", "", "é/ü", "é", "a\x01", "\U0010ffff/x", "\U0010ffff"]
    rows = [("st"[i % 2], p, f"u{i}") for i, p in enumerate(paths)] + [("s", None, "u"), ("s", "a", "u0")]
    got = {tuple(r) for r in layout.path_conflicts(spark.createDataFrame(rows, "site string, path string, url string")).collect()}
    want = set()
    for site in "st":
        named = {}
        for s, p, u in rows:
            if s == site and p is not None:
                named.setdefault(p, set()).add(u)
        for p, urls in named.items():
            below = sum(q.startswith(p + "/") for q in named)
            if len(urls) > 1:
                want.add((site, p, "same_path", len(urls), min(urls)))
            if below:
                want.add((site, p, "file_is_folder", below, min(urls)))
    assert got == want
    empty = spark.createDataFrame([], "site string, path string, url string")
    assert layout.path_conflicts(empty).count() == 0
    deep = spark.createDataFrame([("s", "x/" * 500 + str(i), "u") for i in range(50)], "site string, path string, url string")
    plan = layout.path_conflicts(deep)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and layout.path_conflicts(deep).count() == 0  # the marks were written by ranges before


def test_posting_lists_of_assets(spark):
    numbers = [0, 1, 1, 32767, 32768, 70000, -1, 2**53 + 1, None]
    rows = [("s", "u", n) for n in numbers] + [("s", "v", None)]
    lists = layout.asset_pages(spark.createDataFrame(rows, "site string, asset_url string, page_id long"))
    assert {(r.block, r.n_pages) for r in lists.collect()} == {(0, 3), (1, 1), (2, 1), (-1, 1), (2**38, 1)}
    assert sorted(r.page_id for r in layout.pages_of(lists).collect()) == sorted(set(numbers) - {None})
    # An asset on all pages: rows of bounded width, one for each 32,768 pages.
    wide = layout.asset_pages(spark.range(100_000).selectExpr("'s' as site", "'u' as asset_url", "id as page_id"))
    assert [(r.n_pages, len(r.pages)) for r in wide.orderBy("block").collect()] == [(32768, 32768)] * 3 + [(1696, 1696)]


def test_a_job_reads_each_page_text_once(spark):
    """Links, assets, branch and the log of the queue come from one scan of the text; only saved pages are read again, to be rewritten."""
    pages, sites = site_pages(spark)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(html):
        reads.add(1)
        return html

    job = clone.clone_cms_site(pages.withColumn("html", counted("html")), sites, CMS_EXPORT.with_(seed_paths=()))
    for table in (job.crawl.log, job.assets(), job.asset_files(), job.manifest(), job.files(), job.conflicts(), job.queue_log()):
        table.collect()
    assert reads.value == pages.count()
    assert job.page_files().count() == job.saved().count()


def test_stored_references_equal_the_tables(spark):
    pages = derived.pages_site(spark, SF)
    for options in (GENERIC, CMS_EXPORT):
        found = written(page_references(pages, options.strip_slash), "references")
        links = link_rows(found.select("page_id", "src", "found.links"), internal_only=False)
        assert links.exceptAll(link_table(pages, options.strip_slash, internal_only=False)).count() == 0 < links.count()
        refs = asset_rows(found.select("page_id", "src", "found.refs"), options)
        assert refs.exceptAll(asset_table(pages, options)).count() == 0 < refs.count() == asset_table(pages, options).count()
        index = captures.lowest_page(found.select(F.col("src").alias("url"), "page_id", "branch"))
        assert index.exceptAll(captures.page_index(pages, options.strip_slash, with_branch=True)).count() == 0 < index.count()
    scan = found.select("found.refs")._jdf.queryExecution().executedPlan().toString()
    assert "refs" in scan and "links" not in scan.partition("ReadSchema")[2]
