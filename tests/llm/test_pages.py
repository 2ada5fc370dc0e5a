"""The operators on pages: extraction, URL filters, WARC."""

import datetime
import hashlib
import re

import pytest

from kilngraph.llm import html_extract, url_filter, warc

PAGES = "page_id long, url string, html string"


def extracted(spark, *html, url="http://a.example/x"):
    out = html_extract.extract_text(spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], PAGES)).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["page_id"])]


def test_op8_articles(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><ul><li>menu</li></ul></nav>
    <div class="cookie-notice">we use</div><article><header><h1>Head &amp;  line</h1></header><p>One
      <b>bold</b>&nbsp;&#8212; text<p>Two<br>lines</p><aside>side</aside><script>var x="<p>no</p>"</script><form>f<input></form>
      <ul><li>a<li>b</ul><div class="ad">buy</div><section id="comments"><p>reader</p></section></article><footer>&copy; me</footer></body></html>"""
    assert extracted(spark, page) == ["Head & line\nOne bold — text\nTwo lines\na\nb"]


def test_op8_names_never_empty_an_article(spark):
    got = extracted(spark, '<div class="widget"><article><p>a</p></article></div>', '<article class="post has-comments share"><p>b</p></article>',
                    '<article><p>costs <span class="share-price">12</span></p><section class="related-work"><p>work</p></section><label>l</label><div class="related-posts">x</div><div class="share-buttons">y</div><div id="comments">z</div><div class="ad-slot">w</div></article>',
                    '<article><p>m</p><article class="comment"><p>c</p></article></article><div class="related-posts"><article>other</article></div>', f"<article>{'<p>long ' * 20000}</article>")
    assert got[:4] == ["a", "b", "costs 12\nwork\nl", "m"] and got[4] == "\n".join(["long"] * 20000)


def test_op8_broken_and_empty(spark):
    got = extracted(spark, None, "", "plain text only, not repeated", "<article><p>open <b>never closed", "<!-- only --><script>x", "<p>a < b & c</p>")
    assert got[0] == got[1] == got[4] == "" and got[3] == "open never closed" and got[2] == "plain text only, not repeated" and got[5] == "a < b & c"


def test_op8_repeats_across_pages_of_a_host(spark):
    plate = "Welcome to our wonderful site, where every page begins with exactly this line of text and nothing else at all."
    own = [f"This is body number {i}, whose text is told only here: {'abcdefgh'[i] * 40}." for i in range(3)]
    got = extracted(spark, *[f"<body><div>{plate}</div><p>{o}</p></body>" for o in own])
    assert got == own


def test_op8_pages_that_are_stored_twice(spark):
    plate = "Welcome to our wonderful site, where every page begins with exactly this line of text and nothing else at all."
    own = [f"This is body number {i}, whose text is told only here: {'abcdefgh'[i] * 40}." for i in range(3)]
    pages = [f"<body><div>{plate}</div><p>{o}</p></body>" for o in own]
    assert extracted(spark, *pages, pages[0], pages[0]) == [*own, own[0], own[0]]
    assert extracted(spark, f"<body><p>{own[1]}</p></body>", f"<body> <p>{own[1]} </p></body>") == [own[1], own[1]]


def test_op8_every_page_of_the_table(spark, sf):
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>(?=<p>)", article)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def day(text):
    return datetime.date.fromisoformat(text)


def test_op9_temporal_join(spark):
    events = [("l", "domain", "bad.com", "add", day("2024-02-01")), ("l", "domain", "bad.com", "remove", day("2024-03-01")), ("l", "domain", "bad.com", "add", day("2024-05-01")),
              ("l", "domain", "bad.com", "add", day("2024-06-01")), ("k", "prefix", "ok.com/a/", "add", day("2024-01-01")), ("k", None, "x", "add", None),
              ("k", "domain", "sub.bad.com", "remove", day("2024-01-01"))]
    urls = [(1, "http://bad.com/x", day("2024-01-31")), (2, "http://bad.com/x", day("2024-02-01")), (3, "https://www.BAD.com:80/", day("2024-02-29")), (4, "http://bad.com", day("2024-03-01")),
            (5, "http://bad.com", day("2030-01-01")), (6, "http://ok.com/a/b?c", day("2024-01-01")), (7, "http://ok.com/ab", day("2024-01-01")), (8, None, day("2024-01-01")), (9, "nonsense", None),
            (None, "http://notbad.com/", day("2024-02-01")), (2, "http://bad.com/x", day("2024-02-01"))]
    captures = spark.createDataFrame(urls, "page_id long, url string, fetched date")
    out = url_filter.filter_urls(captures, spark.createDataFrame(events, "list string, kind string, value string, action string, at date")).collect()
    assert sorted((r["page_id"] or 0, r["blocked"], r["n_entries"]) for r in out) == [
        (0, False, 0), (1, False, 0), (2, True, 1), (2, True, 1), (3, True, 1), (4, False, 0), (5, True, 1), (6, True, 1), (7, False, 0), (8, False, 0), (9, False, 0)]
    assert url_filter.filter_urls(captures, spark.createDataFrame([], "list string, kind string, value string, action string, at date")).where("blocked").count() == 0


def test_op9_far_dates_and_no_captures(spark):
    events = spark.createDataFrame([("l", "domain", "bad.com", "add", day("2024-02-01")), ("l", "domain", "late.com", "add", day("2105-01-01"))], "list string, kind string, value string, action string, at date")
    kinds = "page_id long, url string, fetched date, list string, month int"
    rows = [(1, "http://bad.com", day("2101-05-05"), "own", 1), (2, "http://late.com/" + "x/" * 500, day("2105-01-01"), "own", 1), (3, "http://late.com", day("2104-12-31"), "own", 1), (4, "http://bad.com", None, "own", 1)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, kinds), events).collect()
    assert sorted((r["page_id"], r["blocked"]) for r in out) == [(1, True), (2, True), (3, False), (4, False)]
    assert url_filter.filter_urls(spark.createDataFrame([], kinds), events).count() == 0
    assert not url_filter.filter_urls(spark.createDataFrame([(1, "http://bad.com", None, "", 1)], kinds), events).first()["blocked"]


def test_op9_and_op10_sql(spark, sf):
    import duckdb

    from kilngraph.llm import queries

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    for name in ("op9_url_filter", "op10_warc"):
        sql = queries.oracle_sql()[name]
        df = queries.queries()[name](spark, sf)
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        order = lambda row: tuple((v is not None, v) for v in row)
        assert sorted(map(tuple, df.select(rel.columns).collect()), key=order) == sorted(rel.fetchall(), key=order)


def test_op9_against_every_entry(spark, sf):
    """Every capture against every interval."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    captures, events = url_filter.dated_captures(pages), url_filter.sample_lists(pages)
    intervals = url_filter.intervals(events).collect()
    got = {r["page_id"]: r for r in url_filter.filter_urls(captures, events).collect()}
    for c in captures.collect():
        host, _, path = re.match(r"https?://([^/?#]*)(/?)([^?#]*)", c["url"]).groups()
        n = 0
        for e in intervals:
            fits = host == e["value"] or host.endswith("." + e["value"]) if e["kind"] == "domain" else f"{host}/{path}".startswith(e["value"])
            n += fits and e["since"] <= c["fetched"] and (e["until"] is None or c["fetched"] < e["until"])
        assert got[c["page_id"]]["n_entries"] == n


def test_op10_round_trip(spark):
    big, small = "x" * 100_000 + "é", "y" * 999
    rows = [(1, "http://a", big), (2, "http://é \n", big), (3, None, small), (4, "", small), (5, "u", None), (None, "u", big), (6, "u", "z" * 1000), (7, "u", "z" * 1000)]
    out = sorted((tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()), key=lambda r: r[0] or 0)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    n = lambda t: len((t or "").encode())
    wanted = {None: ("revisit", 2), 1: ("revisit", 2), 2: ("response", None), 6: ("revisit", 7)}
    assert out == sorted(((i, n(t), sha(t), *wanted.get(i, ("response", None))) for i, _, t in rows), key=lambda r: r[0] or 0)


def test_op10_damage_is_found(spark):
    archives = warc.write_archives(spark.createDataFrame([(1, "u", "a" * 70_000)], PAGES)).collect()[0][0]
    records = list(warc.parse_records(archives))
    assert [f["warc-type"] for f, _ in records] == ["response", "continuation", "continuation"]
    lost = b"".join(warc.record({k: v for k, v in f.items() if k != "content-length"}, b) for f, b in records[:-1])
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(spark.createDataFrame([(lost,)], "archive binary")).collect()


@pytest.mark.parametrize("run", [html_extract.extract_text, warc.archive_pages])
def test_empty_and_clashing(spark, run):
    assert run(spark.createDataFrame([], PAGES)).count() == 0
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "own"), (1, "u", "<p>x</p>", "own"), (None, None, None, None)], PAGES + ", text string")
    for c in ("row", "host", "digest", "first", "opened", "doc_id", "n"):
        df = df.withColumn(c, df["text"])
    assert run(df).count() == 3


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<html><head><title>t</title><body><article><p>hello world</p></article></body></html>", "hello world"), ("<head><title>t</title><meta charset=x><p>first</p><p>second</p>", "first\nsecond"),
        ("<body><nav><a>menu</a><main><p>the text</p></main>", "the text"), ("<header><nav>x<main><article>own</article></main><footer>f</footer>", "own"),
        ("<div hidden><main>not this</main></div><article>this</article>", "this"), ("<aside><article>teaser</article></aside><main>text</main>", "text"),
    ],
)
def test_op8_end_tags_that_are_left_out(spark, page, wanted):
    out = html_extract.extract_text(spark.createDataFrame([(1, "https://h/x", page)], "page_id long, url string, html string")).first()
    assert (out["text"], out["n_chars"]) == (wanted, len(wanted))


def test_op10_writings_read_together(spark):
    """Two writings of long pages, dealt over more partitions than files, and rows of one page_id."""
    rows = [(k, f"https://h/{k}", "".join(chr(97 + (k * i) % 26) for i in range(120_000 + k))) for k in range(1, 9)] + [(3, "https://h/other", "y" * 90_000), (3, "https://h/other", "y" * 90_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(40)
    both = warc.write_archives(pages).unionByName(warc.write_archives(pages))
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(both).collect())
    assert got == sorted((i, len(t), hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows for _ in range(2))
