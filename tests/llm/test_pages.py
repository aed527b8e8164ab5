"""Page differencing and dated URL lists."""

import datetime

import numpy as np
import pytest

from geoledger.llm import page_diff, url_lists


def _text(html):
    return "\n\n".join(t for t, _ in page_diff.lines_of(html))


def test_markup_becomes_blocks():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";if(a<b){}</script></head><body>
    <header>Site</header><nav><ul><li><a href=/x>menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
    <article><header><h1>Head&amp;line</h1></header><p><b>One.<br><p>Two&nbsp; three\n four &lt;x&gt;</p><form><p>ask</p></form><ul><li>a<li>b</ul>
    <div id="comments"><p>first!</p></div><aside>side</aside></article><p class=notice>cookie</p><footer>&copy; end</footer></body></html>"""
    assert _text(html) == "Head&line\n\nOne.\n\nTwo three four <x>\n\na\n\nb"


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain < text & more", "plain < text & more"), ("<p>a<p>b", "a\n\nb"), ("<div>a<span>b</span> c</div>d", "ab c\n\nd"), ("<p hidden>x</p>y", "y"),
    ("<script>never closed", ""), ("<p title='a>b'>c</p>", "c"), ("<p title='open>c</p><p>d</p>", "c\n\nd"), ("</div></p>x", "x"), ("<main><p>m</p></main><p>o</p>", "m"),
    ("<p>one <!-- <p>two", "one"), ("<div style='display: none'>x</div><p>y", "y"), ("<section class='related-posts'>x</section><p>y", "y")])
def test_odd_markup(html, text):
    assert _text(html) == text


def _longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    random = np.random.default_rng(4)
    for _ in range(200):
        a, b = ([str(x) for x in random.integers(0, 6, int(random.integers(0, 15)))] for _ in range(2))
        found = sorted(page_diff.shared_lines(a, b))
        assert len(found) == _longest(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)


PAGES = "page_id long, url string, html string"


def test_lines_of_the_nearest_page_go_unless_marked_as_article(spark):
    body = lambda k: f"<div>Our site</div><div>Story {k} begins here and goes on</div><p>Body {k} with enough words to count</p><div>Write to us</div>"
    marked = lambda k: f"<div>Our site</div><article><p>Story {k} in an article element</p><p>Shared passage</p></article>"
    rows = [(1, "http://a.example/x/1", body(1)), (2, "https://A.example/x/2?q=1", body(2)), (3, "http://b.example/x/3", marked(3)),
            (4, "http://b.example/x/4", marked(4)), (5, "http://c.example/only", body(5)), (6, "http://d.example/1", body(6)), (7, "http://d.example/2", body(6)),
            (8, None, None), (9, "relative/path", body(9)), (10, "", ""), (10, "", ""), (11, None, body(11))]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "url AS host", "page_id AS text", "html AS lines", "url AS path").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = page_diff.extract(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    text = {r.page_id: r.text for r in got}
    story = lambda k: f"Story {k} begins here and goes on\n\nBody {k} with enough words to count"
    whole = lambda k: f"Our site\n\n{story(k)}\n\nWrite to us"
    assert text[1] == story(1) and text[2] == story(2)
    assert text[3] == "Story 3 in an article element\n\nShared passage"
    assert all(text[k] == whole(k if k != 7 else 6) for k in (5, 6, 7, 9, 11))  # no neighbour, copies only, no host
    assert text[8] == text[10] == "" and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert page_diff.extract(df.limit(0)).count() == 0


EVENTS = "domain string, list string, action string, at timestamp"


def _day(n, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=n)


def _plain_verdict(url, at, events):
    match = __import__("re").match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    host = match.group(1).lower().rstrip(".") if match else ""
    if not host or at is None or len(host) > 253:
        return (False, None, 0)
    active = {}
    for domain, name, action, when in sorted((e for e in events if None not in (e[0], e[2], e[3]) and e[2] in ("add", "remove")), key=lambda e: (e[3], e[2] == "add")):
        if when <= at:
            active[domain.lower(), name or ""] = action == "add"
    on = [k for k, v in active.items() if v and (host == k[0] or host.endswith("." + k[0]))]
    return (bool(on), max((d for d, _ in on), key=lambda d: (len(d), d), default=None), len({x for _, x in on}))


def test_captures_are_judged_by_the_entries_of_their_time(spark):
    events = [("bad.example", "spam", "add", _day(3)), ("bad.example", "spam", "remove", _day(40)), ("bad.example", "spam", "add", _day(90, 5)),
              ("sub.bad.example", "malware", "add", _day(10)), ("sub.bad.example", "malware", "remove", _day(10)), ("BAD.example", "malware", "add", _day(20)),
              ("bad.example", "malware", "remove", _day(20, 1)), ("bad.example", "malware", "add", _day(20, 2)), (None, "x", "add", _day(1)), ("bad.example", "x", None, _day(1)),
              ("bad.example", "x", "noise", _day(1)), ("bad.example", "x", "add", None), ("other.example", None, "add", _day(0)), ("bad.example", "spam", "add", _day(3)), ("example", "tld", "add", _day(300))]
    urls = ["http://bad.example/", "https://user@www.SUB.bad.example.:8080/a?b", "http://notbad.example/x", "http://other.example", None, "relative", "http://", "http://" + "a." * 140 + "bad.example"]
    hours = [_day(d, h) for d in (0, 3, 10, 20, 39, 40, 90, 200, 366) for h in (0, 1, 2, 5)] + [None]
    rows = [(k, u, t) for k, (u, t) in enumerate((u, t) for u in urls for t in hours)]
    rows += rows[:5]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").selectExpr("*", "url AS host", "page_id AS matched", "url AS month")
    dated = spark.createDataFrame(events, EVENTS)
    got = url_lists.filter_urls(captures, dated)
    assert got.columns == ["page_id", "url", "fetched_at", "host", "month", "blocked", "matched", "n_lists"]
    assert sorted((r.page_id, r.blocked, r.matched, r.n_lists) for r in got.collect()) == sorted(
        ((k, *_plain_verdict(u, t, events)) for k, u, t in rows), key=lambda x: x[0])
    assert url_lists.filter_urls(captures.limit(0), dated).count() == 0
    assert url_lists.filter_urls(captures, dated.limit(0)).where("blocked").count() == 0
