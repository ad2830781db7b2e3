import pytest

from marlstone.llm.warc import audit, fixity_drill, merkle_nodes, ranges, write_warc
from marlstone.llm.wrappers import Judged, aligned, expression, general, infer_wrappers, main_text, parsed

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="x">
<header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="ad banner">Buy!</div>
<article><header><h1>Title {0}</h1></header><p>First&nbsp;&amp; <b>bo</b>ld {0}.<br>Next<p class="lead">Mid&#233; {0}</p>{1}<aside>Side</aside><form>Mail <input></form>
<section class="comments"><p>Comment {0}</p></section></article><div id="sidebar1">More {0}</div><!-- <p>no</p> --><footer>&copy; Us</footer></body></html>"""


def page(k):
    return PAGE.format(k, "".join(f"<h2>H{j}</h2><p>P{j} {k}</p>" for j in range(k % 4)))


def want(k):
    return f"Title {k} First & bold {k}. Next Midé {k}" + "".join(f" H{j} P{j} {k}" for j in range(k % 4))


ROWS = [(k, f"http://h{k % 2}.example/{k}", page(k), "x") for k in range(12)] + [
    (20, None, None, None), (21, "odd", "", "x"), (22, "http://plain.example/", "<div><p>Long text here.</p><p>And &lt; more", "x"), (23, "http://h0.example/z", page(5)[:420], "x"),
    (24, "http://h1.example/z", "<p" * 50 + "<a \"", "x"), (3, "http://h1.example/3", page(3), "x"), (None, "u", "<p>n</p>", None), (30, "http://long.example", "<article>" + "<p>w w</p>" * 20000, "x"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, text string").repartition(3)


def test_main_text(spark, pages):
    got = [(r.page_id, r.text, r.n_chars) for r in main_text(pages).collect()]
    assert len(got) == len(ROWS) and all(n == len(t) for _, t, n in got)
    by = {i: t for i, t, _ in got}
    for k in range(12):
        assert by[k] == want(k)
    assert by[20] == by[21] == "" and by[22] == "Long text here. And < more" and by[30] == " ".join(["w"] * 40000)
    assert by[23].startswith("Title 5 First") and by[None] == "n"
    assert main_text(pages.where("false")).count() == 0


def test_wrapper_covers_all_pages(spark, pages):
    whole = general(parsed(page(0)), 0)
    for k in range(1, 8):
        whole = aligned(whole, general(parsed(page(k)), k))
    text = expression(whole)
    assert "((<h2>#PCDATA</>)? (<p>#PCDATA</>)?)" in text and '"Home"' in text and "One" not in text
    assert Judged(whole).text(parsed(page(6))) == want(6) and Judged([]).text(parsed(page(6))) == ""
    hosts = {r.host: r.pages for r in infer_wrappers(pages).collect()}
    assert hosts["h0.example"] == 7 and hosts[""] == 3


def plain(k, body):
    menu = "".join(f"<li><a href=/{j}>Topic {j} {k}</a></li>" for j in range(5))
    return f"<html><body><div><ul>{menu}</ul></div><div id=c>{body}</div><div class=box><p>Subscribe to our letter, it is free and always will be, for all of our dear readers of this site, " + "and so on " * 20 + f"</p></div><div>Up {k}</div></body></html>"


def labelled_pages():
    """Pages with the text that a person would take from them: hosts without article elements, misleading classes, a notice that never changes."""
    out = []
    for k in range(20):
        body = f"<h1>Head {k}</h1>" + "".join(f"<p>Story {k} part {j} tells how things went on that day in town.</p>" for j in range(2 + k % 3))
        out.append(("http://rootless.example/", plain(k, body), f"Head {k} " + " ".join(f"Story {k} part {j} tells how things went on that day in town." for j in range(2 + k % 3))))
        out.append(("http://classes.example/", f"<article><h1>Shares {k}</h1><p class=share-price>Price {k} rose.</p><p class=search-results-study>Study {k} shows.</p><div class=share>Share {k}</div><p>All the best of tips.</p></article>", f"Shares {k} Price {k} rose. Study {k} shows."))
        out.append(("http://body.example/", f"<div class='widget page'><h2>Odd {k}</h2><p>The main text {k} is in an element with the class of a widget.</p></div><div class=widget>Vote {k}</div>", f"Odd {k} The main text {k} is in an element with the class of a widget."))
    return out


def test_wrappers_decide(spark):
    rows = labelled_pages()
    table = spark.createDataFrame([(i, u + str(i), h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = [{r.page_id: r.text for r in main_text(table.repartition(n)).collect()} for n in (1, 7)]
    assert got[0] == got[1] == {i: t for i, (_, _, t) in enumerate(rows)}
    # A page by itself, without what the others of its host show, is read differently.
    alone = [Judged(general(parsed(h), 1)).text(parsed(h)) for _, h, _ in rows]
    assert sum(a != t for a, (_, _, t) in zip(alone, rows, strict=True)) >= len(rows) // 3


def test_deep_nesting(spark):
    deep = "<div>" * 10_000 + "<p>deep</p><nav>menu</nav><div>text" + "</div>" * 10_000
    rows = [(1, "http://d/1", deep), (2, "http://d/2", "<b>" * 3000 + "x"), (3, "http://d/3", "<article>" + "<ul><li>" * 3000 + "y"), (4, "http://e/", "<p>a<h2>b" * 4000), (5, "http://e/", "<i>k</i><p>z</p><h2>q" * 3000 + "<div>" * 5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep text" and got[2] == "x" and got[3] == "y" and got[4].startswith("a b a b") and len(got) == 5


def test_warc(spark, pages):
    files = write_warc(pages, file_pages=4)
    rows, ends = {r.file: bytes(r.content) for r in files.collect()}, {r.file: list(r.ends) for r in files.collect()}
    assert sum(map(len, ends.values())) == len(ROWS) and min(rows) < 0 and all(ends[f][-1] == len(c) for f, c in rows.items())
    assert page(7).encode() in rows[1] and rows[1].startswith(b"WARC/1.1\r\n")
    ours = merkle_nodes(files)
    assert audit(ours, ours).count() == 0

    def other(change):
        return merkle_nodes(spark.createDataFrame(change, "file long, content binary, ends array<long>"))

    spans = {f: list(ranges(c, ends[f])) for f, c in rows.items()}
    first = spans[1][0][1]
    changed = bytearray(rows[2])
    changed[spans[2][1][0] + 300] ^= 4
    theirs = other([(f, bytes(changed), ends[f]) if f == 2 else (f, c[first:], [e - first for e in ends[f][1:]]) if f == 1 else (f, c, ends[f]) for f, c in rows.items() if f != 0] + [(99, rows[0], ends[0])])
    got = sorted((r.file, r.idx, r.damage) for r in audit(ours, theirs).collect())
    assert (2, 1, "changed") in got and [g for g in got if g[0] == 2] == [(2, 1, "changed")]
    assert {g[2] for g in got if g[0] == 0} == {"missing"} and {g[2] for g in got if g[0] == 99} == {"extra"}
    assert (1, 3, "missing") in got
    assert fixity_drill(pages.where("false")).count() == 0
    drilled = fixity_drill(pages, every=5, which=2).collect()
    assert sorted(r.page_id for r in drilled if r.damage == "changed") == [2, 7, 22] and len(drilled) == len(ROWS)


def test_many_records(spark):
    rows = spark.range(700).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "repeat('x', cast(id % 9 AS int)) AS html")
    drilled = fixity_drill(rows, every=50, which=7)
    assert {r.page_id for r in drilled.where("damage <> 'none'").collect()} == {k for k in range(700) if k % 50 == 7}




def test_odd_urls_lose_no_record(spark):
    urls = ["http://a/\r\n\r\nWARC/1.1\r\n", "http://a/\r\nContent-Length: 3\r\n", "http://a/\0\n", "http://a/b c", None, ""]
    rows = [(k, urls[k % len(urls)], "<p>x</p>\r\n\r\nWARC/1.1\r\n" * (k % 3)) for k in range(30)]
    drilled = fixity_drill(spark.createDataFrame(rows, "page_id long, url string, html string"), every=10, which=7).collect()
    assert sorted(r.page_id for r in drilled) == list(range(30)) and {r.page_id for r in drilled if r.damage != "none"} == {7, 17, 27}
