import json
import random

from gridloom.llm.html_extract import Alignment, _postorder, extract, extract_pages, induce, parse, read


def page(n, body, host_ad="Buy now"):
    return (
        f'<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu{n}</a></ul></nav>'
        f'<div class="ad">{host_ad} {n}</div>{body}<footer>&copy; site {n}</footer></body></html>'
    )


def test_article_without_furniture():
    html = page(1, '<article><h1>Title &amp; more</h1><p>One  two\n three<p><b>Four<br>five</b></p><aside>no</aside><div class="comments"><p>me first</p></div><form><p>mail?</p></form><p>Six &#8212; &lt;b&gt;</article>')
    assert extract(html, None) == "Title & more\nOne two three\nFour five\nSix — <b>"


def test_broken_markup_loses_no_text():
    assert extract("<article><p>a <b>b <i>c</p><p>d</b> e", None) == "a b c\nd e"
    assert extract("<article><p>a < b and 1<2 &am", None) == "a < b and 1<2 &am"
    assert extract('<article><p title="x > y">in</p><p>cut <a href="', None) == "in\ncut"
    assert extract("plain text only", None) == "plain text only"
    assert extract("", None) == "" and extract("<script>x", None) == ""
    deep = "<article>" + "<div>" * 3000 + "low" + "</div>" * 3000
    assert extract(deep, None) == "low"


STORY = "Body of story number {n} goes on and on for a while and then says what {n} has done, " * 3 + "at last"


def site(n, extra="", inside=""):
    return (
        f'<html><body><div class="top">Daily Site</div><div><p>Welcome to the site</p></div><div class="story"><h2>News {n}</h2>{inside}<p>{STORY.format(n=n)}</p><p>More {n}</p></div>'
        f"{extra}<div>Contact us</div></body></html>"
    )


def test_wrapper_finds_the_varying_slot():
    pages = [site(n) for n in range(4)]
    wrapper = json.loads(induce(pages))
    text = f"News 77\n{STORY.format(n=77)}\nMore 77"
    assert read(site(77), wrapper) == (text, "wrapper")
    assert induce(pages[:2]) is None and induce([pages[0]] * 5) is None
    copies = [site(5, f"<p>{n}</p>", f"<p>{'the same long text ' * 20}</p>") for n in range(5)]
    assert induce(copies) is None  # nothing to learn from copies
    again = site(78, "", f"<p>{'a text that others repeat ' * 200}</p>")
    assert "others repeat" in extract(again, json.loads(induce([site(n, "", f"<p>{'a text that others repeat ' * 9}</p>") for n in range(4)])))


def test_long_and_many_constants_are_template():
    notice = "<p>" + "All of this notice is on every page of this site. " * 20 + "</p>"
    many = "".join(f"<p>Constant block {k}</p>" for k in range(60))
    deep = "<div>" * 40 + "<p>Deep constant</p>" + "</div>" * 40
    for inside in (notice, many, deep):
        wrapper = json.loads(induce([site(n, inside=inside) for n in range(4)]))
        assert extract(site(9, inside=inside), wrapper) == f"News 9\n{STORY.format(n=9)}\nMore 9"


def test_one_page_of_another_layout_does_not_matter():
    pages = [site(n) for n in range(4)] + ["<html><body><table><tr><td>Something else altogether</td></tr></table></body></html>"]
    wrapper = json.loads(induce(pages))
    assert read(site(8), wrapper)[1] == "wrapper"
    assert read(pages[-1], wrapper) == ("Something else altogether", "page")


def test_names_count_as_a_whole():
    body = "<p>" + "The article itself, which is by far the longest text here. " * 5 + "</p>"
    assert extract(f'<body><div class="nav-bar">Menu</div><div class="content has-sidebar">{body}</div><div class="cookie-notice">Yes?</div></body>', None) == extract(f"<body><div>{body}</div></body>", None) != ""
    kept = '<article><p data-id="search">one two</p><p class="market-share">three</p><p class="share-links">no</p></article>'
    assert extract(kept, None) == "one two\nthree"
    assert extract(f'<body><div class="sidebar">{body}{body}</div><p>x</p></body>', None).count("The article") == 10  # holds most of the text
    assert extract('<body><div class="ad">Buy now, buy now, buy now</div><p>Short</p></body>', None) == "Short"
    teasers = "".join(f"<article><h3>Teaser {k}</h3></article>" for k in range(3))
    assert extract(f"<body><div>{teasers}</div><div id=story>{body}{body}</div></body>", None).count("The article itself") == 10
    assert "Teaser" not in extract(f"<body><div>{teasers}</div><div id=story>{body}{body}</div></body>", None)
    nested = f'<article>{body}<article class="reader"><p>First!</p></article></article>'
    assert "First" not in extract(nested, None) and extract(nested, None)
    assert extract(f"<body><header>Site</header>{body}</body>", None).startswith("The article") and extract(f"<article><header><h1>Head</h1></header>{body}</article>", None).startswith("Head")


def plain_weight(x, y):
    """Simple tree matching by its definition."""
    if x.label() != y.label():
        return 0.0
    xs, ys = x.elements(), y.elements()
    best = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, u in enumerate(xs):
        for j, v in enumerate(ys):
            w = plain_weight(u, v)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0.0)
    return 1.0 + 0.5 * (x.own_text() == y.own_text()) + best[-1][-1]


def test_tree_matching_is_largest_and_keeps_order():
    rng = random.Random(6)

    def tree(depth):
        return "".join(f"<{t}>{rng.choice('ab')}{tree(depth - 1) if depth and t == 'div' else ''}</{t}>" for t in (rng.choice(["div", "div", "span", "b"]) for _ in range(rng.randrange(0, 5))))

    for _ in range(60):
        a, b, aligned = parse(tree(3)), parse(tree(3)), Alignment()
        aligned.add(a)
        aligned.add(b)
        pairs = aligned.match(a, b)
        assert sum(1.0 + 0.5 * (x.own_text() == y.own_text()) for x, y in pairs) == plain_weight(a, b)
        place = [{id(x): k for k, x in enumerate(reversed(_postorder(t)))} for t in (a, b)]
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs}) and all(x.label() == y.label() for x, y in pairs)
        order = sorted((place[0][id(x)], place[1][id(y)]) for x, y in pairs)
        assert [q for _, q in order] == sorted(q for _, q in order)
    wide = [parse("<ul>" + "".join(f"<li>{k}</li>" for k in range(lo, lo + 3000)) + "</ul>") for lo in (0, 500)]
    aligned = Alignment()
    for t in wide:
        aligned.add(t)
    assert sum(x.own_text() == y.own_text() for x, y in aligned.match(*wide)) >= 2500
    deep = [parse("<div>" * 5000 + str(k) + "</div>" * 5000) for k in (1, 2)]
    for t in deep:
        aligned.add(t)
    assert len(aligned.match(*deep)) == 5001


def test_pages(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", page(i, f"<article><p>Story {i}</p></article>")) for i in range(12)]
    rows += [(20, None, None), (21, "no host", ""), (None, "https://h0.example/x", page(3, "<main><p>m</p></main>")), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as wrapper", "3 as text", "4 as id")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_pages(df).collect()), key=repr)
    want = [(i, f"Story {i}", len(f"Story {i}")) for i in range(12)] + [(20, "", 0), (21, "", 0), (None, "m", 1), (1, "Story 1", 7)]
    assert got == sorted(want, key=repr)
    assert extract_pages(df.limit(0)).count() == 0
