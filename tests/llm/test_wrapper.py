import random
import time

from millrace.llm import wrapper
from millrace.llm.wrapper import page_text

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a></ul></nav>"
    "<header>Site</header><!-- x --><div class='ad'>Buy</div><article><h1>He&amp;ad</h1><p><b>one<br><p>two  <i>thr</i>ee</p>{slot}<p>{text}</p></article>"
    "<aside>side</aside><form><p>mail</p></form><section class='comments'><article>long comment</article></section><footer>&copy; me</footer></body></html>"
)


def test_elements():
    assert page_text(PAGE.format(slot="", text="a &lt;b&gt;\n c&nbsp;d")) == "He&ad\none\ntwo three\na <b> c d"
    assert page_text(None) == page_text("") == page_text("<p") == ""
    assert page_text("plain <b>text</b> & more") == "plain text & more"
    assert page_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert page_text("<p>a<p>b<div id=main><p>x<p>y") == "x\ny"
    assert page_text("<div class='site-header'>x</div><div class=header><h2>y</h2></div><p>z") == "z"
    assert page_text("<article><header><h1>t</h1></header><header>by me</header><p>z</article><p>w") == "t\nz"
    assert page_text("<p title='>'>a</p><p title=\"b>c</p>") == "a\nc"


def test_alignment_is_largest():
    a, b = (wrapper.parse(f"<div>{x}</div>") for x in ("<p>1</p><ul><li>2</ul><p>3</p><h2>4</h2>", "<h2>0</h2><p>1</p><p>3</p><ul><li>2<li>5</ul><h2>4</h2>"))
    pairs = [(x.tag, y.tag) for x, y in wrapper.aligned(a, b)]
    assert all(x == y for x, y in pairs)
    assert sorted(x for x, _ in pairs if x not in ("html", "#")) == ["div", "h2", "li", "p", "ul"] and len(pairs) == 9


def pages(spark, n=12):
    rows = [(i, f"http://a.example/{i}", PAGE.format(slot="<p>Read our rules.</p>", text=f"text {i}, " * 12), "h") for i in range(n)]
    rows += [(100, "http://b.example/", PAGE.format(slot="<p>Read our rules.</p>", text="alone"), "h"), (101, None, None, None), (102, "x", "<p>no host", "h"), (1, "http://a.example/1", "", "h")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_template_text_goes(spark):
    for limit in (32 << 20, 0):
        got = sorted((r.page_id, r.text) for r in wrapper.extract_text(pages(spark), max_bytes=limit).collect())
        # head and first lines are the same on all pages of the host: template; on a page alone they are not
        want = [(i, (f"text {i}, " * 12).strip()) for i in range(12)]
        assert got == sorted([*want, (1, ""), (100, "He&ad\none\ntwo three\nRead our rules.\nalone"), (101, ""), (102, "no host")])
    assert wrapper.extract_text(pages(spark).limit(0)).count() == 0


LONG = "<html><body><div><p>Short article {i} here.</p></div><div><p>" + "The same boilerplate stands on every page. " * 20 + "</p></div></body></html>"


def test_long_boilerplate_and_small_hosts_give_a_template(spark):
    rows = [(n * 100 + i, f"http://c{n}.example/{i}", LONG.format(i=i)) for n in (12, 8, 4) for i in range(n)]
    # repetitions of the first page are no evidence, and three pages are too few
    rows += [(2000 + i, f"http://d.example/{i}", LONG.format(i=0)) for i in range(12)] + [(3000 + i, f"http://e.example/{i}", LONG.format(i=i)) for i in range(3)]
    got = {r.page_id: r.text for r in wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n * 100 + i] == f"Short article {i} here." for n in (12, 8, 4) for i in range(n))
    assert all("boilerplate" in got[i] and "Short article" in got[i] for i in (*range(2000, 2012), *range(3000, 3003)))


def match_size(a, b):
    """Simple tree matching as it is defined: labels, and the best order-keeping match of the children."""
    if a.label != b.label:
        return 0
    xs, ys = wrapper._kids(a), wrapper._kids(b)
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, p in enumerate(xs, 1):
        for j, q in enumerate(ys, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + match_size(p, q))
    return 1 + best[-1][-1]


def test_alignment_is_simple_tree_matching(monkeypatch):
    rnd = random.Random(0)

    def html(depth):
        some = [lambda: "<p>x</p>", lambda: f"<ul>{html(depth - 1)}</ul>" if depth else "", lambda: f"<div>{html(depth - 1)}</div>" if depth else "t", lambda: "word"]
        return "".join(rnd.choice(some)() for _ in range(rnd.randint(0, 5)))

    for table in (4096, 3):
        monkeypatch.setattr(wrapper, "_TABLE", table)
        for _ in range(150):
            a, b = wrapper.parse(html(3)), wrapper.parse(html(3))
            pairs = wrapper.aligned(a, b)
            assert len(pairs) == match_size(a, b) and all(x.label == y.label for x, y in pairs)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_long_pages_take_time_by_their_length():
    start = time.perf_counter()
    assert page_text("<a " + "x " * 500_000) == page_text("<div " + "a='b' " * 200_000) == ""
    assert page_text("<" * 300_000) == "<" * 300_000 and len(page_text("<p>a" * 100_000)) == 199_999
    rnd = random.Random(1)
    lists = [wrapper.parse("<div>" + "".join(rnd.choice(["<p>a</p>", "<ul><li>x</ul>", "<p><b>t</b> z</p>"]) for _ in range(3000)) + "</div>") for _ in range(2)]
    assert len(wrapper.aligned(*lists)) > 4000
    assert time.perf_counter() - start < 40


def nameless(i, rnd, tag="div", comments=False):
    words = lambda n: " ".join(rnd.choice(["lumo", "tarek", "onu", "sil", "mena", "rotu", "pavi"]) for _ in range(n))
    links = "".join(f"<{tag} class=k9><a href=/{k}>{words(1)}</a></{tag}>" for k in range(rnd.randint(4, 7)))
    paragraphs = [words(rnd.randint(8, 60)) for _ in range(rnd.randint(1, 6))]
    title = f"{words(4)} {i}"
    body = f"<h1>{title}</h1>" + "".join(f"<{tag} class=q>{p}</{tag}>" for p in paragraphs)
    page = f"<html><body><{tag} class=z1>{links}</{tag}><{tag} class=z2><{tag}>{words(7)}</{tag}></{tag}><{tag} class=z3>{body}</{tag}><{tag} class=z4><{tag}>{words(9)}</{tag}></{tag}></body></html>"
    return page, "\n".join([title, *paragraphs])


def test_structure_finds_content_where_names_say_nothing(spark):
    rnd = random.Random(4)
    made = [nameless(i, rnd) for i in range(60)]
    # pages of one host; z1 is a list of links, z2 and z4 are short lines of like length, all of them different on each page
    rows = [(i, f"http://n{i % 3}.example/{i}", page) for i, (page, _) in enumerate(made)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for limit in (32 << 20, 0):
        got = {r.page_id: r.text for r in wrapper.extract_text(docs, max_bytes=limit).collect()}
        assert got == {i: text for i, (_, text) in enumerate(made)}
    assert all(page_text(page) != text for page, text in made)  # a page alone can't tell


def test_names_only_decide_what_structure_leaves_open(spark):
    rnd = random.Random(6)
    long = lambda n: " ".join(rnd.choice(["lumo", "tarek", "onu", "sil"]) for _ in range(n))
    # the content's class is on the list of sides; comments hold more text than the article
    widget = [(i, "http://w.example/", f"<div class=menu><a>{long(2)}</a></div><div class='widget main-widget'><section><p>{long(80)} {i}</p><p>{long(30)}</p></section></div>") for i in range(20)]
    talk = [(100 + i, "http://t.example/", f"<div class=post><h1>t{i}</h1><p>{long(20)}</p></div><div class=comments><div><p>{long(300)}</p></div></div>") for i in range(20)]
    got = {r.page_id: r.text for r in wrapper.extract_text(spark.createDataFrame(widget + talk, "page_id long, url string, html string")).collect()}
    assert all(str(i) in got[i] and len(got[i].split("\n")) == 2 for i in range(20))
    assert all(got[100 + i].startswith(f"t{i}\n") and len(got[100 + i].split()) == 21 for i in range(20))


def test_depth_and_class_names_lose_no_text():
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert wrapper.page_text(f"<body><article><p>one</p>{deep}<p>two</p></article>") == "one\ndeep\ntwo"
    spans = "<span>" * 250 + "<nav>menu</nav>" + "</span>" * 250
    assert wrapper.page_text(f"<body>{spans}<article><p>one</p></article>") == "one"
    article = "<article><h1>T</h1><p class='text-banner'>one</p><section class='legal'>two</section><p>x <math><mi>y</mi></math> z</p></article>"
    for around in ('<div class="layout has-sidebar">', '<div id="page" class="no-sidebar">', '<main class="with-sidebar">', '<div class="sidebar">'):
        assert wrapper.page_text(f"<body>{around}{article}</body>") == "T\none\ntwo\nx y z", around
    related = '<div class="related"><article><p>other</p></article></div>'
    assert wrapper.page_text(f"<body>{article}{related}</body>") == "T\none\ntwo\nx y z"
    assert wrapper.page_text('<body><div class="comments"><p>much longer than the text of the page</p></div><div><p>text</p></div>') == "text"
