"""HTML extraction."""

import random
import time

from factloom.llm import html

PAGE = '<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><a href="/">Site</a></header><nav><ul>{nav}</ul></nav><!-- c --><div class="ad">buy</div><div class="cookie-notice">ok?</div><article><h1>{t}</h1>{body}<aside>see also</aside><form><p>Name</p></form><div id="comments-3"><p>first!</p></div></article><div class="sidebar">more</div><footer>&copy; x</footer></body></html>'


def text(page):
    """The article of a page that is all that its host has."""
    html._deep()
    return html.article(html.Wrapper(html.written(html.fold(html.parse(page)))).read(html.parse(page)))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int")


def test_articles_are_found_whatever_repeats(spark):
    rows, want = [], {}
    for i in range(12):
        paras = [f"Para  {i}.{k} &amp; <b>bold\n{k}</b><br>" for k in range(i % 4)]
        body = "".join(f"<p>{p}" if k % 2 else f"<p>{p}</p>" for k, p in enumerate(paras)) + ("<ul><li>a<li>b</ul>" if i % 3 == 0 else "")
        rows.append((i, f"http://h{i % 2}.example.com/{i}", PAGE.format(t=f"Title {i}", nav="<li><a>n</a></li>" * (i % 5), body=body)))
        want[i] = "\n".join([f"Title {i}", *[f"Para {i}.{k} & bold {k}" for k in range(i % 4)], *(["a", "b"] if i % 3 == 0 else [])])
    rows += [(20, None, None), (21, "http://h0.example.com/", ""), (22, "bad url", "<p>only &lt;text&gt; here"), (22, "bad url", "<p>only &lt;text&gt; here"), (None, "http://z.example/", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    got = html.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    text = {r.page_id: r.text for r in got}
    assert {k: text[k] for k in want} == want
    assert text[20] == text[21] == "" and all(r.n_chars == len(r.text) for r in got)
    assert text[22] == "only <text> here" and text[None] == "deep"


def test_text_of_one_page_is_not_the_hosts(spark):
    rows = [(1, "http://a.example/1", "<h1>A</h1><p>a<blockquote>only here</blockquote><p>and here"), (2, "http://a.example/2", "<h1>B</h1><p>b"), (3, "http://a.example/3", "<h1>C</h1><p>c")]
    rows += [(10 + i, f"http://b.example/{i}", f"<b>Site</b><hr><p>{i}</p>") for i in range(3)]
    text = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert text[1] == "A\na\nonly here\nand here" and text[2] == "B\nb" and text[3] == "C\nc"
    assert [text[10 + i] for i in range(3)] == ["0", "1", "2"]


def test_elements_without_an_end_tag_cut_nothing_off():
    assert text('<article><p>a <svg class="i" viewBox="0 0 1 1"/> b<p>c <math/> d</article>') == "a b\nc d"
    for tag in ("button", "object", "canvas", "video", "audio", "select", "svg"):
        assert text(f"<article><p>a</p><{tag} class=x><p>b</p><p>c</p></article>") == "a\nb\nc", tag
        assert text(f"<article><p>a <{tag} class=x><source><i>no</i></{tag}> b</p><p>c</p></article>") == "a b\nc", tag
    assert text("<article><p>so <math display=block><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>") == "so x=2 holds"
    assert text("<article><p>a</p><svg><title>no</title><path d='M0'/><text>no</text></svg><p>b</article>") == "a\nb"


def test_joined_wrappers_give_the_same(spark):
    rows = [(i, "http://a.example/", PAGE.format(t="T", nav="", body=f"<p>{i}</p>")) for i in range(4)]
    assert {r.page_id: r.text for r in html.extract(pages(spark, rows), broadcast_bytes=0).collect()} == {i: f"T\n{i}" for i in range(4)}
    assert html.extract(pages(spark, [])).collect() == []


def test_wrappers_are_union_free_and_cover_their_pages():
    a, b = html.fold(html.parse("<ul><li>1<li>2</ul><p>x")), html.fold(html.parse("<h2>t</h2><p>x<p>y"))
    w = html.merge(a, b)
    assert [(x[0], x[1], x[2]) for x in w] == [("ul", True, False), ("h2", True, False), ("p", False, True)]
    rep = html.fold(html.parse("<dl>" + "<dt>a<dd>b" * 3 + "</dl>"))
    assert rep[0][4][0][0] == "(dt|dd)" and rep[0][4][0][2]
    one = html.fold(html.parse("<dl><dt>a<dd>c</dl>"))
    merged = html.merge(rep, one)
    assert merged[0][4][0][0] == "(dt|dd)"
    assert html.written(html.read_wrapper(html.written(merged))) == html.written(merged)
    assert [html._aligned(list(x), list(y)) for x, y in (("abcd", "abcd"), ("abc", "xbz"), ("", "a"))] == [[(0, 0), (1, 1), (2, 2), (3, 3)], [(1, 1)], []]


def odd_site(rng, n):
    """Pages whose class names say nothing, in a layout of two columns; and their articles."""
    name = lambda: "".join(rng.choice("bcdfgklmnpqrstvwxz") for _ in range(7))
    top, side, body, foot, ad = (name() for _ in range(5))
    words = lambda k: " ".join(name() for _ in range(k))
    rows, want, links = [], {}, [words(1) for _ in range(8)]
    for i in range(n):
        paras = [words(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 9))]
        title, line = words(5), words(4)
        menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in links)
        more = "".join(f'<div><a href="/x">{words(3)}</a></div>' for _ in range(6))
        rows.append((i, "http://odd.example/", f'<html><body><div class="{top}"><ul>{menu}</ul></div><div class="{ad}">{line}</div><div class="{body}"><h1>{title}</h1>{"".join(f"<p>{x}</p>" for x in paras)}</div><div class="{side}"><b>More</b>{more}</div><div class="{foot}">All rights kept by us and by nobody else</div></body></html>'))
        want[i] = "\n".join([title, *paras])
    return rows, want


def test_a_host_of_nameless_elements_is_read_through_its_wrapper(spark):
    rows, want = odd_site(random.Random(3), 40)
    more, articles = odd_site(random.Random(4), 30)
    rows += [(100 + i, "http://other.example/", h) for i, _, h in more]
    want |= {100 + i: t for i, t in articles.items()}
    df = pages(spark, rows)
    got = [{r.page_id: r.text for r in html.extract(d, names=n).collect()} for d, n in ((df, True), (df.repartition(7), True), (df.repartition(2, "page_id"), False))]
    assert got == [want] * 3


def test_without_names_the_given_articles_come_out_the_same(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    with_names, without = ({r.page_id: r.text for r in html.extract(df, names=n).collect()} for n in (True, False))
    assert sum(with_names[k] == without[k] for k in with_names) >= 0.98 * len(with_names)


def test_marks_that_go_wrong_lose_nothing():
    assert text("<article><p>one</p><title-bar>x</title-bar><p>two</p></article>") == "one\nx\ntwo"
    assert text('<p class="x>one</p><p>two</p>') == "one\ntwo"
    assert text('<p class="x>one</p><p class="y">two</p>') == "one\ntwo"
    assert text('<p title="a > b" data-x=\'<b>\'>one</p>') == "one"
    assert text("<article>a < b and <3 <!-- > --> c <!--> d</article>") == "a < b and <3 c d"
    deep = "<div>" * 200 + "<nav>no</nav>" + "<p>yes</p>" * 2 + "</div>" * 200
    assert text(deep) == "yes\nyes"


def test_pages_of_a_million_characters_take_time_in_proportion():
    for page in ("<a " * 300_000, '<a "' * 200_000, "<a '>" * 100_000, "<button>" * 60_000, "<div>" * 60_000 + "deep", "<li>" * 60_000, "<b class=x><div>" + "<i class=q>" * 30_000 + "</b>" * 30_000, "<!--" * 200_000, "<script>" * 100_000, "</div>" * 150_000, "<dt>a<dd>b" * 30_000):
        begun = time.process_time()
        text(page)
        assert time.process_time() - begun < 20, page[:20]


def five_pages(host, body_class, inner_class="", data="", form=False):
    """Five pages of a host with a menu, a share bar and an article; what the article says."""
    rng, out = random.Random(host), []
    for i in range(5):
        says = [" ".join(rng.choice(["river", "stone", "walks", "evening", "quietly", "market", "a", "the"]) for _ in range(30)) + "." for _ in range(3)]
        inner = "".join(f'<p class="{inner_class if k == 1 else ""}">{p}</p>' for k, p in enumerate(says))
        bar = '<div class="share">Share this with your friends today</div>'
        body = f'<div class="{body_class}" {data}>{bar}{inner}</div>'
        body = f'<form action="/">{body}</form>' if form else body
        out.append((f"http://{host}/{i}", f'<html><body><div class="nav"><a href="/">Home</a> <a href="/x">News</a></div>{body}<div class="foot">All rights reserved by the owner of this host</div></body></html>', "\n".join(says)))
    return out


def test_no_article_is_lost_to_a_name(spark):
    from factloom.llm.html import DROPPED_WORDS, READER_WORDS, extract

    words = sorted(DROPPED_WORDS)
    pages = [p for w in words for p in five_pages(f"part-{w}.example", f"overflow-{w}", "x") + five_pages(f"utility-{w}.example", f"md:{w} lg:block {w}-none", "y")]
    pages += [p for w in words if w not in READER_WORDS for p in five_pages(f"inner-{w}.example", "c1", f"{w}-price")]
    pages += five_pages("data.example", "c1", "c2", 'data-hidden="true" data-class="share" aria-hidden="false" data-id="nav"') + five_pages("form.example", "c1", "c2", form=True)
    pages += five_pages("layout.example", "post-share-layout", "social-science text-sm form-text")
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert [(u, got[i]) for i, (u, _, want) in enumerate(pages) if got[i] != want] == []


def test_names_still_take_away_what_the_figures_agree_on(spark):
    from factloom.llm.html import extract

    pages = []
    for i, (u, h, want) in enumerate(five_pages("noise.example", "article-body", "c")):
        noise = '<div class="cookie-banner">We use cookies, please accept them all</div><div class="user-comments"><p>' + f"Reader {i} thinks that number {i * 7} is best" + '</p></div><div hidden>secret ' + str(i) + '</div><aside>Aside ' + str(i) + "</aside>"
        pages.append((u, h.replace("</div><div class=\"foot\">", noise + "</div><div class=\"foot\">"), want))
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert [got[i] for i in range(5)] == [want for _, _, want in pages]
