import random
from html import escape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lumenary.llm import page_wrappers as W


def page(title, paragraphs, items=("x", "y"), extra="", foot="f"):
    links = "".join(f'<li><a href="/{i}">{i}</a></li>' for i in items)
    return f'<!DOCTYPE html><html><head><title>T {title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav><!-- a <p>b --><div class="ad">buy {title}</div><article><h1>{title}</h1>{"".join(f"<p>{p}" for p in paragraphs)}{extra}</article><footer>{foot} {title}</footer></body></html>'


def read(pages):
    """Each page by the wrapper of them all."""
    wrapper = W.compact(W.infer(pages))
    return [W.extract(h, wrapper) for h in pages]


def test_wrapper_as_expression():
    pages = [page("A", ["one", "two"]), page("B", ["three"], extra="<blockquote>q</blockquote>"), page("C", ["1", "2", "3"])]
    want = "<> <html> <body> <div.ad> # </> <article> <h1> # </> (<p> # </>)+ (<blockquote> 'q' </>)? </> </> </> </>"
    assert str(W.infer(pages)) == want == str(W.infer(pages[::-1])) == str(W.infer([pages[1], *pages]))


def test_constants_are_no_slots():
    w = str(W.infer([page("A", ["same"]), page("B", ["same"])]))
    assert "'same'" in w and "'A'" not in w and "'buy A'" not in w


@pytest.mark.parametrize("size", [1, 2, 5, 9, 14])
def test_groups_of_any_length_fold(size):
    """Groups of more siblings than any fixed bound, repeated; and lists in no order."""
    names = ["h2", "p", "ul", "pre", "table", "dl", "blockquote", "h3", "h4", "h5", "h6", "address", "center", "section"][:size]
    group = "".join(f"<{n}>x</{n}>" for n in names)
    root = W.infer(["<main>" + group * 5 + "</main>"])
    assert str(root) == "<> <main> (" + " ".join(f"<{n}> 'x' </>" for n in names) + ")+ </> </>"
    rng = random.Random(size)
    loose = ["<main>" + "".join(f"<{n}>{k}</{n}>" for k, n in enumerate(rng.choices(["p", "h2", "ul", "pre", "h3"], k=300))) + "</main>" for _ in range(3)]
    assert read(loose) == ["\n\n".join(map(str, range(300)))] * 3
    assert len(str(W.infer(loose))) < 200


def test_extract():
    html = page("Häd &amp; <b>x</b>", ["one  \n two<br>three", "&lt;tag&gt; &eacute;&nbsp;end</p>"], extra='<div class="comments"><p>nice</p></div><form><p>mail</p></form><aside>s</aside>')
    want = "Häd & x\n\none two three\n\n<tag> é end"
    assert W.extract(html) == want == read([html, page("B", ["q"])])[0]


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<p>a <b>b</p>c", "a b\n\nc"), ("a < b & c", "a < b & c"), ("<article><p>cut o", "cut o"),
    ("<ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>", "1\n\n2\n\n3 4\n\n5"), ("<p>x</p><!-- never closed <p>y", "x"), ("<script>if (a < b) </script><p>z", "z"),
    ("<nav>n<p>m</nav>t", "t"), ("<div hidden>h</div><div style='display: none'>i</div><p a='>'>v</p>", "v"), ("<header>h</header><main><header><h1>k</h1></header>t</main>", "k\n\nt"),
    ('<div id="cookieBanner">c</div><div role="navigation">n</div><section class="reader-comments">r</section><p>ok but longer than those', "ok but longer than those"),
    ("<div>" * 3000 + "deep", "deep"), ("<div>" * 150 + "<p>a<p>b" + "<div class='sidebar'>s</div>", "a\n\nb\n\ns"),
    # names that contain a part's word, parts that hold all, forms around a page
    ('<div class="content with-sidebar"><p>The article.</p></div>', "The article."), ('<div id="social-history"><p>x</p></div>', "x"), ('<div class="no-comments"><p>x</p></div><p>y', "x\n\ny"),
    ('<div class="article-header"><h1>Head</h1></div><p>text', "Head\n\ntext"), ('<section class="related-work"><p>a</p></section><p>b', "a\n\nb"), ('<p class="share-price">9</p><p>b', "9\n\nb"),
    ("<form id=f><div><h1>t</h1><p>all of it</p></div></form>", "t\n\nall of it"), ('<div class="ad">only this</div>', "only this"),
    ('<div class="site has-sidebar"><article><p>a</p></article><div class="sidebar">s</div></div>', "a"), ("<main><h1>t</h1><p>lead</p><article><p>a text</p></article></main>", "t\n\nlead\n\na text"),
])
def test_odd_pages(html, want):
    assert W.extract(html) == want


def build(rng, n, with_article=False):
    """Pages of a host without article or main, and the text that each should give."""
    prose = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta & eta", "theta"]) + str(rng.randint(0, 99)) for _ in range(k))
    pages = []
    for _ in range(n):
        title, lead, body = prose(5), prose(20), [prose(rng.randint(3, 60)) for _ in range(rng.randint(1, 9))]
        inner, want = f"<h1>{escape(title)}</h1><div class=lead>{escape(lead)}</div>", [title, lead]
        for k, b in enumerate(body):
            kind = rng.choice(["p", "p", "p", "li", "blockquote"])
            inner += f"<ul><li>{escape(b)}<li>{k} more</ul>" if kind == "li" else f"<{kind}>{escape(b)}</{kind}>"
            want += [b, f"{k} more"] if kind == "li" else [b]
        links = "".join(f"<li><a href=/{k}>{prose(2)}</a>" for k in range(rng.randint(2, 6)))
        notice = "<div class=info>All prices without tax. Call us any day.</div>" * (rng.random() < 0.7)
        tag = "article" if with_article else "div"
        pages.append((f'<html><body><div id=top><a href=/>Site of things</a></div><div class=wrap>{notice}<{tag} class=post>{inner}</{tag}><div class="side">{prose(4)}</div><div class=more><ul>{links}</ul></div></div><p>Made with care in the north.</p></body></html>', "\n\n".join(want)))
    return pages


@pytest.mark.parametrize("seed", range(6))
def test_hosts_without_article_are_read_by_their_wrapper(seed):
    pages = build(random.Random(seed), 12)
    html = [h for h, _ in pages]
    assert read(html) == [t for _, t in pages]
    assert [W.extract(h) for h in html] != [t for _, t in pages]  # a page alone does not show what the host repeats
    # a null and an empty page after many layouts take nothing away
    many = [f"<body><div class=x{k}><p>{k}</p></div></body>" for k in range(80)]
    assert read([*html, *many, None, "", *html])[:12] == [t for _, t in pages]


def test_names_of_either_are_read_off_the_wrapper():
    make = lambda t, n: f"<article><h1>{t}</h1><div class=notice>{n}</div><p>{t} text {t}</p></article>"
    assert read([make(x, "Read our terms") for x in ("a", "b", "c")]) == [f"{x}\n\n{x} text {x}" for x in "abc"]
    assert read([make(x, f"found {x}") for x in ("a", "b", "c")]) == [f"{x}\n\nfound {x}\n\n{x} text {x}" for x in "abc"]
    head = lambda h, t: f"<header><h1>{h}</h1></header><div class=c><p>{t}</p><p>and {t} again</p></div>"
    assert read([head("Site", x) for x in ("one", "two", "six")])[0] == "one\n\nand one again"
    assert read([head(f"On {x}", x) for x in ("one", "two", "six")])[0] == "On one\n\none\n\nand one again"


def test_copies_of_one_page_are_no_template():
    pages = build(random.Random(9), 1)
    copies = [pages[0][0].replace("Site of things", f"Site {k}") for k in range(3)]
    assert all(pages[0][1] in text for text in read(copies))


class Plain(HTMLParser):
    """An extractor of its own: the text of the article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.off, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.off += tag in ("nav", "aside", "form", "footer", "script", "style") or tag in ("div", "section") and bool(dict(attrs).get("class"))
        if tag == "br":
            self.handle_data(" ")
        elif tag in W.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.off -= tag in ("nav", "aside", "form", "footer", "script", "style")
        if tag in W.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside > 0 and not (self.off and not self.inside):
            self.blocks[-1] += data


@pytest.fixture(scope="module")
def truth():
    def of(html):
        parser = Plain()
        parser.feed(html)
        parser.close()
        return "\n\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)

    return of


def test_pages_query(spark, truth):
    for sf in ("sf0.001", "sf0.01"):
        rows = W.op6_page_wrappers(spark, f"/root/testdata/{sf}").collect()
        source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
        assert len(rows) == len(source)
        for r in rows:
            assert r["n_chars"] == len(r["text"]) > 0 and r["text"] == truth(source[r["page_id"]])


def test_query_over_hosts_without_article(spark):
    """Pages of several hosts over many tasks: partial wrappers are merged to the same decisions."""
    rows, want = [], {}
    for host in range(4):
        for k, (html, text) in enumerate(build(random.Random(100 + host), 40 if host else 200)):
            rows.append((1000 * host + k, f"http://h{host}.x/{k}", html))
            want[1000 * host + k] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    assert {r["page_id"]: r["text"] for r in W.main_texts(pages).collect()} == want
    found = W.host_wrappers(pages.select(W._host(F.col("url")).alias("host"), "html")).collect()
    assert len(found) == 4 and all("'Made with care in the north.'" in r["expression"] and "(<p> # </>)+" in r["expression"] for r in found)


def test_odd_tables(spark):
    rows = [(1, "http://h/a", page("A", ["p"])), (1, "http://h/a", page("A", ["p"])), (2, None, page("B", ["q"])), (3, "odd", None), (None, "http://U@H:80/x", ""), (4, "http://h/b", "<p>alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = pages.select("*", F.lit(1).alias("host"), F.lit(2).alias("part"), F.lit("t").alias("text"), F.lit("r").alias("wrapper"))
    for table in (pages, wide):
        got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in W.main_texts(table).collect())
        assert got == sorted([("1", "A\n\np", 4), ("1", "A\n\np", 4), ("2", "B\n\nq", 4), ("3", "", 0), ("None", "", 0), ("4", "alone", 5)])
    assert W.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
