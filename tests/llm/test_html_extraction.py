import re
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm.html_extraction import Page, main_texts, templates

SCHEMA = "page_id long, url string, html string"


def page(k, body, host="a.example.org"):
    return (
        k,
        f"https://{host}/p/{k}",
        f"<!DOCTYPE html><html><head><title>Title {k}</title><style>p{{x}}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home {k}</a></li></ul></nav>"
        f"{body}<aside>Side {k} text that is long enough to count for something</aside><div class='ad-box'>Buy {k}</div><div id='comments'><p>Nice {k}!</p></div><footer>&copy; {k}</footer></body></html>",
    )


def texts(spark, rows):
    return {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_articles(spark):
    rows = [page(k, f"<article><h1>Head &amp; {k}</h1><p><b>First\n  line<br>of {k}<p>Second&nbsp;&eacute;</p><!-- x --><form>no</form><ul><li>one<li>two</ul></article>") for k in range(5)]
    got = texts(spark, rows)
    assert got == {k: f"Head & {k}\n\nFirst line of {k}\n\nSecond é\n\none\n\ntwo" for k in range(5)}


def test_slots_without_article_tags(spark):
    """The content slot is found by the text that it holds."""
    rows = [page(k, f"<div class='wrap'><div class='teaser'>Short {k}</div><div class='story'><p>{'Long text. ' * (5 + k)}</p><p>{k} more {'words ' * 9}</p></div></div>", "b.example.org") for k in range(6)]
    got = texts(spark, rows)
    assert all(got[k] == f"{('Long text. ' * (5 + k)).strip()}\n\n{k} more {('words ' * 9).strip()}" for k in range(6))


@pytest.mark.parametrize("pages", [1, 2, 7])
def test_slots_beside_each_other(spark, pages):
    """Title and all content slots are kept where no article or main holds them, however the text is shared out."""
    names = "amber birch cedar delta ember frost grove".split()
    body = lambda k, w, lead: f"<div class='wrap'><div class='content'><h1>On {w} {k}</h1><div class='lead'><p>{f'lead of {w} ' * lead}</p></div><div class='body'><p>{f'body of {w} ' * 20}</p></div></div></div>"
    rows = [page(k, body(k, w, 8 if k else 60), f"c{pages}.example.org") for k, w in enumerate(names[:pages])]
    rows = [(i, u, h.replace(f"<div class='ad-box'>Buy {i}</div>", "")) for i, u, h in rows]
    got = texts(spark, rows)
    assert got == {k: f"On {w} {k}\n\n{(f'lead of {w} ' * (8 if k else 60)).strip()}\n\n{(f'body of {w} ' * 20).strip()}" for k, w in enumerate(names[:pages])}


def test_titles_that_differ_in_digits_or_are_links(spark):
    rows = [page(k, f"<div class='content'><{'a><h1' if k % 2 else 'h1><a'} href='/{k}'>Part {k}</{'h1></a' if k % 2 else 'a></h1'}><div class='body'><p>{'words ' * (20 + k)}</p></div></div>", "d.example.org") for k in range(4)]
    assert texts(spark, rows) == {k: f"Part {k}\n\n{('words ' * (20 + k)).strip()}" for k in range(4)}


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_that_only_sound_like_dropped_parts(spark, tag):
    names = "amber birch cedar delta".split()
    body = lambda w: (
        f"<{tag}><div class='entry-header'><h1 class='header'>On {w}</h1></div><p id='notice-of-1912'>Notice of {w}</p><h2 id='related-work'>Related {w}</h2>"
        f"<section id='navigation-at-sea'><p>Sea of {w}</p></section><section id='comments' class='social-history'><p>Class of {w}</p></section>"
        f"<div class='share sharing-top'><p>Share {w}</p></div><div class='cookie-notice'><p>Cookies {w}</p></div><section class='comments'><p>Comment {w}</p></section></{tag}>"
    )
    got = texts(spark, [page(k, body(w), f"{tag}.example.org") for k, w in enumerate(names)])
    assert got == {k: f"On {w}\n\nNotice of {w}\n\nRelated {w}\n\nSea of {w}\n\nClass of {w}" for k, w in enumerate(names)}


def test_two_templates_on_a_host(spark):
    rows = [page(k, f"<div class='story'><p>{'alpha ' * 20}{k}</p><p>x</p></div>") for k in range(4)] + [page(k, f"<div class='post'><span>s</span><p>{'beta ' * 20}{k}</p><p>y</p></div>") for k in range(10, 14)]
    got = texts(spark, rows)
    assert all("alpha" in got[k] for k in range(4)) and all("beta" in got[k] for k in range(10, 14))


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "http://x.example/", ""), (3, "http://x.example/", "just text"), (4, "http://x.example/q", "<p>open <b>never closed"), (None, "not a url", "<article><p>null id</article>"),
        (5, "http://y.example/", "<div>a &lt; b < c</div>"), (6, "http://z.example/", "<article>" + "<p>x" * 3000), (6, "http://z.example/", "<div>" * 2000 + "deep"), (7, "http://z.example/", "<script>never ends"), (8, "http://z.example/", "<!-- never ends"),
    ]
    df = main_texts(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in df.collect()), key=repr)
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    by = dict((i, t) for i, t, _ in got if i != 6)
    assert by[1] == by[2] == by[7] == by[8] == "" and by[3] == "just text" and by[4] == "open never closed" and by[5] == "a < b < c" and by[None] == "null id"


def test_empty_table(spark):
    assert main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", ["sf0.001"])
def test_whole_table(spark, name):
    """Against the standard library's parser, which knows that these pages have one article of plain blocks."""

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag == "br":
                self.blocks[-1] += " "
            elif tag != "b":
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag != "b":
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages, want = spark.read.parquet(f"/root/testdata/{name}/pages.parquet"), {}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html)
        parser.close()
        assert {t for t in re.findall(r"<(\w+)", r.html.split("<article>")[1].split("</article>")[0])} <= {"p", "h1", "b", "br"}
        want[r.page_id] = "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.strip())
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert got == want


@pytest.mark.parametrize("part", ['<a "', "<a '\">", '<p>x<a b="', "<", "<!", "<!-- x", "<script>", "<div a='", "</b", '<i "\'>'])
def test_linear_in_a_page_of_broken_markup(part):
    began = time.perf_counter()
    Page(part * (1_000_000 // len(part)) + ">tail")
    assert time.perf_counter() - began < 30  # a quadratic walk takes hours


def test_broken_quotes():
    assert Page("<div>one <a href='x>two</a> three</div>").blocks == ["one two three"]
    assert Page("<div>one <a title='a > b'>two</a> < three <4</div>").blocks == ["one two < three <4"]
    assert Page("<p>5 <b").blocks == ["5 <b"] and Page("x <!-- y").blocks == ["x"] and Page("a <?php b ?> c").blocks == ["a c"]


def test_templates_of_a_host(spark):
    rows = [(r[1].split("/")[2], r[0], r[2]) for r in (page(k, f"<article><p>{'word ' * 30}{k}</p></article>") for k in range(3))]
    got = templates(spark.createDataFrame(rows, "host string, page long, html string")).collect()
    assert len(got) == 1 and got[0].roots[0].startswith("html>body>article")


WORDS = "amber birch cedar delta ember frost grove heron islet jetty knoll larch".split()


def bare(k, body, host):
    return k, f"https://{host}/{k}", f"<html><body>{body}</body></html>"


def layout_a(w, n):
    return f"<div class='top'>Site banner</div><div class='box'><h2>On {w}</h2><p>{f'alpha {w} ' * n}</p></div><div class='end'>End A</div>", f"On {w}\n\n{(f'alpha {w} ' * n).strip()}"


def layout_b(w, n):
    return f"<div class='head-b'>Other banner</div><div class='main-b'><div class='lead'>Lead of {w}</div><div class='rest'><p>{f'beta {w} ' * n}</p></div></div><div class='foot-b'>End B</div>", f"Lead of {w}\n\n{(f'beta {w} ' * n).strip()}"


def check_host(spark, layouts, host):
    rows = [bare(k, html, host) for k, (html, _) in enumerate(layouts)]
    want = {k: text for k, (_, text) in enumerate(layouts)}
    assert texts(spark, rows) == want
    assert texts(spark, rows + rows) == want  # every row twice
    assert texts(spark, rows + rows[:1] * 4) == want


def test_constant_text_of_two_layouts_on_a_host(spark):
    check_host(spark, [layout_a(w, 20) for w in WORDS[:4]], "one.example.org")
    check_host(spark, [layout_a(w, 20) for w in WORDS[:4]] + [layout_b(w, 15) for w in WORDS[4:7]], "two.example.org")


def test_articles_shorter_than_the_template(spark):
    long = "Terms and conditions of this site apply. " * 40
    check_host(spark, [(f"<div class='top'>{long}</div><div class='box'><p>Brief {w}</p></div><div class='end'>{long}</div>", f"Brief {w}") for w in WORDS[:5]], "short.example.org")


@pytest.mark.parametrize("tag", ["article", "div"])
def test_a_header_that_holds_the_title(spark, tag):
    pages = [(f"<div class='top'>Site</div><{tag} class='post'><div class='header'><h1>On {w}</h1></div><div class='text'><p>{f'{w} words ' * 12}</p></div></{tag}>", f"On {w}\n\n{(f'{w} words ' * 12).strip()}") for w in WORDS[:5]]
    check_host(spark, pages, f"header-{tag}.example.org")


def test_titles_that_differ_in_a_digit_beside_the_body(spark):
    pages = [(f"<div class='top'>Site</div><div class='name'>Part {k}</div><div class='text'><p>{f'{w} words ' * 12}</p></div>", f"Part {k}\n\n{(f'{w} words ' * 12).strip()}") for k, w in enumerate(WORDS[:5])]
    check_host(spark, pages, "parts.example.org")


def test_generated_hosts(spark):
    """Hosts of random templates without article or main: what varies is the article, what doesn't is the template."""
    import random

    pick, rows, want = random.Random(11), [], {}
    for h in range(12):
        layouts = []
        for t in range(pick.choice([1, 1, 2, 3])):
            fixed = [f"<div class='f{'abc'[t]}{'pqrs'[j]}'>{' '.join(pick.choices(WORDS, k=pick.randrange(1, 30)))}</div>" for j in range(4)]
            layouts.append((t, fixed))
        for t, fixed in layouts:
            for _ in range(pick.randrange(4, 9)):
                k = len(rows)
                said = [" ".join([f"u{k}x{j}", *pick.choices(WORDS, k=pick.randrange(40))]) for j in range(3)]
                inner = f"<div class='t{'abc'[t]}'><h2>{said[0]}</h2><p>{said[1]}</p><ul class='plain'><li>{said[2]}</li></ul></div>"
                rows.append(bare(k, f"{fixed[0]}<div class='w{'abc'[t]}'>{fixed[1]}{inner}{fixed[2]}</div>{fixed[3]}", f"h{h}.example.org"))
                want[k] = "\n\n".join(said)
    pick.shuffle(rows)
    assert texts(spark, rows) == want


def test_very_long_page_and_extra_columns(spark):
    from pyspark.sql import functions as F

    rows = [bare(k, layout_a(w, 60_000 if k == 2 else 9)[0], "long.example.org") for k, w in enumerate(WORDS[:4])]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in main_texts(pages.select("*", *[F.lit("x").alias(c) for c in "host roots fixed page token own size".split()])).collect()}
    assert got == {k: layout_a(w, 60_000 if k == 2 else 9)[1] for k, w in enumerate(WORDS[:4])}
