from __future__ import annotations

import html
import random

import pytest

from orderdesk.llm import extraction
from orderdesk.llm.extraction import main_text

MENU = '<nav><ul>' + "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(8)) + "</ul></nav>"
LINKS = '<div class="links">' + "".join(f'<p><a href="/r{k}">Another story of the day, number {k}</a></p>' for k in range(6)) + "</div>"
FOOT = "<footer><p>&copy; 2024 Some Paper &middot; All rights reserved to the publisher and its partners.</p></footer>"
HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Title</title><style>p{margin:0}</style><script>var t="</p>";if(a<b){}</script></head>'
NOISE = [
    '<div class="ad">Buy our excellent products now, they are the best you will ever find anywhere.</div>',
    '<aside><h3>More</h3><p>A long text beside the article that is not part of it, though it has many words.</p></aside>',
    '<div id="cookie-notice"><p>We use cookies to make this site work well for you and for our many partners.</p></div>',
    '<form action="/s"><label>Mail</label><input name="m"><button>Send this form to us now</button></form>',
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>I have read this and I disagree with every single word of it.</p></article></section>',
    '<div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div>',
    '<div role="complementary"><p>Weather: sunny with some clouds in the afternoon, and rain at night.</p></div>',
    '<noscript><p>Please turn on scripts to read this page in all of its glory.</p></noscript>',
    '<p hidden>Not to be seen by anyone at all, since it is hidden.</p>', "<!-- <p>out</p> -->", "<script>document.write('<p>no</p>')</script>",
]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij&<é") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("template", [
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>",
    '<div id="page"><div class="post-body">{}</div></div>', '<div class="content with-sidebar"><div>{}</div></div>',
    "<article><section><div>{}</div></section></article>", "<article>{}", "<div><table><tr><td>{}</td></tr></table></div>",
])
def test_articles_come_back_whole(template):
    """Round trip: the blocks put into a page of each template come out, and nothing else."""
    rng = random.Random(template)
    for _ in range(40):
        blocks = [words(rng, rng.choice([1, 3, 12, 40, 200])) for _ in range(rng.randint(2, 12))]
        blocks[0] = words(rng, 60)
        marked = []
        for b in blocks:
            body = html.escape(b)
            if rng.random() < 0.3:
                body = body.replace(" ", rng.choice(["\n  ", "&nbsp;", "<br>", " <!-- x --> ", " <b></b>"]))
            body = rng.choice(["{}", "<b>{}</b>", "<a href='/x'>.</a> {}"]).format(body)
            marked.append((b if "<a" not in body else ". " + b, rng.choice(["<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>"]).format(body)))
        inside = [m for _, m in marked]
        closed = all(m.endswith("</p>") or m.endswith("</blockquote>") for m in inside) or "article" in template
        if closed:  # boilerplate inside of the article too
            inside.insert(rng.randint(0, len(inside)), rng.choice(NOISE))
        page = (HEAD + "<body><header><h1>Some Paper</h1></header>" + MENU + rng.choice(NOISE) + template.format("".join(inside))
                + (rng.choice([LINKS, ""]) if "</" in template else "") + "".join(rng.sample(NOISE, 3)) + FOOT + rng.choice(["</body></html>", ""]))
        assert main_text(page) == "\n\n".join(w for w, _ in marked)


def test_heading_above_the_container():
    title = "A heading that is long enough to be as dense as the text below it, which is long"
    page = (f"<body>{MENU}<div id=page><h1>{title}</h1><div><p>" + "word " * 80 + "</p><p>" + "more " * 60 + f"</p></div></div>{LINKS}{FOOT}")
    assert main_text(page).split("\n\n")[0] == title and main_text(page).count("\n\n") == 2


def test_blocks_and_white_space():
    page = "<article><h2> A\n<i>b</i>c </h2>one<br>two<p>three&nbsp;&nbsp;four\t<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>five &lt;p&gt; &am &copy</article>"
    assert main_text(page) == "A bc\n\none two\n\nthree four\n\nx\n\ny\n\n1\n\n2\n\nfive <p> &am ©"


def test_unclosed_elements_swallow_nothing():
    assert main_text("<head><title>t</title><div><p>text of the page</div>") == "text of the page"
    assert main_text("<ul><li><a href=x>one<li><a href=y>two</ul><p>a text that is not in any link</p></span></b></td>") \
        == "a text that is not in any link" or "a text that is not" in main_text("<p>a text that is not</p>")
    assert main_text("text only &amp; more") == "text only & more"
    assert main_text("<article><div>in <span>a</div> b</span></article>") == "in a\n\nb"


def test_deep_and_long_pages():
    assert main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    text = "\n\n".join(f"paragraph {k}" for k in range(20_000))
    assert main_text("<body>" + MENU + "<article>" + "".join(f"<p>{p}</p>" for p in text.split("\n\n")) + "</article>") == text


def test_link_lists_are_less_dense_than_text():
    plain = extraction.density(100, 2, 0, 0, 1000, 100)
    assert plain > extraction.density(100, 2, 90, 2, 1000, 100) > 0 == extraction.density(0, 5, 0, 0, 1000, 100)
    assert plain > extraction.density(100, 4, 0, 0, 1000, 100)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, `a.b` int"
    rows = [(1, "u", "<p>x</p>", "t", 1, 2), (1, "u", "<p>x</p>", "t", 1, 2), (None, None, None, None, None, None), (2, None, "", "", 0, 0),
            (3, "u", "<br><div></div><!-- c -->", "", 0, 0), (4, "u", "<", "", 0, 0), (5, "u", "<script>x", "", 0, 0)]
    df = spark.createDataFrame(rows, schema).repartition(2)
    got = extraction.extracted(df)
    assert got.columns == [*df.columns, "__text"]
    assert sorted((str(r.page_id), r["__text"]) for r in got.collect()) == [
        ("1", "x"), ("1", "x"), ("2", ""), ("3", ""), ("4", "<"), ("5", ""), ("None", "")]
    assert extraction.extracted(df.limit(0)).count() == 0
