import random

import pytest

from suffloom.llm.html_text import BAD, GOOD, NEAR_GOOD, SHORT, STOP_WORDS, Block, blocks_of, classify, extract, inherit, main_text

LONG = "This is the text of the article and it has a lot of the words that we want to keep in the page."
FOREIGN = "Das ist der Text von dem Artikel und er hat auch die Worte, die wir nicht in der Seite verlieren."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var x = '<p>{LONG}</p>';</script>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>(c) {LONG}</footer>", f"Title\n{LONG}\nShort."),
        (f"<article><p><b>{LONG}<br><p>Next\n\t line&nbsp;&amp; more &lt;b&gt; &#233;&#x41;</article>", f"{LONG}\nNext line & more <b> éA"),
        (f"<div id='menu'><a>A</a> <a>B</a></div><div class='content'><h2>Head</h2><p>{LONG}</p><p>Mid.</p><p>{FOREIGN}</p></div>", f"Head\n{LONG}\nMid.\n{FOREIGN}"),
        (f"<header>{LONG}</header><main><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form></main>", LONG),
        (f"<article><p>{LONG}</p><section id='comments'><p>{FOREIGN}</p></section><div class='ad'>{FOREIGN}</div></article>", LONG),
        (f"<div class='cookie-notice'>{LONG}</div><div class='sidebar'><p>{LONG}</p></div><p>{FOREIGN}</p>", FOREIGN),
        (f"<ul><li><a href=1>One of the links</a></li><li><a href=2>Two of the links</a></li></ul><p>{LONG}</p>", LONG),
        (f"<article><header><h1>In the article</h1></header><p>{LONG}</p></article>", f"In the article\n{LONG}"),
        (f"<article><!-- <p>{FOREIGN}</p> --><p>a <i>b</i>c</p><p hidden>no</p><p style='display: none'>no</p></article>", "a bc"),
        ("<article><p>1 < 2 and 3 > 2</p><p>x<br>y</article>", "1 < 2 and 3 > 2\nx y"),
        (f"<article><p>{LONG}</p><p>cut off &am", f"{LONG}\ncut off &am"),
        (f"<div class='siteHeader'>{LONG}</div><div class='post-header overflow-hidden'><h1>The title of it</h1></div><p>{LONG}</p><div class='userComments'>{FOREIGN}</div><div id=newsletter_box>{FOREIGN}</div>", f"The title of it\n{LONG}"),
        (f"<div class='widget-area'><p>{LONG}</p></div>", LONG),
        (f"<article><div class='article-header'><h1>Head</h1></div><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div></article>", f"Head\n{LONG}"),
        (f"<div role='dialog'>{LONG}</div><div class='hidden'>{LONG}</div><p>{FOREIGN}</p><div class='comment-list'><div class='comment'>{LONG}</div></div>", FOREIGN),
        ("", ""),
    ],
)
def test_pages(body, text):
    assert main_text(page(body)) == text


def test_broken_markup():
    for raw in ["<", "<p", "</", "<!--", "<script>", "<article", "<a href='x", "&", "&#", "&#xffffffff;", "<p>" * 3000 + "x", "</p>" * 3000, "<![CDATA[x", "<div class=" + "a" * 5000]:
        assert isinstance(main_text(raw), str)
        blocks_of(raw)


def test_entities_are_decoded_once():
    assert main_text("<article><p>&amp;lt; &amp;amp;</p></article>") == "&lt; &amp;"


def test_rows(spark):
    from pyspark.sql import functions as F

    schema = "page_id bigint, url string, html string"
    rows = [(1, "u", page(f"<article><p>é {LONG}</p></article>")), (2, None, None), (3, "v", ""), (None, "w", "x"), (1, "u", page(f"<article><p>é {LONG}</p></article>")), (4, "z", page("<article>" + f"<p>{LONG}</p>" * 20000 + "</article>"))]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r["page_id"], r["url"], r["n_chars"], len(r["text"])) for r in extract(df).collect()), key=repr)
    n = len(LONG)
    assert got == sorted([(1, "u", n + 2, n + 2)] * 2 + [(2, None, 0, 0), (3, "v", 0, 0), (None, "w", 0, 0), (4, "z", 20000 * (n + 1) - 1, 20000 * (n + 1) - 1)], key=repr)
    assert extract(df.limit(0)).count() == 0
    assert extract(df.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))).columns == ["page_id", "url", "text", "n_chars"]


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (f"<article><p title=it's>{LONG}</p><p>Second.</p><p>Third's.</p></article>", f"{LONG}\nSecond.\nThird's."),
        (f"<article><p><img alt=it's src=x>{LONG}</p><p>5\" wide</p></article>", f'{LONG}\n5" wide'),
        (f"<article><p \"x>{LONG}</p><p>Next.</p></article>", f"{LONG}\nNext."),
        (f"<article><p title='a > b' class=x>{LONG}</p><p title = \"c>d\">Next.</p></article>", f"{LONG}\nNext."),
    ],
)
def test_quotes_in_tags(markup, text):
    assert main_text(page(markup)) == text


@pytest.mark.parametrize("name", ["discussion", "related", "search", "notice", "copyright", "register", "share", "comments-free", "alert"])
def test_names_that_may_be_the_article_s(name):
    for attr in ("class", "id"):
        assert main_text(page(f"<article><p>{LONG}</p><div {attr}='{name}'><p>{LONG} {FOREIGN}</p></div><p>{LONG}</p></article>")) == f"{LONG}\n{LONG} {FOREIGN}\n{LONG}"


def test_marks_are_features():
    text = f"Title\n{LONG}\n12 | 34 | 56\n{FOREIGN}"
    inner = f"<h1>Title</h1><p>{LONG}</p><p>12 | 34 | 56</p><p>{FOREIGN}</p>"
    rest = "<nav><a href=a>A</a></nav>", f"<div class=ad>{LONG}</div>", f"<footer>{LONG}</footer>"
    for tag in ("article", "main", "div", "section"):
        assert main_text(page(f"{rest[0]}{rest[1]}<{tag}>{inner}</{tag}>{rest[2]}")) == text
    # A mark without text in it isn't believed; one with the only text is.
    assert main_text(page(f"<article>Teaser</article><div><p>{LONG}</p></div>")).endswith(LONG)
    assert main_text(page("<div>Menu</div><article><p>Short one.</p><p>Another.</p></article>")) == "Short one.\nAnother."


def test_given_pages_with_the_mark_renamed(spark, data):
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    same = sum(main_text(x) == main_text(x.replace("<article>", "<div>").replace("</article>", "</div>")) for x in pages)
    assert same >= 0.98 * len(pages)


def slow_inherit(labels, places, headings, ends):
    """The second pass by its rules, one block at a time."""
    out = list(labels)
    n = len(labels)
    decided = [i for i in range(n) if labels[i] in (GOOD, BAD)]
    for i in range(n):
        if i in decided:
            continue
        left, right = [j for j in decided if j < i], [j for j in decided if j > i]
        a = (labels[left[-1]], places[left[-1]] == places[i], i - left[-1]) if left else (ends, False, i + 1) if ends else None
        b = (labels[right[0]], places[right[0]] == places[i], right[0] - i) if right else (ends, False, n - i) if ends else None
        if a is None or b is None or a[0] == b[0]:
            out[i] = (a or b or (GOOD,))[0]
        elif labels[i] == NEAR_GOOD:
            out[i] = GOOD
        elif headings[i] and not (a[1] and not b[1]):
            out[i] = b[0]
        else:
            out[i] = a[0] if (not a[1], a[2]) <= (not b[1], b[2]) else b[0]
    return out


def test_second_pass_by_brute_force():
    rnd = random.Random(3)
    for _ in range(3000):
        n = rnd.randint(0, 9)
        labels = [rnd.choice([GOOD, BAD, SHORT, SHORT, NEAR_GOOD]) for _ in range(n)]
        places, headings = [rnd.randint(1, 2) for _ in range(n)], [rnd.random() < 0.3 for _ in range(n)]
        ends = rnd.choice([None, BAD])
        blocks = [Block("x", heading=h, place=p, label=x) for x, p, h in zip(labels, places, headings)]
        inherit(blocks, ends)
        assert [b.label for b in blocks] == slow_inherit(labels, places, headings, ends), (labels, places, headings, ends)


def test_first_pass_by_brute_force():
    """Length, link density and stop-word density, counted afresh for random blocks."""
    rnd = random.Random(5)
    words = ["the", "of", "und", "zeppelin", "quorum,", "glyph.", "Of", "(vortex)", "is"]
    for _ in range(400):
        blocks = []
        for _ in range(6):
            text = " ".join(rnd.choice(words[: rnd.choice([3, 9])] + words[3:6] * rnd.choice([0, 9])) for _ in range(rnd.randint(1, 40)))
            blocks.append(Block(text, linked=rnd.choice([0, 0, len(text) // 3, len(text) // 2, len(text)]), apart=rnd.random() < 0.2))
        if not any(not b.apart and not b.linked and len(b.text) >= 70 for b in blocks):
            continue
        classify(blocks, 0.4, 70, 0.08, 0.18)
        plain = [w for b in blocks if not b.apart for w in b.text.lower().replace(",", "").replace(".", "").replace("(", "").replace(")", "").split()]
        often = {w for w in plain if len(w) < 5 and plain.count(w) >= max(4, len(plain) // 100)}
        want = []
        for b in blocks:
            own = [w.strip(",.()") for w in b.text.lower().split()]
            density = sum(w in STOP_WORDS or w in often for w in own) / len(own)
            long, link = len(b.text) >= 70, b.linked / len(b.text)
            prose = GOOD if density >= 0.18 else NEAR_GOOD if density >= 0.08 else SHORT
            want.append(BAD if b.apart else (NEAR_GOOD if long and prose == GOOD and link < 0.9 else BAD) if link > 0.4 else prose if long else SHORT)
        if GOOD in want:
            assert [b.label for b in blocks] == want


def test_tables_articles(spark, data):
    """The given pages mark the article: its paragraphs by a plain expression."""
    import html
    import re

    from suffloom.llm.html_text import op9_html_extraction

    got = {r["page_id"]: r["text"] for r in op9_html_extraction(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        m = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)
        parts = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", m[1])]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)
