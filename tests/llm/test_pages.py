import random

import pyarrow.parquet as pq
import pytest

from lectern.llm.pages import extract_pages, main_text, op5_html, page_lines

BODY = "<p>First paragraph with some words in it, long enough to be one.<p>Second &eacute;t&eacute; &lt;b&gt; one.<br>Third"
TEXT = "First paragraph with some words in it, long enough to be one.\nSecond été <b> one.\nThird"


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("just text", "just text"),
        (f"<title>T</title><body><div>{BODY}</div>", TEXT),
        (f"<nav><ul><li><a href=/a>A</a></li></ul></nav><article>{BODY}</article><footer>&copy; x</footer>", TEXT),
        (f"<article>{BODY}<div class='ad'>Buy</div><p>After</p></article>", TEXT + "\nAfter"),
        (f"<div id=cookie-notice>We use cookies</div><main>{BODY}</main><aside>More</aside>", TEXT),
        (f"<article>{BODY}<section id='comments'><article class='comment'><p>Nice</p></article></section></article>", TEXT),
        (f"<form><p>Name</p></form><script>var t='</p><p>';</script><style>p{{}}</style><div>{BODY}</div>", TEXT),
        ("<article><p>a <b>b</b>\n\t c&nbsp;d<!-- x <p> --> e</article>", "a b c d e"),
        ("<article><p>open <b>bold<p>next</article>", "open bold\nnext"),
        ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"),
        ("<article>x &amp &am 3 < 4 &#233;</article>", "x & &am 3 < 4 é"),
        ("<article><p title=\"a>b\">quoted</p></article>", "quoted"),
        ("<script>never closed <p>x", ""),
        ("<div><a href=/x>only</a> <a href=/y>links</a></div>", ""),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_short_paragraphs_between_links_stay():
    links = "".join(f"<p><a href=/{i}>link {i}</a></p>" for i in range(9))
    assert main_text(f"<body>{links}<p>{'word ' * 60}</p><p>Ok.</p>{links}").split("\n")[-1] == "Ok."


def test_long_and_broken_pages_end():
    assert main_text("<div>" * 20000 + "x") == "x"
    assert main_text("<" * 20000).startswith("<")
    assert len(main_text("<p>" + "word " * 200000)) == 999999


def test_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "z"), (2, None, None, "z"), (3, "u", "", "z"), (1, "u", f"<article>{BODY}</article>", "z")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, TEXT, len(TEXT))] * 2 + [(2, "", 0), (3, "", 0)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("cut", ["<div class='ad'><p>Buy</p><p>this</p><p>now</p><p>!</p></div>", "<p><a href=/a>a</a></p>" * 4, "<form><p>a</p><p>b</p><p>c</p><p>d</p></form>"])
def test_shorter_part_of_a_parted_article_stays(cut):
    assert main_text(f"<body><p>{'word ' * 200}</p>{cut}<p>A short end.</p></body>").split("\n")[-1] == "A short end."


@pytest.mark.parametrize("tag", ["body class='post comments-open'", "article class='post comments-open'", "div class='content has-sidebar'", "div class='no-sidebar'", "main class='with-comments'"])
def test_qualified_names_are_no_boilerplate(tag):
    assert main_text(f"<{tag}>{BODY}</{tag.split()[0]}>") == TEXT


def plain_main(lines):
    """The lines of ``page_lines`` that stay, one at a time."""
    marked = any(inside and not out for _, _, out, inside in lines)
    use = lambda i: 0 <= i < len(lines) and not lines[i][2] and (lines[i][3] or not marked)
    points = lambda i: lines[i][1] - (len(lines[i][0]) - lines[i][1]) if use(i) else 0
    return "\n".join(t for i, (t, *_) in enumerate(lines) if use(i) and points(i - 1) + points(i) + points(i + 1) > 0)


def test_surges_and_dives_equal_a_plain_loop():
    r = random.Random(5)
    word = lambda: "x" * r.randint(1, 9)
    for _ in range(300):
        page = ""
        for _ in range(r.randint(0, 12)):
            text = " ".join(f"<a href=#>{word()}</a>" if r.random() < links else word() for links in [r.choice([0, 0.2, 0.9, 1])] for _ in range(r.randint(1, 8)))
            page += r.choice(["<p>{}</p>", "<li>{}", "<div class=ad>{}</div>", "<article><p>{}</article>", "<nav>{}</nav>"]).format(text)
        assert main_text(page) == plain_main(page_lines(page))


def test_the_distribution_decides_in_marked_articles():
    links = "".join(f"<li><a href=x{i}>Another story {i}</a></li>" for i in range(6))
    page = f"<article><h1><a href=#>Title</a></h1><p>Some running text of the article.</p><p>And more of it, at length.</p><ul>{links}</ul><p>The last words of the article.</p></article>"
    kept = main_text(page).split("\n")
    assert kept[:3] == ["Title", "Some running text of the article.", "And more of it, at length."] and kept[-1] == "The last words of the article."
    assert "Another story 2" not in kept and "Another story 3" not in kept


def test_query(spark, small):
    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    out = {x.page_id: x for x in op5_html(spark, small).collect()}
    assert len(out) == len(pages)
    for p in pages:
        want = plain_main(page_lines(p["html"] or ""))
        assert (out[p["page_id"]].text, out[p["page_id"]].n_chars, out[p["page_id"]].url) == (want, len(want), p["url"]) and want
