import pytest

from urbanloom.llm.html_text import extract, main_text

PROSE = "It was a long day, and the road went on; nobody spoke. Then, at last, they came to a house."


@pytest.mark.parametrize("layout", [
    "<article><h1>Title here</h1>{}</article>",
    "<div class='wrap'><div class='content'><h2>Title here</h2>{}</div></div>",
    "<main><section><h1>Title here</h1>{}</section></main>",
    "<div id='page'><div class='post-7 post'><h2>Title here</h2><div class='text'>{}</div></div></div>",
])
def test_boilerplate_goes(layout):
    body = f"<p>{PROSE} One &amp; two.<p>{PROSE}\n  <b>Bold</b> <a href=x>linked</a> end.<br>Next</p><ul><li>{PROSE}</li></ul>"
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
    <header><p>Site name, your home.</p></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <div class="cookie-notice"><p>{PROSE} Accept cookies.</p></div><!-- <p>hidden</p> --><script>var t = "</p><p>no</p>";</script>
    {layout.format(body)}
    <aside><p>{PROSE} Aside.</p></aside><form><p>Name, please. <input></p></form>
    <div id="comments"><div class="comment"><p>{PROSE} I agree.</p></div></div>
    <footer>&copy; site, 2020. All rights.</footer></body></html>"""
    assert main_text(page) == "\n".join(
        ["Title here", f"{PROSE} One & two.", f"{PROSE} Bold linked end. Next", PROSE])


@pytest.mark.parametrize("layout", [
    "<html><body>{}<div class='content'>{}</div></body></html>", "{}<div class='content'>{}</div>",
    "<html><body>{}{}</body></html>", "{}{}", "<body><div><div id=a>{}</div><div id=b>{}</div></div></body>",
])
@pytest.mark.parametrize("times", [1, 4, 9])
def test_short_blocks_stay_with_the_text(layout, times):
    parts = [("h1", "A heading of thirty characters"), ("h2", "Another heading"), ("p", " ".join([PROSE] * times)),
             ("h3", "Third level"), ("li", "A list item of about forty characters."), ("p", "Short."), ("h2", "Last heading"), ("p", " ".join([PROSE] * times))]
    body = "".join(f"<ul><{t}>{x}</{t}></ul>" if t == "li" else f"<{t}>{x}</{t}>" for t, x in parts)
    menu = "<div class='top'><ul><li><a href=/a>One entry</a><li><a href=/b>Two entries</a></ul></div>"
    assert main_text(layout.format(menu, body)) == "\n".join(x for _, x in parts)


@pytest.mark.parametrize("wrap", [
    "<div class='layout with-sidebar'>{}</div>", "<div class='no-comments'><div class='elementor-widget'>{}</div></div>", "<form>{}</form>",
])
def test_labels_of_a_wrapper_do_not_empty_the_page(wrap):
    inner = f"<div class='text'><h1>Title here</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='sidebar'><p>{PROSE}</p></div>"
    page = wrap.format(inner + f"<div id='comments'><p>{PROSE} Yes.</p></div>")
    assert main_text(f"<body><nav>Menu</nav>{page}</body>") == "\n".join(["Title here", PROSE, PROSE])


def test_labels_within_the_article_and_teasers_beside_it():
    page = f"<article><div class='entry-header'><h1>Title here</h1></div><p>{PROSE}</p><section id='legal-framework'><p>{PROSE}</p></section><div class='comments'><p>{PROSE}</p></div></article>"
    assert main_text(page) == "\n".join(["Title here", PROSE, PROSE])
    paragraphs = [f"{PROSE} {PROSE} {PROSE} {k}" for k in range(20)]
    long = "".join(f"<p>{x}</p>" for x in paragraphs)
    found = main_text(f"<div class='content'>{long}</div><article class='card'><p>{PROSE * 6}</p></article>")
    assert set(paragraphs) <= set(found.split("\n"))


def test_link_lists_go_and_short_articles_stay():
    links = "".join(f"<li><a href=/{k}>Some long menu entry number {k}</a></li>" for k in range(9))
    assert main_text(f"<div><ul>{links}</ul><p>{PROSE}</p></div>") == PROSE
    assert main_text("<article><p>Ok</p></article><div><p>" + "x" * 10 + "</p></div>") == "Ok"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href=\"x", "<nav>Only menu</nav>", "<p></p>"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_unclosed_quotes_and_long_pages():
    assert main_text(f"<p class=\"x>{PROSE}</p>") == PROSE
    assert len(main_text("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>").split("\n")) == 20_000


def test_extract(llm):
    rows = [(1, "u", f"<article><p>{PROSE} é &#233;</p></article>", 5), (None, None, None, 6), (1, "u", "", 7)]
    df = llm.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(1, "u"), (None, None), (1, "u")]
    assert got[0]["text"] == f"{PROSE} é é" and got[0]["n_chars"] == len(PROSE) + 4
    assert [r["text"] for r in got[1:]] == ["", ""]
    assert extract(df.limit(0)).count() == 0
