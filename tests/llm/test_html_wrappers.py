import pytest

from lotwright.llm import html_text

TEXT = "A text of some length that is the whole article of this page, and more."


@pytest.mark.parametrize("start, end", [("<div class='layout with-sidebar'>", "</div>"), ("<div id='page' class='has-header'>", "</div>"), ("<form action=x>", "</form>"), ("<div class='has-header'><form><div class='with-sidebar'>", "</div></form></div>")])
def test_wrappers_with_dropped_names_keep_the_article(start, end):
    side = "<nav>menu</nav><div class='sidebar'>Read this too</div>"
    for inner in (f"<article><p>{TEXT}</p></article>", f"<div><p>{TEXT}</p></div>"):
        assert html_text.extract(f"<body>{start}{side}{inner}{end}</body>") == TEXT


PARAGRAPHS = [f"Paragraph {k} of the article, which says a little more than the one before it did, and then it ends." for k in range(5)]
MENU = "<div class=k1><ul>" + "".join(f"<li><a href=/{k}>Entry {k}</a></li>" for k in range(6)) + "</ul></div>"
END = "<div class=k9>Some words at the end.</div>"


def _body(start, end):
    return start + "<h1>The title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + end


@pytest.mark.parametrize("start, end", [("<div class=k2>", "</div>"), ("<div class=k2><div class=k3>", "</div></div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>")])
def test_density_finds_the_text_among_neutral_names(start, end, monkeypatch):
    page = f"<body>{MENU}{_body(start, end)}{END}</body>"
    want = "\n".join(["The title", *PARAGRAPHS])
    assert html_text.extract(page) == want
    # Without the search by density the same page gives its menu, too.
    monkeypatch.setattr(html_text, "main_subtree", lambda root: (root, 0.0))
    assert html_text.extract(page) != want and "Entry 3" in html_text.extract(page)


def test_parts_as_dense_as_the_path_stay():
    two = "<div class=a>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3]) + "</div><div class=b>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[3:]) + "</div>"
    assert html_text.extract(f"<body>{MENU}<div>{two}</div>{END}</body>") == "\n".join(PARAGRAPHS)


def test_nothing_else_is_dropped():
    body = "<article><p class='related reply widget'>One of them, long enough to be read.</p><svg><text>two</text></svg><map><p>Three stands here and is text.</p></map><p>Four.</p><ul class=social><li>five</li></ul></article>"
    assert html_text.extract(f"<body>{body}</body>") == "One of them, long enough to be read.\ntwo\nThree stands here and is text.\nFour.\nfive"


def test_generated_pages():
    """Every page of the small tables: its article; and most of them when tags and names tell nothing."""
    import re

    import pandas as pd

    right = blind = long = 0
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        parts = [html_text._SPACE.sub(" ", html_text.html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(p for p in parts if p)
        right += html_text.extract(page) == want
        for tag in ("article", "nav", "footer"):
            page = page.replace(f"<{tag}>", f"<div class=k{len(tag)}>").replace(f"</{tag}>", "</div>")
        if want.count("\n") > 3:
            long += 1
            blind += html_text.extract(page.replace('class="ad"', 'class="k2"')) == want
    assert right == len(pages) and blind == long > 100
