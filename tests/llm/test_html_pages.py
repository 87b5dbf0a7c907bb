"""Pages written by hand, with markup that no training layout has: what must come out, and nothing else."""

import pytest

from drawloom.llm import html_text

LINES = ["The council met on Monday to discuss the new bridge over the river, and heard from several residents.", "Work will start in the spring and is expected to last two years, officials said."]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
TITLE = "Bridge plan"


@pytest.fixture(scope="module")
def labeller():
    texts = [f"Some words about matter {i}, and more of it, as was said before." for i in range(60)] + ["Home", "News", "Contact us", "All rights reserved"]
    model = html_text.BlockLabeller()
    model.train(*html_text.labelled_layouts(texts, html_text.TRAIN_PAGES))
    return model


def _text(model, page):
    blocks = html_text.leaf_blocks(page)
    return model.text(blocks, model.logits([blocks])[0])


def _page(article, after=""):
    return f'<html><head><title>x</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>{article}{after}<footer>&copy; 2024 Example Corp</footer></body></html>'


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4, 5, 8, 20, 50, 100, 200])
def test_wrappers_of_any_depth(labeller, depth):
    down, up = "<div>" * depth, "</div>" * depth
    for title in ("", TITLE):
        head, want = (f"<h1>{title}</h1>", [title, *LINES]) if title else ("", LINES)
        for tag in ("article", "main"):
            for page in (f"<{tag}>{down}{head}{BODY}{up}</{tag}>", f"<{tag}>{head}{down}{BODY}{up}</{tag}>", f"{down}<{tag}>{head}{BODY}</{tag}>{up}"):
                assert _text(labeller, _page(page)) == "\n".join(want)


@pytest.mark.parametrize(
    "after",
    [
        '<div id="respond"><p>Leave a reply below</p><form><p><label>Name</label><input></p></form></div>',
        '<div class="comments"><h3>2 comments</h3><div class="comment"><p>I disagree with this plan, it costs too much money for us.</p></div></div>',
        '<section id="comments"><ol class="commentlist"><li><p>Great news, thank you for sharing!</p></li></ol></section>',
        "<aside><h3>Related</h3><ul><li><a href=/a>Other story about things</a></li></ul></aside>",
        '<div class="cookie-banner">We use cookies to improve your visit.</div>',
    ],
)
def test_what_follows_is_left_out(labeller, after):
    assert _text(labeller, _page(f"<article><h1>{TITLE}</h1>{BODY}</article>", after)) == "\n".join([TITLE, *LINES])


def test_a_table_that_lays_out_the_page(labeller):
    page = f"<html><body><table><tr><td><a href=/>Home</a><a href=/n>News</a></td><td><h1>{TITLE}</h1>{BODY}</td></tr></table></body></html>"
    assert _text(labeller, page) == "\n".join([TITLE, *LINES])


def test_paths_do_not_grow_with_depth():
    page = "".join(f'<div class="c{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}">t{i}' for i in range(20_000))
    blocks = html_text.leaf_blocks(page)
    assert len(blocks) == 20_000 and max(len(p) for p, _, _ in blocks) <= html_text.PATH_DIM + 1
    one, many = (html_text.leaf_blocks("<div>" * n + "<p>x")[0][0] for n in (1, 500))
    assert one == many
    outer = html_text.leaf_blocks("<div class=a><div class=b><p>x</p></div><p>y</p></div><p>z</p>")
    assert [len(p) for p, _, _ in outer] == [5, 4, 2]
