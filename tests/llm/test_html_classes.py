"""Class words, and what the line-block distribution cuts."""

import pytest

from quillspark.llm import html_text

TEXT = "A long enough sentence of the article stands here, with many words in it."
P = f"<p>{TEXT} {TEXT}</p>"
LEFT_OUT = ['<div class="user-comments"><p>X said. ' + "much more " * 40 + "</p></div>", '<div class="reader-comments"><p>X</p></div>', '<ol class="commentlist"><li>X</li></ol>', '<section id="discussion-comments"><p>X</p></section>', '<div class="google-ads">X</div>', '<div class="alert alert-info">X</div>', '<div class="cookie-consent-dialog">X</div>']


@pytest.mark.parametrize("part", LEFT_OUT)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "<main><article>{}</article></main>"])
def test_named_parts_go(part, around):
    page = f"<html><body>{around.format('<h1>Title</h1>' + P * 5 + part)}</body></html>"
    assert html_text.main_text(page) == "\n".join(["Title"] + [f"{TEXT} {TEXT}"] * 5)


@pytest.mark.parametrize("around", ['<div class="has-comments">{}</div>', '<div class="page-with-ads">{}</div>', '<div class="ads-free-layout">{}</div>', '<article class="post has-comments">{}</article>', '<div class="side-effects">{}</div>'])
def test_words_that_only_describe_the_page(around):
    assert html_text.main_text(f"<body>{around.format('<h1>Title</h1>' + P)}</body>") == f"Title\n{TEXT} {TEXT}"


def brute_main(page, window, threshold):
    """The lines of a page by all windows, each looked at alone; articles end
    at their last dive but for sentences."""
    lines = html_text.weighed(html_text.lines_of(page))
    marked = any(x.article and x.counted for x in lines)
    size = [len(x.text) if x.counted and 2 * x.links <= len(x.text) and (x.article or not marked) else 0 for x in lines]
    windows = [sum(size[i : i + window]) for i in range(len(size))]
    least = max(1, min(threshold, max(windows, default=0)))
    full = {j for i, w in enumerate(windows) if w >= least for j in range(i, min(i + window, len(size)))}
    live = sorted(j for j in full if size[j])
    if not marked:
        return live
    out = []
    for article in sorted({lines[j].article for j in live}):
        own = [i for i, x in enumerate(lines) if x.article == article and x.counted]
        last = max(j for j in live if lines[j].article == article)
        while own[-1] > last and (lines[own[-1]].heading or (len(lines[own[-1]].text) < 20 and lines[own[-1]].text[-1] not in ".!?:;")):
            own.pop()
        out += own
    return out


@pytest.mark.parametrize("marked", [True, False])
def test_against_windows(marked):
    tail = "<p>So it ends.</p><p>x</p><h3>More</h3><p>Share</p><p>Print</p><p>Mail</p>"
    page = "<h1>Title</h1>" + P * 3 + "<p>Short one.</p>" + P + tail
    page = f"<article>{page}</article>" if marked else f"<div>{page}</div>"
    lines = html_text.lines_of(page)
    got = html_text.main_text(page).split("\n")
    assert got == [lines[i].text for i in brute_main(page, html_text.WINDOW, html_text.THRESHOLD)] or not marked
    assert "Share" not in got and "Mail" not in got and "So it ends." in got and "Short one." in got


def test_without_surges_the_text_would_differ(monkeypatch):
    page = f"<article><h1>Title</h1>{P}<p>One.</p><p>a</p><p>b</p><p>c</p><p>Share</p></article>"
    with_surges = html_text.main_text(page)
    monkeypatch.setattr(html_text, "surges", lambda sizes, *a: [(0, len(sizes))])
    assert html_text.main_text(page) != with_surges
