"""Pages that wrap their article in what is usually none, broken and very deep pages, and the path ratios by hand."""

import html as entities
import re
import time
from collections import defaultdict

import pytest

from stockweave.llm import htmltext

BODY = " ".join(["A sentence of the article, with words and a comma."] * 40)
TEXT = f"<h1>Title</h1><p>{BODY}</p><p>{BODY}</p>"
WANT = "\n\n".join(["Title", BODY, BODY])


@pytest.mark.parametrize("page", [
    '<div class="overflow-hidden">{}</div>', '<div title="the hidden city">{}</div>', "<form action='x' method=post>{}</form>",
    "<form><fieldset>{}</fieldset></form>", "<div hidden>{}</div>", '<div style="color:red; display : none">{}</div>', '<div aria-hidden="true">{}</div>',
    "<dialog open>{}</dialog>", "<header><div>{}</div></header>", '<div data-hidden="true">{}</div>'])
def test_wrappers_of_the_whole_article_stay(page):
    around = "<html><body><nav><a href='/'>Home</a><a href='/b'>Blog</a></nav>{}<footer>All rights reserved.</footer></body></html>"
    assert htmltext.main_text(around.format(page.format(TEXT))) == WANT


def test_parts_beside_the_article_go():
    beside = ["<div hidden>A hidden note, not for reading.</div>", '<div style="display:none">Preloaded text, later.</div>', '<p aria-hidden="true">Icon, text.</p>',
              "<form><label>Name, please</label><input><fieldset>Choose one, please.</fieldset></form>", "<footer>All rights reserved, always.</footer>",
              "<aside>Other things, elsewhere.</aside>", "<dialog>Accept, or not.</dialog>", "<nav>" + "<a href='x'>A long link, of many words.</a>" * 200 + "</nav>"]
    for one in beside:
        for page in (f"<body>{one}<article>{TEXT}</article></body>", f"<body><article>{TEXT}</article>{one}</body>", f"<body><div>{TEXT}{one}</div></body>"):
            assert htmltext.main_text(page) == WANT, one
    assert htmltext.main_text(f"<body><article>{TEXT}</article>{''.join(beside)}</body>") == WANT


@pytest.mark.parametrize("page", [
    "<a " * 350_000, '<a "' * 250_000 + ">", "<a href='x>" * 60_000, "<" * 1_000_000, "<!--" * 200_000, "<div>" * 50_000 + "text, here.",
    "<div>some text, " * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<li><ul>" * 30_000, "<p><font>" * 60_000 + "x", "<table><tr><td>" * 30_000, "</div>" * 100_000,
    "<script>" * 100_000, "<p a=" + " " * 500_000 + ">x"])
def test_broken_and_deep_pages_take_time_in_proportion(page):
    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 15


def test_an_open_quote_costs_one_tag():
    page = f'<body><p title="never closed>first, lost</p><div><p>{BODY}</p><p class="x">{BODY}</p></div></body>'
    assert BODY in htmltext.main_text(page)
    assert htmltext.main_text(f"<body><p>{BODY}</p><p>{BODY} <a href") == f"{BODY}\n\n{BODY} <a href"


def test_content_paths_equal_the_ratios_by_hand():
    page = ("<body><div><p>Lead, short.</p><p>" + BODY + "</p><ul><li>one</li><li>two</li></ul><p>" + BODY[:300] + "</p></div>"
            "<section><h2>More</h2><span>x</span><p>Another, longer one; with marks.</p></section></body>")
    tree = htmltext.read(page)
    leaves = [(n, b, entities.unescape(t)) for n, b, t in tree.leaves]
    found = htmltext._content(tree.nodes, tree.lengths, leaves, 0.25)
    texts = [t for *_, t in found.blocks]
    assert texts == ["Lead, short.", BODY, "one", "two", BODY[:300].strip(), "More", "x", "Another, longer one; with marks."]
    kinds = ["p", "p", "li", "li", "p", "h2", "section", "sp"]
    chars, marks = [len(t) for t in texts], [len(re.findall("[.,;:!?]", t)) for t in texts]
    by = defaultdict(list)
    for i, k in enumerate(kinds):
        by[k].append(i)
    mean = lambda k, v: sum(v[i] for i in by[k]) / len(by[k])
    ratio = [mean(k, chars) for k in kinds]
    extended = [mean(k, chars) * (1 + sum(marks[i] for i in by[k])) / (1 + len(by[k])) for k in kinds]

    def smooth(v):
        padded = [v[0], *v, v[-1]]
        return [0.25 * a + 0.5 * b + 0.25 * c for a, b, c in zip(padded, padded[1:], padded[2:])]

    fused = [(a * b) ** 0.5 for a, b in zip(smooth(ratio), smooth(extended))]
    whole = sum(chars)
    limit, plain = (0.25 * sum(x * c for x, c in zip(v, chars)) / whole for v in (fused, ratio))
    content = {k for k in by if mean(k, fused) >= limit and (ratio[by[k][0]] * extended[by[k][0]]) ** 0.5 >= 0.25 * limit
               or mean(k, chars) >= plain and sum(marks[i] for i in by[k]) >= len(by[k])}
    assert {kinds[i] for i, p in enumerate(found.path) if p in found.content} == content
    held = defaultdict(float)
    for (_, node, text), p in zip(found.blocks, found.path):
        if p in found.content:
            while node >= 0:
                held[node] += len(text)
                node = tree.nodes[node].parent
    assert found.held == [held[k] for k in range(len(tree.nodes))]
