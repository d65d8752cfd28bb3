"""Parts beside the article stay out, however long they are and however many pages of the host have them."""

from __future__ import annotations

import random

import pytest

from lumenframe.llm import html

WORDS = [f"word{i}" for i in range(500)]
SIDES = {
    "aside": "<aside>{}</aside>", "footer": "<footer>{}</footer>", "nav": "<nav>{}</nav>", "form": "<form>{}</form>", "role": "<div role=complementary>{}</div>", "notice": "<div class='cookie-notice'>{}</div>",
    "sidebar": "<div id=sidebar>{}</div>", "comments": "<div class=comments>{}</div>", "advert": "<div class='advert wide'>{}</div>",
}


def text(rng: random.Random, n: int) -> str:
    out = ""
    while len(out) < n:
        out += rng.choice(WORDS) + " "
    return out.strip()


@pytest.mark.parametrize("pages", [1, 3, 50])
@pytest.mark.parametrize("heading", [True, False])
def test_long_parts(spark, pages, heading):
    """Each kind of part, 2 to 50 times as long as the article, before or after it."""
    rng = random.Random(pages)
    rows, want = [], {}
    for kind, shape in SIDES.items():
        for k in range(pages):
            n = len(rows)
            article = text(rng, 180)
            side = shape.format("".join(f"<p>{text(rng, 180)}</p>" for _ in range(rng.choice([2, 5, 14, 50]))))
            own = f"<div class=post>{'<h1>Head</h1>' if heading else ''}<p>{article}</p></div>"
            rows.append((n, f"https://{kind}.example.org/{k}", f"<html><body><nav><a href=/>Home</a></nav>{''.join((side, own) if rng.random() < 0.5 else (own, side))}<footer>(c)</footer></body></html>"))
            want[n] = f"Head\n{article}" if heading else article
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("stray", ["", "<div>(c) 2020 by someone</div>"])
def test_misnamed_article(spark, stray):
    """A class that misleads around the main heading, with other text left or without; a page that is one form; a page of comments alone."""
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(5):
        article = [text(rng, 200), text(rng, 300)]
        rows.append((k, f"https://a.example.org/{k}", f"<body><aside>{text(rng, 2000)}</aside><div class='layout header-fixed'><h1>Head</h1><p>{article[0]}</p><p>{article[1]}</p></div>{stray}<div class=comments>{text(rng, 900)}</div></body>"))
        want[k] = "\n".join(["Head", *article])
        rows.append((10 + k, f"https://b.example.org/{k}", f"<body><form id=all><nav>{text(rng, 90)}</nav><div class=post><p>{article[0]}</p></div></form></body>"))
        want[10 + k] = article[0]
    rows.append((20, "https://c.example.org/", f"<body><div class=comments>{text(rng, 90)}</div></body>"))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] and {k: v for k, v in got.items() if k != 20} == want


def test_tiers():
    """The name of a part says how suspect it is; parts inside count as the worst around them."""
    found = html.blocks("<nav>a</nav><div class=sidebar>b<aside>c</aside></div><div class=comments>d</div><h1>e</h1>f")
    assert [(b.text, max((t for *_, t in b.suspects), default=0), b.heading) for b in found] == [("a", 2, False), ("b", 1, False), ("c", 2, False), ("d", 3, False), ("e", 0, True), ("f", 0, False)]
