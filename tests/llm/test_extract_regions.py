"""Pages whose text lies beside or in several marked articles."""

import math
import random
import statistics
import time

import pytest

from relgrove.llm import extract

LONG = "A paragraph of the text that has words enough to stand out from what is around it, and more of them than any teaser would have."


def test_body_beside_teaser_cards():
    body = "".join(f"<p>{LONG} {k}</p>" for k in range(6))
    cards = "".join(f"<article class='card'><h3><a href='/{k}'>Card {k}</a></h3></article>" for k in range(3))
    want = "\n".join(f"{LONG} {k}" for k in range(6))
    assert extract.main_text(f"<body><div>{body}</div><div>{cards}</div></body>") == want


def test_sibling_articles():
    html = f"<div><article><p>{LONG}</p><p>Short.</p></article><article><p>{LONG} Two.</p></article></div>"
    assert extract.main_text(html) == f"{LONG}\nShort.\n{LONG} Two."


P = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><form id='aspnetForm'><div>{P}<p>Short.</p>{P}</div><select><option>x</select></form></body>", [LONG, "Short.", LONG]),
        (f"<div class='container right-sidebar'>{P}{P}</div>", [LONG, LONG]),
        (f"<div id='page' class='layout-sidebar-right'>{P}</div>", [LONG]),
        (f"<article class='post comments-open'>{P}</article>", [LONG]),
        (f"<form id='f'><div class='sidebar-wrap'><div>{P}{P}</div><div class='comments'>{P}</div></div><div class='footer'>{LONG}</div></form>", [LONG, LONG]),
        (f"<div>{P}<div><a>More</a> <a>Tags</a> <a>Log in</a></div>{P}</div>", [LONG, LONG]),
        (f"<div>{P}<ul><li><a>More</a><li><a>Tags</a></ul>{P}<p><a>One link of the text</a></p>{P}</div>", [LONG, LONG, "One link of the text", LONG]),
        # true sidebars, comments and forms stay out, however long they are
        (f"<div>{P}</div><div class='sidebar'>{P * 3}</div>", [LONG]),
        (f"<article><p>Short.</p></article><div class='sidebar'>{P * 9}</div>", ["Short."]),
        (f"<div class='comments'>{P * 3}</div>", []),
        (f"<form><input><label>Name</label></form>{P}", [LONG]),
        (f"<div class='sidebar'><article><h3>Card</h3><p>teaser</p></article></div><div>{P * 3}</div>", [LONG] * 3),
        (f"<article>{P}<article class='comment'>{P}</article></article><article class='comment-body'>{P}</article>", [LONG]),
    ],
)
def test_wrappers_and_parts(html, want):
    assert extract.main_text(html) == "\n".join(want)


def test_clusters_by_brute_force():
    """Ratios, smoothing and threshold by plain sums, on pages without marks, links and names."""
    rng = random.Random(7)
    for _ in range(80):
        texts = [" ".join(rng.choice(["alpha", "be", "gamma", "delta"]) for _ in range(rng.choice([1, 2, 3, 30, 60]))) for _ in range(rng.randrange(1, 25))]
        inner = [rng.randrange(0, 4) for _ in texts]
        html = "".join(f"<p>{'<i></i>' * k}{t}</p>" for t, k in zip(texts, inner, strict=True))
        ratios = [len(t) / (1 + 2 * k) for t, k in zip(texts, inner, strict=True)]  # its own start tag, and the tags within
        smooth = []
        for k in range(len(texts)):
            near = [(math.exp(-((j - k) ** 2) / 2), r) for j, r in enumerate(ratios) if abs(j - k) <= 2]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        least = min(statistics.pstdev(smooth), max(smooth))
        over = [k for k, r in enumerate(smooth) if r >= least - 1e-9]
        assert extract.main_text(html) == "\n".join(texts[over[0] : over[-1] + 1])


@pytest.mark.parametrize("html", ["<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<div class='sidebar'>" * 20_000 + "x", "<p>y</p>" + "<a " * 50_000, "<form>" * 20_000, "<p>y</p>" + "<!--" * 50_000])
def test_odd_pages_take_linear_time(html):
    start = time.time()
    extract.main_text(html)
    assert time.time() - start < 5
