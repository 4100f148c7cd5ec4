import random
import time

import pytest

from tessera.llm import html
from tessera.llm.html import Block

PLAIN = """<html><body><div><div><a href=/a>Start of it</a> <a href=/b>Shop</a></div></div>
<div><div>A heading here</div><div>The cat sat on the mat and it was of the best kind that is to be had in that town.</div>
<div>It is so.</div><div>And the dog was in the garden for the most of the day, as it is to this day, with a bone.</div></div>
<div><div>Copyright Acme Widgets Incorporated, Springfield Branch Office, Reserved Rights, Imprint, Sitemap</div><div>Version 2</div></div></body></html>"""


def test_density_alone_decides_without_class_names(monkeypatch):
    want = ["A heading here", "The cat sat on the mat and it was of the best kind that is to be had in that town.", "It is so.",
            "And the dog was in the garden for the most of the day, as it is to this day, with a bone."]
    assert html.main_text(PLAIN).split("\n\n") == want
    monkeypatch.setattr(html, "STOP_WORDS", frozenset())
    assert html.main_text(PLAIN) == ""


def test_links_and_length_decide():
    linked = "<p>The one and the other of it are <a>to be had in the shop that is on the corner of the street by the river</a></p>"
    assert html.main_text(linked) == ""
    assert [html.decide(Block(text=t, ground=g)) for t, g in (("the " * 20, 0), ("stone " * 20, 0), ("stone " * 20, 1), ("the", 0))] == ["good", "bad", "", ""]
    assert html.decide(Block(text="the " * 20, bad=True)) == "bad" and html.decide(Block(text="© the " * 20)) == "bad"


def brute(found):
    first = [html.decide(b) for b in found]
    out = []
    for i, b in enumerate(found):
        label = first[i]
        scopes = [lambda j: found[j].path == b.path and not found[j].bad, lambda j: found[j].ground == b.ground]
        for inside in scopes + ([] if b.ground else [lambda j: True]):
            decided = [(abs(i - j), j < i, first[j]) for j in range(len(found)) if first[j] and inside(j)]
            if not label and decided:
                label = min(decided)[2]
        out.append(label or "good")
    return out


def test_open_blocks_take_the_nearest_decided_label():
    r = random.Random(7)
    for _ in range(500):
        found = [Block(text=r.choice(["short", "the cat and of it " * 9, "stone river cloud " * 9]), path=r.randint(0, 3), bad=r.random() < 0.1,
                       ground=r.choice([0, 0, 5]), heading=r.random() < 0.1) for _ in range(r.randint(0, 14))]
        assert [b.label for b in html.classify(found)] == brute(found)


@pytest.mark.parametrize("page", ["<p>short one</p>" * 16000, "<div>" * 16000 + "x", "<div><p>" + "the cat and of it " * 5 + "</p></div>" + "<li>x" * 16000])
def test_long_pages_take_linear_time(page):
    start = time.time()
    html.main_text(page)
    assert time.time() - start < 8  # a quadratic pass took a minute


def test_math_stays_and_modifiers_do_not_hide_a_page():
    page = '<div class="with-sidebar"><p>The sum of the two is <math><mi>a</mi>+<mi>b</mi></math> and that is it for the day and for the night.</p></div>'
    assert html.main_text(page) == "The sum of the two is a+b and that is it for the day and for the night."
    assert html.main_text('<div class="left-sidebar"><p>' + "the cat and of it " * 9 + "</p></div>") == ""


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, PLAIN, "own"), (1, PLAIN, "own"), (None, None, None), (2, "<p>" + "the cat and of it " * 20000, "x")], "page_id long, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r["page_id"] or 0, len(r["text"])) for r in got) == sorted([(0, 0), (1, len(html.main_text(PLAIN))), (1, len(html.main_text(PLAIN))), (2, 18 * 20000 - 1)])
    assert html.extract(df.limit(0)).columns == df.columns and html.extract(df.limit(0)).count() == 0
