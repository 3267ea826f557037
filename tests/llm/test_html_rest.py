"""Wrapper induction leaves nothing out on hosts of many layouts and in long lists."""

import random

from linkforge.llm import html_extract

SCHEMA = "page_id long, url string, html string"
TAGS = "div section ul ol dl blockquote center address figure details dir fieldset".split()


def texts(spark, rows):
    got = html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    return sorted((r.page_id, r.text) for r in got)


def test_every_layout_has_its_reference(spark):
    """Twelve layouts: four more than all pages of a host are given. Copies of rows stay rows."""
    assert len(TAGS) > html_extract.LAYOUTS
    rows = []
    for k, tag in enumerate(TAGS):
        for i in range(12):
            page = f"<html><body><{tag}><div>Offer {k} for all</div><div>Story {k} {i}</div></{tag}></body></html>"
            rows.append((100 * k + i, f"http://many.example.org/{k}/{i}", page))
    rows += [(i, f"http://other.example.org/{i}", f"<html><body><p>Join us now</p><p>Word {i}</p></body></html>") for i in range(5000, 5012)]
    rows += rows[-20:] + rows[:3] + [(9000, "http://many.example.org/rare", "<html><body><main><p>Offer 3 for all</p></main></body></html>")]
    want = {p: f"Story {p // 100} {p % 100}" if p < 5000 else f"Word {p}" for p, _, _ in rows} | {9000: "Offer 3 for all"}
    assert texts(spark, rows) == sorted((p, want[p]) for p, _, _ in rows)


def test_template_in_the_middle_of_long_lists(spark):
    """The eighth of 8 to 60 like siblings is folded with its neighbours on most pages."""
    rows, want = [], []
    for i in range(40):
        r = random.Random(i)
        lines = [f"Line {k} of story {i} {r.random()}" for k in range(r.choice([7, 9, 14, 30, 59]))]
        want.append((i, "\n".join(lines)))
        rows.append((i, f"http://long.example.org/{i}", "<div>" + "".join(f"<p>{x}</p>" for x in [*lines[:7], "Read on for free", *lines[7:]]) + "</div>"))
    assert texts(spark, rows) == want


def test_lists_without_single_ends(spark):
    """Over MOST_NODES nodes all like siblings are folded; a text in most lists is template, the others stay."""
    rows, want = [], []
    for i in range(12):
        cells = [[f"Cell {i} {k} {j}" for j in range(9)] for k in range(90)]
        want.append((i, "\n".join(x for row in cells for x in row)))
        body = "".join("<section>" + "".join(f"<div>{x}</div>" for x in [*row[:4], "Top of page", *row[4:]]) + "</section>" for row in cells)
        rows.append((i, f"http://wide.example.org/{i}", f"<html><body>{body}</body></html>"))
    assert texts(spark, rows) == want
