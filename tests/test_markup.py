from __future__ import annotations

import random

from scorebook.sources import markup

NESTED = """<!DOCTYPE html><html><body>
<TABLE class="outer"><tr><td>a</td><td>b <table id="in"><tr><td>x</td><td>y</td></tr></table> c</td></tr>
<tr><th>h</th><td></td></tr></TABLE><p>after</p></body></html>"""


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def shape(rows):
    return [(r.name, r.depth, r.parent, r.close) for r in sorted(rows, key=lambda r: r.pos)]


def test_a_table_in_a_cell_does_not_end_the_outer_one(spark):
    found = sorted(markup.elements(pages(spark, NESTED), "table").collect(), key=lambda r: r.pos)
    assert [r.attributes.strip() for r in found] == ['class="outer"', 'id="in"']
    assert found[0].inner.endswith("<td></td></tr>") and found[1].inner == "<tr><td>x</td><td>y</td></tr>"
    assert found[1].depth == found[0].depth + 3
    cells = sorted(markup.table_cells(pages(spark, NESTED)).collect(), key=lambda r: r.cell)
    assert [(r.table == found[0].pos, r.inner[:3]) for r in cells] == [
        (True, "a"), (True, "b <"), (False, "x"), (False, "y"), (True, "h"), (True, "")
    ]


def test_depth_and_parent(spark):
    got = shape(markup.tree(pages(spark, "<div><p>a<br>b</p><div><img src=x></div></div><p>c</p>")).collect())
    assert got == [("div", 0, None, 7), ("p", 1, 0, 3), ("br", 2, 1, None), ("div", 1, 0, 6), ("img", 2, 4, None), ("p", 0, None, 9)]


def test_unclosed_crossing_and_stray_tags(spark):
    texts = ["<ul><li>a<li>b</li></ul>", "</p><p>x</p></p><p>y</p>", "<b><i>x</b></i>", "<div/><span>t</span>", "<p", "", None, "<1> a < b > c"]
    by = {}
    for r in markup.tree(pages(spark, *texts)).collect():
        by.setdefault(r.page_id, []).append(r)
    assert shape(by[0]) == [("ul", 0, None, 4), ("li", 1, 0, None), ("li", 1, 0, 3)]
    assert [(n, d, c) for n, d, _, c in shape(by[1])] == [("p", 0, 2), ("p", 0, 5)]
    assert shape(by[2]) == [("b", 0, None, 2), ("i", 1, 0, 3)]
    assert shape(by[3]) == [("div", 0, None, None), ("span", 0, None, 2)]
    assert set(by) == {0, 1, 2, 3}


def test_scripts_styles_and_comments_hold_no_markup(spark):
    text = "<div><!-- </div> <b> --><script>var a = '</div><p>';</script><style>p{}</style><p>x</p></div>"
    assert [(r[0], r[1]) for r in shape(markup.tree(pages(spark, text)).collect())] == [
        ("div", 0), ("script", 1), ("style", 1), ("p", 1)
    ]


def plain(text):
    """A stack of the random, well-nested page below."""
    out, stack, pos, i = [], [], -1, 0
    while i < len(text):
        if text[i] == "<":
            pos += 1
            end = text.index(">", i)
            tag = text[i + 1 : end]
            if tag[0] == "/":
                out[stack.pop()][3] = pos
            else:
                out.append([tag, len(stack), out[stack[-1]][4] if stack else None, None, pos])
                stack.append(len(out) - 1)
            i = end
        i += 1
    return [tuple(r[:4]) for r in out]


def build(r, depth=0):
    if depth > 5 or r.random() < 0.2:
        return r.choice(["text", "a &amp; b", "日本", ""])
    tag = r.choice(["table", "tr", "td", "div", "p"])
    return f"<{tag}>" + "".join(build(r, depth + 1) for _ in range(r.randint(0, 3))) + f"</{tag}>"


def test_random_nested_pages_equal_a_stack(spark):
    r = random.Random(3)
    texts = ["".join(build(r) for _ in range(4)) for _ in range(40)]
    by = {}
    for row in markup.tree(pages(spark, *texts).repartition(4)).collect():
        by.setdefault(row.page_id, []).append(row)
    for i, text in enumerate(texts):
        assert shape(by.get(i, [])) == plain(text)


def test_inner_text_by_characters(spark):
    found = markup.elements(pages(spark, "<p>日本👩語</p> ü <p>x<b>y</b></p>"), "p").collect()
    assert sorted(r.inner for r in found) == ["x<b>y</b>", "日本👩語"]
