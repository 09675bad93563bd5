"""Pages whose containers have telling class names, pages without article, and what the weights drop."""

import pytest

from graphloom.llm.html_text import main_text

BODY = [f"Sentence {k} of the story goes on for a while, with commas, and ends here. It has a second part, too, so it is long." for k in range(6)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "page-with-comments", "legal-text", "share", "widget"])
def test_container_with_most_text_stays(name):
    assert main_text(f"<body><div class='{name}'>{PARAGRAPHS}</div></body>") == "\n\n".join(BODY)
    assert main_text(f"<body><div id='{name}'><div><h1>Title</h1>{PARAGRAPHS}</div></div></body>") == "\n\n".join(["Title", *BODY])


def test_weights_drop_light_paths():
    page = f"<body><div><span>Home</span></div><div>{PARAGRAPHS}</div><div><ul><li><a href=x>More</a></li><li><a href=y>Else</a></li></ul></div><table><tr><td>Printed 2020</td></tr></table></body>"
    assert main_text(page) == "\n\n".join(BODY)


def test_short_blocks_between_and_siblings_stay():
    page = f"<body><div>{PARAGRAPHS}<h2>Next</h2><ul><li>one</li></ul></div><section><p>{BODY[0]}</p></section></body>"
    assert main_text(page) == "\n\n".join([*BODY, "Next", "one", BODY[0]])


def test_named_asides_are_left_out():
    aside = "<div class='sidebar'><p>Subscribe now, it is cheap, and good for you.</p></div>"
    assert main_text(f"<body><div class='layout has-sidebar'>{aside}{PARAGRAPHS}{aside}</div></body>") == "\n\n".join(BODY)


CLOSING = {
    "ul": "<ul><li>first point</li><li>second point</li></ul>", "blockquote": "<blockquote>As they say.</blockquote>", "pre": "<pre>print(1)</pre>",
    "table": "<table><tr><td>a</td><td>b</td></tr></table>",
}


@pytest.mark.parametrize("shape", sorted(CLOSING))
@pytest.mark.parametrize("place", ["behind", "before"])
def test_closing_and_leading_blocks_of_a_container(shape, place):
    parts = {"ul": ["first point", "second point"], "blockquote": ["As they say."], "pre": ["print(1)"], "table": ["a", "b"]}[shape]
    inner = PARAGRAPHS + CLOSING[shape] if place == "behind" else CLOSING[shape] + PARAGRAPHS
    want = [*BODY, *parts] if place == "behind" else [*parts, *BODY]
    assert main_text(f"<body><div><a href=x>Home</a></div><div>{inner}</div><div><a href=y>Imprint</a></div></body>") == "\n\n".join(want)


def test_a_lead_and_a_closing_paragraph():
    assert main_text(f"<body><div><div>Our man abroad</div>{PARAGRAPHS}</div></body>") == "\n\n".join(["Our man abroad", *BODY])
    assert main_text(f"<body><div>{PARAGRAPHS}</div><p>The end.</p></body>") == "\n\n".join([*BODY, "The end."])
    assert main_text(f"<body><div>{PARAGRAPHS}</div><p class='copyright'>All rights reserved.</p><div>Bottom</div></body>") == "\n\n".join(BODY)
    assert main_text(f"<body><div>{PARAGRAPHS}<p><a href=a>One</a> <a href=b>Two</a></p></div></body>") == "\n\n".join(BODY)


def _plain_weights(nodes):
    """Fused weights of (path, text, share of links): length a node times marks a node, and the same smoothed over the order of nodes."""
    import math

    by = {}
    for k, (path, _, _) in enumerate(nodes):
        by.setdefault(path, []).append(k)
    n = len(nodes)
    length, marks, links = [0.0] * n, [0.0] * n, [0.0] * n
    for rows in by.values():
        chars = sum(len(nodes[k][1]) for k in rows)
        for k in rows:
            length[k] = chars / len(rows)
            marks[k] = sum(c in ".,;:!?" for j in rows for c in nodes[j][1]) / len(rows)
            links[k] = sum(len(nodes[j][1]) * nodes[j][2] for j in rows) / chars

    def smooth(x):
        out = []
        for k in range(n):
            near = [(j, math.exp(-((j - k) ** 2) / 2)) for j in range(max(0, k - 2), min(n, k + 3))]
            out.append(sum(x[j] * w for j, w in near) / sum(w for _, w in near))
        return out

    flat, peaks = smooth(length), smooth(marks)
    fused = [math.sqrt(length[k] * (1 + marks[k]) * flat[k] * (1 + peaks[k])) * (1 - links[k]) for k in range(n)]
    return [sum(fused[j] for j in by[p]) / len(by[p]) for p, _, _ in nodes]


def test_weights_equal_a_plain_computation():
    from graphloom.llm.html_text import blocks, path_weights

    page = f"<body><div><a href=x>Home</a> page</div><div>{PARAGRAPHS}<ul><li>one, two</li><li>three <a href=z>four</a></li></ul></div><div>Bottom: it ends.</div></body>"
    found = blocks(page)
    want = _plain_weights([(e.path, text, linked) for e, text, linked in found])
    assert path_weights(found) == pytest.approx(want)
