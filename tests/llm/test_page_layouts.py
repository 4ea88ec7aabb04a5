"""Main text on layouts that the page model was not trained on."""

from __future__ import annotations

import time
from collections import Counter

import pytest

from wakeline.llm import page_text

PROSE = (
    "The committee published its report on Tuesday after a year of hearings. It lists the causes of the fire and names three firms.",
    "Neighbours said that they had warned the owners twice. A spokesman did not answer our questions, but promised a statement.",
    "Two further hearings are planned for the spring, when the court will decide who has to pay for the repairs.",
)
TITLE, SHORT = "A report on the fire", "Nobody was hurt."
LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Start", "World", "Money", "Travel"))
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
WHOLE = [TITLE, *PROSE]

#: (page, blocks of its text): names in Portuguese, Polish, Dutch, Turkish, made up by a build tool, or none.
HELD_OUT = [
    (f'<body><div class="topo">Jornal</div><ul class="navegacao">{LINKS}</ul><div class="materia">{BODY}</div><div class="rodape"><p>{SHORT}</p></div>', WHOLE),
    (f'<body><div id="naglowek">Gazeta</div><div id="tresc">{BODY}</div><div id="bok"><ul>{LINKS}</ul></div><div id="stopka">{SHORT}</div>', WHOLE),
    (f'<body><div class="css-1a2b"><ul>{LINKS}</ul></div><div class="css-9zk"><div class="css-77"><h2>{TITLE}</h2><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div></div><div class="css-x1">{SHORT}</div>', [TITLE, *PROSE[:2]]),
    (f'<body><div class="koptekst">Krant</div><div class="hoofdtekst"><p>{PROSE[0]}</p></div><div class="voettekst"><a href="/">Start</a></div>', [PROSE[0]]),
    (f'<body><div role="banner">Paper</div><div role="main"><h1>{TITLE}</h1><p>{PROSE[1]}</p></div><div role="complementary"><p>{PROSE[2]}</p></div>', [TITLE, PROSE[1]]),
    (f'<body><div class="icerik"><p>{PROSE[0]}</p><p>{PROSE[1]}</p><p>{PROSE[2]}</p></div><ul>{LINKS}</ul>', list(PROSE)),
    (f'<body><main><p>{PROSE[0]}</p></main><ol class="replies"><li><p>{SHORT}</p></li></ol>', [PROSE[0]]),
    (f'<body><header><h1>Paper</h1></header><article><header><h1>{TITLE}</h1></header><p>{PROSE[0]}</p><p>{SHORT}</p></article><footer>{SHORT}</footer>', [TITLE, PROSE[0], SHORT]),
    (f'<body><nav>{LINKS}</nav><section>{BODY}<aside><p>{SHORT}</p></aside></section><footer><p>{PROSE[0]}</p></footer>', WHOLE),
    (f'<body><table><tr><td><ul>{LINKS}</ul></td><td>{BODY}</td></tr></table>', WHOLE),
    (f'<body><div class="qq"><div class="qa">{BODY}</div><div class="qb"><ul>{LINKS}</ul></div></div><form><p>{PROSE[2]}</p><input></form>', WHOLE),
    (f'<body><nav><ul>{LINKS}</ul></nav><div class="cookie-consent"><p>{PROSE[2]}</p></div><div class="bloque">{BODY}</div>', WHOLE),
]
EMPTY = [
    f"<body><nav><ul>{LINKS}</ul></nav><div class='ad'>{SHORT}</div><footer>{SHORT}</footer>",
    f"<body><ul>{LINKS}</ul><form><label>Name</label><input></form>",
]


@pytest.fixture(scope="module")
def model():
    return page_text.train()


def test_held_out_layouts(model):
    hit = found = wanted = 0
    for page, blocks in HELD_OUT:
        got = Counter(page_text.main_text(page, model).split())
        want = Counter(" ".join(blocks).split())
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    f1 = 2 * hit / (found + wanted)
    assert f1 >= 0.95, f1
    assert [page_text.main_text(p, model) for p in EMPTY] == ["", ""]


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="kopf">Zeitung</div><div class="inhalt"><p>{PROSE[0]}</p></div>',
        f'<body><div role="navigation"><ul>{LINKS}</ul></div><div role="main"><p>{PROSE[0]}</p></div><div role="complementary"><p>{SHORT}</p></div>',
        f'<body><main><p>{PROSE[0]}</p></main><ol class="replies"><li>{SHORT}</li></ol>',
    ],
)
def test_one_paragraph_is_not_lost(model, page):
    assert page_text.main_text(page, model) == PROSE[0]


def test_header_of_an_article_stays_whole(model):
    page = f'<body><article><header><h1>{TITLE}</h1><p class="byline">By Ann.</p></header><p>{PROSE[0]}</p></article>'
    assert page_text.main_text(page, model) == "\n\n".join((TITLE, "By Ann.", PROSE[0]))


def test_deep_pages_take_linear_time():
    def seconds(n: int) -> float:
        start = time.perf_counter()
        nodes = page_text.parse("<div>" * n + "x" + "</p><p>y" * n)
        assert len(nodes) == 3 * n + 2
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(80_000) < 12 * max(seconds(16_000), 0.02)


def test_end_tags_close_what_they_name():
    shape = lambda page: [(x.tag, x.names if x.text else "", x.text) for x in page_text.parse(page)[1:]]
    assert shape("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == [
        ("ul", "", ""), ("li", "", ""), ("#text", "li", "a"), ("li", "", ""), ("#text", "li", "b"),
        ("ul", "", ""), ("li", "", ""), ("#text", "li", "c"), ("#text", "li", "d"),
    ]
    assert shape("<p>a<div>b</section></div>c") == [("p", "", ""), ("#text", "p", "a"), ("div", "", ""), ("#text", "div", "b"), ("#text", "#page", "c")]
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>") == [
        ("table", "", ""), ("tr", "", ""), ("td", "", ""), ("#text", "td", "a"), ("td", "", ""), ("#text", "td", "b"),
        ("tr", "", ""), ("td", "", ""), ("#text", "td", "c"),
    ]
