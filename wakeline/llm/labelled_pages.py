"""Labelled pages for the page model, written by hand: data-keep="1" marks content, "0" takes parts out again.

The layouts vary what real sites vary: where the article sits, how parts are named, which parts look like
prose without being the article. The words do not matter to the model, only their number and links.
"""

from __future__ import annotations

LONG = (
    "The river rose in the night and by morning the lower fields were under water, so the farmers moved "
    "their animals to the hill. Nobody had expected it. The town council met at noon and agreed on a plan."
)
MID = "It was the third flood in ten years, and the old bridge did not survive it."
SHORT = "A quiet day."
WORD = "Rain."


def links(*names: str) -> str:
    return "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)


def linked(n: int, text: str = "Read about the other towns here") -> str:
    return "".join(f'<li><a href="/s{k}">{text}</a></li>' for k in range(n))


NAV = f"<nav><ul>{links('Home', 'News', 'Sport', 'About us')}</ul></nav>"
PROSE = f"<h1>{MID}</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG} {LONG}</p><p>{WORD}</p><p>{MID}</p>"

PAGES = [
    # an article element among the usual parts
    f'<body>{NAV}<div class="ad">{MID}</div><article data-keep="1">{PROSE}</article><footer>&copy; example &middot; {MID}</footer>',
    f'<body><header><h1>Daily Post</h1><p>{SHORT}</p></header>{NAV}<main><article data-keep="1">{PROSE}'
    f'<h2>{SHORT}</h2><ul><li>{MID}</li><li>{WORD}</li></ul></article></main>'
    f'<aside><h3>Most read</h3><ul>{linked(3)}</ul><p>{MID}</p></aside><footer><p>{LONG}</p></footer>',
    f'<body><div id="cookie-notice" class="notice cookie"><p>{LONG}</p><button>Accept</button></div>{NAV}'
    f'<article data-keep="1">{PROSE}<blockquote><p>{MID}</p></blockquote></article>'
    f'<section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div>'
    f'<div class="comment"><p>{SHORT}</p></div></section><footer>{SHORT}</footer>',
    f'<body><header class="site-header">{NAV}</header><div class="sidebar"><p>{LONG}</p><ul>{linked(4)}</ul></div>'
    f'<article data-keep="1">{PROSE}<div class="advert" data-keep="0"><p>{MID}</p></div><p>{LONG}</p></article>'
    f'<form action="/subscribe"><label>Your address</label><p>{MID}</p><input name="q"><button>Send</button></form>',
    f'<body>{NAV}<article data-keep="1">{PROSE}<p>{LONG}</p><div class="share" data-keep="0"><a href="/x">Share this</a></div>'
    f'<div class="comments" data-keep="0"><p>{LONG}</p><p>{MID}</p></div></article><div class="banner">{SHORT}</div>',
    # no article element
    f'<body><div id="header"><h1>Daily Post</h1></div><div id="menu"><ul>{links("One", "Two", "Three")}</ul></div>'
    f'<div id="content" data-keep="1">{PROSE}</div><div id="sidebar"><h3>Links</h3><ul>{linked(5)}</ul><p>{MID}</p></div>'
    f'<div id="footer"><p>{MID}</p></div>',
    f'<body><div class="navbar"><a href="/">Home</a> <a href="/a">All</a></div><div class="wrapper"><div class="post" data-keep="1">'
    f'{PROSE}<p>{LONG}</p></div><div class="related"><h3>More</h3><ul>{linked(4)}</ul></div>'
    f'<div class="ads"><p>{LONG}</p></div></div><div class="copyright">{SHORT}</div>',
    f'<body><main data-keep="1">{PROSE}<table><tr><td>{WORD}</td><td>{SHORT}</td></tr></table></main>'
    f'<aside class="widget"><p>{LONG}</p></aside><footer>{NAV}<p>{SHORT}</p></footer>',
    f'<body><div class="top"><ul class="menu">{links("A", "B", "C", "D")}</ul></div><div class="entry-content story" data-keep="1">'
    f'<h2>{SHORT}</h2><p>{LONG}</p><p>{LONG}</p><pre>{MID}</pre></div><div class="newsletter subscribe"><p>{MID}</p></div>'
    f'<div class="disclaimer notice">{LONG}</div>',
    f'<body><div role="navigation"><a href="/1">Start</a></div><div class="page"><div class="text body" data-keep="1">{LONG}<br>{MID}'
    f'<p>{LONG}</p></div></div><div class="sponsored promo"><p>{MID}</p></div><div role="contentinfo">{SHORT}</div>',
    f'<body><div class="alert warning notice">{MID}</div><section class="article" data-keep="1">{PROSE}</section>'
    f'<section class="discussion"><ol class="comment-list"><li class="comment"><p>{LONG}</p></li><li class="comment reply"><p>{MID}</p></li></ol>'
    f'<form class="comment-form"><p>{SHORT}</p><textarea>{MID}</textarea></form></section>',
    # articles with parts inside
    f'<body>{NAV}<article data-keep="1"><h1>{SHORT}</h1><p>{LONG}</p><figure><img src="a"><figcaption>{MID}</figcaption></figure>'
    f'<nav data-keep="0"><ul>{links("Part 1", "Part 2")}</ul></nav><p>{MID}</p><aside data-keep="0"><p>{LONG}</p></aside>'
    f'<form data-keep="0"><p>{MID}</p></form><p>{LONG}</p><footer data-keep="0"><p>{MID}</p></footer></article>',
    f'<body><article data-keep="1">{PROSE}<p>{SHORT}</p><ol><li>{MID}</li><li>{LONG}</li></ol><h3>{WORD}</h3><p>{MID}</p></article>'
    f'<div class="advertisement"><p>{LONG}</p></div><div class="sidebar-right"><p>{SHORT}</p></div>',
    f'<body>{NAV}<div class="ad">{LONG}</div><article data-keep="1"><h1>{WORD}</h1><p>{WORD}</p><p>{SHORT}</p></article>'
    f'<div class="ad">{LONG}</div><aside>{LONG}</aside><footer>{LONG}</footer>',
    f'<body><div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></div><article class="post" data-keep="1">'
    f'<h1>{MID}</h1><p><a href="/x">{SHORT}</a> {LONG}</p><p>{MID} <a href="/y">{WORD}</a></p></article>'
    f'<div class="tags"><a href="/t">flood</a> <a href="/u">river</a></div><div class="popup modal"><p>{LONG}</p></div>',
    f'<body>{NAV}<main><article data-keep="1"><header><h1>{MID}</h1><p class="byline">{SHORT}</p></header><div class="section">'
    f'<h2>{SHORT}</h2><p>{LONG}</p></div><div><div>{LONG}</div><p>{MID}</p></div><ul><li>{WORD}</li></ul></article></main>'
    f'<aside class="sidebar"><h3>Related</h3><p>{LONG}</p></aside><div class="cookie-banner">{MID}</div>'
    f'<section class="comments"><h2>Reader comments</h2><div class="comment"><p>{LONG}</p></div></section>'
    f'<form><p>{SHORT}</p><input></form><footer>{WORD}</footer>',
    f'<body>{NAV}<article class="article" data-keep="1"><section><h2>{SHORT}</h2><p>{LONG}</p><p>{WORD}</p></section><section><h2>{WORD}</h2>'
    f'<div class="text"><p>{MID}</p><div>{SHORT}</div></div></section><div class="body"><p>{LONG}</p></div></article><footer>{MID}</footer>',
    f'<body><header><h1>Post</h1></header><main><article data-keep="1"><div class="article-header"><h1>{MID}</h1></div><div class="article-body">'
    f'{PROSE}<figure><figcaption>{SHORT}</figcaption></figure></div></article></main><div class="consent gdpr"><p>{LONG}</p></div>',
    # pages without named parts
    f'<body data-keep="1"><h1>{SHORT}</h1><p>{LONG}</p><p>{MID}</p><p>{LONG}</p></body>',
    f'<body><p data-keep="1">{LONG}</p><p data-keep="1">{SHORT}</p><p data-keep="1">{MID}</p><div class="footer">{SHORT}</div>',
    f'<body><div class="menu">{SHORT}</div><div data-keep="1"><p>{LONG}</p><div><p>{MID}</p></div></div><div class="footer">{MID}</div>',
    f'<div data-keep="1"><h2>{WORD}</h2><p>{LONG}</p><p>{WORD}</p></div><ul>{linked(4)}</ul>',
    # no content at all
    f"<body>{NAV}<div class='ad'>{MID}</div><footer>{SHORT}</footer>",
    f'<body><form id="login"><label>Name</label><input><p>{SHORT}</p></form><div class="footer"><ul>{linked(3)}</ul></div>',
]

# Layouts without named parts, with other neighbours, so that bare paragraphs weigh as much as named ones.
PAGES += [
    f'<html><head><title>{SHORT}</title></head><body data-keep="1"><p>{LONG}</p></body></html>',
    f'<p data-keep="1">{LONG}</p><p data-keep="1">{MID}</p>',
    f'<body><div class="nav">{links("A", "B")}</div><h1 data-keep="1">{SHORT}</h1><p data-keep="1">{LONG}</p><p data-keep="1">{WORD}</p><div class="footer">{SHORT}</div>',
    f'<body><table><tr><td><a href="/">Home</a></td><td data-keep="1"><h2>{SHORT}</h2><p>{LONG}</p><p>{MID}</p></td></tr></table></body>',
]

# Layouts whose parts are named in other languages or by roles, or not named at all. Each tuple names, in this order,
# the top, the menu, the text, the side column, the advert, the comments and the bottom of a page.
PART_NAMES = [
    ("kopf", "navigation", "inhalt", "seitenleiste", "werbung", "kommentare", "fuss"),
    ("entete", "menu", "contenu", "barre laterale", "publicite", "commentaires", "pied"),
    ("cabecera", "menu", "contenido", "barra lateral", "publicidad", "comentarios", "pie"),
    ("testata", "menu", "contenuto", "colonna", "pubblicita", "commenti", "fondo"),
    ("masthead", "toolbar", "primary", "secondary", "sponsor", "replies", "colophon"),
    ("hd", "nv", "bd", "sd", "pr", "rp", "ft"),
    ("", "", "", "", "", "", ""),
]


def layouts(top: str, menu: str, text: str, side: str, advert: str, comments: str, bottom: str) -> list[str]:
    """A few pages with parts of these names."""
    entries = f'<div class="{menu}"><ul>{links("Home", "News", "Sport")}</ul></div>'
    notes = f'<ol class="{comments}"><li><p>{MID}</p></li><li><p>{LONG}</p></li></ol>'
    return [
        f'<body><div class="{top}"><span>Daily Post</span></div>{entries}<div class="{text}" data-keep="1">{PROSE}</div>'
        f'<div class="{side}"><h4>{WORD}</h4><ul>{linked(4)}</ul></div><div class="{bottom}"><p>&copy; {SHORT}</p></div>',
        f'<body><div class="{top}">Daily Post</div><div class="{text}"><p data-keep="1">{LONG}</p></div><div class="{bottom}">{SHORT}</div>',
        f'<body><div id="{top}">{entries}</div><div id="{text}" data-keep="1"><h2>{SHORT}</h2><p>{LONG}</p><p>{MID}</p><p>{LONG}</p>'
        f'<div class="{advert}" data-keep="0"><a href="/buy">{SHORT}</a></div><p>{LONG}</p></div>'
        f'<div id="{side}"><p>{SHORT}</p><ul>{linked(3)}</ul></div><div id="{bottom}"><a href="/">Home</a> {SHORT}</div>',
        f'<body>{entries}<main><p data-keep="1">{LONG}</p></main>{notes}<div class="{bottom}"><a href="/about">About us</a></div>',
        f'<body><section class="{text}" data-keep="1"><h1>{SHORT}</h1><p>{LONG} {LONG}</p><p>{LONG}</p></section>'
        f'<section><h2>{WORD}</h2>{notes}</section><div class="{advert}">{SHORT}</div>',
    ]


for names in PART_NAMES:
    PAGES += layouts(*names)

PAGES += [
    # roles in place of elements
    f'<body><div role="banner">Daily Post</div><div role="navigation"><ul>{links("A", "B", "C")}</ul></div><div role="main" data-keep="1"><p>{LONG}</p></div>'
    f'<div role="complementary"><p>{MID}</p><ul>{linked(3)}</ul></div><div role="contentinfo">{SHORT}</div>',
    f'<body><div role="navigation">{links("A", "B")}</div><div role="main" data-keep="1">{PROSE}</div><div role="complementary"><p>{LONG}</p></div>',
    f'<body><div role="search"><p>{SHORT}</p></div><div role="article" data-keep="1"><h1>{MID}</h1><p>{LONG}</p></div><div role="contentinfo"><p>{MID}</p></div>',
    # the header of an article belongs to it, that of a page does not
    f'<body><article data-keep="1"><header><h1>{MID}</h1></header><p>{LONG}</p><p>{SHORT}</p></article><footer>{SHORT}</footer>',
    f'<body><header><p>{SHORT}</p></header>{NAV}<article data-keep="1"><header><h1>{SHORT}</h1><p>{WORD}</p></header><p>{LONG}</p><p>{MID}</p></article>',
    f'<body><main><article data-keep="1"><header class="entry"><h2>{WORD}</h2><p class="author">{SHORT}</p></header><div>{PROSE}</div></article></main><footer>{SHORT}</footer>',
    f'<body><header><h1>Daily Post</h1></header><main data-keep="1"><p>{LONG}</p></main><footer><p>{MID}</p></footer>',
    f'<body>{NAV}<main data-keep="1"><p>{MID}</p></main><section class="comments"><div><p>{LONG}</p></div></section>',
]
