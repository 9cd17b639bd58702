"""Labelled pages: hand-written layouts whose text blocks are marked as main text or not.

In a layout {T} {P} {S} stand for a title, a paragraph and a short line of the main
text, {l} {n} {p} for a link, a note and a paragraph that do not belong to it. What
stands between [[ and ]] is repeated. The words that fill the places are drawn from
syllables, so only markup and the shape of the text can be learned.
"""

from __future__ import annotations

import random
import re

MARK = "\ue000"

MENU = '<ul>[[<li><a href="/x">{l}</a></li>]]</ul>'
COMMENT = '<div class="comment"><span class="author">{l}</span><p>{p}</p><a href="#r">{l}</a></div>'
FORM = '<form action="/s"><label>{n}</label><input name="q"><button>{n}</button></form>'

LAYOUTS = [
    # News and blog pages with semantic elements.
    f"<body><nav>{MENU}</nav><div class='ad'>{{p}}</div><article><h1>{{T}}</h1><p>{{P}}</p>[[<p>{{P}}</p>]]</article><footer>{{p}}</footer>",
    f"<body><header><a href='/'>{{l}}</a><nav>{MENU}</nav></header><main><article><h1>{{T}}</h1>[[<p>{{P}}</p><p>{{S}}</p>]]</article></main><aside><h3>{{n}}</h3>{MENU}<p>{{p}}</p></aside><footer><p>{{n}}</p>{MENU}</footer>",
    f"<body><div class='cookie-notice'>{{p}}<button>{{n}}</button></div><header class='site-header'><h2>{{n}}</h2></header><article class='post'><header><h1>{{T}}</h1></header><p><b>{{P}}<br>[[<p>{{P}}]]<blockquote>{{P}}</blockquote><div class='share'>[[<a href='/s'>{{l}}</a>]]</div></article><section class='comments'><h2>{{n}}</h2>[[{COMMENT}]]{FORM}</section><footer>&copy; {{n}}</footer>",
    f"<body><nav>{MENU}</nav><article><h1>{{T}}</h1>[[<p>{{P}}</p>]]<div class='advert'>{{p}}</div>[[<p>{{P}}</p>]]<ul>[[<li>{{S}}</li>]]</ul><section id='comments'><h3>{{n}}</h3>[[<article class='comment'><p>{{p}}</p></article>]]</section></article><footer>{{p}}</footer>",
    f"<body><div role='banner'>{{n}}</div><div role='navigation'>{MENU}</div><div role='main'><h1>{{T}}</h1>[[<h2>{{S}}</h2><p>{{P}}</p>]]</div><div role='complementary'><p>{{p}}</p></div><div role='contentinfo'>{{p}}</div>",
    # Pages built of plain containers.
    f"<body><div id='header'><div class='logo'>{{n}}</div><div class='menu'>{MENU}</div></div><div id='content'><h1>{{T}}</h1>[[<p>{{P}}</p>]]</div><div id='sidebar'><div class='widget'><h3>{{n}}</h3>{MENU}</div><div class='widget'>{{p}}</div></div><div id='footer'><p>{{p}}</p></div>",
    f"<body><div class='top-bar notice'>{{p}}</div><div class='navbar'>{MENU}</div><div class='entry-content'><h2>{{T}}</h2>[[<div>{{P}}</div>]]<pre>{{P}}</pre></div><div class='related-posts'><h3>{{n}}</h3>{MENU}</div><div class='newsletter'>{{p}}{FORM}</div><div class='site-footer'>{{n}} {{n}}</div>",
    f"<body><table><tr><td class='nav'>{MENU}</td><td class='main'><h1>{{T}}</h1>[[<p>{{P}}]]<table><tr><td>{{S}}</td><td>{{S}}</td></tr></table></td><td class='ads'>{{p}}</td></tr></table><div class='copyright'>{{n}}</div>",
    f"<body><div class='breadcrumbs'>[[<a href='/b'>{{l}}</a> ]]</div><div class='post-body'><h1>{{T}}</h1><p>{{S}}</p>[[<p>{{P}} <a href='/i'>{{S}}</a> {{P}}</p>]]</div><div class='sponsored banner'><p>{{p}}</p></div><div id='disqus' class='comment-list'>[[{COMMENT}]]</div><div class='footer'><p>{{p}}</p>{MENU}</div>",
    f"<body><header><p>{{p}}</p></header><nav><p>{{p}}</p>{MENU}</nav><article><h1>{{T}}</h1><p>{{S}}</p>[[<p>{{P}}</p><p>{{S}}</p>]]<footer><p>{{n}}</p></footer></article><aside><p>{{p}}</p></aside><form><p>{{p}}</p></form><footer><p>{{p}}</p><p>{{p}}</p></footer>",
    f"<body><nav>{MENU}</nav><!-- ad --><div class='ad'>{{p}}</div><article><h1>{{T}}</h1><p><b>{{P}}<br><p>{{S}}</p>[[<p>{{P}}</p>]]<p><b>{{S}}<br>[[<p>{{P}}</p>]]<footer>&copy; {{p}}</footer>",
    f"<body><div class='alert warning'>{{p}}</div><aside class='sidebar'>{MENU}<p>{{p}}</p></aside><article><h1>{{T}}</h1>[[<p>{{P}}</p><aside class='promo'>{{p}}</aside>]]<h2>{{S}}</h2>[[<p>{{S}}</p>]]<div class='tags'>[[<a href='/t'>{{l}}</a>]]</div></article><div class='comments'>[[<p>{{p}}</p>]]</div><div class='reply'>{FORM}</div><footer>{{n}}</footer>",
    f"<body><div class='login'>{FORM}</div><section class='story'><h1>{{T}}</h1>[[<section><h3>{{S}}</h3><p>{{P}}</p></section>]]</section><section class='reviews'>[[<p>{{p}}</p>]]</section><div class='popup consent'><p>{{p}}</p><button>{{n}}</button></div><footer>{MENU}{{p}}</footer>",
]

# Names that sites use for the same part of a page; one of them is drawn per page.
SYNONYMS = {
    "content": ["content", "main-content", "page-content", "body-content", "text"],
    "entry-content": ["entry-content", "entry", "article-body", "article-content", "richtext"],
    "post-body": ["post-body", "post", "post-content", "blog-post", "body-text"],
    "story": ["story", "story-body", "article", "main-article", "longform"],
    "main": ["main", "main-column", "primary", "content-main"],
    "sidebar": ["sidebar", "side", "rail", "right-column", "secondary", "sidenav"],
    "widget": ["widget", "box", "module", "panel", "teaser"],
    "menu": ["menu", "navigation", "nav-links", "top-menu", "mainnav"],
    "navbar": ["navbar", "nav", "navigation", "topnav"],
    "breadcrumbs": ["breadcrumbs", "breadcrumb", "path"],
    "header": ["header", "masthead", "top", "branding"],
    "footer": ["footer", "bottom", "site-info", "colophon"],
    "site-footer": ["site-footer", "page-footer", "foot", "footer-links"],
    "copyright": ["copyright", "legal", "imprint", "disclaimer"],
    "ad": ["ad", "ads", "advert", "advertisement", "adbox", "ad-slot", "sponsor"],
    "advert": ["advert", "ad", "advertisement", "banner-ad", "promoted"],
    "promo": ["promo", "promotion", "offer", "sponsored", "cta"],
    "cookie-notice": ["cookie-notice", "cookie-banner", "gdpr", "consent", "notice", "privacy-notice"],
    "alert": ["alert", "notice", "message", "announcement", "warning"],
    "popup": ["popup", "modal", "overlay", "dialog", "lightbox"],
    "comments": ["comments", "comment-section", "discussion", "responses", "replies", "user-comments"],
    "comment": ["comment", "comment-body", "reply", "response", "user-comment"],
    "comment-list": ["comment-list", "commentlist", "thread", "discussion"],
    "reviews": ["reviews", "ratings", "feedback", "comments"],
    "related-posts": ["related-posts", "related", "recommended", "read-more", "see-also"],
    "newsletter": ["newsletter", "subscribe", "signup", "subscription", "mailing-list"],
    "login": ["login", "signin", "search", "account"],
    "share": ["share", "social", "sharing", "follow-us"],
    "tags": ["tags", "categories", "meta", "topics"],
}

_SYLLABLES = "ka to mi re lu san ver den al ti po est ra un shi gor".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    count = round(low * (high / low) ** rng.random())
    words = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(count)]
    return " ".join(words).capitalize()


def _fill(layout: str, rng: random.Random) -> str:
    repeat = re.compile(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]")
    while repeat.search(layout):
        layout = repeat.sub(lambda m: m.group(1) * rng.choice([1, 1, 2, 3, 5, 9]), layout)
    drawn = {name: rng.choice(names) for name, names in SYNONYMS.items()}
    layout = re.sub(r"(?<=[' ])[a-z-]+(?=[ ']?[^=]*'[ >])", lambda m: drawn.get(m.group(), m.group()), layout)
    end = lambda: rng.choice([".", ".", ".", "", "!", "?"])
    make = {
        "T": lambda: MARK + _words(rng, 2, 14) + rng.choice(["", "."]),
        "P": lambda: MARK + ". ".join(_words(rng, 2, 40) for _ in range(rng.randint(1, 6))) + end(),
        "S": lambda: MARK + _words(rng, 1, 9) + end(),
        "l": lambda: _words(rng, 1, 4),
        "n": lambda: _words(rng, 1, 9) + end(),
        "p": lambda: ". ".join(_words(rng, 2, 30) for _ in range(rng.randint(1, 4))) + end(),
    }
    return re.sub(r"\{(\w)\}", lambda m: make[m.group(1)](), layout)


def labelled_pages(per_layout: int, seed: int, layouts: list[str] | None = None) -> list[str]:
    """Pages whose main text blocks start with MARK."""
    rng = random.Random(seed)
    return [_fill(x, rng) for x in (layouts or LAYOUTS) for _ in range(per_layout)]
