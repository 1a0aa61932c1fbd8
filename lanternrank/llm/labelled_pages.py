"""Labelled pages to train the text extraction on.

Each layout lists regions of a page in order, with markup as web publishers use
it; a region is labelled as article or not. Invented sentences fill them, so that
the blocks of a page carry their labels, whatever language they would be in.
"""

from __future__ import annotations

import random

from lanternrank.llm.html_text import Block, blocks_of

MARK = "␞"  # ends a block of the article, while labels are read off

# Regions outside the article: markup around the filler.
LINKS = ("<a href='/x'>{w}</a>", "<li><a href='/x'>{w}</a></li>", "<li><a href='#'>{w} {w}</a></li>")
MENUS = (
    "<nav><ul>{l}</ul></nav>", "<div class='menu'><ul>{l}</ul></div>", "<div id='nav'>{l}</div>",
    "<ul class='main-nav'>{l}</ul>", "<nav class='breadcrumb'>{l}</nav>", "<div class='breadcrumbs'>{l}</div>",
    "<div role='navigation'><ul>{l}</ul></div>", "<menu>{l}</menu>",
)
HEADERS = (
    "<header><h1>{w} {w}</h1><p>{s}</p></header>", "<header class='site-header'><a href='/'>{w}</a></header>",
    "<div id='header'><h2>{w}</h2></div>", "<div class='masthead'>{w} {w}</div>", "<header><div class='logo'>{w}</div>{l}</header>",
)
FOOTERS = (
    "<footer>&copy; {w}.example &middot; {s}</footer>", "<footer><p>{s}</p><p>{s}</p></footer>", "<div class='footer'>{s} {l}</div>",
    "<div id='footer'><p>&copy; 2024 {w}</p></div>", "<footer class='site-footer'><ul>{l}</ul></footer>", "<footer>{s}\n{s}</footer>",
)
SIDES = (
    "<aside><h3>{w} {w}</h3><p>{s}</p></aside>", "<div class='sidebar'><h2>{w}</h2><ul>{l}</ul></div>", "<aside class='related'>{l}</aside>",
    "<div id='sidebar'><p>{s} {s}</p></div>", "<section class='related-posts'><h3>{w}</h3><p>{s}</p></section>", "<aside>{s} {s}</aside>",
    "<div class='widget'><p>{s}</p></div>", "<div class='r-col'><h4>{w} {w}</h4><ul>{l}</ul></div>", "<div class='col-2'><h3>{w}</h3><p>{s}</p>{l}</div>",
    "<div class='right-rail'><p>{s}</p><p>{s}</p></div>",
)
NOTICES = (
    "<div class='cookie-notice'>{s} <button>OK</button></div>", "<div id='consent'><p>{s} {s}</p></div>", "<div class='notice'>{s}</div>",
    "<div class='newsletter-signup'><p>{s}</p></div>", "<div class='popup'>{s}</div>", "<div role='alert' class='banner'>{s}</div>",
    "<p class='cookie-banner'>{s}</p>", "<dialog>{s}</dialog>", "<div class='legal'><p>{s} {s}</p></div>",
)
ADVERTS = (
    "<div class='ad'>{s}</div>", "<div class='ads'><p>{s}</p></div>", "<div class='advert'>{s}</div>", "<div id='ad-top'><a href='/b'>{s}</a></div>",
    "<section class='sponsored'><p>{s} {s}</p></section>", "<div class='promo'><h3>{w}</h3><p>{s}</p></div>", "<div class='advertisement'>{s} {s} {s}</div>",
    "<!-- ad --><div class='ad'>{s}\n{s}</div>",
)
FORMS = (
    "<form><label>{w}</label><input name='q'><button>{w}</button></form>", "<form class='search'><p>{s}</p><input></form>",
    "<form id='login'><fieldset><legend>{w}</legend><p>{w} {w}</p></fieldset></form>", "<form action='/s'><select><option>{w}</option></select>{s}</form>",
)
COMMENTS = (
    "<div class='comments'><h3>{w}</h3><p>{s} {s}</p><p>{s}</p></div>", "<section id='comments'><ul><li><p>{s} {s} {s}</p></li><li><p>{s}</p></li></ul></section>",
    "<div class='comment'><b>{w}</b><p>{s} {s}</p></div>", "<ol class='commentlist'><li>{s} {s}</li><li>{s}</li></ol>",
    "<section class='reader-comments'><article class='comment'><p>{s} {s}</p></article></section>", "<div class='replies'><div class='reply'><p>{s} {s}</p></div></div>",
    "<div id='disqus_thread'><p>{s} {s}</p><p>{s}</p></div>", "<section class='reader-responses'><h3>{w}</h3><p>{s} {s}</p><p>{s} {s} {s}</p></section>",
    "<div class='discussion-thread'><div><b>{w}</b> {s} {s}</div><div><b>{w}</b> {s}</div></div>", "<div class='fb-comments'><p>{s}</p></div>",
)
SHARES = ("<div class='share'>{l}</div>", "<div class='social-links'>{l}</div>", "<p class='tags'>{l}</p>", "<div class='byline meta'>{w} {w}</div>")
# Where the article stands, and its blocks.
ARTICLES = (
    "<article>{t}{b}</article>", "<main>{t}{b}</main>", "<div class='content'>{t}{b}</div>", "<div id='main'><div class='post'>{t}{b}</div></div>",
    "<section class='story'>{t}{b}</section>", "<div class='article-body'>{t}{b}</div>", "<main><article class='entry'>{t}{b}</article></main>",
    "<div>{t}{b}</div>", "{t}{b}", "<div role='main'>{t}{b}</div>", "<table><tr><td>{t}{b}</td></tr></table>", "<article>{t}<div class='entry-content'>{b}</div></article>",
    "<div class='container'><div class='row'><div class='col-8'>{t}{b}</div></div></div>", "<div class='left-col'>{t}{b}</div>",
    "<div>{t}{r}{m}</div>", "<div class='text'>{t}{r}{m}</div>", "<table><tr><td>{r}{m}</td></tr></table>",
)
TITLES = ("", "<h1>{w} {w} {w}{m}</h1>", "<h1>{s}{m}</h1>", "<h2>{w} {w} {w} {w}{m}</h2>")
BODIES = (
    "<p>{p}{m}</p>", "<p><b>{p}{m}<br>", "<p>{p}{m}", "<p>{s}{m}</p>", "<p>{w}.{m}</p>", "<div>{p}{m}</div>", "<blockquote><p>{s} {s}{m}</p></blockquote>",
    "<h2>{w} {w}{m}</h2><p>{p}{m}</p>", "<ul><li>{s}{m}</li><li>{w} {w} {w}{m}</li></ul>", "<pre>{w} = {w}\n{w}{m}</pre>", "<p>{s} <a href='/y'>{w} {w}</a> {s}{m}</p>",
    "<figure><img src='i'><figcaption>{s}{m}</figcaption></figure>", "<table><tr><td>{w}{m}</td><td>{w} {w}{m}</td></tr></table>", "<p>{w} | {w} | {w} | {w}{m}</p>",
    "<p>{u} {u} {u}{m}</p>", "<p>{p}&amp;{w}*** {w}$$${m}</p>",
)


class _Filler:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def word(self) -> str:
        return "".join(self.draw.choice("aeiou") + self.draw.choice("bcdfglmnprstvé") for _ in range(self.draw.randrange(1, 5)))

    def sentence(self) -> str:
        n = self.draw.choice([1, 2, 4, 6, 8, 12, 18])
        return " ".join(self.word() for _ in range(n)).capitalize() + self.draw.choice([".", ".", "!", ""])

    def fill(self, shape: str) -> str:
        out = ""
        while "{" in shape:
            before, _, rest = shape.partition("{")
            kind, _, shape = rest.partition("}")
            out += before + self.one(kind)
        return out + shape

    def one(self, kind: str) -> str:
        draw = self.draw
        if kind == "w":
            return self.word()
        if kind == "u":
            return self.word().upper() + "!!"
        if kind == "s":
            return self.sentence()
        if kind == "p":
            return " ".join(self.sentence() for _ in range(draw.randrange(2, 9)))
        if kind == "r":  # an article of lines instead of paragraphs
            return "<br><br>".join(self.one("p") + draw.choice(["", "<br>" + self.one("p")]) for _ in range(draw.randrange(2, 6)))
        if kind == "m":
            return MARK
        if kind == "l":
            shape = draw.choice(LINKS)
            return "".join(self.fill(shape) for _ in range(draw.randrange(2, 8)))
        if kind == "t":
            return self.fill(draw.choice(TITLES))
        parts = [self.fill(draw.choice(BODIES[:5] * 2 + BODIES)) for _ in range(draw.choice([1, 2, 3, 5, 9]))]
        if draw.random() < 0.3:  # a region within the article that is none of it
            parts.insert(draw.randrange(len(parts) + 1), "</b>" + self.fill(draw.choice(ADVERTS + SHARES + SIDES + FORMS)))
        if draw.random() < 0.15:
            parts.append("</b>" + self.fill(draw.choice(COMMENTS)))
        return "".join(parts)

    def page(self) -> str:
        draw, some = self.draw, lambda kinds, p: [draw.choice(kinds)] if self.draw.random() < p else []
        top = some(HEADERS, 0.4) + some(MENUS, 0.7) + some(NOTICES, 0.3) + some(ADVERTS, 0.4) + some(FORMS, 0.2)
        end = some(SHARES, 0.3) + some(COMMENTS, 0.4) + some(SIDES, 0.4) + some(ADVERTS, 0.2) + some(NOTICES, 0.2) + some(FORMS, 0.2) + some(FOOTERS, 0.8)
        if draw.random() < 0.2:
            top += some(SIDES, 1.0)
        body = "".join(self.fill(x) for x in [*top, draw.choice(ARTICLES[:3] + ARTICLES), *end])
        return f"<html><head><title>{self.sentence()}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled(pages: int = 320, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """Pages as blocks with their labels; the same for the same arguments."""
    filler, out = _Filler(seed), []
    for _ in range(pages):
        page = filler.page()
        marked, plain = blocks_of(page), blocks_of(page.replace(MARK, ""))
        out.append((plain, [MARK in b.text for b in marked]))
    return out


def page_and_text(seed: int) -> tuple[str, str]:
    """One page and the text of its article, to test with."""
    page = _Filler(seed).page()
    kept = [b.text.replace(MARK, "") for b in blocks_of(page) if MARK in b.text]
    return page.replace(MARK, ""), "\n".join(" ".join(t.split()) for t in kept)
