"""Labelled pages for the block model: built from page patterns, every block with its label.

Page layouts on the web follow a few habits: semantic elements or ``div`` with
telling class names for menus, headers, side columns, notices, adverts, forms,
comments and footers, and an article of headings, paragraphs, lists and quotes.
The patterns below mix these habits at random, by a fixed seed, with invented text.
"""

from __future__ import annotations

import html
import random

#: Openings of each kind of region, as element and attribute.
REGIONS = {
    "menu": "nav|nav class='navbar'|div class='menu'|ul class='nav-list'|div id='navigation'|div class='breadcrumb'|div class='topbar links'|ul class='pagination'|div role='navigation'|div class='toc'|div class='tags'|div class='share social'".split("|"),
    "header": "header|div class='header'|div id='site-header'|div class='masthead'|div class='logo branding'|header class='page-header'|div class='top-header'|div role='banner'".split("|"),
    "side": "aside|div class='sidebar'|div id='sidebar'|aside class='widget'|div class='related'|div class='recommended'|div class='widget-area'|section class='related-posts'|div class='trending popular'|div role='complementary'|div class='author-bio'|div class='teaser more-stories'".split("|"),
    "notice": "div class='cookie-banner'|div id='cookie-notice'|div class='notice'|div class='consent gdpr'|div class='alert'|div class='disclaimer'|section class='notice'|div class='popup modal'|div class='overlay'|div role='alert'|div role='dialog'|div class='paywall'|div class='message info'".split("|"),
    "advert": "div class='ad'|div class='ads'|div class='advert'|div class='advertisement'|div id='ad-slot'|div class='sponsored'|aside class='ad'|div class='banner-ad'|div class='promo'|ins class='adsbygoogle'|section class='promotion'|div class='sponsor'".split("|"),
    "form": "form|form class='search'|div class='newsletter'|form id='login'|div class='subscribe'|form class='contact-form'|div class='signup'|div class='search-box'|fieldset|form class='comment-form'".split("|"),
    "comments": "section class='comments'|div id='comments'|div class='comment'|ol class='comment-list'|div id='disqus_thread'|div class='replies'|section id='reader-comments'|div class='comment-body'|div class='responses discussion'|div class='reader comments'|article class='comment'|div class='user-reviews feedback'".split("|"),
    "footer": "footer|div class='footer'|div id='footer'|div class='site-footer'|div class='copyright'|footer class='page-footer'|div class='legal'|div class='bottom'|div role='contentinfo'|div class='colophon'".split("|"),
}
ARTICLES = "article|main|div class='content'|div class='post'|div class='entry-content'|div class='article-body'|div id='content'|div class='story'|section class='article'|article class='post'|div class='post-body'|div class='text'|main id='main'|div role='main'|div itemprop='articleBody'|div".split("|")
WRAPPERS = "|div|div class='wrapper'|div id='page'|div class='container'|div class='row'|section|div class='layout'".split("|")
_SYLLABLES = "an be co da en fi go ha in jo ka lu mo ne or pa qui re so ti un ve wa xi yo zu".split()
_SHORT = "Home|About|Contact|Log in|Sign up|Next|Previous|Read more|Share|Search|Menu|Top|News|Terms|Privacy|Help".split("|")


class _Writer:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def text(self, low: int, high: int) -> str:
        pick = self.random
        words = ["".join(pick.choices(_SYLLABLES, k=pick.randint(1, 4))) for _ in range(pick.randint(low, high))]
        for i in range(0, len(words), pick.randint(5, 14)):
            words[i] = words[i].capitalize()
            if i:
                words[i - 1] += pick.choice([".", ".", ",", "?", "!!"])
        words[-1] += pick.choice([".", ".", "", "!"])
        if pick.random() < 0.08:
            words = [w.upper() + "!!" for w in words]
        return " ".join(words)

    def block(self, element: str, text: str, label: int) -> None:
        shown = html.escape(text, quote=False)
        pick = self.random.random()
        if pick < 0.1:
            shown = f"<b>{shown}</b>"
        elif pick < 0.16:
            shown = f"<b>{shown}<br>"
        elif pick < 0.2:
            shown += " <a href='#'>" + self.random.choice(_SHORT) + "</a>"
        close = "" if element in ("p", "li") and self.random.random() < 0.15 else f"</{element.split()[0]}>"
        self.parts.append(f"<{element}>{shown}{close}")
        self.labels.append((text, label))

    def inside(self, opening: str, fill) -> None:
        if opening:
            self.parts.append(f"<{opening}>")
        fill()
        if opening:
            self.parts.append(f"</{opening.split()[0]}>")

    def region(self, kind: str) -> None:
        pick = self.random

        def fill() -> None:
            if kind == "menu":
                self.parts.append("<ul>")
                for _ in range(pick.randint(2, 7)):
                    self.parts.append("<li><a href='/x'>" + (word := pick.choice([*_SHORT, self.text(1, 2)])) + "</a></li>")
                    self.labels.append((word, 0))
                self.parts.append("</ul>")
            elif kind == "comments":
                if pick.random() < 0.6:
                    self.block(pick.choice(["h2", "h3", "h4"]), pick.choice(["Comments", "Responses", self.text(1, 3)]), 0)
                for _ in range(pick.randint(1, 4)):
                    self.block(pick.choice(["p", "div", "li", "div class='comment'"]), self.text(3, 60), 0)
            elif kind == "form":
                for _ in range(pick.randint(1, 3)):
                    self.block(pick.choice(["label", "p", "button", "div"]), pick.choice([*_SHORT, self.text(2, 9)]), 0)
            else:
                for _ in range(pick.randint(1, 3)):
                    element = pick.choice(["p", "div", "span", "li", "h2", "h3", "h4", "p", ""])
                    text = self.text(2, 30 if kind != "header" else 8)
                    if element:
                        self.block(element, text, 0)
                    else:
                        self.parts.append(html.escape(text, quote=False))
                        self.labels.append((text, 0))
                        break

        self.inside(pick.choice(REGIONS[kind]), fill)

    def article(self) -> None:
        pick = self.random

        def fill() -> None:
            if pick.random() < 0.7:
                self.block(pick.choice(["h1", "h1", "h2"]), self.text(2, 10), 1)
            for _ in range(pick.choice([1, 2, pick.randint(1, 12), pick.randint(3, 12), pick.randint(3, 12)])):
                kind = pick.random()
                if kind < 0.72:
                    self.block("p", self.text(*pick.choice([(1, 4), (5, 60), (20, 90), (5, 60), (20, 90), (150, 700)])), 1)
                elif kind < 0.8:
                    self.block(pick.choice(["h2", "h3"]), self.text(1, 6), 1)
                elif kind < 0.86:
                    self.inside(pick.choice(["ul", "ol"]), lambda: [self.block("li", self.text(2, 20), 1) for _ in range(3)])
                elif kind < 0.9:
                    self.inside("blockquote", lambda: self.block("p", self.text(5, 40), 1))
                elif kind < 0.93:
                    self.block(pick.choice(["pre", "figcaption", "td", "div"]), self.text(3, 20), 1)
                else:
                    self.region(pick.choice(["advert", "side", "notice", "form", "menu", "advert"]))
            if pick.random() < 0.4:
                self.region(pick.choice(["comments", "comments", "menu", "footer", "side", "form"]))

        self.inside(pick.choice(ARTICLES), fill)

    def page(self) -> None:
        pick = self.random
        self.parts.append("<!DOCTYPE html><html><head><title>t</title></head><body>")
        wrapper = pick.choice(WRAPPERS)

        def fill() -> None:
            share = 0.45 if pick.random() < 0.85 else 0.05  # some pages have hardly more than the article
            before = [k for k in ("header", "menu", "notice", "advert", "form", "side") if pick.random() < share]
            after = [k for k in ("side", "comments", "advert", "form", "notice", "menu", "footer") if pick.random() < share]
            for kind in before:
                self.region(kind)
            self.inside(pick.choice(WRAPPERS), self.article)
            for kind in after:
                self.region(kind)

        self.inside(wrapper, fill)
        self.parts.append("</body></html>" if pick.random() < 0.9 else "")


def labelled_pages(count: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages with, in page order, the texts of their blocks and whether they belong to the article."""
    pages = []
    for i in range(count):
        writer = _Writer(seed * 1_000_003 + i)
        writer.page()
        pages.append(("".join(writer.parts), writer.labels))
    return pages
