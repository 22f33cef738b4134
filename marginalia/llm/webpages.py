"""Pages to learn from: made up, with the blocks of their article known.

Layouts, wrappers, class names, order and clutter vary; words mean nothing, so that what is learnt is
structure. The names are those that public sites commonly use.
"""

from __future__ import annotations

import random

#: Names that public sites commonly give to their parts; the pages to learn from draw on them. Fixed values.
NAMES = {
    "ad": ("ad", "ads", "adv", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner", "ad-slot", "adbox", "commercial"),
    "head": ("header", "site-header", "masthead", "branding", "topline", "logo", "tagline", "sitename"),
    "foot": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon", "imprint"),
    "comment": ("comments", "comment-list", "replies", "reply", "discussion", "reader-comments", "comment-thread", "disqus", "respond", "feedback"),
    "notice": ("cookie-banner", "notice", "consent", "alert", "popup", "gdpr-notice", "cookie", "modal", "overlay", "toast", "warning", "privacy", "dialog"),
    "side": ("sidebar", "side", "widget", "related", "popular-posts", "rail", "recommended", "trending", "teaser", "latest", "more", "aside"),
    "form": ("newsletter", "search-form", "subscribe", "login-box", "contact-form", "signup", "register", "form"),
    "share": ("share", "social-links", "follow-us", "tweet", "social"),
    "nav": ("nav", "main-menu", "menu", "breadcrumbs", "topbar", "navigation", "pagination", "pager", "tabs", "skip", "toc", "crumb"),
    "content": ("content", "article-body", "post", "entry-content", "story", "main", "text", "page-content", "article", "entry", "prose", "body"),
    "title": ("title", "headline", "entry-title", "post-title", "heading", "article-title", "page-title"),
    "lead": ("lead", "intro", "summary", "standfirst", "excerpt", "dek", "caption", "paragraph"),
}


class Page:
    """One page: html, and the texts of its article's blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.kept: set[str] = set()
        self.html = self._page()

    def _word(self) -> str:
        return "".join(self.r.choice(("ba", "ne", "ti", "lor", "su", "ke", "an", "ist", "ou", "mé", "ra", "ß")) for _ in range(self.r.randint(1, 4)))

    def _words(self, a: int, b: int) -> list[str]:
        return [self._word() for _ in range(self.r.randint(a, b))]

    def _sentences(self, a: int, b: int) -> str:
        return " ".join(" ".join(self._words(3, 16)).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(a, b)))

    def _title(self) -> str:
        return " ".join(self._words(1, 12)).capitalize() + self.r.choice(["", "", "."])

    def _keep(self, text: str) -> str:
        self.kept.add(" ".join(text.split()))
        return text

    def _attr(self, role: str) -> str:
        names = NAMES[role]
        landmark = {"nav": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "form": "search", "content": "main"}.get(role)
        if landmark and self.r.random() < 0.12:
            return f' role="{landmark}"'
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' class="{name} {self._word()}"', f' id="{name}"', f" class={name}", f' class="{self._word()} {name}-{self.r.randint(1, 9)}"'])

    def _box(self, role: str, tags: tuple[str, ...], inside: str) -> str:
        tag = self.r.choice(tags)
        attr = self._attr(role) if tag in ("div", "section", "ul", "p") or self.r.random() < 0.4 else ""
        return f"<{tag}{attr}>{inside}</{tag}>"

    def _links(self, a: int, b: int) -> str:
        items = [f'<a href="/{self._word()}">{" ".join(self._words(1, 4))}</a>' for _ in range(self.r.randint(a, b))]
        way = self.r.random()
        if way < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + self.r.choice(["</li>", "</li>", ""]) for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &raquo; "]).join(items)

    def _para(self) -> str:
        text = self._keep(self._sentences(1, self.r.choice([1, 3, 8])))
        if self.r.random() < 0.3:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            words[k] = self.r.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span class=x>{}</span>"]).format(words[k])
            text = " ".join(words)
        return text

    def _article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.9:
            title = f"<h1{self._attr('title') if r.random() < 0.5 else ''}>{self._keep(self._title())}</h1>"
            if r.random() < 0.15:
                title = f"<header>{title}" + (f"<p>{self._keep(' '.join(self._words(2, 6)))}</p>" if r.random() < 0.5 else "") + "</header>"
            out.append(title)
        style = r.random()
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 22])):
            x = r.random()
            if x < 0.08:
                out.append(f"<h{r.choice('2346')}>{self._keep(self._title())}</h2>")
            elif x < 0.14:
                out.append("<ul>" + "".join(f"<li>{self._keep(self._sentences(1, 2))}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.18:
                out.append(f"<blockquote><p>{self._para()}</p></blockquote>")
            elif x < 0.2:
                out.append(f"<figure><img src=x.png><figcaption>{self._keep(self._sentences(1, 1))}</figcaption></figure>")
            elif x < 0.22:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self._keep(' '.join(self._words(1, 4)) + str(r.randint(1, 10**6)))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif style < 0.15:
                out.append(f"<div>{self._para()}</div>")
            elif style < 0.5 and r.random() < 0.3:
                out.append(f"<p><b>{self._para()}<br>")
            else:
                out.append(f"<p{self._attr('lead') if r.random() < 0.08 else ''}>{self._para()}" + r.choice(["</p>", "</p>", "</p>", ""]))
            if r.random() < 0.06:
                out.append(self._clutter(r.choice(["ad", "form", "side", "share", "notice"])))
        return "".join(out)

    def _clutter(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self._box("nav", ("nav", "nav", "div", "ul"), self._links(2, 9))
        if kind == "head":
            inner = f"<{(t := r.choice(['h1', 'div', 'p', 'h2']))}>{' '.join(self._words(1, 5))}</{t}>" + (f"<p>{self._sentences(1, 1)}</p>" if r.random() < 0.4 else "")
            return self._box("head", ("header", "header", "div"), inner + (self._clutter("nav") if r.random() < 0.5 else ""))
        if kind == "foot":
            inner = r.choice([f"&copy; {self._word()} &middot; {self._sentences(1, 2)}", f"<p>&copy; {self._sentences(1, 2)}</p>{self._links(2, 6)}", self._links(2, 8), f"<div>{self._sentences(1, 3)}</div>"])
            return self._box("foot", ("footer", "footer", "div"), inner)
        if kind == "ad":
            inner = r.choice([self._sentences(1, 3), f"<p>{self._sentences(1, 3)}</p>", f"<a href=/buy>{self._sentences(1, 2)}</a>", f"<h3>{self._title()}</h3><p>{self._sentences(1, 4)}</p>", " ".join(self._words(1, 4))])
            return self._box("ad", ("div", "div", "section", "aside"), inner)
        if kind == "side":
            inner = r.choice([f"<h3>{self._title()}</h3>{self._links(2, 8)}", f"<h2>{self._title()}</h2><p>{self._sentences(1, 4)}</p>", f"<p>{self._sentences(1, 5)}</p>" * r.randint(1, 2), "".join(f"<div><a href=/r>{self._title()}</a><p>{self._sentences(1, 2)}</p></div>" for _ in range(r.randint(1, 4)))])
            return self._box("side", ("aside", "aside", "div", "section"), inner)
        if kind == "notice":
            inner = r.choice([f"<p>{self._sentences(1, 3)}</p><button>{self._word()}</button>", self._sentences(1, 3), f"{self._sentences(1, 2)} <a href=/p>{self._word()}</a>"])
            return self._box("notice", ("div", "div", "section", "p") if "<p>" not in inner else ("div", "section"), inner)
        if kind == "form":
            inner = f"<label>{' '.join(self._words(1, 5))}</label><input name=q><button>{self._word()}</button>" + r.choice(["", f"<p>{self._sentences(1, 2)}</p>", f"<select><option>{self._word()}<option>{self._word()}</select>"])
            form = f"<form action=/s>{inner}</form>"
            return form if r.random() < 0.6 else self._box("form", ("div",), f"<h3>{self._title()}</h3><p>{self._sentences(1, 2)}</p>" + form)
        if kind == "share":
            return self._box("share", ("div", "ul"), self._links(2, 5))
        each = lambda: r.choice([
            f"<div><b>{self._word()}</b> <p>{self._sentences(1, 5)}</p></div>", f'<div class="comment"><p>{self._sentences(1, 6)}</p></div>',
            f"<article><h4>{self._word()}</h4><p>{self._sentences(1, 4)}</p></article>", f"<li><p>{self._word()}:</p><p>{self._sentences(1, 4)}</p></li>", f"<p>{self._sentences(1, 4)}</p>"])
        inner = (f"<h{(k := r.choice('23'))}>{' '.join(self._words(1, 3))}</h{k}>" if r.random() < 0.7 else "") + "".join(each() for _ in range(r.randint(1, 6)))
        return self._box("comment", ("section", "div", "div"), inner + (self._clutter("form") if r.random() < 0.3 else ""))

    def _noise(self) -> str:
        return self.r.choice(["", "", f'<script>var t="</p>";track({self.r.randint(1, 99)});</script>', "<style>p{margin:0}</style>", "<!-- ad 1 -->", "<noscript>js</noscript>", "\n  "])

    def _page(self) -> str:
        r = self.r
        article = self._article()
        inner = []
        if r.random() < 0.12:
            article += self._clutter("comment")
        wrap = r.random()
        if wrap < 0.4:
            article = f"<article>{article}</article>"
        elif wrap < 0.55:
            article = f"<main>{article}</main>"
        elif wrap < 0.82:
            article = f"<div{self._attr('content')}>{article}</div>"
        if r.random() < 0.3:
            article = r.choice(["<main>{}</main>", "<div class=container>{}</div>", "<div id=main>{}</div>", "<div>{}</div>"]).format(article)
        before = [k for k, p in (("notice", 0.25), ("head", 0.5), ("nav", 0.75), ("ad", 0.4), ("form", 0.15), ("side", 0.12)) if r.random() < p]
        after = [k for k, p in (("share", 0.15), ("ad", 0.25), ("side", 0.35), ("comment", 0.35), ("form", 0.15), ("nav", 0.1), ("foot", 0.85), ("notice", 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        inner = [self._clutter(k) + self._noise() for k in before] + [article] + [self._noise() + self._clutter(k) for k in after]
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self._title()}</title>{self._noise()}</head><body>'
        return head + "".join(inner) + r.choice(["</body></html>", "</body></html>", ""])
