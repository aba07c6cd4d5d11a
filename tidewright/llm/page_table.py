"""The labelled table of the HTML operator's tree: invented pages whose parts are known.

Every page is put together by rule from a seed. An element says in ``data-keep`` whether its
text belongs to the article (1) or not (0). Half of the pages have markup that says nothing:
only div, p and names without a meaning, so that counts have to decide. Names of the other half
tell the truth for parts apart, and now and then lie about parts of the article.
"""

from __future__ import annotations

import random

PAGES = 1200
SEED = 20240611
SYLLABLES = "ba be bo da de do fa fi ga go ka ki la le lo ma me mi na no pa pe ra re ri sa se so ta te ti to va vi".split()
VOCABULARY = [a + b + c for a in ("", "ma", "ro", "ti") for b in SYLLABLES for c in ("", "n", "s")]
CUE_TEXTS = (
    "subscribe to our newsletter", "we use cookies on this site", "share this on facebook", "buy now with a discount", "sponsored advertisement",
    "free shipping on every offer", "login or register to comment", "cookies and consent", "Anzeige", "click here for the offer",
)
COMMENT_TITLES = ("Comments", "3 comments", "Kommentare", "12 Kommentare", "Commentaires", "Comentarios", "Reader comments", "Leave a reply")
RELATED_TITLES = ("Related", "Related articles", "Share", "Newsletter", "Subscribe", "Sponsored")
#: What a telling name of each part may be, and names that tell nothing.
NAMES = {
    "nav": ("nav", "main-menu", "navbar", "breadcrumb"), "ad": ("ad", "ads top", "advert", "sponsor-box", "promo", "banner"), "notice": ("cookie-notice", "consent", "alert", "modal"),
    "side": ("sidebar", "widget", "related", "recommended-posts"), "foot": ("footer", "legal", "site-footer copyright"), "comments": ("comments", "comment-list", "disqus", "replies"),
    "form": ("newsletter", "signup", "login"), "share": ("share", "social-links", "share-buttons"), "head": ("header", "masthead", "site-header"),
}
PLAIN_NAMES = ("", ' class="c1"', ' class="row x-7"', ' id="b2"', ' class="box"', ' class="css-1q8z"', ' class="inner wide"')


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.telling = self.rng.random() < 0.5

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int, stop: bool = True) -> str:
        out = self.rng.choices(VOCABULARY, k=self.rng.randint(low, high))
        return " ".join(out).capitalize() + ("." if stop else "")

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.words(low, high, False)}</a>'

    def name(self, part: str) -> str:
        if self.telling and self.chance(0.85):
            return f' class="{self.rng.choice(NAMES[part])}"'
        return self.rng.choice(PLAIN_NAMES)

    def wrapped(self, part: str, inner: str, tags: tuple[str, ...] = ("div", "div", "section")) -> str:
        tag = self.rng.choice(tags) if self.telling else "div"
        return f'<{tag}{self.name(part)} data-keep="0">{inner}</{tag}>'

    # parts that are not the article

    def links(self) -> str:
        form, n = self.rng.randint(0, 2), self.rng.randint(2, 9)
        if form == 0:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        if form == 1:
            return "<p>" + " | ".join(self.link() for _ in range(n)) + "</p>"
        return "".join(f"<div>{self.link(1, 5)}</div>" for _ in range(n))

    def nav(self) -> str:
        return self.wrapped("nav", self.links(), ("nav", "nav", "div", "menu"))

    def header(self) -> str:
        slogan = f"<p>{self.words(2, 9, False)}</p>" if self.chance(0.6) else ""
        entry = f"<p>{self.link()} {self.link()}</p>" if self.chance(0.5) else ""
        return self.wrapped("head", f"<div>{self.words(1, 3, False)}</div>{slogan}{entry}", ("header", "header", "div"))

    def cued(self, low: int, high: int) -> str:
        return f"{self.words(low, high)} {self.rng.choice(CUE_TEXTS).capitalize()}." if self.chance(0.75) else self.words(low, high)

    def ad(self) -> str:
        text = self.words(3, 80) if self.telling else self.cued(2, 24)
        more = f" {self.link()}" if self.chance(0.4) else ""
        form = self.rng.randint(0, 2)
        return self.wrapped("ad", (f"{text}{more}", f"<p>{text}{more}</p>", f"<h4>{self.words(2, 4, False)}</h4><p>{text}{more}</p>")[form], ("div", "div", "aside"))

    def notice(self) -> str:
        return self.wrapped("notice", f"<p>{self.cued(8, 80 if self.telling else 30)}</p><button>{self.words(1, 2, False)}</button>" if self.chance(0.5) else self.cued(6, 70 if self.telling else 24))

    def side(self) -> str:
        out = ""
        for _ in range(self.rng.randint(1, 3)):
            out += f"<h3>{self.rng.choice(RELATED_TITLES) if self.chance(0.5) else self.words(1, 3, False)}</h3>"
            form = self.rng.randint(0, 2) if self.telling else 0
            out += (self.links(), f"<p>{self.words(6, 90)}</p>", f"<p>{self.words(5, 40)} {self.link()}</p>")[form]
        return self.wrapped("side", out, ("aside", "aside", "div"))

    def teasers(self) -> str:
        """Short leads to other pages, some as articles of their own."""
        tag = "article" if self.chance(0.5) else "div"
        return "".join(f'<{tag} data-keep="0"><h3>{self.link(2, 6)}</h3>' + (f"<p>{self.words(4, 14)} {self.link()}</p>" if self.chance(0.6) else "") + f"</{tag}>" for _ in range(self.rng.randint(1, 4)))

    def share(self) -> str:
        text = self.rng.choice(("Share this", "Share on facebook", "Tweet this", "Share with your friends"))
        return self.wrapped("share", text if self.chance(0.5) else f"{text}: {self.link()} {self.link()}", ("div", "p"))

    def form(self) -> str:
        return f'<form{self.name("form")} data-keep="0"><p>{self.words(5, 25)}</p><label>{self.words(1, 2, False)}</label><button>{self.words(1, 1, False)}</button></form>'

    def comments(self) -> str:
        titled = not self.telling or self.chance(0.7)
        out = f"<h{(k := self.rng.randint(2, 4))}>{self.rng.choice(COMMENT_TITLES)}</h{k}>" if titled else ""
        tag = self.rng.choice(("p", "div", "li", "article"))
        for _ in range(self.rng.randint(1, 6)):
            by = f"<div>{self.words(1, 2, False)}</div>" if self.chance(0.3) else ""
            out += f"<{tag}>{by}{self.words(2, 90 if self.telling else 45)}</{tag}>"
        return self.wrapped("comments", out) if self.chance(0.7) or not titled else f'<div data-keep="0">{out}</div>'

    def footer(self) -> str:
        text = f"&copy; {self.words(1, 3, False)}" + (f" &middot; {self.words(2, 20)}" if self.chance(0.6) else "")
        return self.wrapped("foot", f"{self.links() if self.chance(0.4) else ''}<p>{text}</p>" if self.chance(0.6) else text, ("footer", "footer", "div"))

    def tail(self) -> str:
        return self.rng.choice((f'<p data-keep="0">{self.link(3, 8)}</p>', f'<p data-keep="0">{self.link()} {self.link()}</p>'))

    # the article

    def paragraph(self) -> str:
        size = self.rng.random()
        low, high = (1, 9) if size < 0.25 else (10, 40) if size < 0.7 else (41, 140)
        text = self.words(low, high)
        if high > 9 and self.chance(0.25):
            text = f"{self.words(4, 12, False)} {self.link()} {text}"
        if self.chance(0.05):
            return f"<blockquote>{text}</blockquote>"
        name = ' class="share-price"' if self.telling and high > 40 and self.chance(0.08) else ""  # a name that lies
        return f"<p{name}>{text}</p>"

    def body(self) -> str:
        out = []
        if self.telling and self.chance(0.3):  # an article of a line or two
            return f"<p>{self.words(1, 16)}</p>" * self.rng.randint(1, 2)
        for k in range(self.rng.choice((1, 2, 3, 4, 5, 6, 8, 12))):
            if k and self.chance(0.12):
                out.append(f"<h2>{self.words(1, 6, False)}</h2>")
            if k and self.chance(0.08):
                out.append("<ul>" + "".join(f"<li>{self.words(1, 12)}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>")
            if k and self.chance(0.05):
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 2, False)}</td><td>{self.words(1, 2, False)}</td></tr>" for _ in range(3)) + "</table>")
            out.append(self.paragraph())
            if self.chance(0.08):  # parts apart inside it
                out.append(self.rng.choice((self.share, self.ad, self.tail))())
        if not any(len(p.split()) > 12 for p in out) and self.chance(0.8):
            out.append(f"<p>{self.words(20, 60)}</p>")
        return "".join(out)

    def article(self) -> str:
        title = self.words(2, 12, False)
        title = f'<h1><a href="/a">{title}</a></h1>' if self.chance(0.12) else f"<h1>{title}</h1>"
        if self.chance(0.15):
            title = f"<header>{title}</header>"
        inner = title + self.body() + (self.comments() if self.chance(0.15) else "")
        kind = self.rng.choice(("article", "main", "both", "div", "bare", "div")) if self.telling else self.rng.choice(("div", "bare", "deep"))
        names = self.rng.choice(("", ' class="post no-ads"', ' class="with-comments wide"', ' id="more"', ' class="share-enabled"')) if self.telling else self.rng.choice(PLAIN_NAMES)
        mark = f'{names} data-keep="1"'
        return {
            "article": f"<article{mark}>{inner}</article>", "main": f"<main{mark}>{inner}</main>", "both": f"<main><article{mark}>{inner}</article></main>",
            "div": f"<div{mark}>{inner}</div>", "deep": f"<div{mark}><div>{inner}</div></div>", "bare": inner.replace("<p", '<p data-keep="1"').replace("<h1", '<h1 data-keep="1"').replace("<h2", '<h2 data-keep="1"')
            .replace("<li>", '<li data-keep="1">').replace("<td>", '<td data-keep="1">').replace("<blockquote>", '<blockquote data-keep="1">').replace('data-keep="1" data-keep="0"', 'data-keep="0"'),
        }[kind]

    def page(self) -> str:
        before = [f for f, p in ((self.header, 0.4), (self.nav, 0.8), (self.notice, 0.25), (self.ad, 0.5), (self.side, 0.15), (self.teasers, 0.1)) if self.chance(p)]
        after = [f for f, p in ((self.share, 0.2), (self.tail, 0.3), (self.side, 0.3), (self.ad, 0.25), (self.comments, 0.3), (self.form, 0.2), (self.teasers, 0.2), (self.nav, 0.1)) if self.chance(p)]
        self.rng.shuffle(before)
        if self.chance(0.3):
            self.rng.shuffle(after)
        if self.chance(0.75):
            after.append(self.footer)
        whole = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        if self.telling and self.chance(0.25):
            whole = f'<div class="{self.rng.choice(("page has-sidebar", "layout with-comments", "site-header-fixed"))}">{whole}</div>'
        name = ' class="has-sidebar"' if self.telling and self.chance(0.15) else ""
        return f"<html><body{name}>{whole}</body></html>"


def pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    """The marked pages, the same for the same seed."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(count)]
