"""Labelled pages in many layouts, made by rule, to train the extractor on."""

from __future__ import annotations

from html import escape
from random import Random

_SYLLABLES = "ka lo mi ter ven dor sha pel on in er an tis qua bre nu ost fal gri ma".split()
_BODY_NAMES = ["content", "post-content", "entry", "story-body", "article-text", "main-copy"]
_NAMES = {
    "menu": ["nav", "main-menu", "navbar", "breadcrumb", "site-navigation", "pagination"],
    "head": ["header", "masthead", "topbar", "site-head"],
    "foot": ["footer", "site-footer", "legal", "copyright"],
    "side": ["sidebar", "widget", "related", "trending-rail", "side-box"],
    "ad": ["ad", "ads", "advert", "sponsored-box", "promo", "ad-slot"],
    "notice": ["cookie-banner", "notice", "consent", "newsletter", "alert-box", "popup"],
    "comments": ["comments", "comment-list", "reader-comments", "discussion", "replies"],
    "form": ["login-form", "search-form", "contact", "signup"],
}


class _Page:
    def __init__(self, rng: Random):
        self.rng, self.main = rng, set()
        self.plain = rng.random() < 0.15  # a layout without telling names
        self.semantic = rng.random() < 0.75

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def prose(self, most: int) -> str:
        text = " ".join(self.phrase(1, 18) + self.rng.choice(".....!?") for _ in range(self.rng.randint(1, most)))
        if self.rng.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        if self.rng.random() < 0.08:
            text = " ".join(w + self.rng.choice(["***", "%%%", "&&&", "$$$"]) for w in text.split())
        return text

    def keep(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return escape(text, quote=False)

    def inline(self, text: str) -> str:
        """Main text with markup inside that adds or removes nothing."""
        words = self.keep(text).split(" ")
        if len(words) > 4 and self.rng.random() < 0.3:
            i = self.rng.randrange(len(words) - 2)
            tag = self.rng.choice(["b", "em", "a", "span", "i"])
            words[i] = f'<{tag}{" href=/x" if tag == "a" else ""}>{words[i]}'
            words[i + 1] += f"</{tag}>"
        return " ".join(words)

    def wrap(self, role: str, tag: str | None, inside: str) -> str:
        name = self.rng.choice(_NAMES[role])
        if tag and self.semantic and self.rng.random() < 0.8:
            return f'<{tag}{f" class={name}" if self.rng.random() < 0.3 else ""}>{inside}</{tag}>'
        if self.plain:
            return f"<div>{inside}</div>"
        return f'<div {self.rng.choice(["class", "id"])}="{name}">{inside}</div>'

    def links(self, low: int, high: int) -> str:
        many = [f'<a href="/{self.word()}">{self.phrase(1, 3)}</a>' for _ in range(self.rng.randint(low, high))]
        kind = self.rng.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in many) + "</ul>"
        return self.rng.choice([" | ", " ", " &raquo; "]).join(many)

    def menu(self) -> str:
        return self.wrap("menu", "nav", self.links(2, 9))

    def head(self) -> str:
        return self.wrap("head", "header", f"<a href=/>{self.phrase(1, 3)}</a>" + (f"<p>{self.phrase(2, 8)}</p>" if self.rng.random() < 0.6 else "") + (self.menu() if self.rng.random() < 0.4 else ""))

    def advert(self) -> str:
        return self.wrap("ad", None if self.rng.random() < 0.8 else "aside", self.rng.choice(["", "<p>"]) + self.prose(2))

    def notice(self) -> str:
        return self.wrap("notice", None, f"<p>{self.prose(2)}</p>" + self.rng.choice(["", "<button>Ok</button>", f"<a href=#>{self.phrase(1, 2)}</a>"]))

    def form(self) -> str:
        inside = "".join(f"<label>{self.phrase(1, 2)}</label><input name=x>" for _ in range(self.rng.randint(1, 3)))
        form = f"<form>{inside}<textarea>{self.phrase(1, 3)}</textarea><button>{self.phrase(1, 2)}</button></form>"
        return self.wrap("form", None, f"<h3>{self.phrase(1, 4)}</h3>{form}") if self.rng.random() < 0.5 else form

    def side(self) -> str:
        inside = "".join(f"<h3>{self.phrase(1, 3)}</h3>" + self.rng.choice([self.links(2, 6), f"<p>{self.prose(3)}</p>"]) for _ in range(self.rng.randint(1, 3)))
        return self.wrap("side", "aside", inside)

    def comments(self) -> str:
        inside = f"<h3>{self.phrase(1, 3)}</h3>" + "".join(
            f"<{t}><b>{self.phrase(1, 2)}</b><p>{self.prose(3)}</p></{t}>" for t in [self.rng.choice(["div", "li", "article"])] * self.rng.randint(1, 5)
        )
        name = self.rng.choice(_NAMES["comments"])
        tag = self.rng.choice(["section", "div", "ol", "aside"])
        return f'<{tag} {self.rng.choice(["class", "id"])}="{name}">{inside}</{tag}>'

    def foot(self) -> str:
        text = f"&copy; {self.rng.randint(1999, 2026)} {self.phrase(1, 5)}" if self.rng.random() < 0.8 else self.phrase(2, 8)
        return self.wrap("foot", "footer", (self.links(1, 5) if self.rng.random() < 0.5 else "") + f"<p>{text} &middot; {self.prose(2)}</p>")

    def body(self) -> str:
        rng, out = self.rng, []
        title = f"<h1>{self.keep(self.phrase(1, 9) + rng.choice(['', '.']))}</h1>"
        out.append(f"<header>{title}</header>" if rng.random() < 0.2 else title)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.74:
                text = self.inline(self.prose(rng.choice([1, 3, 7])) if rng.random() < 0.9 else self.phrase(1, 2) + ".")
                out.append(rng.choice(["<p>{}</p>"] * 8 + ["<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(text))
            elif kind < 0.82:
                out.append(f"<h{(k := rng.randint(2, 4))}>{self.keep(self.phrase(1, 7))}</h{k}>")
            elif kind < 0.89:
                out.append("<ul>" + "".join(f"<li>{self.inline(self.prose(2))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{self.keep(self.prose(3))}</blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{self.keep(self.phrase(1, 4))}</td><td>{self.keep(self.phrase(1, 6))}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            else:
                out.append(rng.choice([self.advert, self.side, self.notice, self.form])())
        inside = "".join(out)
        tag = rng.choice(["article", "article", "main", None])
        if tag and (self.semantic or rng.random() < 0.5):
            inside = f"<{tag}>{inside}{self.comments() if rng.random() < 0.15 else ''}</{tag}>"
        else:
            inside = f'<div class="{rng.choice(_BODY_NAMES)}">{inside}</div>' if not self.plain or rng.random() < 0.5 else f"<div>{inside}</div>"
        return f'<main>{inside}</main>' if rng.random() < 0.2 else inside

    def html(self) -> str:
        rng = self.rng
        before = [part() for part in [self.head, self.menu, self.notice, self.advert, self.form, self.side] if rng.random() < 0.45]
        after = [part() for part in [self.comments, self.form, self.side, self.advert, self.menu, self.notice] if rng.random() < 0.4]
        rng.shuffle(before)
        rng.shuffle(after)
        end = self.foot() if rng.random() < 0.85 else ""
        body = "".join(before) + self.body() + "".join(after) + end
        head = f"<head><title>{self.phrase(1, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if rng.random() < 0.8 else "")


def labelled_pages(count: int, seed: int) -> list[tuple[str, set[str]]]:
    """(html, texts of the main blocks) of ``count`` pages."""
    rng = Random(seed)
    pages = []
    for _ in range(count):
        page = _Page(rng)
        html = page.html()
        pages.append((html, page.main))
    return pages
