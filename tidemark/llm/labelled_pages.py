"""Labelled pages to learn extraction weights from: page layouts made by rule, with their main blocks.

Every page is put together from parts that are main text or not, so that the label of
each block is known. A part is told by its element, by the name in its class or id, or
by its form only: a share of all parts has names that mean nothing, and many main
parts have names that usually stand for something else, so that no name decides alone.
Articles can end in lists of linked references; what lies beside them can be prose under a
meaningless name, or cards that are article elements themselves.

``python -m tidemark.llm.labelled_pages`` learns the weights of all these pages and saves
them as ``page_weights.json`` beside this file.
"""

from __future__ import annotations

import random

# Usual names of page parts that are not main text.
BOILERPLATE = {
    "nav": ("nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toc"),
    "header": ("header", "masthead", "banner", "topbar", "logo"),
    "footer": ("footer", "copyright", "colophon", "bottom"),
    "aside": ("sidebar", "aside", "related", "widget", "recommended", "trending", "popular", "more"),
    "div": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsbygoogle", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "signup", "social", "share", "sharing", "login", "search", "paywall", "disclaimer", "pagination", "pager", "skip", "tags"),
    "section": ("comments", "comment", "replies", "discussion", "respond", "disqus", "reactions", "feedback"),
    "form": ("form", "login", "search", "subscribe"),
    "dialog": ("dialog", "cookie", "modal"),
    "button": ("button", "btn"),
    "fieldset": ("fields",),
    "address": ("contact",),
    "menu": ("menu",),
}
MAIN = {"article": ("article", "post", "entry", "story"), "main": ("main", "content"), "div": ("content", "article", "body", "post", "text", "entry", "story", "main")}
NAMES = sorted({n for names in BOILERPLATE.values() for n in names})


def labelled_pages(count: int = 2400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """(page, set of main blocks) for ``count`` layouts."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwz"

    def words(n: int) -> list[str]:
        return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]

    def phrase(n: int) -> str:
        return " ".join(words(n))

    def prose(n: int) -> str:
        """Sentences of ``n`` words in all."""
        out = words(n)
        for i in range(n):
            if i == 0 or out[i - 1][-1] in ".?!":
                out[i] = out[i].capitalize()
            if rng.random() < 0.12 or i == n - 1 and rng.random() < 0.9:
                out[i] += rng.choice("....?!")
        return " ".join(out)

    def name() -> str:
        """A name that means nothing and comes only once."""
        return "".join(rng.choice(letters) for _ in range(6)) + str(rng.randint(0, 99))

    def opening(tag: str, names: tuple[str, ...], odd: float) -> str:
        """The start tag, with one of the names, a meaningless one or none."""
        kind = rng.random()
        own = name() if kind < odd else rng.choice(names)
        if rng.random() < 0.25:
            own = rng.choice((f"{own}-{name()}", f"{name()}-{own}", f"{own} {name()}"))
        named = tag in ("div", "section") or rng.random() < 0.5
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{own}">' if named else f"<{tag}>"

    def menu() -> str:
        link = lambda: f"<a href='/{name()}'>{phrase(rng.randint(1, 4))}</a>"
        n = rng.choice((rng.randint(3, 7), rng.randint(3, 7), rng.randint(3, 7), rng.randint(8, 25)))
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        return rng.choice((" | ", " ", "<br>")).join(link() for _ in range(n))

    def noise(inside: bool = False) -> str:
        tag = rng.choice([*BOILERPLATE, *["div"] * 8, "aside", "aside", "footer", "header", "header", "form"])
        names = BOILERPLATE[tag]
        holder = tag if rng.random() < 0.6 else "div"
        kind = rng.random()
        if tag == "section":
            body = "".join(f"<p>{prose(rng.randint(3, 40))}</p>" for _ in range(rng.randint(1, 5)))
            return f'<{holder} {rng.choice(("class", "id"))}="{rng.choice(names)}">{body}</{holder}>'
        if tag in ("form", "button", "fieldset"):
            body = "".join(f"<label>{phrase(rng.randint(1, 4))}</label><input>" for _ in range(rng.randint(1, 4)))
            body = body if rng.random() < 0.7 else f"<p>{prose(rng.randint(2, 30))}</p>{body}"
            return f"{opening(holder, names, 0)}{body}</{holder}>"
        if not inside and kind > 0.94:  # prose that only its place tells from an article
            return f'<div class="{name()}">' + "".join(f"<p>{prose(rng.randint(4, 30))}</p>" for _ in range(rng.randint(2, 7))) + "</div>"
        if not inside and kind > 0.88:  # cards of other articles
            cards = "".join(f"<article><a href='/{name()}'>{phrase(rng.randint(2, 8))}</a>{rng.choice(('', f'<p>{prose(rng.randint(3, 12))}</p>'))}</article>" for _ in range(rng.randint(2, 6)))
            return f"{opening('div', BOILERPLATE['aside'], 0.3)}{cards}</div>"
        if kind < 0.4 and not inside:
            return f"{opening(holder, names, 0.5)}{menu()}</{holder}>"
        if kind < 0.45:
            hidden = rng.choice(("hidden", 'aria-hidden="true"', 'style="display:none"', "style='color:red; visibility: hidden'"))
            return f"<div {hidden}>{prose(rng.randint(3, 30))}</div>"
        body = rng.choice((phrase, prose))(rng.choice((rng.randint(1, 3), rng.randint(1, 14), rng.randint(5, 50))))
        body = body if rng.random() < 0.5 else f"<p>{body}</p>"
        return f"{opening(holder, names, 0)}{body}</{holder}>"

    out = []
    for _ in range(count):
        parts, main = [], set()
        for _ in range(rng.randint(1, 9)):
            n = rng.choice((rng.randint(1, 6), rng.randint(8, 30), rng.randint(20, 90)))
            m = prose(n)
            main.add(m)
            w = m.split()
            k = rng.randint(0, len(w) - 1)
            linked = " ".join([*w[:k], f"<a href='/{name()}'>{w[k]}</a>", *w[k + 1 :]])
            bold = f"<b>{m}</b>" if rng.random() < 0.5 else f"<b>{m}"
            parts.append(rng.choice((f"<p>{m}</p>", f"<p>{m}</p>", f"<p>{m}", f"<p>{bold}<br></p>", f"<p>{linked}</p>", f"<div><p>{m}<br></div>", f"<ul><li>{m}</li></ul>", f"<ol><li>{linked}</li></ol>", f"<blockquote>{m}</blockquote>", f"<section><h2>{m}</h2></section>", f"<table><tr><td>{m}</td></tr></table>", f"<figure><figcaption>{m}</figcaption></figure>", f'<p class="{name()}">{m}</p>')))
        tag = rng.choice(list(MAIN))
        if rng.random() < 0.2:  # references: a list of links, with or without words around them
            entries = [(phrase(rng.randint(0, 4)), phrase(rng.randint(2, 9)), phrase(rng.randint(0, 3))) for _ in range(rng.randint(2, 10))]
            main |= {" ".join(" ".join(e).split()) for e in entries}
            kind = rng.choice(("ul", "ol"))
            named = rng.choice(("", "", f' class="{name()}"') if tag != "div" else (' class="references"', ' id="sources"', ' class="footnotes"'))
            parts.append(f"<{kind}{named}>" + "".join(f"<li>{a} <a href='/{name()}'>{b}</a> {c}</li>" for a, b, c in entries) + f"</{kind}>")
        while rng.random() < 0.7:
            parts.insert(rng.randint(1, len(parts)), noise(inside=True))
        odd = rng.random()
        wrong = rng.choice(NAMES if rng.random() < 0.7 else BOILERPLATE["section"])
        start = opening(tag, MAIN[tag], 0.4) if odd > 0.4 or sum(len(m.split()) for m in main) < 80 else f'<{tag} class="{wrong}{rng.choice(("", "-" + name(), "-text"))}">'
        title = prose(rng.randint(2, 9)).rstrip(".")
        main.add(title)
        head = rng.choice((f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>"))
        body = "".join(noise() for _ in range(rng.randint(1, 4))) + f"{start}{head}{''.join(parts)}</{tag}>" + "".join(noise() for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            body = f'<div class="{name()}"><div>{body}</div></div>'
        out.append((f"<html><head><title>{title}</title></head><body>{body}</body></html>", main))
    return out


if __name__ == "__main__":
    from pathlib import Path

    from tidemark.llm import html_extract

    Path(__file__).with_name("page_weights.json").write_text(html_extract.learn(labelled_pages()).to_json(), encoding="utf-8")
