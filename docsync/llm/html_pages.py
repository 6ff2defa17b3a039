"""Labelled pages to train the extraction model: layouts with marked main text.

``data-main`` on an element marks its text, and that of its blocks, as main text; the attribute
is not seen by the model. ``{s}`` stands for a few filler words, ``{p}`` for sentences.
"""

from __future__ import annotations

import random

FILLER = (
    "river stone garden winter market letter bridge evening window mountain story village summer paper music "
    "road light house water table morning answer people question history island season forest journey corner"
).split()

LAYOUTS = [
    """<html><head><title>{s}</title><style>a{{}}</style><script>x("<p>")</script></head><body>
    <nav><ul><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li><li><a href="/c">{s}</a></li></ul></nav>
    <div class="ad">{p}</div><article data-main><h1>{s}</h1><p><b>{s}<br><p>{p}</p><p>{p}</p><p>{p}</p></article>
    <footer>&copy; {s} &middot; {p}</footer></body></html>""",
    """<body><header><h1>{s}</h1><p>{s}</p></header><main><article data-main><h2>{s}</h2><p>{p}</p><p>{p} <a href="/x">{s}</a> {p}</p>
    <ul><li>{p}</li><li>{s}</li></ul><blockquote><p>{p}</p></blockquote></article><aside><h3>{s}</h3><p>{p}</p><ul><li><a href="/q">{s}</a></li></ul></aside></main>
    <section class="comments"><h3>{s}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></section><footer><p>{p}</p></footer></body>""",
    """<body><div id="header"><a href="/">{s}</a></div><div id="menu"><a href="/1">{s}</a> <a href="/2">{s}</a></div>
    <div id="content"><div class="post" data-main><h1>{s}</h1><div class="entry-content"><p>{p}</p><p>{p}</p><h2>{s}</h2><p>{p}</p></div></div>
    <div class="related-posts"><h4>{s}</h4><ul><li><a href="/r">{s}</a></li><li><a href="/s">{s}</a></li></ul></div></div>
    <div id="sidebar"><div class="widget"><h3>{s}</h3><p>{p}</p></div></div><div id="footer">{p}</div></body>""",
    """<body><div class="cookie-notice"><p>{p}</p><button>{s}</button></div><nav class="navbar"><a href="/">{s}</a></nav>
    <div class="main-content"><h1 data-main>{s}</h1><div class="share"><a href="/t">{s}</a></div><p data-main>{p}</p><p data-main>{p}</p>
    <div class="advert"><p>{p}</p></div><p data-main>{p}</p><table data-main><tr><td>{s}</td><td>{p}</td></tr></table></div>
    <form class="newsletter"><label>{s}</label><input name="e"><p>{p}</p></form><footer>{s}</footer></body>""",
    """<body><div class="notice">{p}</div><div role="navigation"><ul><li><a href="/1">{s}</a><li><a href="/2">{s}</a></ul></div>
    <article data-main><header><h1>{s}</h1></header><section><p>{p}</p><p>{p}</p></section><section><h2>{s}</h2><p>{p}</p><pre>{s}</pre></section></article>
    <div id="comments"><ol><li><p>{p}</p></li><li><p>{p}</p></li></ol></div><footer><nav><a href="/3">{s}</a></nav></footer></body>""",
    """<body><div class="banner sponsor"><p>{p}</p></div><div class="breadcrumb"><a href="/">{s}</a> {s}</div><div class="article-body" data-main>
    <p>{p}</p><p>{p}</p><figure><figcaption>{s}</figcaption></figure><p>{p}</p></div><div class="tags"><a href="/4">{s}</a></div>
    <div class="promo"><h3>{s}</h3><p>{p}</p></div><div class="login"><form><p>{s}</p></form></div><div class="copyright">{p}</div></body>""",
    """<body><p data-main>{p}</p><p data-main>{p}</p><p data-main>{s}</p></body>""",
    """<div data-main><h1>{s}</h1><p>{p}</p>{p}<p>{p}</p></div><div class="sidebar">{p}</div>""",
    """<body><table><tr><td class="nav"><a href="/5">{s}</a><br><a href="/6">{s}</a></td><td class="text" data-main><h1>{s}</h1><p>{p}</p><p>{p}</p></td></tr></table>
    <div class="legal">{p}</div></body>""",
    """<body><aside class="popup"><p>{p}</p></aside><main data-main><h1>{s}</h1><p>{p}</p><dl><dt>{s}</dt><dd>{p}</dd></dl><p>{p}</p></main>
    <section id="disqus"><p>{p}</p><p>{s}</p></section><div class="social"><a href="/7">{s}</a></div></body>""",
]


def labelled_pages(copies: int = 4, seed: int = 7) -> list[str]:
    """Each layout ``copies`` times, with other filler."""
    rng = random.Random(seed)

    def some(few: int, many: int) -> str:
        return " ".join(rng.choice(FILLER) for _ in range(rng.randint(few, many)))

    def fill(layout: str) -> str:
        out = []
        for part in layout.replace("{{", "{").replace("}}", "}").split("{s}"):
            sentences = [
                " ".join(some(5, 14).capitalize() + "." for _ in range(rng.randint(1, 6))) for _ in range(part.count("{p}"))
            ]
            for s in sentences:
                part = part.replace("{p}", s, 1)
            out.append(part)
        return "".join(p + (some(1, 6).capitalize() if i < len(out) - 1 else "") for i, p in enumerate(out))

    return [fill(layout) for _ in range(copies) for layout in LAYOUTS]
