"""Labelled pages to train the extractor on: layouts with a mark on each part, filled with made-up words.

``keep`` on an element says that its blocks belong to the main text, ``drop`` that they don't; the nearest mark above a
block counts. ``{p}`` stands for a paragraph, ``{h}`` for a heading, ``{s}`` for a few words, ``{l}`` for a list of links,
``{n}`` for a class name that says nothing.
The extractor never sees the marks.
"""

from __future__ import annotations

import random

LAYOUTS = (
    """<body drop><nav>{l}</nav><div class="ad">{s}</div><article keep><h1>{h}</h1><p>{p}</p><p>{p}</p><p><b>{s}</b> {p}<br></article>
    <footer>&copy; {s} &middot; {s}</footer></body>""",
    """<body drop><header><a href="/">{s}</a><p>{s}</p></header><nav>{l}</nav><main keep><h1>{h}</h1><p>{p}</p><h2>{h}</h2><p>{p}</p>
    <ul><li>{s}</li><li>{p}</li></ul><blockquote>{p}</blockquote></main><aside><h3>{s}</h3>{l}</aside><footer><p>{s}</p>{l}</footer></body>""",
    """<body drop><div id="header"><h2>{s}</h2></div><div id="menu">{l}</div><div id="content" keep><h1>{h}</h1><p>{p}</p><p>{s}.</p><p>{p}</p></div>
    <div id="sidebar"><h4>{s}</h4><p>{p}</p>{l}</div><div id="comments"><h3>{s}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{s}</p></div></div>
    <div id="footer">{s}</div></body>""",
    """<body drop><div class="cookie-notice"><p>{p}</p><button>{s}</button></div><div class="top-nav">{l}</div><div class="post" keep><h1>{h}</h1><p>{p}</p>
    <figure><img src="x"><figcaption>{s}</figcaption></figure><p>{p}</p><div class="advert" drop><p>{p}</p></div><p>{p}</p><pre>{s}</pre></div>
    <form action="/s"><label>{s}</label><p>{p}</p><input><button>{s}</button></form><div class="related">{l}</div></body>""",
    """<body drop><table><tr><td class="nav">{l}</td><td class="main" keep><h1>{h}</h1><p>{p}</p><p>{p}</p><table><tr><td>{s}</td><td>{s}</td></tr></table></td></tr></table>
    <div class="copyright">&copy; {s}</div></body>""",
    """<body drop><section class="hero banner"><p>{s}</p></section><article keep><h1>{h}</h1><p>{p}</p><aside class="pullout" drop><p>{p}</p></aside><p>{p}</p>
    <section><h2>{h}</h2><p>{p}</p><ol><li>{p}</li><li>{s}</li></ol></section><section class="comments" drop><h2>{s}</h2><article class="comment"><p>{p}</p></article>
    <article class="comment"><p>{s}</p></article><form><textarea></textarea><p>{s}</p></form></section></article><footer><nav>{l}</nav><p>{p}</p></footer></body>""",
    """<body drop><div class="notice alert"><p>{p}</p></div><nav class="breadcrumb">{l}</nav><div role="main"><div class="entry-content" keep><h1>{h}</h1>
    <p>{p}</p><p>{p}</p><p>{s}.</p></div><div class="share">{l}</div><ul class="comment-list"><li class="comment"><p>{p}</p></li><li><p>{p}</p></li></ul></div>
    <aside class="sidebar"><form><p>{s}</p></form><div class="widget"><h3>{s}</h3><p>{p}</p></div></aside></body>""",
    """<body drop><div>{l}</div><div keep><h1>{h}</h1><p>{p}</p><p>{p}</p><p>{p}</p></div><div><p>&copy; {s}</p>{l}</div></body>""",
    """<body drop><header class="site-header"><div class="logo">{s}</div>{l}</header><article keep><header><h1>{h}</h1></header><p>{p}</p><p>{p}</p>
    <div class="sponsored promo" drop><a href="#">{s}</a><p>{p}</p></div><p>{p}</p><dl><dt>{s}</dt><dd>{p}</dd></dl></article>
    <div id="reader-comments"><p>{s}</p><blockquote><p>{p}</p></blockquote></div><div class="newsletter subscribe"><p>{p}</p></div><footer>{s}</footer></body>""",
    """<body drop><nav>{l}</nav><article keep><h1>{h}</h1><div>{p}</div><div>{s}</div><div>{p}</div></article><div class="ads"><p>{p}</p></div><aside>{l}<p>{p}</p></aside>
    <div class="modal popup"><p>{s}</p></div><footer><small>{s}</small></footer></body>""",
    """<body drop><div class="ad">{p}</div><article keep><h1>{h}</h1><p>{s}</p><p>{s}</p></article><section id="discussion" class="replies"><p>{p}</p><p>{p}</p></section><footer>{p}</footer></body>""",
    """<body keep><p>{p}</p><p>{p}</p><p>{p}</p></body>""",
    """<body keep><h1>{h}</h1><p>{p}</p><p>{s}.</p><p>{p}</p></body>""",
    """<body keep>{p}</body>""",
    """<body keep>{p}<br><br>{p}<div>{p}</div></body>""",
    """<body drop><div class="{n}">{l}</div><div class="{n}" keep><h1>{h}</h1><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p></div><div class="{n}">&copy; {s}</div></body>""",
    """<body drop><nav>{l}</nav><article keep><h1>{h}</h1><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p><div class="{n} {n}" drop><p>{p}</p></div></article><footer>{s}</footer></body>""",
    """<body drop><nav>{l}</nav><article keep><div class="{n}" drop><p>{s}</p></div><h1>{h}</h1><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p>
    <div class="{n}" drop><p>{s}</p><p>{s}.</p></div><div class="{n}" drop>{p}</div></article><footer>{s}</footer></body>""",
    """<body drop><nav>{l}</nav><article keep><div class="{n}"><h1>{h}</h1><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p></div></article><footer>{s}</footer></body>""",
    """<body drop><nav>{l}</nav><main keep><h1>{h}</h1><p class="{n}">{p}</p><p class="{n}">{p}</p><p>{p}</p><p>{p}</p><div class="{n}" drop><div class="{n}"><p>{p}</p></div>
    <div class="{n}"><p>{s}</p></div></div></main><footer>{s}</footer></body>""",
    """<body drop><div id="{n}"><ul>{l}</ul></div><main keep><div class="{n} {n}"><h1>{h}</h1><p>{p}</p><p>{p}</p></div></main><footer>{l}</footer></body>""",
    """<body drop><article keep><h1>{h}</h1><div class="{n}"><p>{p}</p><p>{p}</p></div><div class="{n}"><p>{p}</p></div><div class="{n}"><p>{p}</p><p>{p}</p></div></article>
    <footer>{s}</footer></body>""",
    """<body drop><nav>{l}</nav><article keep><h1>{h}</h1><section class="{n} {n}"><p>{p}</p><p>{p}</p></section><section class="{n}"><h2>{h}</h2><p>{p}</p></section></article></body>""",
)
SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo kra ble sten ough".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    made[0] = made[0].capitalize()
    return " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in made)


def filled(layout: str, rng: random.Random) -> str:
    """The layout with made-up words in its places."""
    made = {
        "p": lambda: _words(rng, 8, 90) + ".",
        "h": lambda: _words(rng, 3, 10),
        "s": lambda: _words(rng, 1, 8),
        "n": lambda: "".join(rng.choice(SYLLABLES) for _ in range(4)),
        "l": lambda: "<ul>" + "".join(f'<li><a href="/{i}">{_words(rng, 1, 3)}</a></li>' for i in range(rng.randint(2, 7))) + "</ul>",
    }
    out, parts = [], layout.split("{")
    for i, part in enumerate(parts):
        out.append(part if i == 0 else made[part[0]]() + part[2:])
    return "".join(out)


def labelled_pages(copies: int = 6, seed: int = 5) -> list[str]:
    """Each layout filled ``copies`` times."""
    rng = random.Random(seed)
    head = '<!DOCTYPE html><html lang="en"><head><title>{s}</title><style>p{margin:0}</style></head>'.replace("{margin", "&#123;margin")
    return [filled(head, rng) + filled(layout, rng) + "</html>" for layout in LAYOUTS for _ in range(copies)]
