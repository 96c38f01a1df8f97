"""Labelled pages of many makes, on which the block field of ``extraction`` is fitted.

Each make is the markup of one kind of site, written by hand.  What stands between the
comments ``<!--main-->`` and ``<!--/main-->`` is labelled main text, all else boilerplate;
readers of the page never see these comments.  Names in braces are filled with invented
text: ``{title}`` a few words, ``{p}`` a paragraph, ``{s}`` a sentence, ``{w}`` one to three
words, ``{links}`` list items with links, ``{a}`` links in a row, ``{paras}`` one to seven
paragraph elements.  ``[[...]]`` is left out of every second rendering.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

MAKES = {
    "plain article": """<html><head><title>{title}</title><style>p{{margin:0}}</style></head><body><nav><ul>{links}</ul></nav><div class="ad">{s}</div>
<article><!--main--><h1>{title}</h1>{paras}<!--/main--></article><footer>&copy; {w} &middot; {s}</footer></body></html>""",
    "article, open tags": """<body><nav><ul>{links}</ul></nav><!-- ad 1 --><div class="ad">{s}</div><article><!--main--><h1>{title}</h1><p><b>{p}<br><p>{p}<p>{p}</p><!--/main--></article>
<footer>&copy; {w} &middot; {s}</footer></body>""",
    "news": """<body><div id="cookie-consent" class="consent">{s}<button>{w}</button></div><header class="masthead"><a href="/">{w}</a><nav class="main-nav"><ul>{links}</ul></nav></header>
<main><div class="breadcrumb">{a}</div><article class="story"><!--main--><h1>{title}</h1><!--/main--><div class="share social">{a}</div><!--main-->{paras}<!--/main-->[[<aside class="related"><h3>{w}</h3><ul>{links}</ul></aside>]]
<!--main--><h2>{title}</h2>{paras}<!--/main--></article><section class="comments" id="comments"><h3>{w}</h3><div class="comment"><b>{w}</b><p>{s}</p></div><div class="comment"><b>{w}</b><p>{p}</p></div></section></main>
<aside class="sidebar"><h4>{w}</h4><ul>{links}</ul><div class="advert">{s}</div></aside><footer class="site-footer"><p>&copy; 2021 {w}. {s}</p>{a}</footer></body>""",
    "blog of divs": """<body><div id="wrapper"><div id="header"><h1><a href="/">{w}</a></h1><p>{s}</p></div><div id="menu"><ul>{links}</ul></div><div id="content"><div class="post"><!--main--><h2>{title}</h2><!--/main-->
<div class="post-meta">{w} | {w}</div><div class="entry"><!--main-->{paras}<blockquote><p>{p}</p></blockquote><ul><li>{s}</li><li>{s}</li></ul>{paras}<!--/main--></div><div class="tags">{a}</div></div>
<div id="comments"><h3>{w}</h3><ol><li class="comment"><p>{p}</p></li><li class="comment"><p>{s}</p></li></ol><form><label>{w}</label><textarea></textarea><button>{w}</button></form></div></div>
<div id="sidebar"><div class="widget"><h3>{w}</h3><ul>{links}</ul></div><div class="widget"><p>{s}</p></div></div><div id="footer"><p>{s}</p></div></div></body>""",
    "no names at all": """<body><div><a href="/">{w}</a></div><div><ul>{links}</ul></div><div><div><!--main--><h1>{title}</h1>{paras}<!--/main--></div></div><div><ul>{links}</ul></div><div>&copy; {w}</div></body>""",
    "no names, plain divs": """<body><div>{a}</div><div><!--main--><h1>{title}</h1><div>{p}</div><div>{p}</div><div>{p}</div><!--/main--></div><div>{a}</div><div>&copy; {w}. {s}</div></body>""",
    "tables": """<body bgcolor="#ffffff"><table><tr><td colspan="2"><a href="/">{w}</a> | <a href="/x">{w}</a> | <a href="/y">{w}</a></td></tr><tr><td>{a}<br>{a}</td><td><!--main--><h1>{title}</h1><p>{p}<p>{p}<br><br>{p}<p>{p}<!--/main--></td></tr>
<tr><td colspan="2"><font size="1">&copy; {w} {s}</font></td></tr></table></body>""",
    "documentation": """<body><header><a href="/">{w}</a><form role="search"><label>{w}</label><input></form></header><nav class="toc"><ul>{links}</ul></nav><main role="main"><div class="breadcrumbs">{a}</div><!--main--><h1>{title}</h1><p>{p}</p>
<pre><code>{s}</code></pre><p>{p}</p><h2>{title}</h2><ul><li>{s}</li><li>{s}</li><li>{s}</li></ul><table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr><tr><td>{w}</td><td>{s}</td></tr></table><p>{p}</p><!--/main-->
<div class="pager">{a}</div></main><footer>{a}<p>{s}</p></footer></body>""",
    "encyclopedia": """<body><div id="mw-navigation" class="navigation"><ul>{links}</ul></div><div id="content" role="main"><!--main--><h1>{title}</h1><p>{p}</p><!--/main--><div class="toc"><ul>{links}</ul></div>
<!--main--><h2>{title}</h2><p>{p}</p><p>{p}</p><h3>{w}</h3><p>{p}</p><dl><dt>{w}</dt><dd>{s}</dd><dt>{w}</dt><dd>{s}</dd></dl><!--/main--></div><footer role="contentinfo"><ul><li>{s}</li><li>{s}</li></ul></footer></body>""",
    "recipe": """<body><div class="topbar">{a}</div><div class="newsletter popup"><p>{s}</p><form><input><button>{w}</button></form></div><div class="content"><!--main--><h1>{title}</h1><p>{p}</p><h2>{w}</h2><ul><li>{w}</li><li>{w}</li><li>{w}</li><li>{w}</li></ul>
<h2>{w}</h2><ol><li>{s}</li><li>{s}</li><li>{s}</li></ol><p>{p}</p><!--/main--></div><div class="related">{links}</div><section id="reviews" class="comments"><p>{s}</p><p>{s}</p></section><footer><p>{s}</p></footer></body>""",
    "main without article": """<body><a href="#c">{w}</a><header><h2>{w}</h2><nav>{a}</nav></header><main id="c"><!--main--><h1>{title}</h1>{paras}<figure><figcaption>{s}</figcaption></figure>{paras}<!--/main--></main><aside><p>{s}</p><p>{s}</p></aside><footer>{a}</footer></body>""",
    "forum-like comments": """<body><nav>{a}</nav><div class="page"><div class="article-body"><!--main--><h1>{title}</h1>{paras}<!--/main--></div><div class="discussion"><div class="reply"><span>{w}</span><p>{p}</p></div><div class="reply"><span>{w}</span><p>{p}</p></div>
<div class="reply"><span>{w}</span><p>{s}</p></div></div></div><footer>&copy; {w}</footer></body>""",
    "bare text": """<!--main--><h1>{title}</h1><p>{p}<p>{p}<p>{p}<!--/main-->""",
    "bare paragraphs": """<html><body><!--main--><p>{p}</p><p>{p}</p><!--/main--></body></html>""",
    "short note": """<body><div class="nav">{a}</div><article><!--main--><h1>{title}</h1><p>{s}</p><!--/main--></article><div class="footer">{s}</div></body>""",
    "mobile": """<body><div role="banner">{w}</div><div role="navigation">{a}</div><div role="main"><!--main--><h1>{title}</h1><section><p>{p}</p><p>{p}</p></section><section><h2>{w}</h2><p>{p}</p></section><!--/main--></div><div role="complementary"><p>{s}</p>{links}</div><div role="contentinfo">{s}</div></body>""",
    "sponsored": """<body><div class="sponsor">{s}</div><header>{w}</header><div class="main"><article><!--main--><h1>{title}</h1><p>{p}</p><!--/main--><div class="promo"><b>{w}</b><p>{s}</p></div><!--main--><p>{p}</p><p>{p}</p><!--/main--><div class="ad-slot ad">{s}</div>
<!--main--><p>{p}</p><!--/main--><div class="author-box"><p>{s}</p></div></article></div><div class="recommended"><ul>{links}</ul></div><div class="cookie notice"><p>{s}</p><button>{w}</button></div></body>""",
    "shop text": """<body><header><nav><ul>{links}</ul></nav><form><input><button>{w}</button></form></header><div class="breadcrumbs">{a}</div><div class="text prose"><!--main--><h1>{title}</h1><p>{p}</p><h3>{w}</h3><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul><!--/main--></div>
<form class="signup"><label>{w}</label><button>{w}</button><p>{s}</p></form><footer><div><h4>{w}</h4><ul>{links}</ul></div><p>&copy; {w} {s}</p></footer></body>""",
    "press release": """<body><div id="top-menu" class="menu">{a}</div><div id="page"><div id="main-body" class="body"><!--main--><h1>{title}</h1><h2>{s}</h2><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p><!--/main--></div></div><div id="bottom"><p>{s}</p><p>{a}</p></div></body>""",
    "letter with asides": """<body><header><p>{s}</p></header><article><header><!--main--><h1>{title}</h1><!--/main--></header><!--main--><p>{p}</p><!--/main--><aside><p>{s}</p></aside><!--main--><p>{p}</p><p>{p}</p><!--/main--><footer>{w} {a}</footer></article><section class="comments"><article><p>{p}</p></article><article><p>{s}</p></article></section></body>""",
    "centered, breaks": """<body><center><a href="/">{w}</a> <a href="/b">{w}</a><hr></center><!--main--><h2>{title}</h2>{p}<br><br>{p}<br><br>{p}<!--/main--><hr><center>{a}<br>&copy; {w}</center></body>""",
    "old frames of divs": """<body><div class="left">{a}<br>{a}</div><div class="middle"><!--main--><h3>{title}</h3><p>{p}</p><p>{p}</p><!--/main--></div><div class="right"><h5>{w}</h5>{a}</div><div class="bottom">{s}</div></body>""",
}

_WORDS = (
    "the of and to in is was for with that on as by at from it this are which be der die das und ein zu von den mit le la les et des un une que el los por "
    "river market stone letter winter morning people house story garden report number question street paper system music result family teacher summer "
    "Wasser Schule Stunde Arbeit Kinder Reise ville maison livre histoire temps camino ciudad historia trabajo tiempo"
).split()


def _fill(rng: random.Random, name: str) -> str:
    some = lambda lo, hi: " ".join(rng.choices(_WORDS, k=rng.randint(lo, hi)))
    sentence = lambda lo, hi: some(lo, hi).capitalize() + rng.choice("....!?")
    if name == "title":
        return some(3, 12).capitalize()
    if name == "s":
        return sentence(4, 16)
    if name == "p":
        if rng.random() < 0.12:  # a last word or two
            return some(1, 4).capitalize() + rng.choice((".", "", " *", ".***", "!"))
        return " ".join(sentence(5, 20) for _ in range(rng.choice((1, 2, 3, 4, 6, 9))))
    if name == "w":
        return some(1, 3).title()
    if name == "links":
        return "".join(f'<li><a href="/{i}">{some(1, 5)}</a></li>' for i in range(rng.randint(2, 9)))
    if name == "a":
        return rng.choice((" ", " | ", " &middot; ")).join(f'<a href="/{i}">{some(1, 3)}</a>' for i in range(rng.randint(1, 6)))
    return "".join(f"<p>{_fill(rng, 'p')}</p>" for _ in range(rng.randint(1, 7)))


def render(make: str, seed: int) -> str:
    """A page of a make, with the comments that label it."""
    rng = random.Random(f"{make}/{seed}")
    shape = re.sub(r"\[\[(.*?)\]\]", (lambda m: m.group(1)) if seed % 2 else "", MAKES[make], flags=re.S)
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", lambda m: _fill(rng, m.group(1)), shape).replace("{{", "{").replace("}}", "}")


def rendered(makes: list[str] | None = None, each: int = 10) -> Iterator[str]:
    """``each`` pages of every make (by default all makes)."""
    for make in makes or MAKES:
        for seed in range(each):
            yield render(make, seed)
