"""Labelled blocks to learn main text from: pages as lists of (HTML, label), 1 for main text; each piece makes one or more
blocks, all of that label. The table is small and fixed: it is what the classifier of `html` learns from, nothing else."""

#: Sentences of some sizes to fill pieces with.
S, M, L = (
    "A short line.",
    "The council met on Tuesday evening to discuss the new library and its opening hours.",
    "The council met on Tuesday evening to discuss the new library, and after three hours of debate most members agreed that it should open on Sundays as well, which residents of the old town had asked for since the spring.",
)
LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Contact"))
MENU = f"<nav><ul>{LINKS}</ul></nav>"

#: Articles of two blocks of any size and kind, alone, after a menu or before a footer: all of an article is main text.
SIZES, KINDS = ("Word.", S, M, L), ("p", "div", "li", "h2")
WHOLE = tuple(
    (*(((MENU, 0),) if (i + j) % 3 == 1 else ()), (f"<article><{k}>{a}</{k}><{KINDS[(i + j) % 4]}>{b}</{KINDS[(i + j) % 4]}></article>", 1), *(((f"<footer>{S}</footer>", 0),) if (i + j) % 3 == 2 else ()))
    for i, a in enumerate(SIZES) for j, b in enumerate(SIZES) for k in KINDS
)

PAGES: tuple[tuple[tuple[str, int], ...], ...] = (
    ((MENU, 0), (f'<div class="ad">{M}</div>', 0), (f"<article><h1>{S}</h1>", 1), (f"<p>{L}</p><p>{M}</p><p>Yes.</p><p>{L}</p></article>", 1), (f"<footer>&copy; site. {M}</footer>", 0)),
    ((MENU, 0), (f"<article><h1>{M}</h1><p><b>{L}<br><p>{M}</p><p>No.</p></article>", 1), (f"<footer>{S}</footer>", 0)),
    ((f'<header><a href="/">Site</a> {M}</header>', 0), (f"<main><h2>{S}</h2><p>{M}</p><ul><li>One thing.</li><li>Another thing to say.</li></ul><p>{S}</p>", 1), (f'<aside><h3>Related</h3><p>{M}</p></aside>', 0), (f"<p>{M}</p></main>", 1), (f'<div class="cookie-notice">{L}</div>', 0)),
    ((f'<div id="menu"><ul>{LINKS}</ul></div>', 0), (f'<div id="content"><h1>{S}</h1><p>{L}</p><p>{S}</p><p>{L}</p>', 1), (f'<div class="share"><a href="#">Share</a> this</div>', 0), ("</div>", 1), (f'<div id="comments"><p>{M}</p><p>{L}</p><p>{S}</p></div>', 0), (f'<div id="footer">{M}</div>', 0)),
    ((f"<div><ul>{LINKS}</ul></div>", 0), (f"<h1>{M}</h1><p>{L}</p><p>{L}</p><p>{M}</p><p>{L}</p>", 1), ('<p><a href="/a">Terms of use</a> <a href="/b">Privacy</a></p>', 0)),
    ((f"<table><tr><td><a href='/x'>Home</a></td><td><a href='/y'>Archive of all older articles by month and year</a></td></tr></table>", 0), (f"<div><h2>{S}</h2><div>{L}</div><div>{L}</div><div>{M}</div></div>", 1), (f'<div><a href="/1">{M}</a></div><div><a href="/2">{M}</a></div>', 0), ("<div>Login</div><div>Search</div>", 0)),
    ((MENU, 0), (f"<article><header><h1>{S}</h1></header><p>{L}</p><blockquote>{M}</blockquote><pre>{S}</pre>", 1), (f'<div class="advert"><p>{L}</p></div>', 0), (f'<p>{M}</p><p>See <a href="/q">the older report</a> of the council for more on this.</p>', 1), (f'<section class="comments"><h3>Comments</h3><article class="comment"><p>{L}</p></article><p>{M}</p></section></article>', 0)),
    ((f'<div role="banner"><p>{M}</p></div>', 0), (f'<div class="sidebar"><p>{L}</p><p>{M}</p></div>', 0), (f'<div class="post"><p>{L}</p><p>{M}</p><p>{S}</p></div>', 1), (f'<div class="newsletter"><p>{M}</p></div>', 0)),
    ((f"<p>{L}</p><p>{L}</p>", 1), ("<p>Menu</p>", 0)),
    ((f'<main><p>{S}</p></main>', 1), (f'<div class="notice"><p>{M}</p></div>', 0), ("<div>Top</div>", 0)),
    ((f"<article><p>{S}</p></article>", 1), (f'<footer><p>{L}</p><p>{M}</p></footer>', 0)),
    ((f'<article><ul><li><a href="/t">{S}</a></li></ul><p>{M}</p></article>', 1), (f'<div><ul><li><a href="/t">{S}</a> new</li></ul></div>', 0)),
    ((f"<article><p>{M}</p><p>{S}</p></article>", 1),),
    ((MENU, 0), ("<article><h1>Snow</h1><p>Yes.</p><p>Much.</p></article>", 1)),
    ((MENU, 0), ("<article><p>Ended.</p></article>", 1)),
    ((f'<main><p><a href="/s">{M}</a></p><p>{M}</p><p>Fin.</p></main>', 1),),
    ((f'<div class="entry"><p>{S}</p><p>Really.</p></div>', 1), (f'<div class="widget">{L}</div>', 0), ("<div>Top</div>", 0)),
    ((f"<div>Login</div>", 0), (f"<h1>{S}</h1><p>{L}</p><p>Yes.</p><p>{L}</p><p>{M}</p><p>No.</p><p>{L}</p>", 1), ("<p>All rights reserved.</p>", 0)),
    ((f"<div><a href='/'>Start</a> &gt; <a href='/n'>News</a></div>", 0), (f"<h1>Snow</h1><p>{L}</p><p>{L}</p>", 1)),
    ((f'<div><a href="/">Start</a></div><div>Weather 12 degrees</div>', 0), (f"<div><p>{M}</p><p>{M}</p></div>", 1), ("<div>Share</div><div>Print</div>", 0)),
    ((f"<p>{L}</p>", 1),),
    ((f"<h2>{S}</h2><p>{M}</p>", 1), (f'<form><p>{M}</p><p>Name</p></form>', 0)),
    ((f'<section id="main"><p>{S}</p>', 1), (f'<div class="promo"><h4>{S}</h4><p>{M}</p></div>', 0), (f"<p>{S}</p><p>{M}</p></section>", 1), (f'<section class="related"><p>{M}</p><p>{L}</p></section>', 0)),
    (('<p><a href="/">Home</a> <a href="/n">News</a></p><p><a href="/s">Search all the older news</a></p>', 0), (f"<h1>{S}</h1><p>{L}</p><p>{M}</p><p>{L}</p>", 1), (f'<p><a href="/1">{M}</a></p><p><a href="/2">{M}</a></p><p><a href="/3">{S}</a></p>', 0)),
    ((MENU, 0), (f"<article><h2>Bread</h2><p>{M}</p><ul><li>Salt</li><li>Flour</li></ul><div>Stir</div><table><tr><td>Egg</td><td>Two</td></tr></table><div>Bake</div></article>", 1), ("<div>Top</div>", 0)),
    ((MENU, 0), ("<article><div>Bake</div></article>", 1)),
    ((f"<article><p>{L}</p><p>No.</p></article>", 1),),
    ((f"<main><h1>{S}</h1><p>{L}</p><div>No.</div></main>", 1),),
    ((f"<article><p>{L}</p><p>{M}</p></article>", 1), ("<p>All rights reserved.</p>", 0)),
    (("<div>Login</div>", 0), (f"<h1>Snow</h1><p>{L}</p><p>{S}</p><p>Yes.</p><p>{L}</p><p>No.</p><p>{S}</p><p>{M}</p>", 1), ("<p>All rights reserved.</p>", 0)),
    *WHOLE,
)
