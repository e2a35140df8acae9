"""Small labelled pages: text that begins with + is main text, with - it is not."""

_LONG = "when the river rose in the spring of that year the people of the lower town moved their goods to the upper floors and waited, as their parents had done before them, for the water to fall again"
_MIDDLE = "the council met twice in one week and found no money for a second bridge"
_SHORT = "nobody was hurt"


def _links(*names: str) -> str:
    return "<ul>" + "".join(f'<li><a href="/{n}">-{n}</a></li>' for n in names) + "</ul>"


PAGES = (
    # An article element with short paragraphs; a page head, menu, advert and foot around it.
    f"<header><p>-The Daily Post</p></header><nav>{_links('home', 'news', 'sport')}</nav><div class=ad>-Buy two and pay for one until the end of this week only</div>"
    f"<article><h1>+Flood</h1><p>+{_LONG}.</p><p>+{_SHORT}.</p><p>+Yes.</p><p>+{_MIDDLE}.</p></article><footer>-Copyright 2019 The Daily Post</footer>",
    f"<nav>{_links('start', 'shop')}</nav><article><h1>+Of bridges</h1><p>+{_MIDDLE} <a href=/b>as told before</a>.</p><p>+So.</p></article><aside><h3>-More to read</h3>{_links('one', 'two')}</aside><footer>-All rights reserved</footer>",
    # The same by class names; reader comments are long.
    f"<div id=masthead>-Our valley</div><div class='nav'>{_links('a', 'b', 'c')}</div><div class=content><h2>+A new bridge</h2><p>+{_LONG}.</p><p>+{_SHORT}.</p></div>"
    f"<div id=comments><h3>-Two replies</h3><div class=comment>-{_LONG}, or so I was told by my aunt.</div><div class=comment>-{_SHORT}, thank you.</div></div><div class=footer>-Imprint and contact</div>",
    # Notices and forms with much text.
    f"<div class=cookie-notice>-We and our partners keep small files on your device to measure visits and to show what may interest you; by going on you agree to this.</div><main><h1>+After the flood</h1><p>+{_MIDDLE}.</p><p>+{_SHORT}.</p></main>"
    "<form><p>-Give us your address and we will write to you every week about what happened in the valley and beyond it.</p></form>",
    f"<article><p>+{_LONG}.</p><div class=newsletter>-Never miss a story: put down your address and get our letter every morning before breakfast.</div><p>+{_SHORT}.</p><div class=advertisement>-Boats of all sizes, new and used</div><p>+{_MIDDLE}.</p></article>",
    # No structure at all: words and links tell.
    f"<div>{_links('home', 'about', 'contact')}</div><h1>+The bridge</h1><div>+{_LONG}.</div><div>+{_MIDDLE}, and that was that for ten long years.</div><div>-Copyright 2019</div>",
    f"<table><tr><td><a href=/x>-Index</a></td><td><a href=/y>-Back</a></td></tr></table><p>+{_LONG} and there was <a href=/z>little</a> else to do.</p><p>+{_LONG}.</p><p>-Printed here</p>",
    f"<p><a href=/1>-first</a> | <a href=/2>second</a></p><h2>+How it went on</h2><p>+{_MIDDLE}; {_MIDDLE}.</p><h2>+And ended</h2><p>+{_LONG}.</p><p><a href=/up>-to the top</a></p>",
    f"<div>-Menu</div><div><a href=/1>-one</a> <a href=/2>two</a></div><p>+{_LONG}.</p><p>+{_MIDDLE} until the next spring.</p><p>+{_LONG}.</p><p><a href=/l>-Legal</a> <a href=/p>Privacy</a></p>",
    f"<div><a href=/s>-Sign in</a></div><p>+{_LONG}.</p><div><a href=/n>-Next page</a></div><div>-Valley press</div>",
    # A sidebar with paragraphs; an article that is mostly a list.
    f"<div class=sidebar><p>-About the writer: born in the valley, lives in the valley, and writes about the valley.</p></div><article><h1>+What to pack</h1><ul><li>+boots</li><li>+rope</li><li>+a lamp</li></ul><p>+{_SHORT}.</p></article>",
    f"<div role=banner>-Good morning, valley</div><div role=main><p>+{_MIDDLE}.</p><p>+{_SHORT}.</p><blockquote>+We wait.</blockquote></div><div role=contentinfo>-Write to the press office for leave to print</div>",
    # Outside the article, though without a name.
    f"<p>-Listen to this page</p><article><p>+{_MIDDLE}.</p><p>+No.</p></article><p>-You have read three of five free pages this month</p><div>-Weather today: rain</div>",
    f"<div>-{_MIDDLE}, says our rival paper in a story that we do not print here.</div><article><h1>+Rain</h1><p>+{_LONG}.</p></article><div>-{_SHORT}</div>",
    # What stands in a named place is not main text, however long it and what follows are.
    *(f"<{place}>-{text}.</{place.split()[0]}><p>+{after}.</p><p>+{_LONG}; {_LONG}.</p><p>+{_MIDDLE}, again and again, until it was forgotten by all.</p><{place}>-{text}!</{place.split()[0]}>"
      for place in ("nav", "div class=promo", "aside", "section id=comments") for text in ("Here", _MIDDLE, f"{_LONG}, {_LONG}") for after in (_LONG, f"{_MIDDLE}, and none was asked for in the years after that")),
    # Nor is what stands beside an article.
    *(f"<div>-{text}.</div><article><h1>+Bridges</h1><p>+{body}.</p><p>+{_SHORT}.</p><p>+{body}</p></article><p>-{text}</p>" for text in (_SHORT, _MIDDLE, _LONG) for body in ("Well", _MIDDLE, f"{_LONG}, {_LONG}")),
    # All of an article is, however short and wherever it stands; a paragraph that is a link too.
    *(f"<article><p>+{first}</p><p>+{last}.</p></article>" for first in ("Yes", "One two", _SHORT, _LONG) for last in ("No", _SHORT, _MIDDLE, f"{_LONG}; {_LONG}")),
    *(f"<p>-{near}</p><article><p>+{first}</p><p><a href=/f>+{_SHORT} in the flood</a></p></article>" for near in ("Print", _SHORT) for first in ("Dry", _LONG)),
    # Without structure short lines about the text are not.
    *(f"<p>-{_SHORT[:n]}</p><p>+{_LONG}.</p><p>+{_LONG}; {_MIDDLE}.</p><p>-{_MIDDLE[:n]}</p>" for n in (4, 8, 13, 15)),
    *(f"<div>-{_SHORT[:n]}</div><div><a href=/i>-{_MIDDLE[:n]}</a></div><div>-{_SHORT}</div>" for n in (4, 8, 15)),
    # Long ones are, first and last too, and a short paragraph between two long ones.
    *(f"<p>+{a}.</p><p>+{b}.</p>" for a in (_LONG, f"{_LONG}; {_LONG}", f"{_LONG}, {_MIDDLE}") for b in (_LONG, f"{_LONG}; {_MIDDLE}")),
    *(f"<div>-{_SHORT[:n]}</div><div>+{_LONG}; {_LONG}.</div>" for n in (4, 8, 15)),
    *(f"<p>+{_LONG}.</p><p>+{_SHORT}.</p><p>+{_LONG}; {_LONG}.</p><p>+{_MIDDLE}.</p><p>+{_LONG}, {_MIDDLE}.</p><p>-{last}</p>" for last in ("Print", _SHORT)),
    *(f"<p>+{_LONG}{extra}.</p>" for extra in ("", f"; {_MIDDLE}", f"; {_LONG}")),
)
