"""Pages whose pieces are labelled (1 for main text), from which the tree of html_extract is grown.

A number in braces stands for so many words.
"""

from __future__ import annotations

import re

_FILLER = "some plain words of a page that say a thing or two about it in a row and then go on".split()


def _page(*pieces: tuple[int, str]) -> list[tuple[int, str]]:
    words = lambda m: " ".join(_FILLER[k % len(_FILLER)] for k in range(int(m[1])))
    return [(label, re.sub(r"\{(\d+)\}", words, piece)) for label, piece in pieces]


_NAV = (0, "<nav><ul><li><a href=/a>{1}</a></li><li><a href=/b>{2}</a></li><li><a href=/c>{1}</a></li></ul></nav>")
_DIV_NAV = (0, "<div class=menu><a href=/a>{1}</a><div><a href=/b>{1}</a></div><div><a href=/c>{2}</a></div></div>")
_FOOT = (0, "<footer><p>{8}</p><ul><li><a href=/t>{1}</a></li><li><a href=/p>{2}</a></li></ul></footer>")
_COOKIES = (0, "<div class='cookie-bar'><p>{25}</p><button>OK</button></div>")

PAGES = [
    _page(_NAV, (0, "<div class=ad>{9}</div>"), (1, "<article><h1>{7}</h1><p>{60}</p><p>{1}</p><p>{35}<br>{3}</p><p>{2}</p><p>{120}</p>"), (1, "<h2>{3}</h2><p>{44}</p><ul><li>{5}</li><li>{14}</li></ul></article>"), _FOOT),
    _page(_COOKIES, (0, "<header><a href=/>{2}</a><p>{6}</p></header>"), _NAV, (1, "<main><h1>{5}</h1><p>{80}</p><figure><img><figcaption>{9}</figcaption></figure><p>{30}</p>"), (0, "<aside><h3>{2}</h3><p>{28}</p></aside>"), (1, "<p>{55}</p><blockquote>{18}</blockquote><p>{4}</p></main>"), _FOOT),
    _page(_DIV_NAV, (1, "<div class='post'><h2 class='post-header'>{6}</h2><p>{70}</p><div class='related-work'><h3>{2}</h3><p>{40}</p><p>{22}</p></div><p>{51}</p>"), (0, "<div class='share'><a href=/s>{1}</a><a href=/u>{1}</a></div>"), (0, "<div class='comments'><h3>{2}</h3><p>{30}</p><p>{45}</p></div>"), (1, "</div>"), _FOOT),
    _page(_NAV, (1, "<article>"), (0, "<header><p>{5}</p></header>"), (1, "<h1>{8}</h1><p>{33}</p><table><tr><th>{2}</th><th>{1}</th></tr><tr><td>{1}</td><td>{3}</td></tr></table><p>{64}</p><pre>{20}</pre>"), (0, "<form><label>{3}</label><input></form>"), (1, "<p>{26}</p>"), (0, "<footer><p>{9}</p></footer>"), (1, "</article>"), (0, "<section><h2>{2}</h2><ul><li><a href=/1>{7}</a></li><li><a href=/2>{9}</a></li></ul></section>"), _FOOT),
    _page(_NAV, (1, "<article><header><h1>{6}</h1></header><p>{50}</p><p><a href=/x>{6}</a></p><p>{12} <a href=/y>{3}</a> {20}</p><ol><li><a href=/z>{4}</a></li><li>{8}</li></ol><p>{90}</p></article>"), (0, "<div><h3>{2}</h3><p>{14}</p></div><div class='newsletter'><p>{20}</p></div>"), _FOOT),
    _page((0, "<div id=header><a href=/>{2}</a><span>{4}</span></div>"), _DIV_NAV, (1, "<div><h1>{7}</h1><p>{66}</p><p>{48}</p><p>{9}</p><p>{73}</p><h2>{3}</h2><p>{39}</p></div>"), (0, "<div class=sidebar><h4>{2}</h4><p>{34}</p></div><div id=footer><p>{10}</p></div>")),
    _page((0, "<table><tr><td><a href=/a>{1}</a></td><td><a href=/b>{2}</a></td><td><a href=/c>{1}</a></td></tr></table>"), (1, "<h2>{4}</h2><p>{57}</p><p>{31}</p><p>{110}</p><p>{16}</p>"), (0, "<p><a href=/n>{1}</a> <a href=/m>{1}</a></p><div class=footer>{11}</div>")),
    _page((1, "<p>{45}</p>")),
    _page((1, "<div>{20}</div>")),
    _page(_DIV_NAV, (0, "<ul><li><a href=/1>{6}</a></li><li><a href=/2>{8}</a></li><li><a href=/3>{5}</a></li></ul><p>{3}</p>"), (0, "<div class='related'><p>{12}</p><a href=/4>{9}</a></div>"), _FOOT),
    _page((0, "<div><a href=/>{2}</a></div><div><a href=/l>{2}</a> {1} <a href=/k>{1}</a></div>"), (1, "<div>{28}</div><div>{35}</div><div>{6}</div><div>{52}</div>"), (0, "<div>{4} <a href=/q>{3}</a></div><div>{3} <a href=/r>{2}</a></div>")),
    _page(_NAV, (0, "<p>{6}</p>"), (1, "<main><p>{2}</p><p>{24}</p><div class='notice'><p>{17}</p></div><p>{61}</p><div class='search-results'><p>{33}</p></div><section><h2>{4}</h2><p>{8}</p></section></main>"), (0, "<div>{9}</div>"), _FOOT),
    _page((0, "<div class='banner'><p>{9}</p></div>"), (0, "<div class='notice'><p>{21}</p></div>"), _DIV_NAV, (1, "<h1>{5}</h1><div>{42}</div><p>{25} <a href=/i>{4}</a></p><p>{63}</p>"), (0, "<div class='search'>{4}</div><div class='comment'><p>{40}</p></div><p>{2} <a href=/up>{3}</a></p>")),
    _page(_NAV, (0, "<div class=promo><p>{33}</p></div>"), (1, "<div role=main><p>{12}</p><p>{6}</p><dl><dt>{2}</dt><dd>{15}</dd><dt>{1}</dt><dd>{31}</dd></dl></div>"), (0, "<p>{40}</p>"), _FOOT),
]
