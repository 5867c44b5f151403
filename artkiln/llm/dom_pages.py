"""Labelled pages from which the extraction model is trained.

``data-main="1"`` opens main text, ``data-main="0"`` closes it again below.
The marks are read as labels and never as features. ``{w3}`` stands for three
words, ``{s}`` for a sentence and ``{l}`` for a long paragraph.
"""

PAGES = (
    """<html><head><title>{w3}</title><style>a</style><script>b</script></head><body><nav><ul><li><a href="/">{w1}</a></li><li><a href="/x">{w1}</a></li><li><a href="/y">{w1}</a></li></ul></nav>
    <div class="ad">{s}</div><article data-main="1"><h1>{w3}</h1><p>{l}</p><p>{s}</p><p><a href="/z">{w3}</a> {l}</p><p>{w1}</p></article><footer>&copy; {w3} &middot; {s}</footer></body></html>""",
    """<html><body><header class="site-header"><a href="/">{w1}</a><form class="search" action="/s"><input><label>{w1}</label><button>{w1}</button></form></header><div class="cookie-banner notice">{s}<button>{w1}</button></div>
    <main data-main="1"><h1>{w3}</h1><h2>{w3}</h2><p>{l}</p><ul><li>{s}</li><li>{w3}</li></ul><p>{s}</p><div class="advert" data-main="0"><p>{s}</p></div><blockquote><p>{s}</p></blockquote><pre>{s}</pre></main>
    <aside class="sidebar"><h3>{w3}</h3><ul><li><a href="/1">{w3}</a></li><li><a href="/2">{w3}</a></li></ul><p>{s}</p></aside><section id="comments" class="comments"><h2>{w1}</h2><div class="comment"><p>{s}</p></div><div class="comment"><p>{l}</p></div></section><footer><p>{s}</p></footer></body></html>""",
    """<html><body><div id="menu" class="menu navigation"><a href="/">{w1}</a> <a href="/b">{w1}</a></div><div class="breadcrumb"><a href="/">{w1}</a> {w1}</div><div id="content" class="content" data-main="1"><h1>{w3}</h1><div class="entry-content post-body"><p>{l}</p><p>{l}</p>
    <table><tr><th>{w1}</th><td>{w3}</td></tr><tr><td>{w1}</td><td>{s}</td></tr></table><figure><figcaption>{s}</figcaption></figure><h3>{w3}</h3><p>{s}</p></div></div><div class="related-posts widget"><h4>{w3}</h4><ul><li><a href="/r">{s}</a></li></ul></div>
    <div id="footer" class="footer"><p>{s}</p><a href="/i">{w1}</a></div></body></html>""",
    """<html><body><div class="banner promo sponsored"><p>{s}</p></div><div class="wrapper container"><div class="article story" data-main="1"><h1>{w3}</h1><p>{s}</p><p>{l}</p><ol><li>{s}</li><li>{l}</li></ol><dl><dt>{w1}</dt><dd>{s}</dd></dl><div>{l}</div><div class="share social" data-main="0"><a href="/t">{w1}</a></div></div>
    <div class="sidebar widget"><p>{s}</p><form class="newsletter subscribe"><p>{s}</p><input><select><option>{w1}</option></select><textarea>{w1}</textarea><button>{w1}</button></form></div></div><div class="replies responses reader-comments"><ul><li class="comment reply"><p>{l}</p></li></ul></div><div class="copyright legal">{s}</div></body></html>""",
    """<html><body><header><h1>{w1}</h1><p>{w3}</p></header><nav class="nav"><a href="/">{w1}</a></nav><section class="post" data-main="1"><h2>{w3}</h2><p>{l}</p><p>{s}</p><p>{l}</p><section><h3>{w3}</h3><p>{s}</p></section></section><div role="alert" class="alert popup modal gdpr consent">{s}</div>
    <div role="complementary" class="ads"><p>{s}</p></div><noscript><p>{s}</p></noscript><footer class="site-footer"><ul><li><a href="/c">{w1}</a></li></ul></footer></body></html>""",
    """<html><body><nav><a href="/">{w1}</a></nav><div class="ad">{l}</div><article data-main="1"><p>{w1}</p></article><footer>{l}</footer></body></html>""",
    """<html><body><p data-main="1">{l}</p><p data-main="1">{s}</p><p data-main="1">{l}</p><div class="pagination"><a href="/2">{w1}</a></div></body></html>""",
    """<html><body><nav>{w3}</nav><article data-main="1"><header><h1>{w3}</h1></header><div class="text body"><p>{s}</p><div><p>{l}</p></div></div><aside class="ad" data-main="0"><p>{s}</p></aside><p>{l}</p><form data-main="0"><p>{s}</p></form><section class="comments" data-main="0"><p>{l}</p></section></article></body></html>""",
)

_LONG = ("Rain had fallen for a week, the road was soft, and the carts stood where they had been left. People spoke of it for years. "
         "Some of them moved away in spring, others stayed and built a wall, which is still there. ")
WORDS = {"w1": "Northern", "w3": "Along the harbour", "s": "The boats came back before noon, and nobody asked why.", "l": _LONG}


def pages() -> list[str]:
    """Every page with short, usual and very long paragraphs."""
    return [p.format(**WORDS | {"l": text}) for p in PAGES for text in ("Northern", _LONG, 12 * _LONG)]
