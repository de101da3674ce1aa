"""Pages written and labelled by hand, in the manner of common site builders; each with its main text as blocks."""

_A = "The council voted on Tuesday to keep the old library open for another year, after a long debate about its cost."
_B = "Several residents spoke in favour of the building, which has stood on the corner of the market square since 1904."
_C = "A final decision on repairs to the roof is expected in the spring, when the surveyor's report will be published."

PAGES = {
    "news": (
        f"""<html><head><title>Library stays open</title></head><body class="home"><div id="wrapper"><div id="masthead"><a href="/">The Daily Herald</a>
<ul class="menu"><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/opinion">Opinion</a></li></ul></div>
<div class="breadcrumb"><a href="/">Home</a> &raquo; <a href="/news">News</a></div>
<div class="story"><h1>Library stays open</h1><p>{_A}</p><p>{_B}</p><div class="advertisement">Advertisement: buy one, get one free</div><p>{_C}</p></div>
<div class="sidebar"><h4>Most read</h4><ul><li><a href="/1">Bridge closed for repairs</a></li><li><a href="/2">School wins prize</a></li></ul></div>
<div id="footer"><p>&copy; 2024 The Daily Herald. All rights reserved.</p></div></div></body></html>""",
        ["Library stays open", _A, _B, _C],
    ),
    "blog": (
        f"""<!doctype html><html><body><header class="site-header"><h2><a href="/">Notes from a small garden</a></h2><nav><a href="/about">About</a> <a href="/archive">Archive</a></nav></header>
<main><article class="post"><h1 class="entry-title">Visiting the <em>old</em> library</h1><div class="entry-content"><p>{_B}</p><blockquote><p>{_A}</p></blockquote><ul><li>{_C}</li><li>Bring a torch and good shoes if you plan to climb the tower yourself.</li></ul></div></article>
<section class="comments"><h3>2 comments</h3><ol><li class="comment"><p>Lovely post, thank you!</p></li><li class="comment"><p>I was there last week.</p></li></ol></section></main>
<aside class="widget-area"><h3>Tags</h3><a href="/t/1">garden</a> <a href="/t/2">books</a></aside><footer class="site-footer">Powered by a small engine</footer></body></html>""",
        ["Visiting the old library", _B, _A, _C, "Bring a torch and good shoes if you plan to climb the tower yourself."],
    ),
    "plain": (f"<html><body><h1>History</h1><p>{_A}<p>{_B}<p>{_C}</body></html>", ["History", _A, _B, _C]),
    "docs": (
        f"""<html><body><div class="cookie-banner"><p>This site uses cookies to improve your experience.</p><button>Accept</button></div><nav class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></nav>
<div role="main" class="content"><h1>User guide</h1><h2>Install</h2><p>{_A}</p><h2>Use</h2><p>{_B}</p><table><tr><td>{_C}</td></tr></table></div><div class="footer"><a href="/terms">Terms</a> <a href="/privacy">Privacy</a></div></body></html>""",
        ["User guide", "Install", _A, "Use", _B, _C],
    ),
    "forms": (
        f"""<html><body><div class="container"><div class="header"><form action="/search"><input name="q"><button>Search</button></form></div><div class="article-body"><h1>Open day</h1><p>{_C}</p><p>{_A}</p></div>
<div class="newsletter"><h4>Newsletter</h4><form><label>Your address</label><input type="email"><button>Subscribe</button></form></div><div class="related"><h4>You may also like</h4><ul><li><a href="/x">Ten places to read</a></li><li><a href="/y">A walk in the hills</a></li></ul></div></div></body></html>""",
        ["Open day", _C, _A],
    ),
    "tables": (
        f"""<html><body><table class="layout"><tr><td class="nav"><a href="/a">Start</a><br><a href="/b">Contact</a></td><td class="main"><h1>Library</h1><p>{_A}</p><p>{_B}</p></td></tr><tr><td colspan="2" class="copyright">Copyright 1999 by the friends of the library</td></tr></table></body></html>""",
        ["Library", _A, _B],
    ),
}
