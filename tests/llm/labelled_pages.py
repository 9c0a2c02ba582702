"""Pages written by hand in layouts that the training generator does not have; ``data-label`` tells main text (1) from the rest (0)."""

PAGES = [
    # a news story: teaser rail, by-line, pull quote, related stories within the column, tags
    """<!doctype html><html lang=en><head><meta charset=utf-8><title>River towns brace for floods | The Daily</title><link rel=stylesheet href=a.css></head><body class="page-story">
    <div id="topbar" data-label=0><a href="/">The Daily</a> <a href=/w>World</a> <a href=/s>Sport</a> <span>Monday 4 March</span></div>
    <div class="ad-slot" data-label=0>Advertisement <a href=x>Buy two, get one free at the garden centre this week only</a></div>
    <main><h1 data-label=1>River towns brace for a second week of floods</h1>
    <p data-label=1>Residents along the lower valley were told on Monday to move their belongings upstairs, as the river is expected to crest again before the weekend.</p>
    <p data-label=1>“We have never seen two peaks so close together,” said the head of the water board, who has worked there for thirty years.</p>
    <blockquote data-label=1><p>The dikes held last week, but they are soaked.</p></blockquote>
    <p data-label=1>Schools in four towns stay closed. Trains run, though with delays of up to an hour.</p>
    <h2 data-label=1>What happens next</h2><p data-label=1>Engineers will inspect the sluices on Tuesday; the results decide whether the low road can be opened.</p></main>
    <aside class="rail related" data-label=0><h3>More from this section</h3><ul><li><a href=1>Storm leaves thousands without power</a><li><a href=2>Opinion: we were warned</a></ul></aside>
    <section id=comments data-label=0><h3>12 comments</h3><div class=comment><p>I live there and the pumps were never serviced, not once.</p></div><div class=comment><p>Stay safe everyone!</p></div></section>
    <footer data-label=0><p>© 2024 The Daily. All rights reserved.</p><a href=t>Terms</a> <a href=p>Privacy</a></footer></body></html>""",
    # a blog with tables for layout, old markup, unclosed paragraphs, unquoted attributes
    """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2 class=masthead data-label=0><B>Martha's workshop diary</B></TD></TR>
    <TR><TD class=menu data-label=0><A HREF=i>Home</A><BR><A HREF=a>About me</A><BR><A HREF=l>Links</A></TD>
    <TD class=content data-label=1><H2>A bench from an old door</H2><P>It's been raining for days, so I finally took the door from the shed apart. The panels were rotten, but the frame is oak, and it doesn't show a single worm hole.
    <P>First I cut the rails to length; then I planed them by hand, since the nails that were left would have ruined the machine.<P>Glue, clamps, patience. Tomorrow I'll oil it.</TD></TR>
    <TR><TD COLSPAN=2 class=copyright data-label=0>Copyright Martha 2003 - mail me</TD></TR></TABLE></BODY></HTML>""",
    # documentation: side navigation, code, definition list, previous and next
    """<html><body><nav class="sidebar-nav" data-label=0><ul><li><a href=a>Install</a></li><li><a href=b>Configure</a></li><li><a href=c>Upgrade</a></li></ul></nav>
    <div role=main class=document><h1 data-label=1>Configuring the cache</h1><p data-label=1>The cache keeps the last answers in memory. Its size is set in <code>cache.size</code>, in megabytes.</p>
    <pre data-label=1>cache.size = 512
cache.policy = lru</pre><p data-label=1>Two policies can be chosen:</p><dl data-label=1><dt>lru</dt><dd>The entry that was not used for the longest time goes first.</dd><dt>fifo</dt><dd>The oldest entry goes first, whether it is in use or not.</dd></dl>
    <p data-label=1>A change takes effect after a restart.</p></div>
    <div class="pager" data-label=0><a href=p>Previous: Install</a> <a href=n>Next: Upgrade</a></div><div class="footer" data-label=0>Built with a generator. Last updated on 3 May.</div></body></html>""",
    # a recipe with a cookie banner, a newsletter form and lists
    """<html><head><title>Soup</title></head><body><div id=cookie-banner data-label=0><p>We use cookies to make this site better for you. By browsing on you agree.</p><button>Accept</button></div>
    <header class=site-header data-label=0><a href=/>Kitchen notes</a><form><input name=q><button>Search</button></form></header>
    <article class="post recipe"><h1 data-label=1>Leek and potato soup</h1><p data-label=1>Serves four. Ready in forty minutes, most of which you can spend reading.</p>
    <ul data-label=1><li>3 leeks, washed and sliced</li><li>500 g floury potatoes</li><li>1 litre of stock</li></ul>
    <ol data-label=1><li>Sweat the leeks in butter until soft, but do not let them brown.</li><li>Add potatoes and stock, and simmer for twenty minutes.</li><li>Blend, season, serve with bread.</li></ol>
    <p data-label=1>It keeps for three days in the fridge &amp; freezes well.</p></article>
    <div class="newsletter-signup" data-label=0><h3>Never miss a recipe</h3><p>Join 10,000 readers and get our best recipes every Friday, free of charge.</p><form><input type=email><button>Sign up</button></form></div>
    <div class="share-buttons" data-label=0><a href=f>Share</a> <a href=t>Tweet</a> <a href=m>Mail</a></div><footer data-label=0>Kitchen notes &copy; 2022</footer></body></html>""",
    # an encyclopedia entry: infobox, headings, references, categories
    """<html><body><div id=mw-head data-label=0><ul class=menu><li><a href=r>Read</a></li><li><a href=e>Edit</a></li><li><a href=h>History</a></li></ul></div>
    <div id=content class=mw-body><h1 data-label=1>Alpine swift</h1><p data-label=1>The <b>Alpine swift</b> is a large swift that breeds from <a href=eu>southern Europe</a> to the Himalaya, and winters much further south.</p>
    <h2 data-label=1>Description</h2><p data-label=1>It is readily told from the common swift by its size, its white belly and its brown breast band. The wings reach 57 cm.</p>
    <h2 data-label=1>Behaviour</h2><p data-label=1>Alpine swifts spend most of their lives in the air, living on the insects they catch in their beaks. They drink on the wing, but roost on vertical cliffs or walls.</p>
    <table data-label=1><tr><th>Length</th><td>20–23 cm</td></tr><tr><th>Weight</th><td>about 100 g</td></tr></table></div>
    <div id=catlinks class=footer data-label=0><a href=c1>Swifts</a> <a href=c2>Birds of Europe</a></div><div id=footer data-label=0><ul><li>This page was last edited in June.</li><li><a href=p>Privacy policy</a></li></ul></div></body></html>""",
    # a press release without classes to go by, in German, shouted headline
    """<html><body><nav data-label=0><a href=1>Start</a> <a href=2>Presse</a> <a href=3>Kontakt</a></nav><main><h1 data-label=1>NEUE BRÜCKE ERÖFFNET</h1><p data-label=1>Die Stadt hat am Freitag die neue Brücke über den Fluss eröffnet. Sie ersetzt die alte, die seit 1961 stand.</p>
    <p data-label=1>Der Bau dauerte drei Jahre und kostete 24 Millionen, zwei mehr als geplant.</p><figure data-label=1><img src=b.jpg><figcaption>Die Brücke am Tag der Eröffnung.</figcaption></figure><p data-label=1>Bis Ende des Jahres fahren auch die Busse darüber.</p></main>
    <footer data-label=0><p>Pressestelle, Rathausplatz 1</p></footer></body></html>""",
    # a forum: the question is the text, replies are reader comments
    """<html><body><div class="navbar" data-label=0><a href=/>Forum</a> &gt; <a href=g>Gardening</a></div><div class="post-body"><h1 data-label=1>Why do my tomatoes split?</h1><p data-label=1>Every August the fruit splits just before it is ripe. I water them each evening, and they stand in full sun. What am I doing wrong?</p></div>
    <div class="replies" data-label=0><div class=reply><p>Uneven watering, almost certainly. Try a mulch, and water in the morning.</p></div><div class=reply><p>Same here, I gave up and grow beans now.</p></div></div>
    <form data-label=0><p>Log in to reply to this thread.</p><input><input type=password></form><div class=legal data-label=0>All posts belong to their authors.</div></body></html>""",
    # broken markup: stray ends, an open head, quotes in text and attributes, comments with tags
    """<html><head><title>x</title><body><!-- <p>not <b>this</b></p> --><div class=menu data-label=0><a href='a"b'>One</a> <a href=c>Two</a></div></span><article>
    <h2 data-label=1>It's "quoted", isn't it?</h2><p data-label=1 title=it's>She said: 5 < 6 and 7 > 6, so don't worry about the rest of it.</p></section><p data-label=1 data-x="a>b">The last paragraph of the story ends here, with a full stop.<p data-label=1>One more without an end</article>
    <script>document.write("<p>never</p>")</script><div class="ads" data-label=0>Cheap flights, book now!</div></body>""",
]
