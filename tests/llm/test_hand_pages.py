"""The extractor on pages written by hand in layouts that its generator does not make, with their articles as labels."""

from tempolith.llm import html_extract, html_pages

# each page: lines of (is main, html)
PAGES = [
    [  # a table layout of the nineties
        (0, "<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>The Daily Harbour</font></td></tr><tr><td width=120>"),
        (0, "<a href=/1>News</a><br><a href=/2>Sport</a><br><a href=/3>Weather</a></td><td>"),
        (1, "<h2>Ferry returns after storm</h2>"),
        (1, "<p>The island ferry sailed again on Tuesday, four days after the storm closed the harbour to all traffic."),
        (1, "<p>Its captain said the crossing was calm, and that most of the cargo had kept well."),
        (0, "</td></tr><tr><td colspan=2><font size=1>Copyright 1998 The Daily Harbour. All rights reserved.</font></td></tr></table></body></html>"),
    ],
    [  # a page built of nameless divs, with a notice and a feed of links
        (0, "<body><div><div><a href=/>Start</a> <a href=/a>About</a> <a href=/c>Contact</a></div></div><div class=cookie-consent>We use cookies. <button>Accept</button></div>"),
        (1, "<div><div class=post><h1>How to repair a wooden chair</h1>"),
        (1, "<div>First take the joint apart; old glue turns soft in warm water, so be patient.</div>"),
        (1, "<div>Then clean both faces, put new glue on them and hold them together for a night.</div>"),
        (1, "<ul><li>Wood glue of good quality</li>"),
        (1, "<li>Two clamps and a soft cloth</li></ul></div></div>"),
        (0, "<div class=related-posts><a href=/x>Paint a door</a><a href=/y>Oil a table</a></div><div>&copy; 2021 Chairs and more</div></body>"),
    ],
    [  # semantic markup with reader comments and a form
        (0, "<body><header><h1>Field Notes</h1><nav><a href=/>Home</a> <a href=/archive>Archive</a></nav></header>"),
        (1, "<main><article><h2>Counting swifts in June</h2>"),
        (1, "<p>We counted the swifts above the mill each evening of the month, and wrote the numbers down at once.</p>"),
        (1, "<blockquote>There were never fewer than forty, even in the rain.</blockquote>"),
        (1, "<p>Next year we will begin in May, since the first pairs came earlier than we had thought.</p></article>"),
        (0, "<section id=comments><h3>2 comments</h3><div class=comment><b>Ann</b><p>Lovely report, thank you! We saw some in town too.</p></div></section></main>"),
        (0, "<form action=/subscribe><label>Your email</label><input name=e><button>Subscribe</button></form><footer>Imprint | Privacy</footer></body>"),
    ],
    [  # a wiki page
        (0, "<body><div id=sidebar-menu><ul><li><a href=/r>Random page</a></li><li><a href=/h>Help</a></li></ul></div>"),
        (1, "<div id=content><h1>Lime mortar</h1>"),
        (1, "<p><b>Lime mortar</b> is made of lime, sand and water. It has been in use for some <a href=/m>thousand years</a>.</p>"),
        (1, "<h2>Use</h2>"),
        (1, "<p>It sets slowly and stays soft, so that walls may move a little without cracks.</p></div>"),
        (0, "<div id=footer>This page was last edited on 3 May. Text is free to use.</div></body>"),
    ],
    [  # a long page with an advert inside the article
        (0, "<body><div class=topbar>Sign in</div><div class=breadcrumb><a href=/>Home</a> &gt; <a href=/t>Travel</a></div>"),
        (1, "<article><h1>Three days along the river</h1>"),
        (1, "<p>We set out early, with bread, cheese and one map, and followed the path down to the old weir.</p>"),
        (0, "<div class=ad-slot>Advertisement <a href=/buy>Buy boots now and save 20%</a></div>"),
        (1, "<p>On the second day it rained; we stayed in a barn, and the farmer brought us soup.</p>"),
        (1, "<p>The third day was the best. By noon we could see the sea.</p></article>"),
        (0, "<aside><h4>Most read</h4><ul><li><a href=/1>Ten cheap trains</a></li><li><a href=/2>Where to swim</a></li></ul></aside></body>"),
    ],
]


def test_recall_and_precision_on_hand_written_pages():
    field = html_extract.fit(html_pages.labelled_pages(400, seed=1))
    hit = wanted = given = 0
    for page in PAGES:
        main = {b.text for yes, html in page if yes for b in html_extract.leaf_blocks(html)}
        blocks = html_extract.leaf_blocks("".join(html for _, html in page))
        chosen = {b.text for b, keep in zip(blocks, field.decode(html_extract.block_features(blocks))) if keep}
        print("missed", sorted(main - chosen), "wrong", sorted(chosen - main))
        hit, wanted, given = hit + len(main & chosen), wanted + len(main), given + len(chosen)
    print("recall", hit, wanted, "precision", hit, given)
    assert hit >= 0.9 * wanted and hit >= 0.9 * given
