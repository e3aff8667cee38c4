"""A small labelled table of pages: lines that begin with + are main text, lines that begin with - are not.

Made up for training; each text is one block. The mark is cut off before the
features of a block are taken.
"""

EXAMPLES = [
    """<html><body><nav><ul><li><a href="/a">- Home</a></li><li><a href="/b">- World news</a></li></ul></nav>
    <div class="ad">- Buy one lamp and get another for free this week only.</div>
    <article><h1>+ River levels fall after a dry spring</h1>
    <p>+ Levels along the lower river fell again last week, and barges now sail with half of their load.</p>
    <p>+ Engineers measured less than two metres at the old bridge.</p><p>+ Nobody was hurt.</p><p>+ Rain?</p></article>
    <footer>- Copyright the river paper, all rights reserved.</footer></body></html>""",
    """<body><header><h2>- The Daily Harbour</h2><p>- News from the coast since the year the lighthouse was built</p></header>
    <main><h1>+ How to mend a net</h1><p>+ Lay the net flat and find the first broken mesh before you cut anything away.</p>
    <p>+ Tie the twine with a sheet bend, keep the gauge level, and work from left to right until the hole is closed.</p>
    <ul><li>+ Twine of the same weight</li><li>+ A wooden gauge</li><li>+ One needle</li></ul></main>
    <aside><h3>- More from us</h3><p>- Seven walks along the shore that you can take with small children in any weather.</p>
    <p><a href="/x">- Tide tables</a></p></aside></body>""",
    """<div class="cookie-notice">- We use cookies to make this site work and to understand how people use it. <a href="/c">- Settings</a></div>
    <div class="post"><h1>+ Notes from the garden</h1><p>+ The beans came up in nine days, a little sooner than the packet said they would.</p>
    <blockquote>+ Water in the evening, my grandmother used to say, and never at noon.</blockquote><p>+ She was right.</p></div>
    <div id="comments"><h3>- Three comments</h3><p>- Lovely post, thank you, our beans are late this year and the slugs ate half of them.</p>
    <p>- Same here!</p></div>
    <form><label>- Your name</label><p>- Leave a reply below, your address will not be published anywhere.</p></form>""",
    """<div class="menu"><a href="/1">- Start</a> <a href="/2">- Shop</a> <a href="/3">- Contact</a></div>
    <p>+ The old mill stands at the end of the lane, where the brook turns south, and has been empty for thirty years.</p>
    <p>+ A group of neighbours wants to buy it and open a workshop for wood and metal there before the winter comes.</p>
    <p><a href="/4">- Read the next story</a></p><p><a href="/5">- All stories</a></p>
    <div class="sidebar"><p>- Follow us every day for more stories about old houses and the people who live in them.</p></div>""",
    """<body><nav><a href="/n">- Overview</a></nav><article><header><h1>+ Bread without kneading</h1></header>
    <p>+ Mix flour, water, salt and a pinch of yeast, then wait.</p><p>+ Wait more.</p>
    <p>+ See also the <a href="/rye">+ rye bread</a> that we baked in March, which takes two days and is worth it.</p>
    <div class="advert"><p>- Knives that stay sharp for a lifetime, now at half the price in our shop.</p></div>
    <table><tr><td>+ Flour</td><td>+ 500 g</td></tr></table>
    <section class="comments"><p>- I tried this with spelt and it rose very well overnight in the cold.</p></section>
    <footer><p>- Filed under baking by the kitchen desk, last changed on Monday.</p></footer></article></body>""",
    """<div class="banner"><p>- Subscribe now and get the first month of our letter for nothing at all.</p></div>
    <div><p>+ Storks have come back to the village after eleven years, and they built a nest on the roof of the school.</p>
    <p>+ Children watch them from the yard.</p><p>+ The teacher keeps a diary.</p></div>
    <div class="share"><p>- Share this with friends</p></div><div class="related"><p><a href="/q">- Swifts in the tower</a></p>
    <p>- Read how the swifts moved into the church tower two summers ago.</p></div>
    <footer><ul><li><a href="/i">- Imprint</a></li><li><a href="/p">- Privacy</a></li></ul></footer>""",
    """<main><p>+ Yes.</p><p>+ The answer came within an hour, signed by all twelve members of the board.</p><h2>+ What now</h2>
    <p>+ Work starts in May.</p><p>+ It ends, if all goes well, before the first snow falls on the pass.</p></main>
    <dialog><p>- Please allow notifications so that you never miss a story from us again.</p></dialog>
    <div class="popup"><p>- Join our club today and save on every order you make until the summer.</p></div>""",
    """<article><h1>+ Untitled</h1><p>+ Erd ta.</p><p>+ Ro.</p><p>+ Ma te ro, te ma ta ro te erd.</p></article>
    <div class="promo">- Ta ro te ma erd te ro ta ma erd ta.</div><nav><li><a>- Te</a></li><li><a>- Ma ta</a></li></nav>
    <footer>- Ro te. Ma ta erd ro te ma ta ro.</footer>""",
    """<nav><p>- Our offices are open on weekdays from nine to five and on Saturdays from ten to two in the afternoon except in August.</p></nav>
    <article><h1>+ The last ferry</h1><p>+ It left at ten.</p><p>+ Those who came late slept in the waiting room, on benches that were made for shorter people, and took the first boat.</p></article>
    <footer>- All texts on this site may be used for teaching as long as the name of the author and the address of the page are given.</footer>""",
    """<aside>- Our editors read every letter that reaches us, and each Friday the best of them is printed on the second page of the paper.</aside>
    <article><p>+ Snow.</p><p>+ It fell for three days and three nights, and on the fourth morning the children dug a tunnel to the baker.</p></article>
    <div class="newsletter">- Leave your address here and once a week we will send you the stories that our readers liked best, nothing else.</div>
    <footer>- Made by hand in a small town by people who like paper, rivers, slow trains and long sentences about all of these things.</footer>""",
    """<form><p>- Tell us what you think of this page, what you were looking for today and whether you found it before you got bored and left.</p></form>
    <div class="content"><p>+ Salt was once worth its weight in silver here.</p><p>+ Mules carried it over the pass.</p>
    <p>+ A mule could carry two sacks, and a driver could lead six mules, so that a caravan of forty was a rare and noisy sight.</p></div>
    <div class="disclaimer"><p>- Nothing on this page is advice of any kind, and whoever follows it all the same does so at their own risk and cost.</p></div>""",
    """<header><p>- A weekly paper for everyone who lives between the two rivers, free at all stations and in most of the bakeries since long ago.</p></header>
    <section><h2>+ Apples</h2><p>+ Pick them dry.</p><p>+ Store them in a cool cellar, stalk up, without touching each other, and look at them once a week all winter.</p></section>
    <div class="sponsored"><p>- Ladders of light wood, tested by gardeners in nine countries and loved by all of them, can be ordered here until Sunday night.</p></div>
    <footer><p>- Printed on recycled paper in the old hall behind the market, which you may visit on the first Monday of every month but May.</p></footer>""",
    """<article><p>+ The clock struck.</p><p>+ Nobody moved until the last stroke had died away, and then all of them spoke at once, louder and louder.</p>
    <aside><p>- The author has written four books about clocks, towers and the people who climb them, and lives by the sea with two dogs.</p></aside>
    <nav><p>- Go back to the first part of this story, or on to the third part, in which the tower is struck by lightning at last.</p></nav>
    <form><p>- Write a comment about this story, and please be kind to others, as all of them have taken the time to read it too.</p></form></article>""",
    """<div role="navigation"><p>- You are reading the second of three pages about the canal, and may also want to see the maps that go with them.</p></div>
    <h1>+ Along the canal</h1><p>+ Start early.</p><p>+ The path is shaded until noon, has a well at the third lock, and ends at an inn which does not always open.</p>
    <p>+ Bring bread.</p><div style="display:none"><p>- This text is for programs that read pages aloud and should not be seen by anybody who looks at this page.</p></div>""",
    """<form id="aspnetForm"><div><a href="/h">- Home</a></div><div>- You are here</div><div><a href="/r">- Roofs</a></div>
    <h1>+ Thatch and slate</h1><p>+ A thatched roof lasts for thirty years if the reeds were cut in a cold winter and laid by a patient hand.</p>
    <p>+ Slate lasts longer.</p><p>+ It is heavier as well, so that the beams below must be of oak and set close to each other.</p>
    <p><a href="/o">+ Oak beams</a> + from old barns are the best that can be had for this, and they cost little.</p>
    <div><a href="/m">- Map</a></div><div>- Last changed today</div><div><a href="/t">- Terms</a></div></form>""",
    """<div class="content with-sidebar"><article><h1>+ Frost in May</h1><p>+ The vines froze in one night.</p>
    <p>+ Growers lit small fires between the rows, and the smoke lay over the valley until the sun came over the hill.</p><p>+ It was in vain.</p></article>
    <div class="sidebar"><p>- More weather from all valleys, with tables of rain and frost since the station was built.</p></div></div>
    <div><a href="/a">- Archive</a></div><p>- Printed daily</p><div><a href="/w">- Weather</a></div>""",
    """<div class="page has-comments"><p><a href="/1">- First page</a></p><p>- Two of nine</p><p><a href="/3">- Next page</a></p>
    <p>+ Bees find their way home by the sun, by the shape of the hills and, close to the hive, by its smell.</p><p>+ Wind does not stop them.</p>
    <p>+ A hive that is moved by night to a place nearby will lose many of them on the first morning.</p>
    <p><a href="/b">- Hives</a></p><p>+ Those that are lost are often taken in by other hives, as long as they bring nectar with them.</p><p><a href="/c">- Honey</a></p>
    <div class="comments"><p>- My bees came back after two days, all of them, and I still do not know how they did it.</p></div></div>""",
    """<div><a href="/s">- Shop</a></div><article class="post-with-ads"><p>+ Read on.</p><p><a href="/k">- Kites on offer</a></p><p>+ It flies.</p><p><a href="/l">- Lines on offer</a></p>
    <p>+ A kite needs a tail only if its bow is flat, and a good wind needs no run at all.</p><div class="ads"><p>- Strong lines for kites of all sizes, sold by the yard in our shop.</p></div></article>""",
    """<div><a href="/u">- Up</a></div><article><p>+ He ran.</p><p><a href="/v">- Vans</a></p><p>+ She laughed at him.</p><p><a href="/z">- Zinc</a></p>
    <p>+ Then both fell.</p><p><a href="/y">- Yarn</a></p><p>+ Up.</p></article><div><a href="/d">- Down</a></div>""",
    """<p><a href="/1">- Pumps and wells</a></p><p>- Open at nine</p><p><a href="/2">- Pipes of all sizes</a></p><p>- Closed on Sundays</p><p><a href="/3">- Where to find us</a></p>
    <h2>+ Digging a well</h2><p>+ Ask the neighbours first, since they know how deep the water stands in a dry summer and how it tastes.</p><p>+ Dig in autumn.</p>
    <p><a href="/5">- Spades</a></p><p>- All rights reserved</p><p><a href="/6">- Legal notes of the firm</a></p>""",
    """<p>+ The lamp went out.</p><p>+ It was dark.</p><p><a href="/7">- Lamps</a></p><p>- Ends soon</p><p><a href="/8">- Oil</a></p>
    <p>+ Somebody lit a match and held it up until it burned their fingers, and then it was dark again.</p><p>+ Nobody spoke.</p><p><a href="/9">- Wicks</a></p>""",
    """<p>+ The tide turned at four.</p><p><a href="/10">- Tides</a></p><p>- Free of charge</p><p><a href="/11">- Moon</a></p><p>- Sold out</p><p><a href="/12">- Charts of the bay</a></p>""",
]
