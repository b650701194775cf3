"""Hand-labelled pages: ``data-main`` opens the content, ``data-not`` ends it for an element inside."""

_LONG = "The council met on Tuesday evening to discuss the new bridge, which has been planned for ten years. Several members asked for a later date, but the vote was clear."
_MID = "Work starts in spring, said the mayor, and nobody in the hall disagreed."
_LIST = "<ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li><li><a href=/c>Weather</a></li></ul>"

PAGES = (
    f"<html><head><title>Bridge</title></head><body><nav>{_LIST}</nav><div class=ad>Buy two, get one free today.</div><article data-main><h1>Bridge</h1><p>{_LONG}</p><p>Yes.</p><p>{_MID}</p></article><footer>&copy; town.example</footer></body></html>",
    f"<html><body><header><h1>Town Paper</h1><p>All the news of the town since 1901.</p></header><main data-main><h2>Bridge vote</h2><p>{_LONG}</p><blockquote>{_MID}</blockquote><p>No</p></main><aside><h3>Most read</h3>{_LIST}</aside><footer><p>Imprint and legal terms, all rights reserved.</p></footer></body></html>",
    f"<html><body><div id=menu>{_LIST}</div><div class='post-content' data-main><h1>Harvest</h1><p>{_LONG}</p><div class='advert' data-not><p>{_MID}</p></div><p>{_MID}</p><ul><li>Apples were few.</li><li>Pears did well this year.</li></ul></div><div class=comments><p>{_LONG}</p><p>Great read!</p></div></body></html>",
    f"<html><body><div class='cookie-notice'><p>We use cookies to make this site better for you. Accept them all or choose.</p><button>Accept</button></div><article data-main><header><h1>Storm</h1></header><p>{_LONG}</p><aside data-not><p>{_MID}</p></aside><p>{_MID}</p><p>It rained.</p><section class=comments data-not><h3>Comments</h3><p>{_LONG}</p></section></article></body></html>",
    f"<html><body><div><a href=/>Home</a> <a href=/x>Archive</a></div><div data-main><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p></div><div><a href=/imprint>Imprint</a></div></body></html>",
    f"<html><body><p data-main>{_LONG}</p><p data-main>{_MID}</p></body></html>",
    f"<html><body><div class=sidebar><h3>About</h3><p>{_MID}</p>{_LIST}</div><article data-main><h1>Trains</h1><p>{_LONG}</p><table><tr><td>Line</td><td>Minutes</td></tr><tr><td>North</td><td>12</td></tr></table><pre>departs 09:15</pre><nav data-not>{_LIST}</nav></article><form><p>Your mail address, please</p><button>Send</button></form></body></html>",
    f"<html><body><header><nav>{_LIST}</nav></header><article data-main><p>Short.</p><p>{_LONG}</p><p>Ok</p><form data-not><p>Sign up for our letter and never miss a story again.</p></form><div class='share' data-not>Tell your friends</div></article><footer>{_LIST}<p>{_MID}</p></footer></body></html>",
    f"<html><body><div id=content><div class='entry' data-main><h2>Lake</h2><p>{_LONG}</p><p>{_MID}</p></div><div class='related'><h3>More</h3>{_LIST}</div><div id=disqus_thread><p>{_MID}</p><p>{_LONG}</p></div></div></body></html>",
    f"<html><body><section><h2>Latest</h2>{_LIST}</section><section class=story data-main><h1>Museum</h1><p>{_MID}</p><figure><figcaption>The hall in 1950.</figcaption></figure><p>{_LONG}</p></section><div role=contentinfo><p>{_MID}</p></div></body></html>",
    f"<html><body><div class=banner>Spring sale, everything must go!</div><div role=navigation>{_LIST}</div><div role=main data-main><h1>Choir</h1><p>{_LONG}</p><dl><dt>When</dt><dd>On Friday at eight.</dd></dl></div><div class='newsletter-popup'><p>{_MID}</p></div></body></html>",
    f"<html><body><article data-main><h1>Rain</h1><p>One.</p><p>Two</p></article><div class='promo box'><p>{_LONG}</p></div></body></html>",
    f"<html><body><nav>{_LIST}</nav><article data-main><h1>A</h1><p>One word.</p><p>Two</p><p>Three and four</p><h2>Next</h2><p>{_LONG}</p><p>12</p></article><footer>{_LONG}</footer></body></html>",
    f"<html><body><div class=ad><p>{_LONG}</p></div><article data-main><h1>{_MID}</h1><p>{_MID}</p><div class='sponsored ad' data-not>{_LONG}</div><ol><li>First</li><li>Then</li></ol><p>End.</p></article><section id=comments><article class=comment><p>{_LONG}</p></article><article class=comment><p>Fully agree.</p></article></section></body></html>",
    f"<html><body><header>{_LONG}</header><article data-main><h1>B</h1><p><a href=/q>{_MID}</a></p><p>See also: <a href=/x>more</a></p><h3>Why</h3><p>{_LONG}</p></article><aside>{_LONG}</aside><div class=notice>{_LONG}</div><form><p>{_LONG}</p></form></body></html>",
    f"<html><body><div class=wrapper><div class=header>{_LONG}</div><div class=main data-main><div><h2>C</h2><p>Go</p><p>{_LONG}</p></div><div><p>{_MID}</p><p>End</p></div><div class=comments data-not><h3>Readers say</h3><div class=comment><p>{_LONG}</p></div><div class=comment><p>Nice</p></div></div></div><div class=footer>{_LONG}</div></div></body></html>",
    f"<html><body><article data-main><p>{_LONG}</p><footer data-not>{_MID}</footer></article><nav><p>{_LONG}</p></nav></body></html>",
    f"<html><body><div class=menu>{_MID}</div><div class=text data-main><p>Hello</p><p>World</p><p>{_LONG}</p></div><div class=sidebar>{_LONG}</div><div id=footer>{_MID}</div></body></html>",
    f"<html><body><nav>{_LIST}</nav><div class=ad>{_MID}</div><article data-main><h1>Only a word</h1><p>Only a word, it.</p></article><footer>{_MID}</footer></body></html>",
    f"<html><body><nav>{_LIST}</nav><div class=ad>{_MID}</div><article data-main><h1>D</h1><p>D | e | f |</p></article><footer>F. {_MID}</footer></body></html>",
    f"<html><body><div class=ad>{_LONG}</div><article data-main><h1>{_MID}</h1></article><footer>{_LONG}</footer></body></html>",
    f"<html><body><nav>{_LIST}</nav><div class=ad>{_LONG}</div><article data-main><p>G</p></article><footer>&copy; g.example</footer></body></html>",
    f"<html><body><h1 data-main>Well</h1><p data-main>{_LONG}</p><p data-main>H i.</p></body></html>",
    "<p data-main>I only</p>",
    f"<html><body data-main>{_MID}</body></html>",
    "<html data-main>J k l</html>",
    f"<body><div class=nav>{_LIST}</div><p data-main>{_MID}</p><p data-main>M n.</p><div class=footer>{_MID}</div></body>",
    f"<html><body><nav>{_LIST}</nav><article data-main><h1>Ferry</h1><p>{_LONG}</p><div class='notice' data-not><p>{_MID}</p></div><p>{_MID}</p><p>Fine.</p></article><footer>{_MID}</footer></body></html>",
    f"<html><body><article data-main><h1>Mill</h1><div class=notice data-not>{_MID}</div><p>{_LONG}</p><p>{_LONG}</p></article></body></html>",
    f"<html><body><div class=content data-main><p>{_LONG}</p><div class='alert notice' data-not>{_LONG}</div><p>{_LONG}</p><div id=newsletter data-not><p>{_LONG}</p></div></div><div class=footer>{_MID}</div></body></html>",
    f"<html><body><article data-main><div class=notice data-not>{_MID}</div><p>{_MID}</p><p>{_MID}</p><div class='notice box' data-not><p>{_MID}</p></div></article></body></html>",
    f"<html><body><nav>{_LIST}</nav><article data-main><div class=ad data-not>{_MID}</div><p>{_MID}</p><div class=notice data-not><p>{_LONG}</p></div><div class=share data-not>{_MID}</div><p>{_MID}</p></article></body></html>",
)
