"""The small labelled table of the HTML operator: made-up pages, and for each text block 1 if it is article text."""

_LONG = "The river rose through the night and by the morning the lower fields stood under water, so the farmers moved their animals up to the old quarry and waited there for the rain to end."
_MID = "Nobody in the village could remember a flood like this one."
_SHORT = "They waited."

EXAMPLES = [
    (
        f"<html><head><title>Flood</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"
        f"<div class='ad'>Buy two, get one free today.</div><article><h1>Flood in the valley</h1><p>{_LONG}</p><p>{_SHORT}</p><p><b>{_MID}<br><p>{_LONG}</p></article><footer>&copy; 2020 Valley News. {_MID}</footer></body></html>",
        [0, 0, 0, 0, 1, 1, 1, 1, 1, 0],
    ),
    (
        f"<body><header><div>Valley News</div><p>{_MID}</p></header><main><h1>Short notes</h1><p>{_SHORT}</p><p>And.</p><p>{_MID}</p><h2>Later</h2><p>{_LONG} <a href=/x>See the map</a>.</p></main>"
        f"<aside><h3>Most read</h3><a href=/1>Ten walks in the hills</a><p>{_MID}</p></aside><form>Your name<p>{_MID}</p></form></body>",
        [0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0],
    ),
    (
        f"<body><div id=menu><a href=/>Start</a> <a href=/about>About us</a></div><div class=cookie-notice>We use cookies to make this site better for you and for our partners in the valley.</div>"
        f"<div class='post-content'><h1>Bread</h1><p>{_LONG}</p><ul><li>Flour and water</li><li>A little salt</li></ul><p>{_SHORT}</p></div>"
        f"<section id=comments><p>Anna</p><p>{_LONG}</p><p>{_SHORT}</p></section><div class=footer>{_MID}</div></body>",
        [0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0],
    ),
    (
        f"<body><p><a href=/>Home</a> | <a href=/c>Contact</a></p><h1>Letters from the north</h1><p>{_LONG}</p><p>{_MID} {_MID}</p><p>{_LONG} {_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p><p><a href=/2>Next page of letters</a></p></body>",
        [0, 1, 1, 1, 1, 1, 1, 0],
    ),
    (
        f"<body><table><tr><td><a href=/a>Articles of the week</a></td><td><a href=/b>Books and maps to buy</a></td></tr></table><div><h2>Old paths</h2><div>{_LONG}</div><div>{_LONG}</div><div>{_MID}</div></div>"
        f"<div><a href=/p>Privacy</a> <a href=/t>Terms of use</a> <a href=/i>Imprint</a></div><p>Page 1 of 3</p></body>",
        [0, 0, 1, 1, 1, 1, 0, 0],
    ),
    (
        f"<body><nav><p>{_LONG}</p></nav><article><header><h1>Stone walls</h1></header><p>{_MID}</p><p>By.</p><div class=share>Share this with your friends</div><p>{_LONG}</p><aside>{_LONG}</aside><p>{_SHORT}</p>"
        f"<div class=related><a href=/w>More about walls</a></div></article><div class=newsletter><p>Get our letters by mail every week, free of charge and easy to stop.</p></div><footer><p>{_LONG}</p></footer></body>",
        [0, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0],
    ),
    (f"<body><main><p>{_SHORT}</p><p><a href=/l>{_MID}</a></p><p>{_MID}</p></main></body>", [1, 1, 1]),
    (f"<body><div><a href=/>Home</a></div><article><h1>Cut off</h1><p>{_LONG}</p><p>{_MID}", [0, 1, 1, 1]),
    (f"<body><article><h2>Alone</h2><p>{_SHORT}</p></article></body>", [1, 1]),
    (f"<body><div class=entry-content><p>{_MID}</p><p>{_LONG}</p><p>{_SHORT}</p></div></body>", [1, 1, 1]),
    (f"<article><p>The old bridge (see <a href=/b>its plan</a> and <a href=/h>its history</a>) fell.</p><p>{_MID}</p></article>", [1, 1]),
    (f"<body><h1>Winter</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p>", [1, 1, 1, 1]),
    (f"<body><div>Loading</div><p>{_LONG}</p><p>{_LONG}</p><div>Top</div></body>", [0, 1, 1, 0]),
    (
        f"<body><div class='page no-sidebar header-fixed'><div class=header>Valley News</div><article><h1>Hay</h1><p>{_SHORT}</p><p>{_LONG}</p><div class=tags>Farming</div></article><div id=footer>{_MID}</div></div></body>",
        [0, 1, 1, 1, 0, 0],
    ),
    (
        f"<body><form id=page><div class='menu-bar'><a href=/>Home</a></div><main><h1>Ice</h1><p>{_MID}</p><p>{_SHORT}</p></main><p>{_MID}</p><input></form></body>",
        [0, 1, 1, 1, 0],
    ),
    (
        f"<body><div class='banner'><div class='entry-content'><p>{_MID}</p><p>{_SHORT}</p></div><p>{_LONG}</p></div><div class=comments><article><p>{_LONG}</p><p>{_SHORT}</p></article></div></body>",
        [1, 1, 0, 0, 0],
    ),
    (
        f"<body><div class='site search'><main><p>{_SHORT}</p><p>{_LONG}</p></main></div><div class=related><article><h3>{_MID}</h3><p>{_SHORT}</p></article></div><article class=comment><p>{_LONG}</p></article></body>",
        [1, 1, 0, 0, 0],
    ),
    ("<body><article><p>And.</p></article></body>", [1]),
    (f"<body><article><p>And.</p><p>{_SHORT}</p></article></body>", [1, 1]),
    (f"<article><p>And.</p><p><a href=/x>So.</a></p><p>Then.</p><p>{_LONG}</p><p>End.</p></article>", [1, 1, 1, 1, 1]),
    (f"<main><p>{_LONG}</p><p>So.</p></main>", [1, 1]),
    ("<div class=post-content><p>And.</p><p>So.</p></div>", [1, 1]),
    ("<div class=post-content><p>And.</p></div>", [1]),
    (f"<div class=article-body><p><a href=/m>{_MID}</a></p><p>{_SHORT}</p></div>", [1, 1]),
    (f"<article><p>{_SHORT}</p><div class=share>Share</div><p>Then.</p><div class=comments><p>{_MID}</p></div></article>", [1, 0, 1, 0]),
]
