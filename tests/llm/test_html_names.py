"""Names of classes that tell of states or subjects do not put an article aside; names of parts do."""

import pytest

from ledgerlark.llm import html_text as H

BODY = f"<p>{H._LONG}</p><p>{H._MID}</p><p>So it is.</p>"
TEXT = f"{H._LONG}\n{H._MID}\nSo it is."


@pytest.mark.parametrize("names", ['class="content has-sidebar"', 'class="flex overflow-hidden"', 'class="post comments-closed"', 'class="story social-enabled"', 'class="entry no-nav"', 'class="news search-results"', 'id="legal-analysis"', 'class="sidebar"'])
def test_the_article_stays(names):
    menu, foot = "<nav><a href=x>Home</a></nav>", "<footer><p>All rights reserved</p></footer>"
    assert H.main_text(f"<body>{menu}<article {names}>{BODY}</article>{foot}</body>", H.tree()) == TEXT
    assert H.main_text(f"<body>{menu}<div {names}><article>{BODY}</article></div>{foot}</body>", H.tree()) == TEXT


@pytest.mark.parametrize("name", ["site-footer", "comment-list", "cookie-notice", "ad-300x250", "sidebar", "related-posts", "main_menu", "left sidebar", "share-buttons", "newsletter-sign-up"])
def test_parts_beside_it_go(name):
    for where in (f'<article>{BODY}</article><div class="{name}">{BODY}</div>', f'<div id="{name.replace(" ", "-")}"><ul><li>{H._LONG}</li></ul></div><main>{BODY}</main>'):
        assert H.main_text(f"<body>{where}</body>", H.tree()) == TEXT


def test_hidden_articles_stay_hidden():
    assert H.main_text(f'<body><article class="sidebar" hidden>{BODY}</article></body>', H.tree()) == ""
    assert H.main_text(f"<body><aside><article>{BODY}</article></aside></body>", H.tree()) == ""
