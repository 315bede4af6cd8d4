"""Main-text extraction on markup and layouts that the given pages do not have."""

import numpy as np
import pytest

from omegalake.llm import html_extract

LONG = "The council met on Tuesday to decide what should become of the old harbour, and many had come to listen."
MORE = "It was agreed in the end that nothing would be built before the winter, whatever the owners might say."
LAST = "A second meeting will be held in the spring, when the engineers have looked at the walls."


@pytest.fixture(scope="module")
def field():
    return html_extract.train()


ATTRIBUTES = [
    ("<p title=don't>{}</p><p title=\"it's\">{}</p>", 2),
    ("<p data-x=a\"b>{}</p><p data-y='a\"b'>{}</p>", 2),
    ("<p data-x=\"1 > 0\">{}</p><p data-x='1 > 0'>{}</p>", 2),
    ("<p a=\"b\"c='d'>{}</p><p a = b c >{}</p>", 2),
    ("<p a= >{}</p><p =x>{}</p>", 2),
    ("<p a='{}</p><p>{}</p>", 1),
    ("<p ' x>{}</p><p \" y>{}</p>", 2),
    ("<p class=hidden-note title='hidden'>{}</p><p data-hidden=1>{}</p>", 2),
]


@pytest.mark.parametrize("inside, kept", ATTRIBUTES)
def test_attributes_swallow_no_text(field, inside, kept):
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title for it</h1>{inside.format(LONG, MORE)}<p>{LAST}</p></article></body></html>"
    found = field.text(page).split("\n")
    assert found == ["A title for it", *[LONG, MORE][2 - kept :], LAST]


def test_hidden_elements_go(field):
    page = f"<article><h1>A title for it</h1><p>{LONG}</p><p hidden>{MORE}</p><div style='color:red; display : none'><p>{MORE}</p><div>x</div></div><p>One <span hidden>no <span>not</span> this</span>word <b style=visibility:hidden>nor this</b>is left out of all that.</p><p hidden=until-found>{MORE}</p><p>{LAST}</p></article>"
    assert field.text(page) == "\n".join(["A title for it", LONG, "One word is left out of all that.", MORE, LAST])


LAYOUTS = [
    # no article element, a dull name
    "<div id=wrap><div class=mainnav><ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>Sport</a></ul></div><div class=storytext><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p></div><div class=colophone>&copy; 2020 The Paper</div></div>",
    # tables for layout
    "<table><tr><td class=linkbar><a href=/a>Home</a><br><a href=/b>News</a><td><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p></table><footer>&copy; 2020</footer>",
    # furniture within the article
    "<article><h1>Harbour</h1><div class=sharebar><a href=/t>Tweet</a> <a href=/f>Share</a></div><p>@1</p><p>@2</p><div class=adslot>Buy two, get one</div><p>@3</p></article>",
    # a sentence under a name not learnt, between paragraphs: kept, which is a known miss
    pytest.param("<article><h1>Harbour</h1><p>@1</p><div class='newsletters'><p>Get our news by mail every morning.</p></div><p>@2</p><p>@3</p></article>", marks=pytest.mark.xfail(strict=False)),
    "<article><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p><div class='author-bio'><p>Ann Other writes about towns and lives by the sea.</p></div></article><section class='user-reviews'><p>I was there and did not like it at all.</p></section>",
    "<main><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p><div class=paywall><p>Subscribe now to read on without adverts.</p></div></main><div class=disclaimers><p>All opinions are those of their authors only.</p></div>",
    "<div class=post><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p><div class='post-footer'>Posted in Towns</div></div><div class='related-posts'><h3>More</h3><ul><li><a href=/1>The pier</a></li><li><a href=/2>The walls</a></li></ul></div>",
    # headers and notices first
    "<header><div>The Daily Paper</div></header><div class='cookies-info' role=alert><p>We use cookies to make this site better for you.</p></div><article><header><h1>Harbour</h1></header><p>@1</p><p>@2</p><p>@3</p></article>",
    "<div class=top-strip>The Daily Paper</div><div class='popups'><p>Sign up for our letter, it is free for a month.</p></div><section class=longread><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p></section><aside class=rail><h3>Also</h3><ul><li><a href=/x>Pier</a></ul></aside>",
    # comments
    "<div class=entry><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p></div><ol class=reply-list><li class=comment>Me too, says somebody under a name of no use.</li><li class=comment>Not me.</li></ol>",
    "<article><h1>Harbour</h1><p>@1</p><p>@2</p><p>@3</p></article><div id=discussions><article class=comment><p>I never liked the harbour, and I never will.</p></article></div>",
    # forms, quotations and lists
    "<div role=navigation><a href=/>Home</a></div><article><h1>Harbour</h1><p>@1</p><blockquote><p>@2</p></blockquote><form><label>Mail</label><input><button>Go</button></form><p>@3</p></article>",
    "<article><h1>Harbour</h1><p>@1<p>@2<p>@3</article><div class=pagebar><a href=/1>1</a> <a href=/2>2</a></div>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_of_other_sites(field, layout):
    page = f"<!DOCTYPE html><html><head><title>Harbour - The Paper</title></head><body>{layout}</body></html>".replace("@1", LONG).replace("@2", MORE).replace("@3", LAST)
    assert [t for t in field.text(page).split("\n") if t != "Harbour"] == [LONG, MORE, LAST]


#: Names of which the training has none.
OTHER_NAMES = {
    "nav": "linkbar globalmenu sections-list crumbs mainnav subnav quicklinks".split(),
    "header": "mast top-strip identity pagehead banner-head nameplate".split(),
    "footer": "base bottom colophone footnotes-site endmatter rights-bar".split(),
    "side": "rail rightcol see-also more-stories aside-box bio related-posts socials sharebar".split(),
    "ad": "adslot ad-unit ads-wrapper advertising sponsored-content promos adbox".split(),
    "notice": "cookiebar cookies-info consents popups alerts disclaimers subscriber-box newsletters signup-box".split(),
    "form": "searchbox newsletter-form loginbox contact-form".split(),
    "comments": "commentarea commenting reply-list user-reviews discussions feedbacks".split(),
    "article": "storytext the-post longread copytext main-text pagebody articlebody postcontent".split(),
}


@pytest.mark.parametrize("unnamed, least", [(0.0, 0.97), (1.0, 0.96)])
def test_unseen_names(field, unnamed, least):
    assert not any(set(OTHER_NAMES[k]) & set(html_extract.NAMES[k]) for k in OTHER_NAMES)
    r, right, total = np.random.default_rng(97), 0, 0
    for _ in range(200):
        page, labels = html_extract.labelled_page(r, OTHER_NAMES, unnamed)
        right += sum(a == b for a, b in zip(field.main(html_extract.leaf_blocks(page)), labels))
        total += len(labels)
    assert right / total >= least


def test_a_page_of_many_megabytes(field):
    page = "<article>" + f"<p>{LONG}</p>" * 40_000 + "</article>"
    assert field.text(page) == "\n".join([LONG] * 40_000)
