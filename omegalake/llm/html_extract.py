"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks (runs of text between block-level tags), each with the tags and
class words of its ancestors and a few features of its text. The field scores each block and each
pair of neighbours as main text or not; Viterbi gives the best labelling, and the text of
the blocks labelled as main, joined by line feeds, is the result. The field is trained on labelled
pages that are made here from a seed, in many layouts, so training needs no corpus.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video textarea title xmp noembed noframes".split())
#: What an opening tag closes: tag -> (tags closed, tags not looked beyond).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPES = frozenset("table td th html body".split())

# After an equals sign a value is quoted, or ends at white space; quotes elsewhere are plain characters.
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)"
_MARKUP = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)"
    rf"|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|{_VALUE})*+|[^>]*)(?:>|\Z)"
    r"|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Attributes whose words say what an element is for.
_NAMING = frozenset("class id role itemprop".split())
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_NAME_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in SKIPPED}


def _attributes(raw: str) -> tuple[set[str], bool]:
    """(words of the naming attributes, whether the element is hidden)."""
    words, hidden = set(), False
    for name, *values in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), "".join(values)
        if name in _NAMING:
            words.update(w for whole in value.lower().split() for w in (*_NAME_WORD.findall(whole), whole))
        hidden |= name == "hidden" and value != "until-found" or name == "style" and bool(_UNSEEN.search(value))
    return words, hidden


Block = tuple[str, frozenset, float]  # text, features of its ancestors, share of its characters in links


def leaf_blocks(page: str) -> list[Block]:
    """The page's text blocks in order; markup, comments, scripts, styles and what is hidden left out."""
    blocks: list[Block] = []
    paths: list[tuple[int, ...]] = []
    stack: list[tuple[str, frozenset, tuple[int, ...]]] = [("", frozenset(), ())]
    parts: list[str] = []
    veil: list = []  # of a hidden element within a block: its tag, and how many of it are open
    linked = in_link = elements = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and "hidden" not in stack[-1][1]:
                blocks.append((text, stack[-1][1], min(1.0, linked / len(text))))
                paths.append(stack[-1][2])
            parts.clear()
        linked = 0
        veil.clear()

    def add(raw: str) -> None:
        nonlocal linked
        if veil:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if veil and tag == veil[0]:
                veil[1] -= 1
                if not veil[1]:
                    veil.clear()
            if tag == "a":
                in_link = 0
            elif tag == "p" and all(x[0] != "p" for x in stack):
                flush()
            elif tag not in INLINE:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in _SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if tag in SKIPPED:
            if not m["attrs"].rstrip().endswith("/") or tag not in ("svg", "math"):
                closing = _RAW_END[tag].search(page, at)
                at = page.find(">", closing.start()) + 1 or len(page) if closing else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            in_link = 1 if tag == "a" else in_link
            if veil:
                veil[1] += tag == veil[0]
            elif m["attrs"] and tag not in VOID and _attributes(m["attrs"])[1]:
                veil[:] = tag, 1
            continue
        flush()
        if tag in VOID:
            continue
        if stack[-1][0] == "p":
            stack.pop()
        closed, scope = CLOSES.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in scope or not closed:
                break
            if stack[k][0] in closed:
                del stack[k:]
        words, hidden = _attributes(m["attrs"]) if m["attrs"] else ((), False)
        own = {"in:" + tag, *("name:" + w for w in words), *(f for w in words for f in _traits(w))}
        if hidden:
            own.add("hidden")
        around = stack[-1][1]
        if words:  # the nearest names count apart
            around = frozenset(f for f in around if not f.startswith("near:"))
            own.update("near:" + w for w in words)
        elements += 1
        stack.append((tag, around | own, (*stack[-1][2], elements)))
    flush()
    return _placed(blocks, paths)


def _traits(word: str) -> list[str]:
    """What a name has in common with others: what it starts and ends with."""
    return [f"starts:{word[:4]}", f"ends:{word[-4:]}"] if len(word) > 4 else []


def _placed(blocks: list[Block], paths: list[tuple[int, ...]]) -> list[Block]:
    """Adds where a block stands in its page: within the element that has most of the text that is no link, and within an article if the page has one."""
    said: dict[int, float] = {}
    for (text, _, linked), path in zip(blocks, paths):
        # A paragraph speaks for its parent, and half as much for the element around that.
        for k, share in ((2, 1.0), (3, 0.5)):
            if len(path) >= k and len(text) > 40:
                said[path[-k]] = said.get(path[-k], 0.0) + share * len(text) * (1 - linked)
    best = max(said, key=said.get, default=0)
    semantic = any("in:article" in b[1] or "in:main" in b[1] for b in blocks)
    found = []
    for (text, ancestors, linked), path in zip(blocks, paths):
        more = {"most:in" if best in path else "most:out"}
        if semantic:
            more.add("article:in" if "in:article" in ancestors or "in:main" in ancestors else "article:out")
        found.append((text, ancestors | more, linked))
    return found


def features(block: Block) -> list[str]:
    text, ancestors, linked = block
    words = text.count(" ") + 1
    found = [*ancestors]
    found.append("words:" + ("1" if words == 1 else "2-4" if words < 5 else "5-11" if words < 12 else "12-29" if words < 30 else "30"))
    found.append("linked:" + ("0" if linked == 0 else "some" if linked < 0.5 else "most"))
    found.append("ends" if text[-1] in ".!?…:\"”»" else "open")
    if "©" in text or "copyright" in text.lower():
        found.append("copyright")
    return found


class Field:
    """Two labels; ``weights`` speak for the label main, ``pairs[a, b]`` for b after a."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, bias: float):
        self.weights, self.pairs, self.bias = weights, pairs, bias
        self.names = sorted((f[5:] for f in weights if f.startswith("name:") and len(f) > 7), key=lambda w: (-len(w), w))
        self.unseen: dict[str, float] = {}

    def _weight(self, feature: str) -> float:
        """A name not seen in training counts as the longest known one that it starts with, or, of five letters or more, ends with (``sharebar``, ``postcontent``)."""
        known = self.weights.get(feature)
        if known is not None or feature[:5] not in ("name:", "near:"):
            return known or 0.0
        if feature not in self.unseen:
            if len(self.unseen) > 100_000:
                self.unseen.clear()
            like = next((w for w in self.names if feature[5:].startswith(w) or len(w) > 4 and feature.endswith(w)), None)
            self.unseen[feature] = self.weights.get(feature[:5] + like, 0.0) if like else 0.0
        return self.unseen[feature]

    def main(self, blocks: list[Block]) -> list[bool]:
        """The best labelling (Viterbi); of equally good ones that with less main text."""
        get, pairs = self.weights.get, self.pairs.tolist()
        known: dict[frozenset, float] = {}
        back, other, own = [], 0.0, 0.0
        for k, block in enumerate(blocks):
            ancestors = block[1]
            if ancestors not in known:
                known[ancestors] = sum(self._weight(f) for f in ancestors)
            unary = self.bias + known[ancestors] + sum(get(f, 0.0) for f in features((block[0], frozenset(), block[2])))
            if k == 0:
                other, own = 0.0, unary
                continue
            to_other = (other + pairs[0][0], own + pairs[1][0])
            to_own = (other + pairs[0][1], own + pairs[1][1])
            back.append((to_other[1] > to_other[0], to_own[1] > to_own[0]))
            other, own = max(to_other), max(to_own) + unary
        if not blocks:
            return []
        labels = [own > other]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n".join(b[0] for b, main in zip(blocks, self.main(blocks)) if main)


# Labelled pages.

_SYLLABLES = "ba re ti on la mi su ne ka or in ed an es ver ge lich tion eau os qué".split()


def _words(r: np.random.Generator, low: int, high: int) -> list[str]:
    return ["".join(r.choice(_SYLLABLES, r.integers(1, 4))) for _ in range(r.integers(low, high + 1))]


def _phrase(r, low: int, high: int, end: str = "") -> str:
    return " ".join(_words(r, low, high)).capitalize() + end


def _prose(r) -> str:
    """Main text in many styles: sentences, headlines, tables as text, shouting, marks."""
    kind, words = r.random(), _words(r, 1, 80)
    if kind < 0.06:
        return " | ".join(words)
    if kind < 0.12:
        return " ".join(w.upper() + "!!" for w in words)
    if kind < 0.2:
        return " ".join(w + str(r.choice(["###", "***", "&amp;&amp;&amp;"])) for w in words)
    if kind < 0.26:
        return " ".join(words[:4])
    return " ".join(words).capitalize() + str(r.choice([".", ".", ".", "?", "", ":"]))


#: Names of classes and ids by what they mark, as sites commonly use them.
NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav pagination pager toc tabs sitemap skip-link".split(),
    "header": "header site-header masthead topbar branding logo hero-banner toolbar".split(),
    "footer": "footer site-footer colophon legal imprint copyright credits bottom-bar post-footer".split(),
    "side": "sidebar widget related share social trending recommended recommendations author-bio about-author tags categories read-more popular most-read toplist archive profile follow-us".split(),
    "ad": "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner affiliate outbrain taboola commercial teaser-ad".split(),
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr popup overlay alert modal disclaimer paywall subscribe subscription newsletter newsletter-signup signup login-prompt warning toast interstitial donate".split(),
    "form": "search searchform newsletter login contact signup f".split(),
    "comments": "comments comment-list commentlist replies responses discussion disqus reviews review-list feedback guestbook thread respond".split(),
    "article": "content main-content post post-body entry entry-content story article article-body articletext blog-post page-content text body-copy".split(),
}


def labelled_page(r: np.random.Generator, names: dict[str, list[str]] = NAMES, unnamed: float = 0.15) -> tuple[str, list[bool]]:
    """A page and, for each of its leaf blocks, whether it is main text.

    names: of classes and ids. unnamed: how many elements around an article, and articles, have names that say nothing.
    """
    labels: list[bool] = []
    pick = lambda *options: str(r.choice(options))

    def block(text: str, main: bool) -> str:
        labels.append(main)
        return text

    def links(n: int, tag: str) -> str:
        return "".join(f"<{tag}><a href='/{k}'>" + block(_phrase(r, 1, 3), False) + f"</a></{tag}>" for k in range(n))

    def named(kind: str, tags: str = "div") -> str:
        """An opening and a closing tag around {}, with a name of this kind, alone or among others, or with a name that says nothing."""
        tag, name = pick(*tags.split()), pick(*names[kind])
        if tag in ("div", "section") and r.random() < unnamed:
            name = "".join(r.choice(_SYLLABLES, 3))
        name = pick(name, name, f"{name} {pick('col', 'row', 'block', 'wrap', 'box', 'mt')}", f"{pick('site', 'page', 'js', 'x')}-{name}")
        return f"<{tag} {pick('class', 'class', 'id')}='{name}'>" + "{}" + f"</{tag}>"

    def furniture(kind: str) -> str:
        n = int(r.integers(1, 7))
        if kind == "nav":
            inner = links(n, "li")
            return pick("<nav><ul>{}</ul></nav>", "<div role='navigation'>{}</div>", named(kind), named(kind, "div ul")).format(inner)
        if kind == "header":
            return pick("<header>{}</header>", named(kind)).format("<div>" + block(_phrase(r, 1, 5), False) + "</div>")
        if kind == "footer":
            return pick("<footer>{}</footer>", named(kind)).format(block(pick("&copy; ", "Copyright ") + _phrase(r, 2, 12, pick(".", "")), False))
        if kind == "side":
            inner = "<h3>" + block(_phrase(r, 1, 3), False) + "</h3><ul>" + links(n, "li") + "</ul><p>" + block(_phrase(r, 5, 30, pick(".", "")), False) + "</p>"
            return pick("<aside>{}</aside>", named(kind, "div section aside")).format(inner)
        if kind == "ad":
            return named(kind, "div section").format(block(_phrase(r, 2, 25, pick(".", "", "!")), False))
        if kind == "notice":
            return pick(named(kind, "div section"), "<div role='alert'>{}</div>", "<div role='dialog' class='modal'>{}</div>").format("<p>" + block(_phrase(r, 4, 25, pick(".", ".", "")), False) + "</p>")
        if kind == "form":
            return f"<form class='{pick(*names[kind])}'><label>" + block(_phrase(r, 1, 3), False) + "</label><input><button>" + block(_phrase(r, 1, 2), False) + "</button></form>"
        said = "".join(pick("<li class='comment'>{}</li>", "<div class='comment-body'><p>{}</p></div>", "<article class='comment'>{}</article>").format(block(_prose(r), False)) for _ in range(n))
        return named("comments", "section div ol").format(said)

    def within(kind: str) -> str:
        """Inside an article only a name that says something tells furniture from text."""
        nonlocal unnamed
        before, unnamed = unnamed, 0.0
        found = furniture(kind)
        unnamed = before
        return found

    def article() -> str:
        inside = "<h1>" + block(_phrase(r, 1, 10), True) + "</h1>" if r.random() < 0.8 else ""
        for _ in range(int(r.integers(1, 12))):
            kind = r.random()
            if kind < 0.46:
                inside += pick("<p>", "<p><b>", "<div>") + block(_prose(r), True) + pick("</p>", "") if kind < 0.38 else "<p>" + block(_prose(r), True) + "<br></p>"
            elif kind < 0.54:
                inside += "<h2>" + block(_phrase(r, 1, 6), True) + "</h2>"
            elif kind < 0.6:
                inside += "<ul>" + "".join("<li>" + block(_phrase(r, 1, 20), True) for _ in range(3)) + "</ul>"
            elif kind < 0.66:
                inside += "<blockquote><p>" + block(_prose(r), True) + "</p></blockquote>"
            elif kind < 0.7:
                inside += "<table><tr><td>" + block(_phrase(r, 1, 4), True) + "<td>" + block(_phrase(r, 1, 4), True) + "</table>"
            elif kind < 0.74:
                inside += "<figure><figcaption>" + block(_phrase(r, 3, 12), True) + "</figcaption></figure>"
            else:
                inside += within(pick("ad", "ad", "side", "form", "notice", "notice", "footer", "nav"))
        return pick(*["<article>{}</article>"] * 4, "<main>{}</main>", "<main><article>{}</article></main>", *(named("article", "div section") for _ in range(4))).replace("{}", inside)

    before = [furniture(k) for k in ("nav", "header", "ad", "notice", "form", "side") if r.random() < 0.45]
    body = "".join(before) + article()
    body += "".join(furniture(k) for k in ("comments", "side", "ad", "form", "nav", "footer") if r.random() < 0.45)
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{body}</body></html>", labels


#: Features of fewer training pages are left out: they are names by chance.
LEAST_PAGES = 4
#: Labelled pages, steps and pace of the training, and the weight decay.
PAGES, STEPS, RATE, DECAY = 800, 150, 0.2, 4e-5


@functools.cache
def train(pages: int = PAGES, seed: int = 3) -> Field:
    """Once for each process. Maximises the likelihood of the labels, by forward and backward sums over all pages at once."""
    r = np.random.default_rng(seed)
    made = []
    while len(made) < pages:
        page, labels = labelled_page(r)
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a labelled page does not read as it was made")
        made.append((blocks, labels))
    names: dict[str, int] = {}
    longest = max(len(labels) for _, labels in made)
    own, place = [], []
    seen = Counter(f for blocks, _ in made for f in {f for b in blocks for f in features(b)})
    wanted = np.zeros((pages, longest), int)
    there = np.zeros((pages, longest), bool)
    for k, (blocks, labels) in enumerate(made):
        wanted[k, : len(labels)], there[k, : len(labels)] = labels, True
        for t, b in enumerate(blocks):
            for f in (f for f in features(b) if seen[f] >= LEAST_PAGES):
                own.append(names.setdefault(f, len(names)))
                place.append(k * longest + t)
    own, place = np.array(own), np.array(place)
    theta = np.zeros(len(names) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_blocks = there.sum()
    for step in range(1, STEPS + 1):
        w, bias, pairs = theta[: len(names)], theta[-5], theta[-4:].reshape(2, 2)
        unary = (np.bincount(place, w[own], pages * longest).reshape(pages, longest) + bias) * there
        node = np.stack([np.zeros_like(unary), unary], axis=2)
        forward, backward = np.zeros((longest, pages, 2)), np.zeros((longest, pages, 2))
        forward[0] = node[:, 0]
        for t in range(1, longest):
            forward[t] = np.where(there[:, t, None], np.logaddexp(forward[t - 1, :, :1] + pairs[0], forward[t - 1, :, 1:] + pairs[1]) + node[:, t], forward[t - 1])
        for t in range(longest - 2, -1, -1):
            onward = backward[t + 1] + node[:, t + 1]
            backward[t] = np.where(there[:, t + 1, None], np.logaddexp(pairs[:, 0] + onward[:, :1], pairs[:, 1] + onward[:, 1:]), 0)
        total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
        p_main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total).T * there
        error = (wanted - p_main) * there
        gradient = np.empty_like(theta)
        gradient[: len(names)] = np.bincount(own, error.ravel()[place], len(names))
        gradient[-5] = error.sum()
        both = there[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                joint = np.exp(forward[:-1, :, a] + pairs[a, b] + node[:, 1:, b].T + backward[1:, :, b] - total).T * both
                gradient[len(names) + 1 + 2 * a + b] = ((wanted[:, :-1] == a) & (wanted[:, 1:] == b) & both).sum() - joint.sum()
        gradient = gradient / n_blocks - DECAY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in names.items()}, theta[-4:].reshape(2, 2).copy(), float(theta[-5]))


def extract(pages: DataFrame, field: Field, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole page.

    Null and empty pages have empty text. Rows with the same key each get a row. Unclosed,
    truncated and misnested markup is read as browsers do in the common cases.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [field.text(x.as_py()) for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return source.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
