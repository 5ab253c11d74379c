"""Main text of web pages as the token run of highest score.

A page is cut into words and tags. Words score by their surroundings (the block they stand in, whether in a link),
positive where labelled pages have content; tags score negative, by how seldom they stand inside it. One linear scan
finds the contiguous run of highest sum; its text, without what is no text of an article, is the result. Labelled pages
are those that mark their article with a single `article` or `main` element: its tokens are inside, all others outside.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are counted on, about (all, if fewer).
LABELLED = 20_000

#: Largest size of a weight (a natural log odds), and the least that a tag costs.
MOST, LEAST = 4.0, 0.1

# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr script style template noscript svg math canvas select button object iframe input textarea".split())
NEVER = frozenset("script style title textarea xmp iframe noembed noframes head template noscript svg math canvas audio video object nav aside footer form button select option dialog menu".split())
MARKED = frozenset(("article", "main"))
#: Elements that are closed by name only; their end tags close what was left open inside.
HOLDS = frozenset("html body span div section article main header ul ol dl table tr td th tbody thead tfoot blockquote figure fieldset center details".split()) | NEVER
# Words in class, id or role that announce something other than the article.
SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted outbrain taboola "
    "nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager skip masthead header footer contentinfo sidebar aside complementary widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login search "
    "comment comments respond reply replies disqus share sharing social related recommended".split()
)
REMARKS = frozenset("comment comments respond reply replies disqus".split())
TITLED = frozenset("post article entry content story page main".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _signs(attributes: str) -> set[str]:
    """Words of class, id and role, in lower case, if one of them announces something else."""
    if "=" not in attributes:
        return set()
    parts = {p.lower() for m in _NAMES.finditer(attributes) for p in _PARTS.findall(m[1] or m[2] or m[3] or "")}
    return parts if parts & SIGNS else set()


def tokens(page: str):
    """Pieces of a page in order: ("text", characters) and ("tag", closing, name, attributes). Comments, declarations and the
    contents of scripts and the like are passed over; what is left open runs to the end."""
    pos, n = 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            yield "text", page[pos:]
            return
        if lt > pos:
            yield "text", page[pos:lt]
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
        elif after and after in "!?":
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
        elif m := (_TAG.match(page, lt) or _LOOSE.match(page, lt)):
            name = m[2].lower()
            yield "tag", bool(m[1]), name, m[3]
            pos = m.end()
            if not m[1] and name in RAW and not m[3].endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, pos)
                pos = n if end is None else end.start()
        elif after == "/" or after.isalpha() and after.isascii():  # a tag that never ends, or a broken end tag
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
        else:
            yield "text", "<"
            pos = lt + 1


def _extents(flat: list) -> tuple[dict[int, int], set[int], set[int]]:
    """Which start tags have an end tag, and where; those around a marked element; those around a heading of first order."""
    opened: list[tuple[str, int]] = []
    number: Counter[str] = Counter()
    closes, marked, headed = {}, set(), set()

    def all_around(found: set[int]) -> None:
        for _, at in reversed(opened):
            if at in found:  # then those further out are there, too
                break
            found.add(at)

    for k, t in enumerate(flat):
        if t[0] == "text" or t[3].endswith("/"):
            continue
        if t[2] == "h1" and not t[1]:
            all_around(headed)
        if t[2] in HOLDS:
            if not t[1]:
                if t[2] in MARKED:
                    all_around(marked)
                opened.append((t[2], k))
                number[t[2]] += 1
            elif number[t[2]]:
                while opened[-1][0] != t[2]:
                    number[opened.pop()[0]] -= 1
                number[t[2]] -= 1
                closes[opened.pop()[1]] = k
    return closes, marked, headed


def _apart(name: str, attributes: str, within: int, holds_marked: bool, holds_title: bool) -> bool:
    """Whether an element is something else than the article; within: the marked elements around it."""
    signs = _signs(attributes) if attributes else set()
    if name in ("html", "body"):
        return False
    if attributes and _HIDDEN.search(attributes):
        return True
    if name in MARKED:
        return bool(signs & REMARKS) and (within > 0 or "comment" in signs)
    if name in NEVER or signs & REMARKS:
        return True
    if name == "header" and not within:
        return True
    return bool(signs) and not holds_marked and not (holds_title and (within > 0 or signs & TITLED))


def read(page: str | None):
    """Tokens of a page with what they stand in, and whether it is labelled.

    Per token (name, words, text, quiet, inside): the tag's name or the words' surroundings; the number of words, 0 for a tag; the
    text, None for a tag; whether something else than an article is around it; whether the marked element is, None if there isn't
    one such element. An element that announces something else but is never closed ends with the next tag of a block.
    """
    flat = list(tokens(page or ""))
    closes, around, titled = _extents(flat)
    found, links, block, loose = [], False, "body", False
    level, starts = {"quiet": 0, "article": 0, "main": 0}, {"article": 0, "main": 0}
    until: dict[int, list[str]] = {}
    for k, t in enumerate(flat):
        if t[0] == "text":
            text = html.unescape(t[1])
            found.append((f"{block}/a" if links else block, len(text.split()), text, level["quiet"] > 0 or loose, level["article"], level["main"]))
            continue
        _, closing, name, attributes = t
        for what in until.pop(k, ()):
            level[what] -= 1
        if name not in INLINE:
            links = loose = False
            block = "body" if closing else name
        elif name == "a":
            links = not closing
        if not closing:
            apart = _apart(name, attributes, level["article"] + level["main"], k in around, k in titled)
            opens = ["quiet"] * apart + [name] * (name in MARKED and not apart and not level["quiet"])
            if name in MARKED and opens == [name]:
                starts[name] += 1
            if k in closes:
                for what in opens:
                    level[what] += 1
                until.setdefault(closes[k], []).extend(opens)
            elif apart and name not in VOID:
                loose = True
        found.append((("/" if closing else "") + name, 0, None, level["quiet"] > 0 or loose, level["article"], level["main"]))
    place = 4 if starts["article"] == 1 else 5 if starts["main"] == 1 and not starts["article"] else None
    return [(*t[:4], None if place is None else t[place] > 0) for t in found]


def _kind(name: str, text: str | None, quiet: bool, inside: bool | None) -> str:
    """What a token's weight goes by: w: words, t: tags. What something else is around, and words beside the one marked element, are kinds of their own."""
    if text is None:
        return "t:quiet" if quiet else f"t:{name}"
    return "w:quiet" if quiet else "w:beside" if inside is False else f"w:{name}"


def _kinds(name: str, text: str | None, quiet: bool, inside: bool | None) -> list[str]:
    """As _kind(), and for words inside the one marked element that kind as well: it stands in where the other was never seen."""
    kind = _kind(name, text, quiet, inside)
    return [kind, "w:inside"] if inside and text is not None and not quiet else [kind]


def counted(pages) -> dict[str, list[int]]:
    """Tokens by kind inside and outside the marked element, over labelled pages; words count each."""
    total: dict[str, list[int]] = {}
    for page in pages:
        found = read(page)
        if not found or found[0][4] is None:
            continue
        for name, n, text, quiet, inside in found:
            if text is None or n:
                for kind in _kinds(name, text, quiet, inside):
                    total.setdefault(kind, [0, 0])[0 if inside and not quiet else 1] += n if text is not None else 1
    return total


def weights(counts: dict[str, list[int]]) -> dict[str, float]:
    """Log odds of being inside by kind of token, smoothed and bounded; tags cost always, at most as much as a word is worth.

    Kinds never seen: words 1 ("w:"), in links outside a paragraph -0.5 ("w:/a"), tags -1 ("t:"); links in a block that was seen
    count as its words. What something else is around costs little: it is left out of the text, and an advert may stand amid an article.
    """
    out = {"w:": 1.0, "w:/a": -0.5, "t:": -1.0}
    for kind, (inside, outside) in counts.items():
        odds = math.log((inside + 1) / (outside + 1))
        out[kind] = max(-1.0, min(-LEAST, odds)) if kind.startswith("t:") else max(-MOST, min(MOST, odds))
    return out | {"w:quiet": -LEAST, "t:quiet": -LEAST}


def _weight(weight: dict[str, float], kinds: list[str]) -> float:
    kind = kinds[0]
    for known in kinds:
        if known in weight:
            return weight[known]
    if kind.startswith("t:"):
        return weight["t:"]
    return (weight["w:p"] if kind == "w:p/a" and "w:p" in weight else weight["w:/a"]) if kind.endswith("/a") else weight["w:"]


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """First and last + 1 of the contiguous run of highest sum, the first and longest of equals; (0, 0) if no sum is above 0."""
    if not len(scores):
        return 0, 0
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    least = np.minimum.accumulate(upto[:-1])
    gain = upto[1:] - least
    if gain.max() <= 1e-9:
        return 0, 0
    last = len(gain) - 1 - int(np.argmax(gain[::-1] >= gain.max() - 1e-9))
    first = int(np.argmax(upto[: last + 1] <= least[last] + 1e-9))
    return first, last + 1


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """Blocks of the best run, white space in a block as one space, joined by two line feeds."""
    found = read(page)
    scores = np.array([_weight(weight, _kinds(name, text, quiet, inside)) * (1 if text is None else n) for name, n, text, quiet, inside in found])
    first, last = best_run(scores)
    blocks: list[list[str]] = [[]]
    for name, _, text, quiet, _ in found[first:last]:
        if text is None:
            if name.lstrip("/") not in INLINE:
                blocks.append([])
            elif name == "br":
                blocks[-1].append(" ")
        elif not quiet:
            blocks[-1].append(text)
    return "\n\n".join(b for b in (" ".join("".join(parts).split()) for parts in blocks) if b)


def learn(pages: DataFrame, labelled: int = LABELLED) -> dict[str, float]:
    """Weights from about so many of the pages that mark their article, dealt by a hash of the page. A row a kind of token comes back;
    kinds are element names that HTML knows, the others count together."""
    known = {"quiet", "beside", "inside", *VOID, *INLINE, *NEVER, *HOLDS, *MARKED, *"p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary".split()}
    marked = pages.where(F.lower("html").contains("<article") | F.lower("html").contains("<main"))
    deal = max(1, -(-marked.count() // labelled))
    marked = marked.where(F.pmod(F.xxhash64("html"), F.lit(deal)) == 0).select("html")

    def count(batches):
        for batch in batches:
            rows: dict[str, list[int]] = {}
            for kind, (a, b) in counted(batch.column("html").to_pylist()).items():
                group, _, name = kind.partition(":")
                key = kind if name.removeprefix("/").partition("/")[0] in known else f"{group}:"
                own = rows.setdefault(key, [0, 0])
                own[0], own[1] = own[0] + a, own[1] + b
            yield pa.RecordBatch.from_pydict({"kind": list(rows), "a": [x[0] for x in rows.values()], "b": [x[1] for x in rows.values()]}, schema=pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    sums = marked.mapInArrow(count, "kind string, a long, b long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return weights({r.kind: [r.a, r.b] for r in sums if r.kind not in ("w:", "t:")})


def extract(pages: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page (page_id, url, html), and its code points.

    Null and empty html, and pages without a run of positive score, have an empty text. Whole pages are read, however long. Rows that
    repeat come out as often. Without a labelled page, words count 1 and tags -1. Other columns play no part.
    """
    weight = learn(pages, labelled)

    def run(batches):
        for batch in batches:
            texts = [main_text(page, weight) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
