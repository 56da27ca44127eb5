"""Main-text extraction by union-free wrapper inference over the pages of a host.

A page's token stream is made well formed (implied ends are closed, inline tags melt into their text,
elements without text fall out) and becomes a wrapper of its own. A wrapper is a regular expression
without unions over tags and texts. The wrappers of a host are aligned pairwise, again and again,
until one is left. Two contents are aligned as sequences, in the order of the page:

* items that match are aligned inside; texts that differ become a slot, equal ones stay a literal
  (a slot remembers up to ``VALUES_KEPT`` texts, so that a template's few variants are told from text);
* an item that only one side has becomes optional;
* neighbours of one kind become a repeated item, successive equal sequences a repeated group, within a
  page and where an alignment brings them together; a group that one side has folds the other side;
* contents of more than ``MOST_ITEMS`` items, whose order says nothing, become one repeated group of
  optional items, ``(a?b?c?)+``, which matches them all.

Every page is aligned, inside tasks first, so a host's wrapper grows with its markup and not with its
pages; partial wrappers of a host meet in two salted steps, none of which is one task's alone.

For extraction a page is matched against its host's wrapper, so every text of it fills a slot, and the
slots decide. Navigation, forms, asides and the like never hold main text. Of the others the page
takes the best level that it fills: under an article, under a main element, anything else (there: in
the element that holds most of it). From these fall out: texts of the template (the same few on many
pages) that are neither headings nor running text, while they are the lesser part; slots of links; and
trailing records below the last heading, which are repeated items of several slots that bear the signs
of readers' comments: a class that says so, an author with a time, or (outside of articles) a short first
slot in a number of items that varies. Class names only speak where an element does not hold the page's
heading or most of its article; words that parts of articles also bear (``AMBIGUOUS``) only break ties:
a part with a heading and running text goes if its slots are links, the template's, or comments, too.

Defined results: null and empty html give an empty text; a page with a null or odd url is matched
against its own wrapper; cut-off pages are closed at their end; a page without any text gives an empty
text; repeated rows are extracted each; very long pages are read whole, elements below ``MOST_DEPTH``
melt into their parent; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, partitions

SALTS = 32
#: Hosts whose wrappers a task holds at once.
HOSTS_HELD = 1_000
#: Items of a content, keys of a free group, length of a repeated group, depth of elements.
MOST_ITEMS, MOST_KEYS, MOST_PERIOD, MOST_DEPTH = 24, 64, 4, 60
#: Texts that a slot remembers (and how long they may be); pages for each that make them a template's.
VALUES_KEPT, VALUE_CHARS, TEMPLATE_PAGES = 4, 200, 5
#: Characters of a comment's first slot and of a text that tells its time, at most.
BYLINE_CHARS, DATED_CHARS = 40, 60
#: Linked characters that make a slot a menu, outside of articles and inside.
LINK_SHARE, ARTICLE_LINK_SHARE = 0.5, 0.8
#: Of the text at the chosen level: what templates hold at most, what records leave at least, what a container holds.
TEMPLATE_SHARE, RECORD_REST, ARTICLE_RECORD_REST, CONTAINER = 0.5, 0.3, 0.5, 0.7

# Element and class names of HTML practice.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base col embed hr img input link meta param source track".split())
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that repeat as running text does, whatever they hold.
FLOWING = HEADINGS | set("p li dt dd tr td th blockquote figure figcaption pre option".split())
#: Elements whose repetition makes records.
RECORDS = set("div section article li".split())
BOILERPLATE_TAGS = set("head nav footer aside form menu button select dialog noscript template iframe object svg canvas audio video fieldset datalist".split())
BOILERPLATE_WORDS = set(
    "ad ads adbox advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar sidenav rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs crumbs pagination pager footer masthead comment comments reply replies discussion disqus feedback form search toolbar skip".split()
)
#: Words that parts of an article bear as well, anywhere and inside articles or main elements.
AMBIGUOUS = set("discussion form social banner notice notices alert search share sharing feedback menu menus".split())
AMBIGUOUS_INSIDE = AMBIGUOUS | set("related recommended recommendations reply promotion rail login overlay notification notifications subscription".split())
#: Words of comments, of their authors and of their times.
COMMENTS = set("comment comments commenter reply replies disqus".split())
AUTHORS = set("author avatar user username byline commenter poster nickname".split())
DATES = set("date time timestamp posted ago".split())
#: Elements of running text: with headings, what a template's repeated texts never are.
RUNNING = set("p li dt dd td th blockquote figcaption pre".split())

#: A short text that tells a time.
_DATED = re.compile(r"\b\d{1,2}:\d{2}\b|\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b(?:19|20)\d{2}\b|\b(?:ago|yesterday|today|hier|gestern|ayer)\b", re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# A wrapper's node. KEY is a tag with its words, TEXT or GROUP; BODY the ordered items inside; FREE marks
# a group of optional items in any order. SEEN counts the parent's instances that hold the node, TIMES its
# own; texts have the VALUES seen (None: too many or long), CHARS and LINKED characters, and a page's RUNS.
# The root has checksums of some of its pages as VALUES, so that copies of a page do not count twice.
KEY, BODY, FREE, PAGES, SEEN, TIMES, REPEATED, VALUES, CHARS, LINKED, RUNS = range(11)
TEXT, GROUP = "#", "()"


def _node(key: str, body: list | None) -> list:
    return [key, body, False, 1, 1, 1, False, None, 0, 0, []]


def _key(name: str, attrs: str) -> str:
    """A tag with its class, id and role words, without digits: the token that is aligned."""
    if not attrs or "=" not in attrs:
        return name
    said = {w.lower() for m in _NAMES.finditer(attrs) for value in m.groups()[1:] if value for part in value.split() for w in ["-".join(_WORDS.findall(part))] if w}
    return name + "".join("." + w for w in sorted(said))


def parse(page: str) -> tuple[list, list[tuple[str, int, tuple[str, ...], tuple[int, ...]]]]:
    """(the page's content as nodes, its texts): a text has its words, linked characters, and its elements' keys and numbers."""
    root = _node("", [])
    stack: list[str] = []
    nodes, keys, numbers = [root], [], []
    texts: list[tuple[str, int, tuple[str, ...], tuple[int, ...]]] = []
    held: list[str] = []
    linked, in_link, opened = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if held:
            said = "".join(held)
            said = " ".join((entities.unescape(said) if "&" in said else said).split())
            if said:
                item = _node(TEXT, None)
                item[VALUES] = [said] if len(said) <= VALUE_CHARS else None
                item[CHARS], item[LINKED], item[RUNS] = len(said), min(linked, len(said)), [len(texts)]
                nodes[-1][BODY].append(item)
                texts.append((said, item[LINKED], tuple(keys), tuple(numbers)))
            held.clear()
        linked = 0

    def close() -> str:
        if len(stack) <= MOST_DEPTH:
            keys.pop()
            numbers.pop()
            node = nodes.pop()
            if node[BODY]:
                node[BODY] = fold(node[BODY])
            else:
                nodes[-1][BODY].pop()
        return stack.pop()

    for m in _TOKEN.finditer(page):
        if (said := m["text"]) is not None:
            held.append(said)
            if in_link:
                linked += len(said.strip())
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not m["end"]
            continue
        if name == "br":
            held.append(" ")
            continue
        flush()
        in_link = False
        if name in VOID:
            continue
        if m["end"]:
            if name in stack:
                while close() != name:
                    pass
            continue
        if stack and stack[-1] in CLOSED_BY_BLOCK:
            close()
        if name in SIBLINGS:
            scope, at = SCOPE[name], len(stack) - 1
            keep = len(stack)
            while at >= 0 and stack[at] not in scope:
                if stack[at] in SIBLINGS[name]:
                    keep = at
                at -= 1
            while len(stack) > keep:
                close()
        if not m["attrs"].rstrip().endswith("/") or name in ("p", "div"):
            stack.append(name)
            if len(stack) <= MOST_DEPTH:
                opened += 1
                keys.append(_key(name, m["attrs"]))
                numbers.append(opened)
                node = _node(keys[-1], [])
                nodes[-1][BODY].append(node)
                nodes.append(node)
    flush()
    while stack:
        close()
    root[BODY] = fold(root[BODY])
    root[VALUES] = [zlib.crc32("\n".join(t[0] for t in texts).encode("utf-8", "replace"))]
    return root, texts


def _shape(node: list) -> set[str]:
    return {x[KEY] for x in _flat(node[BODY])}


def _flat(items: list[list]) -> Iterator[list]:
    for x in items:
        if x[KEY] == GROUP:
            yield from _flat(x[BODY])
        else:
            yield x


def _likeness(a: list, b: list) -> float:
    """How well two items match: 0 not at all, up to 3."""
    if a[KEY] != b[KEY]:
        return 0.0
    if a[KEY] == TEXT:
        return 1.0
    if a[KEY] == GROUP:
        return 3.0 if [x[KEY] for x in a[BODY]] == [x[KEY] for x in b[BODY]] else 0.0
    one, two = _shape(a), _shape(b)
    return 1.0 + 2.0 * len(one & two) / len(one | two) if one | two else 3.0


def _alike(a: list, b: list) -> bool:
    """Whether neighbours are instances of one item."""
    return _likeness(a, b) >= 2.0 or a[KEY] == b[KEY] and a[KEY].split(".")[0] in (TEXT, *FLOWING)


def _joined(a: list, b: list, *, neighbours: bool, across: bool) -> list:
    """Two instances of one item as one: ``neighbours`` in one parent, or from two parents; ``across`` pages."""
    out = list(a)
    out[FREE] = a[FREE] or b[FREE]
    out[PAGES] = a[PAGES] + b[PAGES] if across and not neighbours else max(a[PAGES], b[PAGES])
    out[SEEN] = max(a[SEEN], b[SEEN]) if neighbours else a[SEEN] + b[SEEN]
    out[TIMES] = a[TIMES] + b[TIMES]
    out[REPEATED] = neighbours or a[REPEATED] or b[REPEATED]
    if a[KEY] == TEXT:
        values = None if a[VALUES] is None or b[VALUES] is None else sorted({*a[VALUES], *b[VALUES]})
        out[VALUES] = values if values is not None and len(values) <= VALUES_KEPT else None
        out[CHARS], out[LINKED], out[RUNS] = a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], [] if across else a[RUNS] + b[RUNS]
    else:
        out[BODY] = aligned(a[BODY], b[BODY], across)
        if not a[KEY]:
            out[VALUES] = sorted({*a[VALUES], *b[VALUES]})[: TEMPLATE_PAGES * VALUES_KEPT]
    return out


def _grouped(a: list[list], b: list[list], across: bool) -> list:
    group = _node(GROUP, [_joined(x, y, neighbours=False, across=across) for x, y in zip(a, b, strict=True)])
    group[PAGES], group[SEEN] = max(x[PAGES] for x in (*a, *b)), max(x[SEEN] for x in (*a, *b))
    group[TIMES], group[REPEATED] = 2, True
    return group


def fold(items: list[list], across: bool = False) -> list[list]:
    """Successive equal items as one repeated item, successive equal sequences as one repeated group."""
    out: list[list] = []
    for item in items:
        out.append(item)
        while (shorter := _folded_end(out, across)) is not None:
            out = shorter
    return [_free(out, across)] if len(out) > MOST_ITEMS else out


def _folded_end(out: list[list], across: bool) -> list[list] | None:
    """``out`` with its last items folded into what stands before them, if they repeat it."""
    for n in range(1, MOST_PERIOD + 1):
        last = out[-n:]
        if len(out) > n and n > 1 and (group := out[-n - 1])[KEY] == GROUP and not group[FREE] and len(group[BODY]) == n and all(map(_alike, group[BODY], last)):
            group = list(group)
            group[BODY] = [_joined(x, y, neighbours=False, across=across) for x, y in zip(group[BODY], last, strict=True)]
            group[TIMES] += 1
            return [*out[: -n - 1], group]
        if len(out) >= 2 * n and all(map(_alike, out[-2 * n : -n], last)):
            joined = _joined(out[-2], out[-1], neighbours=True, across=across) if n == 1 else _grouped(out[-2 * n : -n], last, across)
            return [*out[: -2 * n], joined]
    return None


def _free(items: list[list], across: bool) -> list:
    """A group of optional items in any order, which matches ``items`` however they are mixed."""
    by: dict[str, list] = {}
    flat = [x for x in _flat(items)]
    if len({x[KEY] for x in flat}) > MOST_KEYS:  # the classes of so many say nothing
        flat = [[x[KEY].split(".")[0], *x[1:]] for x in flat]
    for x in flat:
        by[x[KEY]] = _joined(by[x[KEY]], x, neighbours=True, across=across) if x[KEY] in by else x
    group = _node(GROUP, list(by.values()))
    group[FREE] = group[REPEATED] = True
    group[PAGES], group[SEEN] = max(x[PAGES] for x in flat), max(x[SEEN] for x in flat)
    return group


def _by_groups(items: list[list], other: list[list], across: bool) -> list[list]:
    """``items`` with every sequence that one of the ``other`` side's groups matches folded into a group."""
    for group in other:
        n = len(group[BODY]) if group[KEY] == GROUP else 0
        if n < 2 or group[FREE]:
            continue
        out: list[list] = []
        at = 0
        while at < len(items):
            here = items[at : at + n]
            if len(here) == n and all(map(_alike, group[BODY], here)):
                one = _node(GROUP, here)
                one[PAGES], one[SEEN], one[REPEATED] = max(x[PAGES] for x in here), max(x[SEEN] for x in here), True
                out.append(one)
                at += n
            else:
                out.append(items[at])
                at += 1
        items = fold(out, across) if len(out) < len(items) else items
    return items


def _is_free(items: list[list]) -> bool:
    return len(items) == 1 and items[0][KEY] == GROUP and bool(items[0][FREE])


def _pairs(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """The places of items that match, in order on both sides, with the greatest likeness in total."""
    if len(a) == len(b) and all(x[KEY] == y[KEY] for x, y in zip(a, b, strict=True)) and len({x[KEY] for x in a}) == len(a):
        return [(i, i) for i in range(len(a))]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    like = [[_likeness(x, y) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            take = like[i][j] + best[i + 1][j + 1] if like[i][j] else 0.0
            best[i][j] = max(take, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if like[i][j] and best[i][j] == like[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list[list], b: list[list], across: bool) -> list[list]:
    """One content that matches whatever either matches."""
    if not _is_free(a) and not _is_free(b):
        b = _by_groups(b, a, across)
        a = _by_groups(a, b, across)
    if _is_free(a) or _is_free(b):
        return [_free(_summed(a, b) if across else [*a, *b], across)]
    out: list[list] = []
    i = j = 0
    for x, y in [*_pairs(a, b), (len(a), len(b))]:
        out += a[i:x]
        out += b[j:y]
        if x < len(a):
            out.append(_joined(a[x], b[y], neighbours=False, across=across))
        i, j = x + 1, y + 1
    return fold(out, across)


def _summed(a: list[list], b: list[list]) -> list[list]:
    """Items of two pages' contents, those of one key joined so that their pages add up."""
    by = {x[KEY]: x for x in _free(a, True)[BODY]}
    for x in _free(b, True)[BODY]:
        by[x[KEY]] = _joined(by[x[KEY]], x, neighbours=False, across=True) if x[KEY] in by else x
    return list(by.values())


def align(a: list, b: list) -> list:
    """One wrapper that matches whatever the wrappers of two pages, or sets of pages, match."""
    return _joined(a, b, neighbours=False, across=True)


def expression(node: list) -> str:
    """The wrapper as a regular expression: tags, ``#`` slots or 'literals', ``?`` and ``+``."""
    parts = []
    for x in node[BODY]:
        if x[KEY] == TEXT:
            said = f"'{x[VALUES][0]}'" if x[VALUES] is not None and len(x[VALUES]) == 1 else TEXT
        else:
            said = expression(x) if x[KEY] == GROUP else f"<{x[KEY]}>{expression(x)}</>"
        optional = node[FREE] or x[SEEN] < node[TIMES]
        parts.append(f"({said}){'+' * x[REPEATED]}{'?' * optional}" if optional or x[REPEATED] else said)
    return "".join(parts)


# What is known of a slot: its level, and letters for what speaks against it. NEVER holds no main text.
NEVER, ARTICLE, MARKED, OTHER = "-012"
TEMPLATE, FLOWED, MENU, RECORD, SIGNED = "tfmra"


def _words(key: str) -> set[str]:
    return {w for word in key.split(".")[1:] for w in word.split("-")}


def _weights(node: list, pages: int) -> tuple[int, int, int]:
    """Characters of a node's texts: all, linked ones, the template's."""
    total = [0, 0, 0]
    for x in node[BODY]:
        part = (x[CHARS], x[LINKED], x[CHARS] * _of_template(x, pages)) if x[KEY] == TEXT else _weights(x, pages)
        total = [a + b for a, b in zip(total, part)]
    return tuple(total)


def _of_template(text: list, pages: int) -> bool:
    return text[VALUES] is not None and min(text[PAGES], pages) >= TEMPLATE_PAGES * len(text[VALUES])


def _boilerplate(key: str, above: tuple[str, ...], node: list | None, pages: int, article: int) -> bool:
    """Whether an element is none of the article's, by its tag and words; ``article``: characters of the one around."""
    name = key.split(".")[0]
    level = _level(above)
    if name in ("html", "body", "main", "article"):
        return False
    if name in BOILERPLATE_TAGS or name == "header" and level != ARTICLE:
        return True
    words = _words(key) & BOILERPLATE_WORDS
    if not words:
        return False
    doubtful = words <= (AMBIGUOUS if level == OTHER else AMBIGUOUS_INSIDE)
    if node is None:
        return not (doubtful and level == ARTICLE)
    if _holds(node, {"h1"}):
        return False
    chars, linked, constant = _weights(node, pages)
    if level == ARTICLE and 2 * chars > article:
        return False
    if doubtful and _holds(node, HEADINGS) and _holds(node, RUNNING):
        return 2 * max(linked, constant) > chars or _has_comments(node)
    return True


def _has_comments(node: list) -> bool:
    return any(x[KEY] != TEXT and (x[REPEATED] and _record(x) and _signs(x) != "" or _has_comments(x)) for x in node[BODY])


def _signs(node: list) -> str:
    """Letters of a repeated record's texts: RECORD for readers' comments, SIGNED for those if a time stands by."""
    said = _words(node[KEY]) | _said(node)
    if said & COMMENTS or said & AUTHORS and said & DATES:
        return RECORD
    return SIGNED if said & AUTHORS or _short_first(node) else ""


def _said(node: list) -> set[str]:
    return {w for x in node[BODY] if x[KEY] != TEXT for w in _words(x[KEY]) | _said(x)}


def _short_first(node: list) -> bool:
    """Whether the first text of a node is short, and differs from page to page, as a name is."""
    while node[KEY] != TEXT:
        node = node[BODY][0]
    return node[CHARS] <= BYLINE_CHARS * node[TIMES] and (node[VALUES] is None or len(node[VALUES]) > 1)


def _level(keys: tuple[str, ...]) -> str:
    parts = [k.split(".") for k in keys]
    if any(p[0] == "article" for p in parts):
        return ARTICLE
    return MARKED if any(p[0] == "main" or "main" in p[1:] or "article" in p[1:] for p in parts) else OTHER


def _holds(node: list, names: set[str]) -> bool:
    return any(x[KEY] != TEXT and (x[KEY].split(".")[0] in names or _holds(x, names)) for x in node[BODY])


def _slots(node: list) -> int:
    """Different places of text inside a node; blocks that repeat count as two."""
    return sum(1 if x[KEY] == TEXT else _slots(x) * (2 if x[REPEATED] and x[KEY].split(".")[0] in RECORDS else 1) for x in node[BODY])


def _record(node: list) -> bool:
    """Whether a repeated node is a record: several slots, no heading, and blocks that running text does not have."""
    names = {x[KEY].split(".")[0] for x in node[BODY]} if node[KEY] == GROUP else {node[KEY].split(".")[0]}
    if not names <= RECORDS or _slots(node) < 2 or _holds(node, HEADINGS):
        return False
    return names != {"li"} or _holds(node, RECORDS - {"li"} | {"header", "footer"})


def judge(wrapper: list) -> list:
    """The wrapper as a template: nodes (key, items, free), and texts ("#", what is known of the slot)."""
    pages = len(wrapper[VALUES])

    def walk(node: list, keys: tuple[str, ...], never: bool, record: str, article: int) -> list:
        out = []
        level = _level(keys)
        flowing = bool(keys) and keys[-1].split(".")[0] in RUNNING | HEADINGS
        for x in node[BODY]:
            if x[KEY] == TEXT:
                said = NEVER if never else level
                if _of_template(x, pages) and not (flowing and level != OTHER):
                    said += FLOWED if flowing else TEMPLATE
                if x[LINKED] > (ARTICLE_LINK_SHARE if level == ARTICLE else LINK_SHARE) * x[CHARS] and (level != ARTICLE or any(k.split(".")[0] == "li" for k in keys)):
                    said += MENU
                out.append([TEXT, said + record])
                continue
            group = x[KEY] == GROUP
            inside = record
            if not record and x[REPEATED] and not x[FREE] and _record(x):
                varies = x[SEEN] < node[TIMES] or x[TIMES] % max(x[SEEN], 1) != 0
                inside = RECORD if level == OTHER and varies and _short_first(x) else _signs(x)
            gone = never or not group and _boilerplate(x[KEY], keys, x, pages, article)
            around = _weights(x, pages)[0] if x[KEY].split(".")[0] == "article" else article
            out.append([x[KEY], walk(x, keys if group else (*keys, x[KEY]), gone, inside, around), bool(x[FREE])])
        return out

    return ["", walk(wrapper, (), False, "", 0), False]


def match(template: list, page: list, give: Callable[[list, list], None]) -> None:
    """Matches a page's content against a template: ``give`` is called with each slot and the texts that fill it."""
    w, p = template[BODY], page[BODY]

    def pair(slot: list, item: list) -> None:
        if item[KEY] == TEXT:
            give(slot, item[RUNS])
        elif item[KEY] == slot[KEY]:
            match(slot, item, give)

    rest = p
    if not _is_free(w) and not _is_free(p):
        p = _by_groups(p, w, False)
        done = set()
        if not _is_free(p):
            for i, j in _pairs(w, p):
                pair(w[i], p[j])
                done.add(j)
        rest = [x for j, x in enumerate(p) if j not in done]
    if rest:  # what the order does not place goes by its key
        by: dict[str, list] = {}
        for x in _flat(w):
            by.setdefault(x[KEY], x)
        for x in _flat(rest):
            if x[KEY] in by:
                pair(by[x[KEY]], x)


def _own(keys: tuple[str, ...]) -> str:
    """What is known of a text that no slot takes."""
    return NEVER if any(_boilerplate(k, keys[:i], None, 0, 0) for i, k in enumerate(keys)) else _level(keys)


def main_text(page: str, template: list | None) -> str:
    """The main text of one page by its host's template, or by that of the page alone."""
    root, texts = parse(page)
    known: list[str | None] = [None] * len(texts)

    def give(slot: list, runs: list[int]) -> None:
        for r in runs:
            known[r] = slot[1]

    match(judge(root) if template is None else template, root, give)
    codes = [_own(texts[i][2]) if k is None else k for i, k in enumerate(known)]
    level = min((c[0] for c in codes if c[0] != NEVER), default=None)
    if level is None:
        return ""
    chars = lambda places: sum(len(texts[i][0]) for i in places)
    chosen = [i for i, c in enumerate(codes) if c[0] == level]
    plain = [i for i in chosen if TEMPLATE not in codes[i]]
    if chars(plain) >= (1 - TEMPLATE_SHARE) * chars(chosen):
        chosen = plain
    chosen = [i for i in chosen if MENU not in codes[i]] or chosen
    if level == OTHER:
        # the template's headings and running text count where the page's own text is
        chosen = _contained(chosen, texts, [i for i in chosen if FLOWED not in codes[i]] or chosen)
    # outside of their comments, signs of an author need a time beside them
    signed = [texts[i][0] for i in chosen if SIGNED in codes[i]]
    dated = sum(len(t) <= DATED_CHARS and _DATED.search(t) is not None for t in signed)
    letters = RECORD + SIGNED * (6 * dated >= len(signed) > 0)
    apart = [i for i in chosen if not any(x in codes[i] for x in letters)]
    if apart and chars(apart) >= (ARTICLE_RECORD_REST if level == ARTICLE else RECORD_REST) * chars(chosen):
        chosen = [i for i in chosen if i <= apart[-1]]
    return " ".join(texts[i][0] for i in chosen)


def _contained(chosen: list[int], texts: list[tuple], telling: list[int]) -> list[int]:
    """The texts in the innermost element that holds most of what the element around it holds of ``telling`` ones."""
    depth, total = 0, sum(len(texts[i][0]) for i in telling)
    while True:
        inner: dict[int, int] = {}
        for i in telling:
            if len(texts[i][3]) > depth + 1:  # a text's own element is no container
                inner[texts[i][3][depth]] = inner.get(texts[i][3][depth], 0) + len(texts[i][0])
        most = max(inner, key=lambda k: (inner[k], -k), default=None)
        if most is None or inner[most] < CONTAINER * total:
            return chosen
        inside = lambda i: len(texts[i][3]) > depth + 1 and texts[i][3][depth] == most  # noqa: B023, E731
        chosen, telling = [i for i in chosen if inside(i)], [i for i in telling if inside(i)]
        depth += 1


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def _wrappers(known: dict[tuple[str, int], list]) -> pa.RecordBatch:
    columns = [pa.array([h for h, _ in known], pa.string()), pa.array([s for _, s in known], pa.int32()), pa.array([json.dumps(w) for w in known.values()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["host", "salt", "wrapper"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to this task's partial wrappers."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % SALTS
    known: dict[tuple[str, int], list] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            wrapper = _learned(parse(page.as_py() or "")[0])
            known[host, salt] = align(known[host, salt], wrapper) if (host, salt) in known else wrapper
            if len(known) >= HOSTS_HELD:
                yield _wrappers(known)
                known = {}
    if known:
        yield _wrappers(known)


def _learned(node: list) -> list:
    """A page's wrapper without the page's texts' places."""
    out = list(node)
    out[RUNS] = []
    if out[BODY] is not None:
        out[BODY] = [_learned(x) for x in out[BODY]]
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers, which come in order of (host, salt), to one of each."""
    key, held = None, None
    for batch in batches:
        done: dict[tuple[str, int], list] = {}
        for host, salt, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, salt) != key:
                if key is not None:
                    done[key] = held
                key, held = (host, salt), json.loads(said)
            else:
                held = align(held, json.loads(said))
        if done:
            yield _wrappers(done)
    if key is not None:
        yield _wrappers({key: held})


_PARTIAL = "host string, salt int, wrapper string"


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper of all pages of each host, as JSON; none for pages without a host."""
    spread = partitions(pages.sparkSession)
    partial = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string")).where("host != ''").mapInArrow(_learn, _PARTIAL)
    salted = partial.repartition(spread, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_merge, _PARTIAL)
    whole = salted.withColumn("salt", F.lit(0)).repartition(spread, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge, _PARTIAL)
    return whole.select("host", "wrapper")


@F.arrow_udf(T.StringType())
def _judge(wrappers: pa.Array) -> pa.Array:
    return pa.array([json.dumps(judge(json.loads(w.as_py())), separators=(",", ":")) for w in wrappers], pa.string())


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array, templates: pa.Array) -> pa.Array:
    out = []
    known: dict[str, list] = {}
    for page, said in zip(pages, templates, strict=True):
        said = said.as_py()
        if said is not None and said not in known:
            known = {} if len(known) >= HOSTS_HELD else known
            known[said] = json.loads(said)
        out.append(main_text(page.as_py() or "", None if said is None else known[said]))
    return pa.array(out, pa.string())


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", result: str = "text") -> DataFrame:
    """``pages`` with a column of main text, by each host's template (a few hundred bytes to some KB).

    Pages and templates are joined by host without hints: Spark broadcasts the templates up to its own
    threshold; beyond, pages are shuffled, and AQE splits a host of many pages.
    """
    templates = infer_wrappers(pages, url_col=url_col, html_col=html_col).select(F.col("host").alias("__host"), _judge("wrapper").alias("__template"))
    joined = pages.withColumn("__host", host_of(F.col(url_col))).join(materialize(templates, "templates"), "__host", "left")
    return joined.withColumn(result, _main_text(F.col(html_col).cast("string"), F.col("__template"))).drop("__host", "__template")
