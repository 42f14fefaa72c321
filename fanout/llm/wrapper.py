"""Main text of pages by union-free regular expressions inferred per host.

A page becomes a tree of its block elements. Equal neighbours fold into repeated groups; trees of one host
are aligned one after another, and what only some of them have turns optional, so the outcome is one
union-free expression over tags and text slots, the host's wrapper. Pages with equal folded trees count
once, parts of a host are aligned apart and their wrappers aligned in turn, so a host of any size
needs no more memory than its wrapper. Text slots are compared, too: a text that stands in the same place on most
pages of a host is the template's and no page's own. The wrapper then reads every page of the host; the paths of its main
items tell which elements of the page's own nesting are main text, each repetition of an item included.
A page that the wrapper does not read goes by its own tree.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanout.llm.shared import cells, importable, written

SALTS = 16
TEMPLATE_PAGES = 4
TEMPLATE_SHARE = 80  # percent
DEEPEST = 100  # levels of elements that hold others; a wrapper is worked on level by level
LOOSE = 60  # optional and repeated items up to which a match may take choices back
CELLS = 250_000  # longer lists are aligned between items that both have once

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
RAW = set("script style".split())
ASIDE = set(
    "head nav header footer aside form script style noscript template button select textarea iframe svg canvas object "
    "dialog menu".split()
)
NO_TEXT_WORDS = set(
    "ad ads advert advertisement advertising banner sponsor sponsored promo cookie cookies consent notice alert popup "
    "modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies "
    "disqus share sharing social related recommended footer header masthead login search widget".split()
)
NEVER_BESIDE = set("body main article".split())
SPEAKING = NEVER_BESIDE | ASIDE
# words that may stand beside those of NO_TEXT_WORDS in a name, and words that turn its sense
NEUTRAL_WORDS = set(
    "area bar block bottom box button buttons container entry form global group inner item items left link links list "
    "outer page panel post posts primary reader readers right row secondary section signup site story stories text "
    "thread title top unit user users wrap wrapper".split()
)
TITLE_HOLDERS = set("header title".split())  # beside these an article's own words do not speak of the page's frame
OWN_WORDS = set("article entry post story".split())
MAIN_WORDS = set("article content main post entry story".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}
CLOSED_BY_SAME |= {"th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*\Z",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


def _label(name: str, rest: str) -> str:
    """The element's name and the whole names of its class, id and role, each reduced to its words."""
    given = (n for m in _NAMES.finditer(rest) for n in "".join(filter(None, m.groups())).lower().split())
    return ".".join([name, *sorted({"-".join(words) for n in given if (words := _WORD.findall(n))})])


def events(page: str) -> list[tuple[str, str]]:
    """(symbol, text) in page order: ``<label>``, ``</label>`` or ``#`` with its text; always well nested.

    Below DEEPEST levels an element whose name says nothing about its text no longer holds what is in it: it
    becomes an empty neighbour before and after, so that text keeps its order and its blocks.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (name, label); no label for an element that holds nothing
    open_names: Counter[str] = Counter()
    depth = 0

    def mark(name: str) -> None:
        out.append((f"<{name}>", ""))
        out.append((f"</{name}>", ""))

    def close() -> str:
        nonlocal depth
        name, label = stack.pop()
        open_names[name] -= 1
        if label:
            depth -= 1
            out.append((f"</{label}>", ""))
        else:
            mark(name)
        return name

    def text(part: str) -> None:
        if out and out[-1][0] == "#":
            out[-1] = ("#", out[-1][1] + part)
        elif part:
            out.append(("#", part))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name or name in INLINE or name in VOID:
            if name in ("br", "hr"):
                text("\n")
            continue
        if m["end"]:
            if open_names[name]:
                while close() != name:
                    pass
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY_SAME.get(name, ())):
            close()
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            mark(name)
            continue
        if m["rest"].endswith("/"):
            continue
        label = _label(name, m["rest"])
        if depth >= DEEPEST and (open_names[name] or name not in SPEAKING):
            stack.append((name, ""))
            mark(name)
        else:
            stack.append((name, label))
            depth += 1
            out.append((f"<{label}>", ""))
        open_names[name] += 1
    while stack:
        close()
    return [(s, t) for s, t in out if s != "#" or t.strip()]


# A wrapper is a list of items; an item is [label, optional, repeated, items]. A text slot's label is "#"; a
# repeated group of several neighbours has the label "".


def _key(item: list) -> tuple:
    return (item[0], *(_key(i)[0] for i in item[3])) if item[0] == "" else (item[0],)


def _one(a: list, b: list) -> list:
    """The item that stands for both, their keys being equal."""
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])]


def _joined(old: list, new: list) -> list:
    """One repeated item, or one repeated group, for two neighbouring runs of equal labels."""
    both = [_one(x, y) for x, y in zip(old, new, strict=True)]
    if len(both) > 1:
        return ["", False, True, both]
    return [both[0][0], both[0][1], both[0][0] != "#", both[0][3]]


def _periods(items: list) -> list[int]:
    """Lengths of runs that are followed by a run of equal labels, shortest first."""
    number: dict[tuple, int] = {}
    ids = np.array([number.setdefault(_key(i), len(number)) for i in items], np.int32)
    found = []
    for size in range(1, len(ids) // 2 + 1):
        same = ids[size:] == ids[:-size]
        if np.count_nonzero(same) < size:
            continue
        ends = np.flatnonzero(np.concatenate((~same, [True])))
        if np.diff(ends, prepend=-1).max() > size:
            found.append(size)
    return found


def folded(items: list) -> list:
    """Neighbouring groups of equal labels become one repeated group, shortest groups first."""
    least = 1
    while len(items) > 1 and (size := next((n for n in _periods(items) if n >= least), 0)):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * size and [_key(i) for i in out[-size:]] == [_key(i) for i in out[-2 * size : -size]]:
                out[-2 * size :] = [_joined(out[-2 * size : -size], out[-size:])]
            if size > 1 and len(out) > size and out[-size - 1][0] == "":
                group = out[-size - 1]
                if [_key(i) for i in group[3]] == [_key(i) for i in out[-size:]]:
                    inner = [_one(x, y) for x, y in zip(group[3], out[-size:], strict=True)]
                    out[-size - 1 :] = [["", group[1], True, inner]]
        items, least = out, size + 1
    return items


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of items of equal keys, ascending in both lists: most of them where the lists are short.

    Longer lists are cut at the items that both have just once, in their longest common order; between
    cuts that are still long, each item meets the next equal one.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= CELLS:
            found += [(i + x, j + y) for x, y in _common(a[i:n], b[j:m])]
            continue
        cuts = _cuts(a, b, i, n, j, m)
        if cuts:
            edges = [(i - 1, j - 1), *cuts, (n, m)]
            found += cuts
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
            continue
        places: dict[tuple, list[int]] = {}
        for y in range(m - 1, j - 1, -1):
            places.setdefault(b[y], []).append(y)
        for x in range(i, n):
            ahead = places.get(a[x], [])
            while ahead and ahead[-1] < j:
                ahead.pop()
            if ahead and ahead[-1] - j <= 2 * (m - j) // (n - x) + 8:
                found.append((x, ahead[-1]))
                j = ahead.pop() + 1
    return sorted(found)


def _cuts(a: list, b: list, i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """The longest run, ascending in both, of keys that stand once in each part."""
    once_a, once_b = ({k for k, c in Counter(part).items() if c == 1} for part in (a[i:n], b[j:m]))
    at = {b[y]: y for y in range(j, m) if b[y] in once_b}
    tails: list[int] = []
    nodes: list[tuple[int, int, int]] = []  # (x, y, the node before it)
    heads: list[int] = []
    for x in range(i, n):
        if a[x] in once_a and a[x] in at:
            y = at[a[x]]
            k = bisect_left(tails, y)
            nodes.append((x, y, heads[k - 1] if k else -1))
            tails[k:k + 1], heads[k:k + 1] = [y], [len(nodes) - 1]
    out, node = [], heads[-1] if heads else -1
    while node >= 0:
        x, y, node = nodes[node]
        out.append((x, y))
    return out[::-1]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    n, m = len(a), len(b)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            common[i][j] = 1 + common[i + 1][j + 1] if a[i] == b[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif common[i + 1][j] >= common[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list, b: list) -> list:
    """One list of items that reads all that either reads: common items in order, the others optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for x, y in [*_pairs([_key(item) for item in a], [_key(item) for item in b]), (len(a), len(b))]:
        out += [[item[0], True, *item[2:]] for item in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_one(a[x], b[y]))
        i, j = x + 1, y + 1
    return folded(out)


def skeleton(page: str) -> list:
    """A page as a wrapper of its own: folded, every item present."""
    levels: list[list] = [[]]
    for symbol, _ in events(page):
        if symbol == "#":
            levels[-1].append(["#", False, False, []])
        elif symbol[1] != "/":
            levels.append([])
        else:
            items = folded(levels.pop())
            levels[-1].append([symbol[2:-1], False, False, items])
    return folded(levels[0])


def _words(label: str) -> tuple[str, set[str]]:
    name, _, rest = label.partition(".")
    return name, set(re.split("[.-]", rest))


def beside(label: str) -> bool:
    """Whether an element holds no article text: by its name, or by a whole class, id or role.

    A name of several words counts if the others are neutral: cookie-notice and comment-list do, has-sidebar and
    no-comments do not, nor does entry-header, which holds an article's own title. The page's
    body, main and article elements never do, nor does any element that holds one: that is for the caller to see.
    """
    name, *given = label.split(".")
    if name in NEVER_BESIDE:
        return False
    return name in ASIDE or any(_speaks_of_frame(set(g.split("-"))) for g in given)


def _speaks_of_frame(words: set[str]) -> bool:
    found = words & NO_TEXT_WORDS
    if not found or not words <= NO_TEXT_WORDS | NEUTRAL_WORDS:
        return False
    return not (found <= TITLE_HOLDERS and words & OWN_WORDS)


def _holds(items: list) -> bool:
    return any(i[0].partition(".")[0] in NEVER_BESIDE or _holds(i[3]) for i in items)


def _mains(items: list, test) -> list[list]:
    found = []
    for item in items:
        if item[0] != "#" and not (item[0] and beside(item[0]) and not _holds(item[3])):
            found += [item] if item[0] and test(*_words(item[0])) else _mains(item[3], test)
    return found


def _skipped(found: list[tuple[str, str]]) -> list[bool]:
    """For each event whether it opens or closes an element that is beside and holds no body, main or article."""
    out, stack = [False] * len(found), []
    for k, (symbol, _) in enumerate(found):
        if symbol == "#":
            continue
        if symbol[1] != "/":
            stack.append([k, symbol[1:-1].partition(".")[0] in NEVER_BESIDE])
            continue
        start, holds = stack.pop()
        out[start] = out[k] = not holds and beside(symbol[2:-1])
        if stack:
            stack[-1][1] |= holds
    return out


def main_items(items: list) -> list[list]:
    """The wrapper's items that hold the article, by the first of these that any item meets."""
    tests = (
        lambda name, words: name == "article",
        lambda name, words: name == "main" or "main" in words,
        lambda name, words: name in ("div", "section") and bool(words & MAIN_WORDS),
        lambda name, words: name == "body",
    )
    for test in tests:
        if found := _mains(items, test):
            return found
    return items


def main_paths(items: list) -> frozenset[tuple[str, ...]]:
    """Labels from the root down to each main item; none if all is main text."""
    mains, paths = main_items(items), set()

    def walk(items: list, path: tuple[str, ...]) -> None:
        for item in items:
            own = (*path, item[0]) if item[0] else path
            if item[0] and any(item is m for m in mains):
                paths.add(own)
            else:
                walk(item[3], own)

    if mains is not items:
        walk(items, ())
    return frozenset(paths)


def expression(items: list, mains: list[list], once: str = "") -> str:
    """The wrapper as a regular expression over a page's symbols; a group around each main item.

    With ``+`` for ``once``, no choice is taken back: every page is matched in one go, but some are then not read.
    """
    parts = []
    for item in items:
        label, optional, repeated, inner = item
        body = expression(inner, mains, once)
        body = "#" if label == "#" else body if label == "" else f"<{re.escape(label)}>{body}</{re.escape(label)}>"
        if optional or repeated:
            body = f"(?:{body}){'*' if optional and repeated else '+' if repeated else '?'}{once}"
        parts.append(f"({body})" if any(item is m for m in mains) else body)
    return "".join(parts)


def _loose(items: list) -> int:
    return sum((i[1] or i[2]) + _loose(i[3]) for i in items)


class Reader:
    """Tells whether a wrapper reads a page: in one go, else, where it has few loose items, by taking choices back."""

    def __init__(self, items: list):
        self.quick = re.compile(expression(items, [], "+"))
        self.exact = re.compile(expression(items, [])) if _loose(items) <= LOOSE else None

    def fullmatch(self, symbols: str) -> re.Match | None:
        return self.quick.fullmatch(symbols) or (self.exact and self.exact.fullmatch(symbols))


def slot(path: list[str], block: str) -> int:
    """A number for a text in its place: the labels above it."""
    return xxhash.xxh64_intdigest("\n".join((*path, "", block)).encode(errors="replace")) - (1 << 63)


def _block(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def slots(page: str) -> list[int]:
    """The numbers of a page's texts, each once."""
    path: list[str] = []
    out: dict[int, None] = {}
    for symbol, text in events(page):
        if symbol == "#":
            if block := _block(text):
                out[slot(path, block)] = None
        elif symbol[1] != "/":
            path.append(symbol[1:-1])
        else:
            path.pop()
    return list(out)


def main_text(
    page: str, wrapper: re.Pattern | Reader, mains: frozenset[tuple[str, ...]], template: frozenset[int] = frozenset()
) -> tuple[str, bool]:
    """The text of the elements at the main paths, one line a block, and whether the wrapper read the page.

    Texts in their place that the host's template has are no page's own.
    """
    found = events(page)
    read = wrapper.fullmatch("".join(s for s, _ in found)) is not None
    if not read:
        mains = main_paths(skeleton(page))
    path: list[str] = []
    inside: list[str] = []  # all blocks inside main elements, and all blocks for a page that has none
    every: list[str] = []
    skipped, main, any_main = 0, 0, False
    for (symbol, text), besides in zip(found, _skipped(found), strict=True):
        if symbol == "#":
            block = "" if skipped else _block(text)
            if block and not (template and slot(path, block) in template):
                every.append(block)
                if main:
                    inside.append(block)
        elif symbol[1] != "/":
            path.append(symbol[1:-1])
            skipped += besides
            if tuple(path) in mains:
                main, any_main = main + 1, True
        else:
            main -= tuple(path) in mains
            skipped -= besides
            path.pop()
    return "\n".join(inside if any_main else every), read


def _skeletons(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(skeleton(t.decode(errors="replace"))) for t in cells(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], ["host", "tree"])


def _inferred(keys: int):
    """Aligns the trees of consecutive rows that agree in their first columns; holds one wrapper at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = json.loads(row[-1])
                if row[:keys] != key:
                    if wrapper is not None:
                        done.append((key[0], json.dumps(wrapper)))
                    key, wrapper = row[:keys], tree
                else:
                    wrapper = aligned(wrapper, tree)
        if wrapper is not None:
            done.append((key[0], json.dumps(wrapper)))
        columns = list(zip(*done, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "tree"])

    return run


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled: dict[str, tuple[Reader, frozenset]] = {}
    for batch in batches:
        texts, read = [], []
        for tree, template, page in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), cells(batch.column(2)), strict=True):
            if tree not in compiled:
                if len(compiled) > 500:
                    compiled.clear()
                items = json.loads(tree)
                compiled[tree] = Reader(items), main_paths(items)
            text, ok = main_text(page.decode(errors="replace"), *compiled[tree], frozenset(template or ()))
            texts.append(text)
            read.append(ok)
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths, pa.array(read, pa.bool_())],
            ["page_id", "url", "text", "n_chars", "read"],
        )


def _slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [slots(t.decode(errors="replace")) for t in cells(batch.column(1))]
        whole = [xxhash.xxh3_128_digest(np.array(s, np.int64).tobytes()) for s in found]
        columns = [batch.column(0), pa.array(whole, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "whole", "slots"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the texts in their place that TEMPLATE_SHARE of a host's pages have, of TEMPLATE_PAGES at least.

    Pages with the same texts count once, so copies of an article make no template. A page has a bounded part of its
    host's template, so the whole of it is little more than a page's texts.
    """
    told = pages.select("host", "html").mapInArrow(_slots, "host string, whole binary, slots array<bigint>")
    told = written(told.groupBy("host", "whole").agg(F.any_value("slots").alias("slots")), "slots")
    met = told.select("host", F.explode("slots").alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n"))
    sizes = told.groupBy("host").agg(F.count("*").alias("pages"))
    often = met.filter(F.col("n") >= TEMPLATE_PAGES).join(sizes, "host").filter(100 * F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("slot").alias("template"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree): the wrapper of every host, from all of its pages."""
    trees = pages.select("host", "html").mapInArrow(_skeletons, "host string, tree string").distinct()
    salted = trees.select("host", F.pmod(F.xxhash64("tree"), F.lit(SALTS)).alias("salt"), "tree")
    parts = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "tree")
    parts = parts.mapInArrow(_inferred(2), "host string, tree string").distinct()
    whole = parts.repartition("host").sortWithinPartitions("host", "tree")
    return whole.mapInArrow(_inferred(1), "host string, tree string")


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, read.

    Text has the blocks of the article in page order, joined by one line feed, character references decoded and
    white space within a block made one space; empty if there is none. ``read`` tells whether the host's
    wrapper read the page. Null html counts as empty; pages with a null url, or one without a host, are one
    host. Repeated rows come back as often as they came. Pages of any length, depth and width are read whole. Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    importable(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    learned = wrappers(named).join(templates(named), "host", "left").withColumnRenamed("host", "site")
    learned = written(learned, "wrappers")
    met = named.join(learned, F.col("host") == F.col("site")).select("page_id", "url", "html", "tree", "template")
    return met.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint, read boolean")
