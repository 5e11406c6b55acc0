"""Main text of pages by wrapper induction over the pages of a host.

A page is reduced to the tree of its block elements, in which a run of like siblings is one node. The most frequent tree of
a host becomes its wrapper. Every page is aligned with the wrapper by simple tree matching (the greatest number of pairs of
nodes that keeps labels, order and ancestry). Over the different pages of the host, a wrapper node that at least two of them
carry and whose text never changes is template, any other is a slot. Copies of a page (like tree, like texts) count
once, for the choice of the wrapper too: what only copies share is not template.

The article of a host is the part of the wrapper that holds its varying text: from the root down, the child that has most of
it is entered, until none has, or until that would leave a varying headline outside. Slots beside it are template too, though
their texts vary. A page's text is made of the other slots, and of what no other page has, without what is marked as something
else (menus, footers, adverts, forms, comments).
A constant heading stays if what follows it up to the next one varies, a constant quote or caption if what is around it varies.
Names only break ties: blocks named as something else have no part in the varying text, and where a page marks its article, only
slots inside are taken, all of them if the template leaves none. A host with one page or without varying text goes by marks alone.

Only counts leave the pages: trees and node statistics are pre-aggregated, so that a host with a third of all pages is not
gathered anywhere. Pages of any length and depth are aligned. Wrappers are sent to the pages; beyond a checked size they are joined.

Nulls and ties: a null html is empty and gives an empty text; pages without a host form one group; of equally frequent trees
the longest and then the smallest is taken; a host with one page has no template; pages that share no node with the wrapper
are read by their marks. Repeated ids are separate pages. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_tree import Node, Page, names_of
from .store import broadcast_if_small, stored

# Names by which pages mark parts that are not their article.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "select", "textarea"}
ASIDE_NAME = (
    r"(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|menu|nav|navbar|navigation|"
    r"newsletter|notice|pagination|popup|promo|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)"
)
_PLACE = r"(?:article|bar|block|box|buttons?|container|content|entry|form|inner|links?|list|main|page|panel|post|section|site|top|widget|wrap|wrapper)"
ASIDE_HINT = re.compile(rf"(?:^|[\s_-]){ASIDE_NAME}(?:$|[\s_-])")
ASIDE_WHOLE = re.compile(rf"(?:{_PLACE}[_-]+)*{ASIDE_NAME}(?:[_-]+(?:{ASIDE_NAME}|{_PLACE}))*")
ASIDE_BLOCK = re.compile(r"(?:reader|user)?[_-]?comments?|ads?|advert\w*")
KEPT = set("h1 h2 h3 h4 h5 h6 blockquote dt th caption figcaption".split())
HEADLINES = {"h1", "h2"}
SHARE = 0.5
"""Of the varying text, what a part must hold to be entered."""
INNER = set("p li ul ol dl dt dd table tbody thead tr td th pre blockquote figure figcaption caption h1 h2 h3 h4 h5 h6".split())
"""Elements that hold a piece of an article, never the whole."""
CONTAINERS = set("div section ul ol dl table header details center".split())
ARTICLE_HINT = re.compile(r"(?:^|\s)(main|articlebody|article-body|post-content|entry-content|article-content)(?:$|\s)")

# What is kept in memory to save time; results do not depend on it.
REMEMBERED = 200_000
SHORT = 10_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


class Shape:
    """A tree in which runs of like siblings are one node; equal trees have equal keys."""

    __slots__ = ("label", "children", "key", "size", "number")

    def __init__(self, label: str, children: list) -> None:
        self.label, self.children, self.number = label, children, -1
        self.key = key_of(label, [c.key for c in children])
        self.size = 1 + sum(c.size for c in children)


def key_of(label: str, children: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(label.encode() + b"(" + b"".join(children))


def wrapper_of(text: str) -> tuple[Shape, int]:
    """Read a shape's text back; nodes are numbered in order."""
    stack: list[tuple[str, list]] = [("", [])]
    for label, mark in re.findall(r"([^(),]*)([(),]|$)", text):
        if mark == "(":
            stack.append((label, []))
            continue
        if label:
            stack[-1][1].append(Shape(label, []))
        if mark == ")":
            name, children = stack.pop()
            stack[-1][1].append(Shape(name, children))
    root = stack[0][1][0]
    for n, s in enumerate(preorder(root)):
        s.number = n
    return root, root.size


def preorder(root: Node | Shape) -> Iterator:
    todo = [root]
    while todo:
        s = todo.pop()
        yield s
        todo.extend(reversed(s.children))


def _at_once(a: Shape, b: Shape, known: dict) -> int | None:
    """What :func:`matched` gives, if that takes no comparison of children."""
    if a.label != b.label:
        return 0
    if a.key == b.key:
        return a.size
    return known.get((a.key, b.key)) if a.children and b.children else 1


def matched(a: Shape, b: Shape, known: dict) -> int:
    """Simple tree matching: pairs in the best alignment of two trees with like roots, 0 otherwise."""
    found = _at_once(a, b, known)
    return _run(_best(a, b, known), known) if found is None else found


def _run(work: Generator, known: dict):
    """Run ``work``, which asks for pairs of nodes to be matched, on a stack of its own: trees may be deep."""
    stack, answer = [(None, work)], None
    while True:
        pair, work = stack[-1]
        try:
            a, b = work.send(answer)
        except StopIteration as end:
            stack.pop()
            answer = end.value
            if not stack:
                return answer
            if len(known) >= REMEMBERED:
                known.clear()  # costs time only
            known[pair] = answer
        else:
            stack.append(((a.key, b.key), _best(a, b, known)))
            answer = None


def _ends(a: Shape, b: Shape) -> tuple[int, int]:
    """How many children are equal at the end and then at the beginning: pairing them is always best."""
    x, y = a.children, b.children
    least, last, first = min(len(x), len(y)), 0, 0
    while last < least and x[-1 - last].key == y[-1 - last].key:
        last += 1
    while first < least - last and x[first].key == y[first].key:
        first += 1
    return first, last


def _columns(ys: list[Shape]) -> dict[str, tuple[list[int], dict]]:
    """For each label its places, and the places of each different tree with children."""
    found: dict[str, tuple[list[int], dict]] = {}
    for j, y in enumerate(ys):
        places, trees = found.setdefault(y.label, ([], {}))
        places.append(j)
        if y.children:
            trees.setdefault(y.key, (y, []))[1].append(j)
    return found


def _row(above: np.ndarray, x: Shape, columns: dict, known: dict) -> Generator:
    """The next row of the matching table, and the pairs that ``x`` gives with each column."""
    gives = np.zeros(len(above) - 1, np.int64)
    if x.label not in columns:
        return above, gives
    places, trees = columns[x.label]
    gives[places] = 1
    if x.children:
        for y, at in trees.values():
            found = _at_once(x, y, known)
            gives[at] = (yield x, y) if found is None else found
    row = np.zeros_like(above)
    row[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gives))
    return row, gives


def _best(a: Shape, b: Shape, known: dict) -> Generator:
    first, last = _ends(a, b)
    xs, ys = a.children[first : len(a.children) - last], b.children[first : len(b.children) - last]
    equal = sum(c.size for c in a.children[:first]) + sum(c.size for c in a.children[len(a.children) - last :])
    if not xs or not ys:
        return 1 + equal
    columns, row = _columns(ys), np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        row, _ = yield from _row(row, x, columns, known)
    return 1 + equal + int(row[-1])


def _traced(a: Shape, b: Shape, known: dict) -> Iterator[tuple[Shape, Shape]]:
    """The pairs of children in the best alignment. Only every so-manieth row is kept, the others are made again."""
    first, last = _ends(a, b)
    n, m = len(a.children) - last, len(b.children) - last
    yield from zip(a.children[:first] + a.children[n:], b.children[:first] + b.children[m:], strict=True)
    xs, ys = a.children[first:n], b.children[first:m]
    if not xs or not ys:
        return
    columns, row, step, kept = _columns(ys), np.zeros(len(ys) + 1, np.int64), isqrt(len(xs)) + 1, []
    for k, x in enumerate(xs):
        if k % step == 0:
            kept.append(row)
        row, _ = _run(_row(row, x, columns, known), known)
    i, j = len(xs), len(ys)
    while i and j:
        start = (i - 1) // step * step
        rows, gives = [kept[start // step]], []
        for x in xs[start:i]:
            row, w = _run(_row(rows[-1], x, columns, known), known)
            rows.append(row)
            gives.append(w)
        while i > start and j:
            above, row, w = rows[i - 1 - start], rows[i - start], gives[i - 1 - start][j - 1]
            if w and row[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                yield xs[i], ys[j]
            elif row[j] == above[j]:
                i -= 1
            else:
                j -= 1


def align(a: Shape, b: Shape, known: dict) -> Iterator[tuple[Shape, Shape]]:
    """The pairs of the best alignment."""
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        a, b = todo.pop()
        yield a, b
        todo.extend(zip(a.children, b.children, strict=True) if a.key == b.key else _traced(a, b, known))


_short_wrapper = lru_cache(maxsize=512)(wrapper_of)


def _pairs(wrapper: str, shape: str) -> dict[int, int]:
    (a, _), (b, _) = ((_short_wrapper if len(t) <= SHORT else wrapper_of)(t) for t in (wrapper, shape))
    return {y.number: x.number for x, y in align(a, b, {})}


_short_pairs = lru_cache(maxsize=1024)(_pairs)


def pairs_of(wrapper: str, shape: str) -> dict[int, int]:
    """Node of a page's shape to the wrapper's node it is aligned with."""
    return (_short_pairs if len(wrapper) + len(shape) <= SHORT else _pairs)(wrapper, shape)


def slots_of(page: Page) -> tuple[str, list[list[int]]]:
    """The page's shape and the numbers of the text blocks in each of its nodes, in the order of :func:`wrapper_of`."""
    keys: dict[int, bytes] = {}
    runs: dict[int, list[list[Node]]] = {}
    for node in reversed(list(preorder(page.root))):
        found: list[list[Node]] = []
        for child in node.children:
            if found and keys[id(found[-1][0])] == keys[id(child)]:
                found[-1].append(child)
            else:
                found.append([child])
        runs[id(node)] = found
        keys[id(node)] = key_of(node.label, [keys[id(run[0])] for run in found])
    text: list[str] = []
    slots: list[list[int]] = []
    todo: list[str | list[Node]] = [[page.root]]
    while todo:
        members = todo.pop()
        if isinstance(members, str):
            text.append(members)
            continue
        text.append(members[0].label)
        slots.append(sorted(t for m in members for t in m.texts))
        below = [[n for run in column for n in run] for column in zip(*(runs[id(m)] for m in members), strict=True)]
        if below:
            text.append("(")
            todo.append(")")
            for k in range(len(below) - 1, -1, -1):
                todo.append(below[k])
                if k:
                    todo.append(",")
    return "".join(text), slots


def named_aside(node: Node, inside: bool) -> bool:
    """Whether a container's names say that it is something else.

    Outside the article (or without one) any word of its class, role or itemprop tells. Ids are often made from the words of a
    heading: they tell there only if all their words do. In an article only such a class, role or itemprop tells, never an id.
    """
    if not node.hint:
        return False
    if not (node.tag in CONTAINERS or "-" in node.tag):  # a block of text
        return any(ASIDE_BLOCK.fullmatch(v) for name, value in names_of(node.attributes) if name == "class" for v in value.split())
    if not ASIDE_HINT.search(node.hint):
        return False
    for name, value in names_of(node.attributes):
        whole = any(ASIDE_WHOLE.fullmatch(v) for v in value.split())
        if name == "id":
            if whole and not inside:
                return True
        elif whole or not inside and ASIDE_HINT.search(value):
            return True
    return False


def marks_of(page: Page) -> tuple[dict[int, bool], dict[int, bool]]:
    """For each element (by its id()) whether it is in an article and whether it is in something else."""
    article, core, aside, header = {}, {}, {}, {}
    for node in preorder(page.root):
        k, up = id(node), id(node.parent)
        hint = ARTICLE_HINT.search(node.hint) if node.hint else None
        core[k] = core.get(up, False) or node.tag == "article" or bool(hint and hint[1] != "main")
        article[k] = article.get(up, False) or core[k] or node.tag == "main" or bool(hint)
    inside = core if any(core.values()) else article  # beside an article, main is only its surroundings
    for node in preorder(page.root):
        k, up = id(node), id(node.parent)
        aside[k] = aside.get(up, False) or node.tag in ASIDE_TAGS or named_aside(node, inside[k])
        header[k] = header.get(up, False) or node.tag == "header"
    return article, {k: aside[k] or header[k] and not article[k] for k in article}


def judged(wrapper: str, nodes: list[tuple[int, int, bool, int]]) -> list[int]:
    """Template nodes of a wrapper, from the number of pages, whether the text is always the same, and the letters of each node
    that has texts."""
    root, _ = wrapper_of(wrapper)
    constant = {node for node, n, same, _ in nodes if n > 1 and same}
    varying = {node: chars for node, n, same, chars in nodes if n > 1 and not same}
    order = list(preorder(root))
    mass, headline = {}, {}
    for s in reversed(order):
        mass[s.number] = varying.get(s.number, 0) + sum(mass[c.number] for c in s.children)
        own = s.label.partition(".")[0] in HEADLINES and s.number in varying
        headline[s.number] = own or any(headline[c.number] for c in s.children)
    kept = {c.number for s in order for c, around in _with_surroundings(s, mass) if c.number in constant and around}
    at = root
    while at.label.partition(".")[0] != "article" and mass[at.number]:
        best = max(at.children, key=lambda c: mass[c.number], default=None)
        if best is None or mass[best.number] < SHARE * mass[at.number] or best.label.partition(".")[0] in INNER:
            break
        if any(headline[c.number] for c in at.children if c is not best):
            break
        at = best
    beside = {node for node in varying if not at.number <= node < at.number + at.size}
    return sorted(constant - kept | beside)


def _with_surroundings(parent: Shape, mass: dict[int, int]) -> Iterator[tuple[Shape, bool]]:
    """Children that a constant text may stay in, and whether what belongs to them varies."""
    for i, child in enumerate(parent.children):
        tag = child.label.partition(".")[0]
        if tag not in KEPT:
            continue
        if tag[0] == "h" and tag[1:].isdigit():
            after = []
            for c in parent.children[i + 1 :]:
                other = c.label.partition(".")[0]
                if other[0] == "h" and other[1:].isdigit() and other <= tag:
                    break
                after.append(c)
            yield child, any(mass[c.number] for c in after)
        else:
            yield child, mass[parent.number] > 0


def main_text(html: str | None, wrapper: str | None = None, template: list[int] | None = None) -> str:
    page = Page(html or "")
    article, aside = marks_of(page)
    marked = {i for i, (n, _, _) in enumerate(page.blocks) if article[id(n)] and not aside[id(n)]}
    constant: set[int] = set()
    if template:
        shape, slots = slots_of(page)
        pairs, fixed = pairs_of(wrapper, shape), set(template)
        constant = {b for number, blocks in enumerate(slots) if pairs.get(number) in fixed for b in blocks}
    if marked:
        return "\n\n".join(page.blocks[i][1] for i in sorted(marked - constant or marked))
    return "\n\n".join(t for i, (n, t, _) in enumerate(page.blocks) if i not in constant and not aside[id(n)])


def induced(pages: DataFrame) -> DataFrame:
    """host, wrapper, template (array of its nodes) from all ``pages (host, html)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, texts, chars, digests = [], [], [], []
            for html in batch["html"].to_pylist():
                page = Page(html or "")
                shape, slots = slots_of(page)
                _, aside = marks_of(page)
                shapes.append(shape)
                texts.append(
                    [xxhash.xxh64_intdigest("\n".join(page.blocks[i][1] for i in b)) >> 1 if b else None for b in slots]
                )
                chars.append([sum(len(page.blocks[i][1]) for i in b if not aside[id(page.blocks[i][0])]) for b in slots])
                digests.append(xxhash.xxh3_128_digest(f"{shape}\n{texts[-1]}"))
            lists = [pa.array(texts, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch["host"], pa.array(digests, pa.binary()), pa.array(shapes, pa.string()), *lists],
                names=["host", "page", "shape", "texts", "chars"],
            )

    read_pages = pages.mapInArrow(read, "host string, page binary, shape string, texts array<long>, chars array<long>")
    trees = stored(read_pages.dropDuplicates(["host", "page"]), "trees")
    counts = trees.groupBy("host", "shape").agg(F.count("*").alias("n"))
    best = F.max_by("shape", F.struct("n", F.length("shape"), "shape"))
    wrappers = stored(counts.groupBy("host").agg(best.alias("wrapper")), "wrappers")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, nodes, found, letters = [], [], [], []
            for host, shape, texts, chars, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = pairs_of(wrapper, shape)
                for number, text in enumerate(texts):
                    if text is not None and number in pairs:
                        hosts.append(host)
                        nodes.append(pairs[number])
                        found.append(text)
                        letters.append(chars[number])
            arrays = [pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(found, pa.int64()), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "node", "text", "chars"])

    aligned = trees.join(broadcast_if_small(wrappers), "host").select("host", "shape", "texts", "chars", "wrapper")
    nodes = (
        aligned.mapInArrow(slots, "host string, node int, text long, chars long")
        .groupBy("host", "node")
        .agg(F.count("*").alias("n"), (F.min("text") == F.max("text")).alias("same"), F.sum("chars").alias("chars"))
    )
    per_host = nodes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "n", "same", "chars"))).alias("nodes"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["wrapper"].to_pylist(), batch["nodes"].to_pylist(), strict=True)
            found = [judged(wrapper, [tuple(s.values()) for s in stats or ()]) for wrapper, stats in pairs]
            arrays = [batch["host"], batch["wrapper"], pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "wrapper", "template"])

    # as many nodes as the wrapper has, for each host
    judgements = wrappers.join(per_host, "host", "left").select("host", "wrapper", "nodes")
    return stored(judgements.mapInArrow(judge, "host string, wrapper string, template array<int>"), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """``pages (page_id, url, html)`` to page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = induced(rows.select("host", "html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("html", "wrapper", "template"))
            texts = [main_text(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = rows.join(broadcast_if_small(wrappers), "host").select("page_id", "url", "html", "wrapper", "template")
    kind = dict(rows.dtypes)
    return joined.mapInArrow(read, f"page_id {kind['page_id']}, url string, text string, n_chars long")
