"""HTML extraction by union-free regular expressions of same-host pages.

A page is a stream of structural tags and texts. The streams of a host's pages are folded (what repeats side by side
becomes a repeated group) and aligned one after another: equal tags stay, equal texts stay constant, differing texts
become slots, and what only one side has becomes an optional group. The result is the host's wrapper.

The wrapper decides what the article is: the container that holds over two thirds of the text in slots, with what is constant
inside it. Constants and slots outside it are the page's frame. Names of elements and classes are hints that take parts
(menus, comments, forms ...) out, unless they hold the article itself. An ``article`` or ``main`` element names the
container where a page has one.
"""

from __future__ import annotations

import difflib
import functools
import hashlib
import html
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import written
from codelake.session import ship

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?(?=[A-Za-z])(?P<name>[^\s/>]+)(?P<attributes>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_BLANKS = re.compile(r"\s+")
#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea template iframe svg object xmp select title".split())
_ENDS = {name: re.compile(rf"</{name}(?![A-Za-z0-9])[^>]*(?:>|\Z)", re.I) for name in RAW}
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
BESIDE = frozenset("nav header footer aside form menu dialog button label fieldset head".split())
#: Last words of class, id and role names of page parts that are not the article, and what may follow such a word.
BESIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies sharing related recommended toolbar pagination pager complementary contentinfo form".split())
GENERIC = frozenset("area bar block box container content inner list section slot thread unit widget wrap wrapper".split())
#: A name that begins so says what the element has beside it.
ABOUT = frozenset("with has no without is".split())
MAIN = frozenset(["article", "main"])
#: Elements that are containers of an article, rather than pieces of its text.
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
BROADCAST_BYTES = 16_000_000  # of wrappers that may be broadcast
SHAPES = 64  # shapes of a host that one step aligns
HELD = 2_000  # shapes that a task holds while it reads pages
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _named_beside(name: str) -> bool:
    words = [w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()]
    if not words or words[0] in ABOUT:
        return False
    while len(words) > 1 and words[-1] in GENERIC:
        words.pop()
    return words[-1] in BESIDE_WORDS


def _beside(name: str, attrs: dict[str, str]) -> bool:
    if name in BESIDE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if name in MAIN or name in ("html", "body", "h1") or "class" not in attrs and "id" not in attrs and "role" not in attrs:
        return False
    return any(_named_beside(w) for k in ("class", "id", "role") for w in attrs.get(k, "").split())


class Block(tuple):
    """(path, text, elements): labels and numbers of the open elements, the outermost first."""

    path = property(lambda self: self[0])
    text = property(lambda self: self[1])
    elements = property(lambda self: self[2])


class Page:
    """A page's blocks of text in order. ``beside`` has the numbers of elements that a name takes out, ``main`` those of
    article elements; comments, scripts, styles and other raw elements give no text."""

    def __init__(self, page: str | None) -> None:
        self.blocks: list[Block] = []
        self.beside: set[int] = set()
        self.main: set[int] = set()
        self.strict: set[int] = set()  # taken out by the element itself, not by its class
        self.titled: set[int] = set()  # elements with an article element or a first heading inside
        self._read(page or "")
        # a class or id cannot take out what holds the article
        self.beside = self.strict | (self.beside - self.titled)

    def _read(self, page: str) -> None:
        open_: list[tuple[str, str, int]] = []  # name, label, number
        text: list[str] = []
        number = at = 0

        def close_block() -> None:
            if text:
                t = _BLANKS.sub(" ", html.unescape("".join(text))).strip()
                text.clear()
                if t:
                    self.blocks.append(Block((tuple(x[1] for x in open_), t, tuple(x[2] for x in open_))))

        while at < len(page):
            m = _TOKEN.search(page, at)
            if not m:
                text.append(page[at:])
                break
            if m.start() > at:
                text.append(page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    text.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
                continue
            if m[0].startswith("</"):
                if name in BLOCKS:
                    close_block()
                    for i in range(len(open_) - 1, -1, -1):
                        if open_[i][0] == name:
                            del open_[i:]
                            break
                continue
            if name in RAW:
                if name == "title":
                    close_block()
                if not m[0].endswith("/>"):
                    end = _ENDS[name].search(page, at)
                    at = end.end() if end else len(page)
                continue
            if name not in BLOCKS:
                continue
            close_block()
            if name in VOID:
                continue
            closes = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}.get(name, {"p"})
            while open_ and open_[-1][0] in closes:
                open_.pop()
            attrs = _attributes(m["attributes"])
            label = name + "".join(f".{w}" for w in sorted(set(attrs.get("class", "").split()))) + (f"#{attrs['id']}" if attrs.get("id") and not re.search(r"\d", attrs["id"]) else "")
            number += 1
            open_.append((name, label, number))
            if _beside(name, attrs):
                self.beside.add(number)
                if _beside(name, {k: v for k, v in attrs.items() if k not in ("class", "id", "role")}):
                    self.strict.add(number)
            elif name in MAIN or attrs.get("role") == "main":
                self.main.add(number)
                self.titled.update(x[2] for x in open_)
            elif name == "h1":
                self.titled.update(x[2] for x in open_)
        close_block()

    def inside(self, block: Block, elements: set[int]) -> bool:
        return not elements.isdisjoint(block.elements)


def blocks(page: str | None) -> list[Block]:
    return Page(page).blocks


# --- wrappers: nodes are ("tag", label), ("text", constant, path), ("slot", size, path), ("plus", nodes), ("opt", nodes)


def stream(page: str | None | Page) -> list[tuple]:
    """The page as nodes: opening and closing labels of its block structure, and its texts."""
    out: list[tuple] = []
    before: tuple[str, ...] = ()
    for path, text, _ in page.blocks if isinstance(page, Page) else blocks(page):
        same = 0
        while same < min(len(before), len(path)) and before[same] == path[same]:
            same += 1
        if same == len(path) == len(before) and path:
            same -= 1
        out += [("tag", "/" + x) for x in reversed(before[same:])] + [("tag", x) for x in path[same:]]
        out.append(("text", text, path))
        before = path
    return out + [("tag", "/" + x) for x in reversed(before)]


def _kind(node: tuple):
    return ("s",) if node[0] in ("text", "slot") else ("t", node[1]) if node[0] == "tag" else (node[0], tuple(_kind(x) for x in node[1]))


def fold(nodes: list[tuple], longest: int = 48) -> list[tuple]:
    """Side-by-side repetitions of up to ``longest`` nodes become one repeated group; a longer one stays written out,
    which changes the wrapper's length and not what it tells of its paths."""
    out: list[tuple] = []
    kinds: list[tuple] = []
    for node in nodes:
        out.append(node)
        kinds.append(_kind(node))
        for n in range(1, min(longest, len(out) // 2) + 1):
            if kinds[-1] == kinds[-n - 1] and kinds[-n:] == kinds[-2 * n : -n] and any(x[0] == "tag" for x in out[-n:]):
                head, gone = out[-2 * n : -n], 2 * n
            elif out[-n - 1][0] == "plus" and kinds[-n - 1][1] == tuple(kinds[-n:]):
                head, gone = out[-n - 1][1], n + 1
            else:
                continue
            tail, kind = out[-n:], ("plus", tuple(kinds[-n:]))
            del out[-gone:], kinds[-gone:]
            out.append(("plus", [_join(a, b) for a, b in zip(head, tail, strict=True)]))
            kinds.append(kind)
            break
    return out


def _join(a: tuple, b: tuple) -> tuple:
    if a[0] in ("text", "slot"):
        return a if a == b else ("slot", max(len(x[1]) if x[0] == "text" else x[1] for x in (a, b)), a[2])
    if a[0] in ("plus", "opt"):
        return (a[0], [_join(x, y) for x, y in zip(a[1], b[1], strict=True)])
    return a


def _flat(nodes: list[tuple]) -> list[tuple[tuple, int]]:
    """(node, number of its optional group, 0 if none): optional groups written out."""
    out: list[tuple[tuple, int]] = []
    for i, node in enumerate(nodes):
        out += [(x, i + 1) for x, _ in _flat(node[1])] if node[0] == "opt" else [(node, 0)]
    return out


def align(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The wrapper of two wrappers: common nodes joined, the rest optional. What is optional is aligned as well, and no
    optional group holds another one, so that a wrapper only grows by what it has not seen."""
    left, right = _flat(a), _flat(b)
    out: list[tuple[tuple, tuple | None]] = []
    for k, (what, i, j, m, n) in enumerate(difflib.SequenceMatcher(None, [_kind(x) for x, _ in left], [_kind(x) for x, _ in right], autojunk=False).get_opcodes()):
        if what == "equal":
            out += [(_join(x, y), (g, h) if g or h else None) for (x, g), (y, h) in zip(left[i:j], right[m:n], strict=True)]
            continue
        out += [(x, (k, 0)) for x, _ in left[i:j]] + [(y, (k, 1)) for y, _ in right[m:n]]
    joined: list[tuple] = []
    last = None
    for node, group in out:
        if group is None:
            joined.append(node)
        elif group == last:
            joined[-1][1].append(node)
        else:
            joined.append(("opt", [node]))
        last = group
    return joined


def learned(page: str) -> tuple[str, dict]:
    """(shape, state) of one page: pages of one shape have the same wrapper but for their texts."""
    p = Page(page)
    named = {b.path[: b.elements.index(e) + 1] for b in p.blocks for e in b.elements if e in p.beside}
    state = {"nodes": fold(stream(p)), "named": named, "page": hashlib.md5(page.encode("utf-8", "surrogatepass")).hexdigest()}
    return _shape(state), state


def _shape(state: dict) -> str:
    return hashlib.md5(repr([_kind(x) for x in state["nodes"]]).encode("utf-8", "surrogatepass")).hexdigest()


def _same(a: dict, b: dict) -> dict:
    """The state of two states of one shape, whatever their order."""
    nodes = a["nodes"] if a["nodes"] == b["nodes"] else [_join(x, y) for x, y in zip(a["nodes"], b["nodes"], strict=True)]
    return {"nodes": nodes, "named": a["named"] | b["named"], "page": a["page"] if a["page"] == b["page"] else ""}


def _aligned(a: dict, b: dict) -> dict:
    return {"nodes": fold(align(a["nodes"], b["nodes"])), "named": a["named"] | b["named"], "page": ""}


def _pages(pages: list[str]) -> dict | None:
    """The state of some pages: those of one shape joined, then the shapes aligned in the order of their first pages."""
    shapes: dict[str, dict] = {}
    for p in pages:
        shape, state = learned(p)
        shapes[shape] = _same(shapes[shape], state) if shape in shapes else state
    return functools.reduce(_aligned, shapes.values()) if shapes else None


def wrapper(pages: list[str]) -> list[tuple]:
    """The wrapper of some pages of a host."""
    state = _pages(pages)
    return state["nodes"] if state else []


def _dumped(state: dict) -> str:
    return json.dumps({**state, "named": sorted(state["named"])})


def _loaded(state: str) -> dict:
    def node(x: list) -> tuple:
        return (x[0], [node(y) for y in x[1]]) if x[0] in ("plus", "opt") else (x[0], x[1]) if x[0] == "tag" else (x[0], x[1], tuple(x[2]))

    found = json.loads(state)
    return {**found, "nodes": [node(x) for x in found["nodes"]], "named": {tuple(x) for x in found["named"]}}


def expression(nodes: list[tuple]) -> str:
    """The wrapper as a readable union-free regular expression."""
    say = {"tag": lambda x: f"<{x[1]}>", "text": lambda x: re.escape(x[1]), "slot": lambda x: "#TEXT", "plus": lambda x: f"({expression(x[1])})+", "opt": lambda x: f"({expression(x[1])})?"}
    return "".join(say[x[0]](x) for x in nodes)


def _leaves(nodes: list[tuple]) -> Iterator[tuple]:
    for node in nodes:
        if node[0] in ("plus", "opt"):
            yield from _leaves(node[1])
        elif node[0] != "tag":
            yield node


def _element(label: str) -> str:
    return re.split(r"[.#]", label, maxsplit=1)[0]


def infer(pages: list[str]) -> dict:
    """What extraction needs of a host with these pages."""
    return told(_pages(sorted(set(pages))) or {"nodes": [], "named": set(), "page": "-"})


def told(state: dict) -> dict:
    """What extraction needs of a host, from its wrapper: ``main`` is the path of the container that holds most of what
    is in slots, ``constant`` the constants outside it with their paths.

    From the outermost element on, the walk goes into a container while that holds over two thirds of the slots' text (a
    piece counts as long as it was on any page). Of a single page everything counts as a slot.
    """
    named, alone = state["named"], bool(state["page"])
    free = lambda path: not any(path[:i] in named for i in range(1, len(path) + 1))
    found = [x for x in _leaves(state["nodes"]) if free(x[2])]
    slots = [(x[2], len(x[1]) if x[0] == "text" else x[1]) for x in found if x[0] == "slot" or alone]
    main: tuple[str, ...] = ()
    while True:
        volume: dict[str, int] = {}
        for path, size in slots:
            if path[: len(main)] == main and len(path) > len(main) and _element(path[len(main)]) in CONTAINERS:
                volume[path[len(main)]] = volume.get(path[len(main)], 0) + size
        best = max(volume, key=lambda x: (volume[x], x), default=None)
        if best is None or 3 * volume[best] <= 2 * sum(size for path, size in slots if path[: len(main)] == main):
            break
        main = (*main, best)
    constant = sorted({("/".join(x[2]), x[1]) for x in found if x[0] == "text" and x[2][: len(main)] != main}) if not alone else []
    return {"main": list(main), "constant": constant}


def main_text(page: str | None, known: dict | None = None) -> str:
    """The page's article: the blocks of its article elements or, without any, of the container that its host's wrapper
    names, without what names take out; white space inside a block is one blank, and blocks are joined by one blank.

    A first heading outside that container belongs to the article too, if the wrapper has no constant there. A page
    that has nothing in the named container (or whose host is unknown) is a wrapper of its own.
    """
    p = Page(page)
    rest = [b for b in p.blocks if not p.inside(b, p.beside)]
    if any(p.inside(b, p.main) for b in rest):
        return " ".join(b.text for b in rest if p.inside(b, p.main))
    for rule in (known, None):
        rule = rule or (infer([page]) if rest else {"main": [], "constant": []})
        main = tuple(rule["main"])
        constant = {(path, text) for path, text in rule["constant"]}
        own = lambda b: b.path[: len(main)] == main  # noqa: B023, E731
        if any(own(b) for b in rest):
            first = next(i for i, b in enumerate(rest) if own(b))
            title = [b for b in rest[:first] if b.path and _element(b.path[-1]) == "h1" and ("/".join(b.path), b.text) not in constant]
            return " ".join(b.text for b in [*title, *(b for b in rest if own(b))])
    return ""


_STATES = "host string, shape string, state string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["host", "shape", "state"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (host, html), rows (host, shape, state), one for all pages of a shape that a task has read."""
    held: dict[tuple[str, str], dict] = {}
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            shape, state = learned(page)
            held[host, shape] = _same(held[host, shape], state) if (host, shape) in held else state
            if len(held) >= HELD:
                yield _batch([(*k, _dumped(v)) for k, v in held.items()])
                held = {}
    yield _batch([(*k, _dumped(v)) for k, v in held.items()])


def _reduced(join: Callable[[dict, dict], dict]):
    """Of rows (host, group, state) that stand together by both, rows (host, shape, state) of the joined groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        whole: dict = {}
        for b in batches:
            done = []
            for *name, state in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if name == last:
                    whole = join(whole, _loaded(state))
                    continue
                if last:
                    done.append((last[0], _shape(whole), _dumped(whole)))
                last, whole = name, _loaded(state)
            if done:
                yield _batch(done)
        if last:
            yield _batch([(last[0], _shape(whole), _dumped(whole))])

    return run


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): what ``told`` tells of each host in JSON, from all its pages.

    A task joins the pages of one shape before anything is shuffled, and so do the tasks' states after it. A host's
    shapes are then aligned in the order of their hashes, ``SHAPES`` of them at a time, until it has one; wrappers of one
    shape are joined again between the steps. So the result does not depend on how the pages are dealt.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pages.where("html <> '' and host <> ''").select("host", "html").mapInArrow(_learn, _STATES)
    while True:
        shapes = found.repartition(n, "host", "shape").sortWithinPartitions("host", "shape", "state").mapInArrow(_reduced(_same), _STATES)
        shapes = written(shapes, "shapes")
        steps = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHAPES).alias("_steps"))
        rows = shapes.join(steps, "host").select("host", F.pmod(F.xxhash64("shape"), F.col("_steps")).cast("string").alias("_step"), "state", "shape")
        rows = rows.repartition(n, "host", "_step").sortWithinPartitions("host", "_step", "shape").select("host", "_step", "state")
        found = written(rows.mapInArrow(_reduced(_aligned), _STATES), "aligned")
        if found.count() == found.select("host").distinct().count():
            break

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(told(_loaded(x))) for x in b.column(2).to_pylist()], pa.string())], ["host", "wrapper"])

    return written(found.mapInArrow(tell, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (the article, empty if none), n_chars.

    Wrappers are inferred from all pages of each host and joined by host: broadcast while
    they are few, else by a sort-merge join whose hot hosts AQE splits. Every page is read whole.

    Nulls: a null html has the empty text; a null url is a page without a host, whose wrapper is its own. Repeated rows
    get equal rows. Very long pages are read whole. Extra columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.col(url_col), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    known = host_wrappers(rows)
    small = known.withColumnRenamed("host", "_host")
    small = F.broadcast(small) if (known.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES else small
    joined = rows.join(small, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, dict | None] = {None: None}
        for b in batches:
            texts = []
            for page, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if w not in read:
                    if len(read) > 2_000:
                        read.clear()
                        read[None] = None
                    read[w] = json.loads(w)
                texts.append(main_text(page, read[w]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
