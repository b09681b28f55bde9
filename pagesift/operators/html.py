"""HTML text as a table: captures -> one row per page holding its element tree.

``parse_pages`` is the only place where HTML is read.  It is a narrow
``mapInArrow`` job: pages are independent, so nothing is shuffled, and the
tree comes back as one ``nodes`` array per page.  Everything that asks
questions *inside* a page (closest ancestor, descendants, text) then runs as
JVM array expressions on that row, see ``pagesift.functions.dom``; only
questions *across* pages need a join or an aggregate.

Node ids are pre-order ranks, so the descendants of a node are the array slice
``[node_id + 1, last_id]`` and its text is a slice of the page text.

The tags on the way to a node are an entry of the page's path trie: ``paths``
holds for each entry the one above it and a tag, ``path`` of a node is its entry,
and ``path_id`` a 64-bit digest of the whole path, equal on all pages.  Paths are
compared and shuffled as digests, and spelled only where they are shown.  A tree may
be as deep as it has elements: nothing here grows with depth times elements.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.sources.captures import spread

NODE_DDL = (
    "struct<node_id:int,parent_id:int,last_id:int,depth:int,sib_ord:int,tag:string,id:string,"
    "classes:array<string>,attrs:map<string,string>,text_start:int,text_len:int,trimmed_len:int,label:string,"
    "child_tags:array<string>,path:int,path_id:bigint>"
)
PATHS_DDL = "array<struct<up:int,tag:string>>"

_STRINGS = pa.list_(pa.string())
_NODE = pa.struct(
    [
        ("node_id", pa.int32()),
        ("parent_id", pa.int32()),
        ("last_id", pa.int32()),
        ("depth", pa.int32()),
        ("sib_ord", pa.int32()),
        ("tag", pa.string()),
        ("id", pa.string()),
        ("classes", _STRINGS),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text_start", pa.int32()),
        ("text_len", pa.int32()),
        ("trimmed_len", pa.int32()),
        ("label", pa.string()),
        ("child_tags", _STRINGS),
        ("path", pa.int32()),
        ("path_id", pa.int64()),
    ]
)
_ENTRY = pa.struct([("up", pa.int32()), ("tag", pa.string())])

# --- tokens -----------------------------------------------------------------

_ATTR = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?))?"""
_ATTR_NOCAP = re.sub(r"\((?!\?)", "(?:", _ATTR)
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*+(?:>|\Z)"  # doctype, bogus comment
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"  # 1: end tag
    r"|</[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:%s)*+)([\s/]*+)(?:>|\Z)" % _ATTR_NOCAP,  # 2, 3, 4: start tag
    re.S,
)
_ATTRS = re.compile(_ATTR, re.S)
# A reference without ";" before "=" or a letter is literal inside an attribute ("?a=1&copy=2").
_ATTR_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?![=a-zA-Z0-9])))")

# --- fixed values of the HTML standard ---------------------------------------

_VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split()
)
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_RCDATA = frozenset(("title", "textarea"))
_HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noframes template noscript".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp li dd dt".split()
) | _HEADINGS
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_BUTTON_SCOPE = _SCOPE | {"button"}
_LIST_SCOPE = _SCOPE | {"ol", "ul"}
_TABLE_SCOPE = frozenset(("html", "table", "template"))
_SECTIONS = frozenset(("tbody", "thead", "tfoot"))
_TABLE_PARTS = _SECTIONS | {"tr", "td", "th", "caption", "colgroup", "col"}
_SPECIAL = (
    _CLOSES_P
    | _SCOPE
    | _TABLE_PARTS
    | _VOID
    | frozenset("body button head iframe noembed noframes noscript script select style textarea title".split())
) - {"dialog", "search"}
_STOPS_LI = _SPECIAL - {"address", "div", "p"}


#: Open elements that ``_find`` looks at one by one before it asks for the last one of each tag.
NEAR = 64
#: Trimmed text of a node up to this length is kept with it as ``label``.
LABEL_CHARS = 25
#: Everything but Unicode white space.
_INK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Tree:
    """Builds the flat node columns of one page from its tokens."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.last: list[int] = []
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.depth: list[int] = []
        self.sib: list[int] = []
        self.start: list[int] = []
        self.length: list[int] = []
        self.children: list[list[str]] = []
        self.path: list[int] = []
        self.entries: dict[tuple[int, str], int] = {}  # path trie: (entry above, tag) -> entry
        self.digests: list[bytes] = []
        self.chunks: list[str] = []
        self.pos = 0
        self.stack: list[int] = []
        self.open: dict[str, list[int]] = {}  # open elements of each tag, ascending as on the stack
        self.body = -1
        self._open("html", {})
        self._open("head", {})

    def _open(self, tag: str, attrs: dict[str, str]) -> int:
        node = len(self.tag)
        depth = len(self.stack)
        up = self.stack[-1] if depth else -1
        self.parent.append(up)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.depth.append(depth)
        self.start.append(self.pos)
        self.last.append(node)
        self.length.append(0)
        self.children.append([])
        if up >= 0:
            self.sib.append(len(self.children[up]))
            self.children[up].append(tag)
        else:
            self.sib.append(0)
        self.path.append(self._entry(self.path[up] if up >= 0 else -1, tag))
        self.stack.append(node)
        self.open.setdefault(tag, []).append(node)
        return node

    def _entry(self, above: int, tag: str) -> int:
        """The path trie's entry for a tag below another entry."""
        found = self.entries.setdefault((above, tag), len(self.digests))
        if found == len(self.digests):
            start = self.digests[above] if above >= 0 else b""
            self.digests.append(blake2b(start + tag.encode("utf-8", "surrogatepass"), digest_size=8).digest())
        return found

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[self.tag[node]].pop()
        self.last[node] = len(self.tag) - 1
        self.length[node] = self.pos - self.start[node]

    def _pop_through(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _find(self, tags, stop) -> int:
        """Stack position of the nearest open element in ``tags`` not behind ``stop``, or -1."""
        below = max(-1, len(self.stack) - 1 - NEAR)
        for i in range(len(self.stack) - 1, below, -1):
            tag = self.tag[self.stack[i]]
            if tag in tags:
                return i
            if tag in stop:
                return -1
        if below < 0:
            return -1
        found = self._last_open(tags)
        return bisect_left(self.stack, found) if found >= 0 and found >= self._last_open(stop) else -1

    def _last_open(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _close(self, tags, stop) -> bool:
        at = self._find(tags, stop)
        if at > 0:
            self._pop_through(at)
        return at > 0

    def _current(self) -> str:
        return self.tag[self.stack[-1]]

    def _merge(self, node: int, attrs: dict[str, str]) -> None:
        for key, value in attrs.items():
            self.attrs[node].setdefault(key, value)

    def _enter_body(self, attrs: dict[str, str]) -> None:
        self._pop_through(1)
        self.body = self._open("body", attrs)

    def text(self, data: str) -> None:
        if not data:
            return
        if self.body < 0 and self._current() in ("html", "head"):
            kept = data.lstrip(" \t\n\f\r")
            if kept:
                self._enter_body({})
                data = kept
            elif self.pos == 0 and len(self.tag) == 2 and not self.children[1]:
                return
        self.chunks.append(data)
        self.pos += len(data)

    def start_tag(self, tag: str, attrs: dict[str, str], self_closing: bool) -> bool:
        """Insert one element; False when the tag is ignored."""
        if tag == "html":
            self._merge(0, attrs)
            return False
        if tag == "head":
            if self.body < 0:
                self._merge(1, attrs)
            return False
        if tag == "body":
            if self.body < 0:
                self._enter_body(attrs)
            else:
                self._merge(self.body, attrs)
            return False
        if self.body < 0 and self._current() in ("html", "head"):
            if tag not in _HEAD_ONLY:
                self._enter_body({})
            elif self._current() == "html":
                self.stack.append(1)
                node = self._open(tag, attrs)
                self.stack.remove(1)
                if tag in _VOID:
                    self._pop()
                return node >= 0
        if tag == "form" and self._find(("form",), ()) > 0:
            return False
        if tag in _TABLE_PARTS and not self._table_part(tag):
            return False
        if tag == "table" and self._current() in (_SECTIONS | {"table", "tr"}):
            self._close(("table",), ())
        if tag == "li":
            self._close(("li",), _STOPS_LI - {"li"})
        elif tag in ("dd", "dt"):
            self._close(("dd", "dt"), _STOPS_LI - {"dd", "dt"})
        if tag in _CLOSES_P:
            self._close(("p",), _BUTTON_SCOPE)
        if tag in _HEADINGS and self._current() in _HEADINGS:
            self._pop()
        elif tag == "button":
            self._close(("button",), _SCOPE)
        elif tag == "a":
            self._close(("a",), _SCOPE)
        elif tag in ("option", "optgroup"):
            if self._current() == "option":
                self._pop()
            if tag == "optgroup" and self._current() == "optgroup":
                self._pop()
        self._open(tag, attrs)
        if tag in _VOID or (self_closing and self._find(("svg", "math"), ()) > 0):
            self._pop()
        return True

    def _table_part(self, tag: str) -> bool:
        """Open the implied table parts around ``tag``; False outside any table."""
        if self._find(("table",), ("html", "template")) < 0:
            return False
        if tag in ("td", "th", "tr"):
            self._close(("td", "th", "caption"), _TABLE_SCOPE)
            if tag == "tr":
                self._close(("tr",), _TABLE_SCOPE)
            if self._find(_SECTIONS | {"tr"}, _TABLE_SCOPE) < 0:
                self._pop_through(self._find(("table",), ()) + 1)
                self._open("tbody", {})
            if tag != "tr" and self._find(("tr",), _TABLE_SCOPE) < 0:
                self._pop_through(self._find(_SECTIONS, _TABLE_SCOPE) + 1)
                self._open("tr", {})
            at = self._find(("tr",) if tag != "tr" else _SECTIONS, _TABLE_SCOPE)
            self._pop_through(at + 1)
        elif tag == "col":
            if self._current() != "colgroup":
                self._pop_through(self._find(("table",), ()) + 1)
                self._open("colgroup", {})
        else:
            self._pop_through(self._find(("table",), ()) + 1)
        return True

    def end_tag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.body < 0 and self._current() == "head":
                self._pop()
            return
        if tag == "br":
            self.start_tag("br", {}, False)
        elif tag == "p":
            if not self._close(("p",), _BUTTON_SCOPE):
                self.start_tag("p", {}, False)
                self._close(("p",), _BUTTON_SCOPE)
        elif tag == "li":
            self._close(("li",), _LIST_SCOPE)
        elif tag in _HEADINGS:
            self._close(_HEADINGS, _SCOPE)
        elif tag == "table" or tag in _TABLE_PARTS:
            self._close((tag,), _TABLE_SCOPE)
        elif tag in _SPECIAL:
            self._close((tag,), _SCOPE)
        else:
            self._close((tag,), _SPECIAL)

    def finish(self) -> None:
        if self.body < 0:
            self._enter_body({})
        self._pop_through(0)
        self.full = "".join(self.chunks)
        self._trim()

    def _trim(self) -> None:
        """Trimmed length of each node's text, and the text itself where it is short."""
        runs = [m.span() for m in _INK.finditer(self.full)]
        starts, ends = [a for a, _ in runs], [b for _, b in runs]
        self.trimmed: list[int] = []
        self.label: list[str | None] = []
        for at, size in zip(self.start, self.length, strict=True):
            i = bisect_right(ends, at)  # first run that ends behind the node's start
            j = bisect_left(starts, at + size) - 1  # last run that starts before its end
            first, last = (max(at, starts[i]), min(at + size, ends[j])) if i <= j else (at, at)
            self.trimmed.append(last - first)
            self.label.append(self.full[first:last] if 0 < last - first <= LABEL_CHARS else None)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRS.findall(raw):
        value = double or single or bare
        if "&" in value:
            value = _ATTR_REF.sub(lambda m: unescape(m.group()), value)
        out.setdefault(name.lower(), value)
    return out


def build_tree(html: str) -> _Tree:
    """The element tree of one page (per-row helper of ``parse_pages``)."""
    if "\r" in html:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
    tree = _Tree()
    pos, size = 0, len(html)
    while pos < size:
        m = _TOKEN.search(html, pos)
        at = m.start() if m else size
        if at > pos:
            data = html[pos:at]
            tree.text(unescape(data) if "&" in data else data)
        if not m:
            break
        pos = m.end()
        end, start, attrs, tail = m.groups()
        if start is not None:
            if html[pos - 1] != ">":
                break  # the page ends inside a tag: the tag is dropped
            tag = start.lower()
            self_closing = tail.endswith("/")
            known = tree.start_tag(tag, _attributes(attrs) if attrs else {}, self_closing)
            if known and (tag in _RAW or tag in _RCDATA):
                close = re.compile(r"</%s(?=[\s/>])[^>]*>?|\Z" % re.escape(tag), re.I).search(html, pos)
                data = html[pos : close.start()]
                if tag == "textarea" and data.startswith("\n"):
                    data = data[1:]
                tree.text(unescape(data) if tag in _RCDATA and "&" in data else data)
                tree._pop()
                pos = close.end()
            elif known and tag in ("pre", "listing") and html.startswith("\n", pos):
                pos += 1
        elif end is not None:
            tree.end_tag(end.lower())
    tree.finish()
    return tree


# --- the Spark job -------------------------------------------------------------


def _offsets(lists) -> pa.Array:
    total, out = 0, [0]
    for item in lists:
        total += len(item)
        out.append(total)
    return pa.array(out, pa.int32())


def _list_of(lists, kind) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(lists), pa.array([v for item in lists for v in item], kind))


def _to_arrow(trees: list[_Tree | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(text, nodes, paths) columns for a batch of parsed pages."""
    live = [t for t in trees if t is not None]

    def flat(name):
        return [v for t in live for v in getattr(t, name)]

    attrs = flat("attrs")
    classes = [list(dict.fromkeys((a.get("class") or "").split())) for a in attrs]
    maps = pa.MapArray.from_arrays(
        _offsets(attrs),
        pa.array([k for a in attrs for k in a], pa.string()),
        pa.array([v for a in attrs for v in a.values()], pa.string()),
    )
    nodes = pa.StructArray.from_arrays(
        [
            pa.array([i for t in live for i in range(len(t.tag))], pa.int32()),
            pa.array(flat("parent"), pa.int32()),
            pa.array(flat("last"), pa.int32()),
            pa.array(flat("depth"), pa.int32()),
            pa.array(flat("sib"), pa.int32()),
            pa.array(flat("tag"), pa.string()),
            pa.array([a.get("id") for a in attrs], pa.string()),
            _list_of(classes, pa.string()),
            maps,
            pa.array(flat("start"), pa.int32()),
            pa.array(flat("length"), pa.int32()),
            pa.array(flat("trimmed"), pa.int32()),
            pa.array(flat("label"), pa.string()),
            _list_of(flat("children"), pa.string()),
            pa.array(flat("path"), pa.int32()),
            pa.array([ids[k] for t in live for ids in [_path_ids(t)] for k in t.path], pa.int64()),
        ],
        fields=list(_NODE),
    )
    trie = [list(t.entries) if t is not None else [] for t in trees]
    entries = pa.StructArray.from_arrays(
        [pa.array([up for t in trie for up, _ in t], pa.int32()), pa.array([tag for t in trie for _, tag in t], pa.string())],
        fields=list(_ENTRY),
    )
    paths = pa.ListArray.from_arrays(_offsets(trie), entries)
    sizes = [[] if t is None else t.tag for t in trees]
    text = pa.array([None if t is None else t.full for t in trees], pa.string())
    return text, pa.ListArray.from_arrays(_offsets(sizes), nodes), paths


def _path_ids(tree: _Tree) -> list[int]:
    return [int.from_bytes(d, "little", signed=True) for d in tree.digests]


def _built(trees: list[_Tree | None], errors: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """``_to_arrow``; when a batch can't be built, the pages that can't be built alone become errors."""
    try:
        return _to_arrow(trees)
    except Exception:
        for i, tree in enumerate(trees):
            try:
                _to_arrow([tree])
            except Exception as exc:
                trees[i], errors[i] = None, type(exc).__name__
        return _to_arrow(trees)


def parse_pages(captures: DataFrame, html: str = "html") -> DataFrame:
    """Parse the ``html`` column of every row; all other columns pass through.

    Adds ``text`` (all text nodes in document order), ``nodes`` (the element
    tree, pre-order), ``paths`` (its path trie) and ``error`` (set instead of raising).  Filter captures
    *before* calling this: Catalyst moves no filter through a Python node.
    """
    keep = [c for c in captures.columns if c != html]
    source = captures.select(*keep, html)
    passed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop(html).schema)
    schema = f"{passed}text string, nodes array<{NODE_DDL}>, paths {PATHS_DDL}, error string"

    def run(batches):
        for batch in batches:
            # Bounded output: a slice of input pages per output batch.
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                trees, errors = [], []
                for page in part.column(len(keep)).to_pylist():
                    try:
                        trees.append(None if page is None else build_tree(page))
                        errors.append("no_html" if page is None else None)
                    except Exception as exc:  # a bad page is data, not a job failure
                        trees.append(None)
                        errors.append(type(exc).__name__)
                text, nodes, paths = _built(trees, errors)
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, text, nodes, paths, pa.array(errors, pa.string())],
                    names=[*keep, "text", "nodes", "paths", "error"],
                )

    return spread(source).mapInArrow(run, schema)


def elements(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per element: the ``nodes`` of parsed pages, with the given page columns."""
    return pages.select(*keys, F.inline("nodes"))
