"""Main text of web pages by union-free wrapper inference.

Pages of a host come from a template. Every page becomes a balanced stream of tokens: open and close
tags (with class and id) and text slots. Streams of one host are aligned one after
the other into a wrapper, a regular expression without unions: equal tags match; at a mismatch the nearer of the two
tags that comes again ends it, and what was passed becomes an optional group ``(...)?``; a sequence that follows itself, of any
period, becomes repeated groups ``(...)+``; aligned texts become a slot, which
knows how many pages it was seen on and whether its text ever differed. Alignment goes level by level, with
all elements that share a place at once, so neither the depth of a page nor the length of a list matters. Partial
wrappers are folded within each partition, then by (host, salt), then by
host; the fold may be regrouped, so a host with a third of all pages is no
single task's list.

The wrapper chooses the text. Slots whose text is the same on all of at least ``template_pages`` different pages are template;
what is left varies. Where the varying text lies decides among article elements, the main element and the region of
the wrapper that holds most of it (``plan``); a page without the host's choice is judged by its own text alike. Left out are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments - by element, role, or a whole word of class or id. A part of a
compound word (``post-share``) counts only for elements with at most half of the text around them, and never
after ``with``, ``no`` and their like. In a main element small articles beside the text are teasers and left out.
Blocks are trimmed, white space inside one becomes one space, and blocks are joined by a space.

Defined results: NULL and empty pages have empty text; pages cut off anywhere keep what they
hold; elements may be nested or unclosed to any depth; a NULL or odd url belongs to the host ""; repeated rows are returned each, but copies of a page count as one
page of their host, wherever they lie; the text of a page depends on how many different pages its host has (``template_pages``); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from bisect import bisect_left
from collections import OrderedDict, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.session import scratch_dir

#: Fixed values of HTML: elements without content, with raw text, and those that break no block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Fixed values of HTML: which open elements an open tag closes first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th")}
_LISTS = ("ul", "ol", "dl", "table", "select")
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = tuple("article aside blockquote body div dl footer form header main nav ol section table td th ul li dd".split())
#: Elements, roles, and words of class or id that are not the article.
OUT_TAGS = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu head title".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentary consent cookie cookies disqus "
                      "footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion "
                      "related recommended replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Beside these a word of OUT_WORDS says what an element has not, or only has beside it.
_NOT = frozenset("with without no non not none has have is hide hidden".split())
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: How surely an element is not the article.
KEPT, PERHAPS, OUT = 0, 1, 2


def _says_out(names: str) -> int:
    """What the words of class and id say."""
    found = KEPT
    for word in names.split():
        if word.lower() in OUT_WORDS:
            return OUT
        parts = [p.lower() for p in _WORDS.findall(word)]
        ends = len(parts) > 1 and not _NOT.intersection(parts) and (parts[0] in OUT_WORDS) + (parts[-1] in OUT_WORDS)
        if ends:
            found = max(found, OUT if ends == 2 else PERHAPS)
    return found


@lru_cache(maxsize=10_000)
def _element(name: str, attrs: str) -> tuple[str, int, int]:
    """Key, OUT, PERHAPS or KEPT, and 2 for an article, 1 for a main element."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):  # of a repeated attribute the first counts
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names, role = f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower()
    main = 2 if name == "article" or found.get("itemprop") == "articleBody" else 1 if name == "main" or role == "main" else 0
    if name in OUT_TAGS or role in OUT_ROLES or found.get("hidden", "until-found").lower() != "until-found":
        out = OUT
    else:
        out = _says_out(names) if names and not main else KEPT
    key = name + ("." + re.sub(r"\d+", "0", ".".join(names.split())) if names else "")
    return key, KEPT if name in ("html", "body") else out, main


@dataclass
class Page:
    """The elements and texts of a page in the order of their opening; a text has tag "". Element 0 is the page."""
    tag: list[str] = field(default_factory=lambda: [""])
    key: list[str] = field(default_factory=lambda: ["#root"])
    up: list[int] = field(default_factory=lambda: [-1])
    out: list[int] = field(default_factory=lambda: [KEPT])
    main: list[int] = field(default_factory=lambda: [0])
    text: list[str | None] = field(default_factory=lambda: [None])

    def add(self, up: int, tag: str, key: str, out: int, main: int, text: str | None) -> int:
        self.tag.append(tag)
        self.key.append(key)
        self.up.append(up)
        self.out.append(out)
        self.main.append(main)
        self.text.append(text)
        return len(self.tag) - 1


def parse(page: str) -> Page:
    """The elements of a page; unclosed ones close where HTML says, or at the end."""
    out = Page()
    stack, places, at, size = [0], defaultdict(list), 0, len(page)

    def innermost(names) -> int:
        """How deep the innermost open element of these names is; 0 if none is open."""
        return max([places[n][-1] for n in names if places.get(n)], default=0)

    def close(depth: int) -> None:
        for i in stack[depth:]:
            places[out.tag[i]].pop()
        del stack[depth:]

    def words(s: str) -> None:
        if s:
            out.add(stack[-1], "", "", KEPT, 0, s)

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at:m.start()])
        at, name = m.end(), m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            depth = innermost((name,))
            if depth and not (name in INLINE and depth < innermost(("article", "main", "body"))):
                close(depth)
            continue
        if name in _ENDS_P and places["p"] and places["p"][-1] > innermost(_SCOPE):
            close(places["p"][-1])
        if name in CLOSES:
            depth = innermost(CLOSES[name])
            if depth > innermost(_LISTS):
                close(depth)
        i = out.add(stack[-1], name, *_element(name, m["attrs"]), None)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            stop = end.start() if end else size
            if name in ("title", "textarea") and stop > at:
                out.add(i, "", "", KEPT, 0, page[at:stop])
            at = end.end() if end else size
            continue
        places[name].append(len(stack))
        stack.append(i)
    return out


#: A text slot: pages, least and largest checksum of its text, and characters seen.
Slot = tuple[int, int, int, int]


@dataclass(slots=True)
class Group:
    """An element of a wrapper, or a slot (key ""); ``many`` and ``optional`` are the + and ? of its group."""
    key: str
    out: int = KEPT
    main: int = 0
    many: bool = False
    optional: bool = False
    slot: Slot | None = None
    children: list[Group] = field(default_factory=list)


def shown(wrapper: list[Group]) -> str:
    """The wrapper as an expression."""
    out: list[str] = []
    todo: list[Group | str] = wrapper[::-1]
    while todo:
        g = todo.pop()
        if isinstance(g, str):
            out.append(g)
            continue
        marks = ("+" if g.many else "") + ("?" if g.optional else "")
        end = f"){marks}" if marks else ""
        out.append("(" if marks else "")
        if g.slot:
            out.append("#TEXT" + end)
        else:
            out.append(f"<{g.key}>")
            todo.append(f"</{g.key}>{end}")
            todo += g.children[::-1]
    return "".join(out)


class _Item:
    """A place in a sequence of siblings and the groups that share it."""
    __slots__ = ("key", "many", "optional", "groups")

    def __init__(self, key: str, many: bool, optional: bool, groups: list[Group]):
        self.key, self.many, self.optional, self.groups = key, many, optional, groups


_MASK = (1 << 61) - 1


def _repeats_folded(items: list[_Item]) -> list[_Item]:
    """Sequences that follow themselves, of any period, as repeated items. Hashes of prefixes compare two stretches at once."""
    out: list[_Item] = []
    codes: dict[str, int] = {}
    places: dict[str, list[int]] = defaultdict(list)
    sums, power = [0], [1]
    for x in items:
        places[x.key].append(len(out))
        out.append(x)
        sums.append((sums[-1] * 1_000_003 + codes.setdefault(x.key, len(codes) + 1)) % _MASK)
        if len(power) < len(sums):
            power.append(power[-1] * 1_000_003 % _MASK)
        again = True
        while again:
            again = False
            n = len(out)
            same = places[out[-1].key]
            for q in reversed(same[:-1]):
                p = n - 1 - q
                if 2 * p > n:
                    break
                last = (sums[n] - sums[n - p] * power[p]) % _MASK
                if last == (sums[n - p] - sums[n - 2 * p] * power[p]) % _MASK:
                    for k in range(n - p, n):
                        a, b = out[k - p], out[k]
                        a.many, a.optional = True, a.optional and b.optional
                        a.groups += b.groups
                        places[b.key].pop()
                    del out[n - p:], sums[n - p + 1:]
                    again = len(out) > 1
                    break
    return out


def _aligned(a: list[_Item], b: list[_Item]) -> list[_Item]:
    """Two sequences as one. At a mismatch the nearer tag that comes again on the other side ends it; what is passed is optional."""
    if len(a) == len(b) and all(x.key == y.key for x, y in zip(a, b)):
        for x, y in zip(a, b):
            x.many, x.optional = x.many or y.many, x.optional or y.optional
            x.groups += y.groups
        return a
    in_a, in_b = defaultdict(list), defaultdict(list)
    for i, x in enumerate(a):
        in_a[x.key].append(i)
    for j, y in enumerate(b):
        in_b[y.key].append(j)

    def after(places: list[int], at: int) -> int:
        k = bisect_left(places, at)
        return places[k] - at if k < len(places) else 1 << 60

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x.key == y.key:
            x.many, x.optional = x.many or y.many, x.optional or y.optional
            x.groups += y.groups
            out.append(x)
            i, j = i + 1, j + 1
            continue
        in_b_after, in_a_after = after(in_b.get(x.key, []), j), after(in_a.get(y.key, []), i)
        skip_a, skip_b = (1, 1) if in_b_after == in_a_after == 1 << 60 else (0, in_b_after) if in_b_after <= in_a_after else (in_a_after, 0)
        for z in (*a[i:i + skip_a], *b[j:j + skip_b]):
            z.optional = True
            out.append(z)
        i, j = i + skip_a, j + skip_b
    for z in (*a[i:], *b[j:]):
        z.optional = True
        out.append(z)
    return _repeats_folded(out)


def _joined(slots: list[Slot]) -> Slot:
    return sum(s[0] for s in slots), min(s[1] for s in slots), max(s[2] for s in slots), sum(s[3] for s in slots)


def align(*streams: list[Group]) -> list[Group]:
    """Streams of siblings as one, level by level."""
    top: list[Group] = []
    todo: list[tuple[list[Group], list[list[Group]]]] = [(top, list(streams))]
    while todo:
        into, lists = todo.pop()
        items: list[_Item] | None = None
        if lists and all(len(groups) == 1 and groups[0].key == lists[0][0].key for groups in lists):
            alike, lists = [groups[0] for groups in lists], []
            items = [_Item(alike[0].key, any(g.many for g in alike), any(g.optional for g in alike), alike)]
        for groups in lists:
            own = _repeats_folded([_Item(g.key, g.many, g.optional, [g]) for g in groups])
            items = own if items is None else _aligned(items, own)
        for x in items or ():
            first = x.groups[0]
            if first.slot:
                into.append(Group("", KEPT, 0, x.many, x.optional, _joined([g.slot for g in x.groups])))
                continue
            g = Group(x.key, min(s.out for s in x.groups), max(s.main for s in x.groups), x.many, x.optional)
            into.append(g)
            below = [s.children for s in x.groups if s.children]
            if below:
                todo.append((g.children, below))
    return top


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _check(words: str) -> int:
    return zlib.crc32(words.encode("utf-8", "surrogatepass"))


def stream(page: Page) -> list[Group]:
    """A page's own wrapper."""
    groups: list[Group | None] = [Group("#root")]
    for i in range(1, len(page.tag)):
        above = groups[page.up[i]]
        made = None
        if page.tag[i]:
            if page.tag[i] not in ("script", "style"):
                made = Group(page.key[i], page.out[i], page.main[i])
        elif words := clean(page.text[i]):
            check = _check(words)
            made = Group("", slot=(1, check, check, len(words)))
        groups.append(made)
        if above is not None and made is not None:
            above.children.append(made)
    return align(groups[0].children)


def packed(wrapper: list[Group]) -> bytes:
    """A wrapper as bytes: its groups in order, each with the number of its children."""
    rows, todo = [], wrapper[::-1]
    while todo:
        g = todo.pop()
        rows.append((g.key, g.out, g.main, g.many, g.optional, g.slot, len(g.children)))
        todo += g.children[::-1]
    return pickle.dumps((len(wrapper), rows))


def unpacked(data: bytes) -> list[Group]:
    n, rows = pickle.loads(data)
    top: list[Group] = []
    open_lists = [(top, n)]
    for *fields, children in rows:
        while not open_lists[-1][1]:
            open_lists.pop()
        into, left = open_lists[-1]
        open_lists[-1] = into, left - 1
        g = Group(*fields)
        into.append(g)
        if children:
            open_lists.append((g.children, children))
    return top


_PATHS: dict[tuple[int, str], int] = {}


def _path(above: int, key: str) -> int:
    """The name of a place: a hash of the keys on the way to it."""
    got = _PATHS.get((above, key))
    if got is None:
        if len(_PATHS) > 200_000:
            _PATHS.clear()
        got = _PATHS[above, key] = int.from_bytes(blake2b(above.to_bytes(8, "big") + key.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
    return got


@dataclass
class Plan:
    """What a host's wrapper says: places of template text with its checksum, which level of elements has the varying text (2 articles, 1
    main, 0 the region), and the region's place (0: the whole page)."""
    fixed: dict[int, int] = field(default_factory=dict)
    level: int | None = None
    region: int = 0


#: Shares of text: an article's of its main element, an article's or main element's of the page.
_OF_MAIN, _OF_PAGE = 0.5, 0.25
_STOP = frozenset("p h1 h2 h3 table ul ol pre blockquote".split())


def _level(articles: float, mains: float, whole: float) -> int:
    """Where the text lies: in articles, in the main element, or in neither."""
    if articles and (articles >= _OF_MAIN * mains if mains else articles >= _OF_PAGE * whole):
        return 2
    return 1 if mains and mains >= _OF_PAGE * whole else 0


def plan(wrapper: list[Group], template_pages: int, enough: float = 0.7) -> Plan:
    """The host's choice, by the varying text of its wrapper."""
    # the wrapper in order: place, place above, parent row, whether repeated, out or inside an article or main element
    rows, todo = [], [(g, -1, 0, False, False, 0) for g in wrapper[::-1]]
    while todo:
        g, up, above, many, out, main = todo.pop()
        many = many or g.many
        if g.slot:
            rows.append((above, above, up, many, out, main, g.slot))
            continue
        here = _path(above, g.key)
        out, main = out or g.out == OUT, max(main, g.main)
        rows.append((here, above, up, many, out, main, g.key))
        at = len(rows) - 1
        todo += [(c, at, here, many, out, main) for c in g.children[::-1]]
    by_place: dict[int, list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        if not isinstance(r[6], str):
            by_place[r[0]].append(i)
    fixed: dict[int, int] = {}
    mass = [0] * len(rows)
    level = [0, 0, 0]
    for place, found in by_place.items():
        _, _, _, many, _, _, slot = rows[found[0]]
        if len(found) == 1 and not many and slot[1] == slot[2] and slot[0] >= template_pages:
            fixed[place] = slot[1]
            continue
        for i in found:
            if not rows[i][4]:
                mass[i] = rows[i][6][3]
                level[0] += mass[i]
                level[1] += mass[i] if rows[i][5] else 0
                level[2] += mass[i] if rows[i][5] == 2 else 0
    places: dict[int, int] = defaultdict(int)
    below: dict[int, dict[int, str]] = defaultdict(dict)
    for i in range(len(rows) - 1, -1, -1):
        here, above, up, _, _, _, what = rows[i]
        if up >= 0:
            mass[up] += mass[i]
        if isinstance(what, str):
            places[here] += mass[i]
            below[above][here] = what
    region = 0
    while level[0]:
        best = max(below[region], key=lambda x: (places[x], -x), default=None)
        if best is None or places[best] < enough * level[0] or below[region][best].split(".")[0] in _STOP:
            break
        region = best
    mains = level[1] if any(r[5] == 1 for r in rows) else 0
    return Plan(fixed, _level(level[2], mains, level[0]) if level[0] else None, region)


def main_text(html: str, plan: Plan) -> str:
    """The main text of a page under its host's plan."""
    page = parse(html)
    n = len(page.tag)
    tag, up, text = page.tag, page.up, page.text
    place, out = [0] * n, [False] * n
    size = [0] * n
    end = list(range(1, n + 1))
    for i in range(1, n):
        above = up[i]
        out[i] = out[above] or page.out[i] == OUT
        if tag[i]:
            place[i] = _path(place[above], page.key[i])
        elif not out[i]:
            check = plan.fixed.get(place[above])
            if check is not None and check == _check(clean(text[i])):
                text[i] = None
            elif not text[i].isspace():
                size[i] = len(text[i])
    for i in range(n - 1, 0, -1):
        size[up[i]] += size[i]
        end[up[i]] = max(end[up[i]], end[i])

    # what is perhaps out goes if it has at most half of the text around it: of its article or main element, else of the page
    around = [0] * n
    gone: list[tuple[int, int]] = []
    for i in range(1, n):
        around[i] = i if page.main[i] or tag[i] == "body" else around[up[i]]
        if out[up[i]]:
            out[i] = True
        elif page.out[i] == PERHAPS and 2 * size[i] <= size[around[up[i]]]:
            out[i] = True
            gone.append((i, size[i]))
    for i, less in gone:
        while i >= 0:
            size[i] -= less
            i = up[i]

    # the outermost articles, main elements and places of the region
    found: dict[int, list[int]] = {2: [], 1: [], 0: []}
    inside = [0] * n  # bits of the levels above
    for i in range(1, n):
        inside[i] = inside[up[i]]
        if not tag[i] or out[i]:
            continue
        for level, here in ((2, page.main[i] == 2), (1, page.main[i] == 1), (0, place[i] == plan.region)):
            if here and not inside[i] >> level & 1:
                found[level].append(i)
                inside[i] |= 1 << level
    held = {level: sum(size[i] for i in at) for level, at in found.items()}
    own = _level(held[2], held[1], size[0])
    level = plan.level if plan.level is not None and held[plan.level] else own
    if level == 2 and own != 2 and held[2] < _OF_PAGE * max(held[1], size[0]):
        level = own
    chosen = found[level] if held[level] else [0]
    keep = [False] * n
    for i in chosen:
        for k in range(i, end[i]):
            keep[k] = True
    if level == 1:
        for i in found[2]:
            if size[i] < _OF_PAGE * held[1]:  # a teaser
                for k in range(i, end[i]):
                    keep[k] = False

    blocks: list[str] = []
    open_block: list[str] = []
    ends: list[int] = []

    def close() -> None:
        if open_block:
            words = clean("".join(open_block))
            if words:
                blocks.append(words)
            open_block.clear()

    for i in range(1, n):
        while ends and ends[-1] <= i:
            ends.pop()
            close()
        if not tag[i]:
            if keep[i] and not out[i] and text[i] is not None:
                open_block.append(text[i])
        elif tag[i] not in INLINE:
            close()
            ends.append(end[i])
    close()
    return " ".join(blocks)


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def different_pages(pages: DataFrame, url: str = "url", html: str = "html", broadcast_rows: int = 200_000) -> DataFrame:
    """``host, html`` of every different page of a host; only texts that have copies are shuffled, once a partition."""
    rows = pages.select(_host(url).alias("host"), F.col(html).cast("string").alias("html")).where("html <> ''").withColumn("digest", F.sha2("html", 256))
    copied = rows.groupBy("host", "digest").count().where("count > 1").select("host", "digest").checkpoint()
    n = copied.limit(broadcast_rows + 1).count()
    if not n:
        return rows.select("host", "html")
    copied = F.broadcast(copied) if n <= broadcast_rows else copied
    one = rows.join(copied, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.first("html").alias("html"))
    return rows.join(copied, ["host", "digest"], "left_anti").select("host", "html").unionAll(one.select("host", "html"))


def _infer(most_hosts: int):
    def run(batches):
        known: OrderedDict[str, list] = OrderedDict()

        def emit(items):
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in items]), pa.array([packed(w) for _, w in items], pa.binary())],
                                              names=["host", "wrapper"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = stream(parse(page))
                known[host] = align(known[host], own) if host in known else own
                if len(known) > most_hosts:
                    yield emit([known.popitem(last=False) for _ in range(most_hosts // 2)])
        if known:
            yield emit(list(known.items()))
    return run


def _fold(table: pa.Table) -> pa.Table:
    wrapper = None
    for blob in sorted(x for x in table.column("wrapper").to_pylist()):
        part = unpacked(blob)
        wrapper = part if wrapper is None else align(wrapper, part)
    return pa.table({"host": pa.array([table.column("host")[0].as_py()]), "wrapper": pa.array([packed(wrapper)], pa.binary())})


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", salts: int = 16, most_hosts: int = 2000) -> DataFrame:
    """``host, wrapper``: one packed wrapper per host; ``shown(unpacked(wrapper))`` is the expression."""
    scratch_dir(pages.sparkSession)
    part = different_pages(small_batches(pages), url, html).mapInArrow(_infer(most_hosts), "host string, wrapper binary")
    once = part.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInArrow(
        _fold, "host string, wrapper binary")
    return once.groupBy("host").applyInArrow(_fold, "host string, wrapper binary")


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               template_pages: int = 8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``key, url, text, n_chars`` of every page.

    Hosts' plans are joined to the pages by host: broadcast if they are counted to be at most ``broadcast_bytes``,
    else by a shuffle whose hot hosts Spark splits."""
    scratch_dir(pages.sparkSession)

    def plans(batches):
        for b in batches:
            made = [pickle.dumps(plan(unpacked(w), template_pages)) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["__host", "__plan"])

    known = wrappers(pages, url, html).mapInArrow(plans, "__host string, __plan binary").checkpoint()
    size = known.agg(F.sum(F.length("__plan") + F.length("__host") + 64)).first()[0] or 0
    rows = pages.select(key, F.col(url).cast("string").alias(url), F.col(html).cast("string").alias("__html"))
    joined = rows.withColumn("__host", _host(url)).join(F.broadcast(known) if size <= broadcast_bytes else known, "__host", "left")

    def run(batches):
        loaded: dict[bytes, Plan] = {}
        for b in batches:
            out = []
            for page, blob in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if len(loaded) > 10_000:
                    loaded.clear()
                if blob is not None and blob not in loaded:
                    loaded[blob] = pickle.loads(blob)
                out.append(main_text(page or "", loaded[blob] if blob is not None else Plan()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                             names=[key, url, "text", "n_chars"])

    schema = rows.select(key, url).schema.add("text", "string").add("n_chars", "long")
    return joined.select(key, url, "__html", "__plan").mapInArrow(run, schema)
