"""Main text of web pages: nearest-URL page differencing, guided by markup.

Every page is differenced. The pages of a host are ordered by URL path, id and content, and neighbours that are copies of
each other (their common lines hold more than COPY of the longer one's text) form a run. A page's candidates are the
last page of the run before and the first of the run after its own, so copies are walked past whatever their number; the
candidate whose path shares the longest beginning comes first (the one before, if both do), and the first that is no
copy of the page is its partner. The two pages' text lines (blocks) are aligned by a longest common subsequence.

Shared lines are deleted, guided by markup: lines inside elements or classes that hold no article (menus, adverts, forms
and so on) go also where they are not shared, as they differ from page to page, and where a page marks its article or
main element its text is that element's, shared or not. A page alone on its host, or among copies only, has no partner.

Only signatures (hashes and lengths of lines) are sorted and compared, in ranges of the order, so a host of any size is
spread over tasks. What a range cannot know, the runs that go on at its edges, is settled from one row a range; so the
partner, and the text, is the same however the pages are partitioned.

Defined cases: null html gives the empty text, also an empty table an empty one. A null URL counts as the empty one. Rows
are pages of their own, also when they repeat. Texts are whole, however long; a page is held in memory by one task. Other
columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, balanced, frame, rows, texts_of, unframe

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")

# HTML element names by role, and words in class names, ids and roles that mark what is no article.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "link", "mark", "meta", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OUT = {"head", "nav", "footer", "aside", "button", "select", "option", "datalist", "dialog", "menu", "object", "embed", "canvas", "audio", "video", "fieldset", "label", "input", "map"}
OUT_WORDS = {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner", "banners",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "disclaimer",
    "sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations", "trending", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "nav", "navbar", "navigation", "menu", "menubar", "topbar", "toolbar", "masthead", "header", "footer", "copyright", "legal", "login", "search", "searchbox", "skip",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "reviews", "form", "feedback",
}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: First words of class names that describe the page around an element, as in has-sidebar.
ABOUT = {"has", "with", "no", "not", "without", "is", "js"}
#: Elements that never hold an article: one that is open when an article begins was not closed.
NEVER = {"nav", "header", "menu", "footer"}
MAIN_WORDS = {"article", "story", "post", "entry", "content", "main", "body", "page", "text"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Two pages whose common lines hold more than this share of the longer one's text are copies.
COPY = 0.5
#: Equal pairs of lines from which alignments are split in two rather than listed.
PAIRS = 1 << 20


class Block:
    """out: 2 in what holds no article, 1 in a form only, 0 elsewhere."""

    __slots__ = ("text", "out", "main", "linked")

    def __init__(self, text: str, out: int, main: int, linked: float):
        self.text, self.out, self.main, self.linked = text, out, main, linked


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _words(name: str) -> list[list[str]]:
    """Of each class or id its words."""
    return [[w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", x).lower()) if w] for x in name.split()]


def _role(tag: str, raw: str, in_main: bool) -> tuple[bool, int]:
    """Whether the element holds no article, and its rank as the article: 2 article, 1 main, 0 neither."""
    a = _attributes(raw)
    if tag in OUT or tag == "header" and not in_main or "hidden" in a or a.get("role") in OUT_ROLES or "display:none" in a.get("style", "").replace(" ", ""):
        return True, 0
    if tag not in ("html", "body", "article", "main"):
        for words in _words(f"{a.get('class', '')} {a.get('id', '')}"):
            marks = OUT_WORDS & set(words) if words and words[0] not in ABOUT else set()
            if marks - {"header"} or marks and not MAIN_WORDS & set(words) and not in_main:
                return True, 0
    elif tag == "article" and any(OUT_WORDS & set(w) for w in _words(a.get("class", ""))):
        return True, 0
    if tag == "article" or a.get("itemprop") == "articlebody" or a.get("role") == "article":
        return False, 2
    return False, int(tag == "main" or a.get("role") == "main")


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed, without empty ones."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # name, holds no article, rank
    outs = mains = tops = links = forms = 0
    text: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                found.append(Block(whole, 2 if outs else min(forms, 1), 2 if mains else 1 if tops else 0, linked / max(1, sum(map(len, text)))))
            text.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if links else 0

    def leave(name: str) -> None:
        """Closes the innermost open element of that name and all in it, if there is one."""
        nonlocal outs, mains, tops, links, forms
        if any(n == name for n, _, _ in stack):
            n = None
            while n != name:
                n, out, rank = stack.pop()
                outs, mains, tops, links, forms = outs - out, mains - (rank == 2), tops - (rank == 1), links - (n == "a"), forms - (n == "form")

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW and not closing:
            if name not in INLINE:
                end()
            close = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(html, at)
            at = close.end() if close and not raw.rstrip().endswith("/") else at if raw.rstrip().endswith("/") else size
            continue
        if name == "br":
            add("\n")
            continue
        if name in INLINE and (name in VOID or name not in ("a", "span")):
            continue
        if name not in INLINE:
            end()
        if name in VOID:
            continue
        if closing:
            leave(name)
        elif not raw.endswith("/") or name == "a":
            if name in ("p", "li") and stack and stack[-1][0] == name:
                leave(name)  # left open
            if name in ("article", "main"):
                for never in NEVER:
                    leave(never)
            out, rank = _role(name, raw, mains + tops > 0)
            stack.append((name, out, rank))
            outs, mains, tops, links, forms = outs + out, mains + (rank == 2), tops + (rank == 1), links + (name == "a"), forms + (name == "form")
    end()
    return found


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a and each beginning of b, by one big number of a bit per line of b."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    zeros = ~np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little", count=len(b)).astype(bool)
    return np.concatenate([[0], np.cumsum(zeros)])


def align(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    places: dict = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    if len(a) > 1 and sum(len(places.get(x, ())) for x in a) > PAIRS:  # lines that repeat: split where both halves' lengths add up to the most
        mid = len(a) // 2
        cut = int((_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return align(a[:mid], b[:cut]) + [mid + i for i in align(a[mid:], b[cut:])]
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):  # from the last place to the first, so that a line is used once
            k = bisect.bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            elif j < tails[k]:
                tails[k], links[k] = j, link
    node, out = links[-1] if links else None, []
    while node:
        i, node = node
        out.append(i)
    return out[::-1]


@dataclass
class Lines:
    """What differencing needs of a page: its place and the hashes and lengths of its lines, runs of equal lines as one."""

    host: str
    path: str
    hashes: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, host: str, path: str, lines: list[str]) -> Lines:
        return cls(host, path, np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], "<u8"), np.array([len(x) for x in lines], "<u4"))

    def __post_init__(self):
        self.first = np.flatnonzero(np.concatenate([[True], self.hashes[1:] != self.hashes[:-1]])) if len(self.hashes) else np.zeros(0, np.int64)
        self.keys = self.hashes[self.first].tolist()

    def dumps(self) -> bytes:
        return frame([self.host.encode("utf-8", "surrogatepass"), self.path.encode("utf-8", "surrogatepass"), self.hashes.tobytes(), self.sizes.tobytes()])

    @classmethod
    def loads(cls, b: bytes | None) -> Lines | None:
        if not b:
            return None
        host, path, hashes, sizes = unframe(b)
        return cls(host.decode("utf-8", "surrogatepass"), path.decode("utf-8", "surrogatepass"), np.frombuffer(hashes, "<u8"), np.frombuffer(sizes, "<u4"))

    def shared(self, other: Lines) -> tuple[list[int], bool]:
        """Places of the lines aligned with the other page's, and whether the pages are copies."""
        if self.keys == other.keys:
            found = list(range(len(self.keys)))
        else:
            found = align(self.keys, other.keys)
        size = lambda p: int(p.sizes[p.first].astype(np.int64).sum())
        ends = np.append(self.first, len(self.hashes))
        both = int(self.sizes[self.first[found]].astype(np.int64).sum()) if found else 0
        copy = both > COPY * max(size(self), size(other)) or self.keys == other.keys
        return [i for k in found for i in range(ends[k], ends[k + 1])], copy

    def copies(self, other: Lines) -> bool:
        return self.host == other.host and self.shared(other)[1]

    def alike(self, other: Lines) -> int:
        n = 0
        for x, y in zip(self.path, other.path):
            if x != y:
                break
            n += 1
        return n


def partner_lines(page: Lines, before: Lines | None, after: Lines | None) -> list[int]:
    """The lines that the page shares with its partner, given its candidates."""
    for other in sorted((x for x in (before, after) if x is not None and x.host == page.host), key=lambda x: -page.alike(x)):
        found, copy = page.shared(other)
        if not copy:
            return found
    return []


class Page:
    def __init__(self, html: str | None):
        self.blocks = blocks(html or "")
        self.lines = [b.text for b in self.blocks]


def main_text(page: Page, drops: list[int] | None = None) -> str:
    """The page's text, given the lines that it shares with its partner."""
    left = [i for i, b in enumerate(page.blocks) if not b.out]
    inside = [i for i, b in enumerate(page.blocks) if b.out == 1]
    if not left and any(page.lines[i].count(" ") >= 9 for i in inside):  # some sites put a whole page, prose and all, into one form
        left = inside
    best = max((page.blocks[i].main for i in left), default=0)
    if best:
        return " ".join(page.lines[i] for i in left if page.blocks[i].main == best)
    gone = set(drops or ())
    return " ".join(page.lines[i] for i in left if page.blocks[i].linked < 0.6 and i not in gone)


def _sign(batches):
    for batch in batches:
        host, path, html = (texts_of(batch.column(batch.schema.names.index(c))) for c in ("host", "path", "html"))
        made = [Lines.of(h, p, [b.text for b in blocks(x)]).dumps() for h, p, x in zip(host, path, html)]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in ("host", "path", "id", "digest")), pa.array(made, pa.binary())], names=["host", "path", "id", "digest", "lines"])


def _runs(batches):
    """Over a sorted range: drops of the pages whose candidates lie in it (kind 1), the pages of its first and last run
    (kind 2, for edge 0, 1 or, where both are one run, 2), and one row (kind 0) of its first page, last page, first page
    of the second run and last page of the last but one."""
    part = TaskContext.get().partitionId()
    first = second = last = before_last = None  # before_last: the last page of the run before the current one
    run: list[tuple] = []
    number = 0
    names = ["kind", "part", "edge", "id", "digest", "drops", "payload"]

    def batch(rows_: list[tuple]):
        columns = list(zip(*rows_))
        kinds = (pa.int32(), pa.int32(), pa.int32(), id_type, pa.binary(), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    def settled(after: Lines):
        """Rows of the run that ended before the page `after`."""
        for id_, digest, page in run:
            if number == 1:
                yield 2, part, 0, id_, digest, None, page.dumps()
            elif drops := partner_lines(page, before_last, after):
                yield 1, part, None, id_, digest, drops, None

    id_type = None
    for b in batches:
        id_type = b.schema.field("id").type
        out = []
        for id_, digest, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            page = Lines.loads(raw)
            if last is None or not page.copies(last):
                if last is not None:
                    out.extend(settled(page))
                    before_last = last
                    second = second or page
                first = first or page
                run, number = [], number + 1
            run.append((id_, digest, page))
            last = page
        if out:
            yield batch(out)
    if last is not None:
        edge = 1 if number > 1 else 2
        for s in range(0, len(run), 4_096):
            yield batch([(2, part, edge, id_, digest, None, page.dumps()) for id_, digest, page in run[s : s + 4_096]])
        yield batch([(0, part, number, None, None, None, frame([x.dumps() if x is not None else b"" for x in (first, last, second, before_last)]))])


def _edges(batches):
    """From one row a range, in order: for each range and edge (0 first run, 1 last run, 2 the only one) the candidates."""
    got = []
    for b in batches:
        got += [(part, n, [Lines.loads(x) for x in unframe(p)]) for part, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
    got.sort(key=lambda x: x[0])
    left: list[Lines | None] = []  # candidate before the first run of each range
    for i, (_, _, (first, *_rest)) in enumerate(got):
        if not i:
            left.append(None)
            continue
        _, n, (_, last, _, before_last) = got[i - 1]
        left.append(last if not first.copies(last) else before_last if n > 1 else left[-1])
    right: list[Lines | None] = [None] * len(got)  # candidate after the last run of each range
    for i in range(len(got) - 2, -1, -1):
        _, n, (first, _, second, _) = got[i + 1]
        right[i] = first if not first.copies(got[i][2][1]) else second if n > 1 else right[i + 1]
    out: dict = {"part": [], "edge": [], "before": [], "after": []}
    for (part, n, (_, _, second, before_last)), l, r in zip(got, left, right):
        for edge, x, y in ((2, l, r),) if n == 1 else ((0, l, second), (1, before_last, r)):
            for name, v in zip(out, (part, edge, x.dumps() if x else b"", y.dumps() if y else b"")):
                out[name].append(v)
    if out["part"]:
        yield rows("part int, edge int, before binary, after binary", out)


def _settle(batches):
    for b in batches:
        c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names) if n != "id"}
        drops = [partner_lines(*(Lines.loads(x) for x in x3)) for x3 in zip(c["payload"], c["before"], c["after"])]
        keep = [i for i, d in enumerate(drops) if d]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array([drops[i] for i in keep], pa.list_(pa.int32()))], names=["id", "digest", "drops"])


def shared_lines(keyed: DataFrame) -> DataFrame:
    """keyed(host, path, id, digest, html) to (id, digest, drops): places of the lines that a page shares with its partner, if there are any."""
    kind = keyed.schema["id"].dataType.simpleString()
    signed = balanced(keyed.select("host", "path", "id", "digest", "html")).mapInArrow(_sign, f"host string, path string, id {kind}, digest binary, lines binary")
    order = ["host", "path", "id", "digest"]
    ranged = signed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "digest", "lines")
    found = Kept(ranged.mapInArrow(_runs, f"kind int, part int, edge int, id {kind}, digest binary, drops array<int>, payload binary"), "page-runs").df
    edges = found.where("kind = 0").select("part", "edge", "payload").repartition(1).mapInArrow(_edges, "part int, edge int, before binary, after binary")  # a row a range
    asked = found.where("kind = 2").join(edges, ["part", "edge"]).select("id", "digest", "payload", "before", "after")
    drops = found.where("kind = 1").select("id", "digest", "drops").union(asked.mapInArrow(_settle, f"id {kind}, digest binary, drops array<int>"))
    return drops.groupBy("id", "digest").agg(F.first("drops").alias("drops"))  # rows that repeat have the same


def _extract(batches):
    for b in batches:
        texts = [main_text(Page(h), d) for h, d in zip(texts_of(b.column(2)), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    source = df.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    address = F.coalesce("url", F.lit(""))
    digest = F.unhex(F.md5(F.concat(address, F.lit("\n"), F.coalesce("html", F.lit("")))))
    host, path = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    keyed = source.withColumn("digest", digest)
    drops = shared_lines(keyed.withColumn("host", host).withColumn("path", path)).withColumnsRenamed({"id": "_id", "digest": "_digest"})
    kind = source.schema["id"].dataType.simpleString()
    joined = keyed.join(drops.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("id", "url", "html", "drops").mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
