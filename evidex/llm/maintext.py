"""Main text of stored pages: markup first, then differences to the nearest page of the host.

A page is read into lines, one per block of text. Lines inside menus, headers, footers, sidebars, forms,
notices, adverts, reader comments, scripts and styles go by their tags or names. Lines inside an article or
main element are kept; they are not differenced, as two pages may carry the same article. All other lines are
settled by page differencing: pages of a host with equal lines are one class, classes are ordered by host and path of
their first page, each is paired with the neighbour on its host whose path agrees longest, and lines that a longest common
subsequence aligns are template and go. So copies are answered alike, and a neighbour always differs. A class
without a neighbour on its host keeps what markup left.

On a page with an article, lines outside it that differencing leaves are kept if they are paragraphs (headings, items, quotations), if they are of
``PROSE`` characters or more, or if together they are longer than the article (which then is a teaser); other short text beside an article is a label.
A class or id rules an element out only if all its words are of boxes and of what is not the article (``share-buttons``, not ``share-price-report``).

Pages are parsed twice, so that whole texts are shuffled once: hashed lines find the template lines of each class, and packed
texts are joined to them. A host that has a third of all pages is many slices of the order.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.order import with_next
from evidex.session import stored

# --- fixed values: HTML's own element kinds, and names that pages give to what is not the article ---
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
                   "table tbody tfoot thead title tr ul".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video")
OUTSIDE = frozenset("nav aside footer form button select menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
                  "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond share "
                  "sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words that only say where or what kind of box something is.
LAYOUT = frozenset("area bar block bottom box button buttons container content footer head header inner item items left link links list main outer page panel right section site text top wrap wrapper".split())
#: Elements whose text is prose at any length; other text beside an article has to be of so many characters.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption".split())
PROSE = 40
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
                  r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _aside(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds nothing of the article."""
    if name in OUTSIDE or name == "header" and not inside:
        return True
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values)
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main") and any(_names_aside(v) for v in value.split()):
            return True
    return False


def _names_aside(value: str) -> bool:
    """Whether one class or id names what is not the article: with no other word in it that says something."""
    words = {w.lower() for w in _NAME.findall(value)}
    return bool(words & NAMES) and words <= NAMES | LAYOUT


def read_page(html: str) -> list[tuple[int, str]]:
    """Lines that markup does not rule out, in page order, and what they are: 1 the article's, 2 a paragraph outside one, 0 other text."""
    lines: list[tuple[int, str]] = []
    held: list[str] = []
    dropped: list[str] = []  # open elements since one that is not the article's, itself first
    depth, at, inner = 0, 0, ""

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append((1 if depth > 0 else 2 if inner in PARAGRAPHS else 0, text))

    for tag in _TAG.finditer(html):
        if not dropped:
            held.append(html[at:tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS and not dropped:
            flush()
            inner = "" if tag["close"] else name
        elif name in ("br", "td", "th") and not dropped:
            held.append(" ")
        main = name in ("article", "main")
        if tag["close"]:
            if dropped:
                if main and depth and name not in dropped:  # the article ends whatever was left open in it
                    dropped.clear()
                    depth -= 1
                elif name in dropped:
                    del dropped[len(dropped) - 1 - dropped[::-1].index(name):]
            elif main and depth:
                depth -= 1
        elif dropped:
            if main and not depth and not _aside(name, tag["attrs"], False):  # a menu that was never closed
                dropped.clear()
                depth += 1
            elif name in (dropped[0], "article", "main"):
                dropped.append(name)
        elif name not in VOID and not tag["attrs"].endswith("/") and _aside(name, tag["attrs"], depth > 0):
            dropped.append(name)
        elif main:
            depth += 1
    if not dropped:
        held.append(html[at:])
    flush()
    return lines


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which elements of ``a`` a longest common subsequence of ``a`` and ``b`` aligns.

    Equal ends are taken off; the rest is cut in two where forward and backward lengths add up best, so memory is
    linear, and lengths are found bit-parallel over ``b``.
    """
    out = [False] * len(a)

    def lengths(x: list[int], y: list[int]) -> int:
        """Bit vector whose zeros are the places of y where the common length with x grows."""
        at: dict[int, int] = {}
        for k, v in enumerate(y):
            at[v] = at.get(v, 0) | (1 << k)
        full = (1 << len(y)) - 1
        row = full
        for v in x:
            u = row & at.get(v, 0)
            row = ((row + u) | (row - u)) & full
        return row

    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out[i] = True
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out[j] = True
        if i == j or p == q:
            continue
        if j - i == 1:
            out[i] = a[i] in b[p:q]
            continue
        mid, n = (i + j) // 2, q - p
        ahead, behind = lengths(a[i:mid], b[p:q]), lengths(a[mid:j][::-1], b[p:q][::-1])
        bits = [np.frombuffer(bin((1 << n) | v)[3:].encode(), np.uint8)[::-1] == 48 for v in (ahead, behind)]
        total = np.append(0, np.cumsum(bits[0])) + np.append(0, np.cumsum(bits[1]))[::-1]
        best = p + int(np.argmax(total))
        todo += [(i, mid, p, best), (mid, j, best, q)]
    return out


def main_text(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, url, text``: the main text of every snapshot's whole ``body``.

    Blocks are joined by two line ends; white space inside a block is one blank; character references
    are decoded; nothing is capped. A null or empty body, or one without main text, gives an empty text. A null
    url is a host of its own without neighbours. Repeated rows are answered each. Other columns are not
    looked at.
    """
    kind = snapshots.schema["snapshot_id"].dataType.simpleString()
    place = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(place, r"^([^/?#]*)", 1))
    pages = snapshots.select("snapshot_id", F.col("url").cast("string"), F.col("body").cast("string"), host.alias("host"), F.regexp_extract(place, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    key = F.concat_ws("\u0001", "host", "path", F.lpad(F.coalesce(F.col("snapshot_id").cast("string"), F.lit("")), 20, "0")).alias("key")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [[hash_line(t) for kind, t in read_page(body) if kind != 1] if body else [] for body in batch["body"]]
            yield batch.drop(columns="body").assign(digest=[_digest(x) for x in lines], lines=lines)

    outside = (pages.filter("host <> ''").select("host", "path", "body", key)
               .mapInPandas(hashed, "host string, path string, key string, digest binary, lines array<long>").filter(F.size("lines") > 0))
    classes = stored(outside.groupBy("host", "digest").agg(F.min_by(F.struct("key", "path"), "key").alias("at"), F.any_value("lines").alias("lines"))
                     .select("host", "digest", "at.key", "at.path", "lines"), "page_classes")
    beside = with_next(classes, "key", [F.col("digest")], ["host", "path", "lines"], before="previous")

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = []
            for host, path, lines, *near in zip(batch["host"], batch["path"], batch["lines"], batch["previous"], batch["next"], strict=True):
                partners = [n for n in near if n is not None and n["host"] == host]
                partner = max(partners, key=lambda n: _agreement(path, n["path"]), default=None)
                gone.append(bytes(shared_lines(list(lines), list(partner["lines"]))) if partner is not None else None)
            yield batch[["host", "digest"]].assign(gone=gone)

    template = beside.select("host", "digest", "path", "lines", "previous", "next").mapInPandas(difference, "host string, digest binary, gone binary").filter("gone is not null")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            pages = [read_page(body) if body else [] for body in batch["body"]]
            yield batch.drop(columns="body").assign(own=[press.compress(json.dumps(p).encode()) for p in pages],
                                                    digest=[_digest([hash_line(t) for kind, t in p if kind != 1]) for p in pages])

    parsed = pages.select("snapshot_id", "url", "host", "body").mapInPandas(read, f"snapshot_id {kind}, url string, host string, own binary, digest binary")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = ["\n\n".join(_kept(json.loads(unpack(own)), gone)) for own, gone in zip(batch["own"], batch["gone"], strict=True)]
            yield pd.DataFrame({"snapshot_id": batch["snapshot_id"], "url": batch["url"], "text": texts})

    return parsed.join(template, ["host", "digest"], "left").select("snapshot_id", "url", "own", "gone").mapInPandas(settle, f"snapshot_id {kind}, url string, text string")


def _kept(lines: list[tuple[int, str]], gone: bytes | None) -> list[str]:
    """The lines of the article and those of the others that are no template and no labels beside the article."""
    flags = iter(gone or b"")
    left = [(kind, text) for kind, text in lines if kind == 1 or not next(flags, 0)]
    article = sum(len(text) for kind, text in left if kind == 1)
    teaser = sum(len(text) for kind, text in left if kind != 1) > article
    return [text for kind, text in left if kind or teaser or len(text) >= PROSE]


def _digest(lines: list[int]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(np.array(lines, np.int64).tobytes())


def hash_line(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _agreement(a: str, b: str) -> tuple[int, int]:
    """Path segments, then characters, that two paths share from the start."""
    x, y = a.split("/"), b.split("/")
    same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    chars = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return same, chars
