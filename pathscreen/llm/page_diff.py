"""HTML main text by markup and nearest-URL page differencing.

Markup is cut into blocks, the lines of a page. Every page is paired with the page of the nearest URL path on its host that
marks an article as it does, or marks none as it does; the lines of both are aligned by longest common subsequence and the shared ones go. A check by markup follows: blocks in menus, headers,
footers, sidebars, forms, notices, adverts or comments go though no other page has them, and if the page marks its article, the
article's blocks are the text, also those that another page repeats.
"""
from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pathscreen.llm.common import pieces, text_key
from pathscreen.staging import stage

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_CUT = re.compile(r"<[a-zA-Z/!][^>]*\Z")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Elements of HTML by their use.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title", "head"}
AROUND = {"nav", "footer", "aside", "form", "menu", "dialog"}
CONTAINERS = {"html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "menu", "dialog", "ul", "ol", "dl", "table", "figure",
              "fieldset", "details", "center", "blockquote"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "tr", "td", "th", "caption", "figcaption", "address", "hr", "summary", "option",
                       "thead", "tbody", "tfoot", "legend", "hgroup", "search"}
SAYS_AROUND = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sidebar", "menu", "navbar", "navigation", "nav", "breadcrumb", "breadcrumbs", "cookie",
               "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "social", "related", "recommended", "comment", "comments", "disqus",
               "footer", "header", "masthead", "complementary", "contentinfo", "search", "pagination"}

#: Of these: names of matter that may hold articles of its own (cards, comments).
SECONDARY = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "related", "recommended",
             "comment", "comments", "disqus"}
#: Parts that a name of what surrounds an article can have besides; with any other part (has-sidebar, related-work) a name says nothing.
BESIDES = {"site", "page", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "box", "slot", "unit", "area", "block", "bar", "list", "links", "widget",
           "module", "section", "container", "wrapper", "wrap", "inner", "outer", "sticky", "fixed", "mobile", "desktop", "buttons", "wall", "overlay", "posts", "articles", "form", "item", "items",
           "icon", "button", "toggle", "link", "body", "text", "thread", "reply"}
TITLES = {"header", "masthead"}  # no surroundings within an article, as the element of that name
MAIN, OPEN, OUT = range(3)  # a block in the article, in neither the article nor surroundings, in surroundings
NO, NAME, CARDS, SURE = range(4)  # surroundings: none, by name, by the name of matter with articles of its own, by element or role


def _named(attributes: str) -> tuple[set[str], set[str]]:
    """(roles, tokens of class and id)."""
    roles: set[str] = set()
    names: set[str] = set()
    for kind, value in _NAMED.findall(attributes) if attributes else ():
        (roles if kind.lower() == "role" else names).update(value.strip("\"'").lower().split())
    return roles, names


def _around(roles: set[str], names: set[str], titles: bool) -> int:
    """What whole roles and names say; ``titles``: whether a header counts."""
    says = SAYS_AROUND if titles else SAYS_AROUND - TITLES
    if roles & says:
        return SURE
    found = NO
    for name in names:
        parts = {w for w in re.split(r"[^a-z]+", name) if w}
        if parts & says and parts <= says | BESIDES:
            found = max(found, CARDS if parts & SECONDARY else NAME)
    return found


def marked_lines(page: str) -> tuple[list[str], list[int], bool]:
    """(all blocks in page order, for each what the markup says of it: ``MAIN``, ``OPEN`` or ``OUT``, whether an article is marked).

    An article within surroundings that only a name tells is the article if no other is marked; if the name is that of cards or
    comments, only if the page has nothing else. ``OPEN`` blocks are outside of it and of all that surrounds it.
    """
    found: list[tuple[str, int | None, bool]] = []  # block, surroundings of the article it is in (None: in no article), whether it is surroundings itself
    marks: set[int] = set()
    held: list[str] = []
    stack: list[tuple[str, int | None, int]] = []  # container, surroundings of the article it is in (None: in no article), surroundings within that
    inside: int | None = None
    around, own = NO, False
    at = 0

    def end_block() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append((text, inside, bool(around or own)))

    cut = _CUT.search(page)
    size = cut.start() if cut else len(page)
    while at < size:
        m = _TAG.search(page, at, size)
        if m is None:
            held.append(page[at:size])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            if name == "head" or m[3].endswith("/"):
                continue  # its elements are raw themselves
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at, size)
            at = close.end() if close else size
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCKS:
            continue
        end_block()
        own = False
        if name not in CONTAINERS:
            own = not m[1] and _around(*_named(m[3]), False) > NO
        elif m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            inside, around = stack[-1][1:] if stack else (None, NO)
        elif not m[3].endswith("/"):
            roles, names = _named(m[3])
            if name in AROUND or name == "header" and inside is None:
                around = SURE
            elif name not in ("html", "body"):
                around = max(around, _around(roles, names, inside is None))
            if inside is None and around < SURE and (name in ("article", "main") or "main" in roles):
                # cards are articles, the main part of a page is none
                inside, around = NAME if around == CARDS and name != "article" else around, NO
                marks.add(inside)
            stack.append((name, inside, around))
    end_block()
    level = next((k for k in (NO, NAME) if k in marks), None)
    if level is None and CARDS in marks and all(out or at_ is not None for _, at_, out in found):
        level = CARDS
    said = [OUT if out else OPEN if at_ is None else MAIN if at_ == level else OUT for _, at_, out in found]
    return [text for text, _, _ in found], said, level is not None


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """(blocks of the article, blocks outside of it and of all that surrounds it, whether an article is marked); see ``marked_lines``."""
    texts, said, marked = marked_lines(page)
    return [t for t, k in zip(texts, said) if k == MAIN], [t for t, k in zip(texts, said) if k == OPEN], marked


def common(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    n, out = min(len(a), len(b)), set()
    first = next((i for i in range(n) if a[i] != b[i]), n)
    last = next((i for i in range(n - first) if a[-1 - i] != b[-1 - i]), n - first)
    out.update(range(first), range(len(a) - last, len(a)))
    where: dict = {}
    for j in range(first, len(b) - last):
        where.setdefault(b[j], []).append(j)
    ends, tails = [], []
    for i in range(first, len(a) - last):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(link)
            else:
                ends[k], tails[k] = j, link
    link = tails[-1] if tails else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _page_key() -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("n")), F.hex(text_key(F.col("url"))), F.hex(text_key(F.col("html"))))))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        out, marks = [], []
        for texts, _, marked in (marked_lines(p or "") for p in batch.column("html").to_pylist()):
            out.append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t in texts])
            marks.append(marked)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), pa.array(marks, pa.bool_()), batch.column("path"), pa.array(out, pa.list_(pa.int64()))],
                                         names=["key", "host", "marked", "path", "lines"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, at = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shard] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "shard", "at"])
        at += b.num_rows


def _alike(a: str, b: str | None) -> int:
    return -1 if b is None else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, gone = [], []
        for r in batch.to_pylist():
            before, after = _alike(r["path"], r["path_b"]), _alike(r["path"], r["path_a"])
            other = r["lines_b"] if before >= after else r["lines_a"]
            keys.append(r["key"])
            gone.append(sorted(common(r["lines"], other or [])))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int64()))], names=["key", "gone"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): the numbers of the lines of each page, surroundings and article alike, that the nearest page of its host and kind shares.

    The pages of a host that mark an article and those that mark none are two kinds: their layouts differ. Pages are numbered in the order of host, kind and path by ranges, so a host of any size is spread; each meets the page before
    and the page after it by number and is aligned with the one whose path has more in common with its own.
    """
    host, path = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    open_ = pages.where(F.col("html").isNotNull() & F.col("url").isNotNull())
    rows = open_.select(_page_key().alias("key"), host.alias("host"), path.alias("path"), "html").where("host != ''")
    rows = stage(rows.mapInArrow(_lines, "key binary, host string, marked boolean, path string, lines array<long>").where(F.size("lines") > 0).dropDuplicates(["key"]))
    spread = rows.repartitionByRange("host", "marked", "path", "key").sortWithinPartitions("host", "marked", "path", "key")
    placed = stage(spread.mapInArrow(_numbered, "key binary, host string, marked boolean, path string, lines array<long>, shard int, at long"))
    base = placed.groupBy("shard").agg(F.count("*").alias("n"))
    base = base.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # one row per shard
    placed = placed.join(base, "shard").withColumn("at", F.col("at") + F.col("base")).select("key", "host", "marked", "path", "lines", "at")

    def near(step: int, name: str) -> DataFrame:
        return placed.select((F.col("at") + step).alias("at"), F.col("host").alias(f"host_{name}"), F.col("marked").alias(f"marked_{name}"), F.col("path").alias(f"path_{name}"), F.col("lines").alias(f"lines_{name}"))

    met = placed.join(near(1, "b"), "at", "left").join(near(-1, "a"), "at", "left")
    same = {n: F.col(f"host_{n}").eqNullSafe(F.col("host")) & F.col(f"marked_{n}").eqNullSafe(F.col("marked")) for n in "ba"}
    met = met.select("key", "path", "lines", *(F.when(same[n], F.col(f"{c}_{n}")).alias(f"{c}_{n}") for n in "ba" for c in ("path", "lines")))
    return met.mapInArrow(_shared, "key binary, gone array<long>").where(F.size("gone") > 0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts, shared, repeated, restored = [], [], [], []
        for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines, said, marked = marked_lines(page or "")
            drop = set(gone or ())
            # differencing leaves the lines that the nearest page lacks; the check by markup takes out what surrounds and gives back a marked article
            kept = [i for i, k in enumerate(said) if (k == MAIN if marked else k == OPEN and i not in drop)]
            texts.append("\n\n".join(lines[i] for i in kept))
            shared.append(0 if marked else sum(said[i] == OPEN for i in drop))
            repeated.append(len(drop))
            restored.append(len(drop.intersection(kept)))
        columns = [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], shared, repeated, restored))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_shared", "n_repeated", "n_restored"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that only differencing took out), n_repeated (lines that the nearest page has
    too), n_restored (of these, lines of a marked article, which stay) of every row of ``pages(page_id, url, html)``.

    Null or empty html: the empty text. Null urls and urls without a host: no pair, nothing is taken out as shared. Repeated rows
    get equal results and are not paired with each other; paths that tie go by the page's hash; an empty table gives
    an empty result; other columns are not read. Runs jobs.
    """
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    gone = stage(shared_lines(plain)).withColumnRenamed("key", "_key")
    rows = plain.withColumn("key", _page_key()).join(gone, F.col("key") == F.col("_key"), "left").select("page_id", "url", "html", "gone")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_repeated long, n_restored long")
