"""HTML extraction by nearest-URL page differencing (operator 10).

Pages are read into text lines, one per block element, each with what its markup says about it: cut
(inside a menu, header, footer, sidebar, notice, advert, form, script, style or comment list), main
(inside the article) or neither. Pages of a host are ordered by URL path; every page is aligned with
its nearest neighbour there (longest common path, then least distance) by longest common
subsequence of lines, and the lines both share are deleted: what a site prints on every page goes,
whatever its markup. A neighbour that shares every line a page would keep is a copy of it and the
next nearest is taken; where only copies are near, pages of equal lines count once and the nearest
other page is found beyond them. Lines of a marked article are the page's own even where a neighbour
repeats them.

Only 64-bit hashes of lines are ordered and compared; the lines themselves go through one shuffle to
meet the verdict. Pages meet in blocks of bounded size that overlap, so a host may be any size.

The text is the kept lines of the article if the page marks one, else all kept lines, in page order.

Results: null or empty html gives an empty text. A null url is a host of its own without neighbours'
paths. Equal rows get equal results. Markup that is cut off or left open counts as closed at the end.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.ordering import gathered, overlapping_blocks, ranked, runs
from graphloom.session import materialize

BLOCK = 512
WINDOW = 4

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not markup: it ends at their own end tag only.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
_CUT_TAGS = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg",
    "canvas", "object", "audio", "video", "dialog", "menu", "title", "map", "datalist", "fieldset", "xmp",
}
_CUT_NAMES = {
    "nav", "navbar", "navigation", "menu", "header", "masthead", "topbar", "footer", "sidebar", "side", "aside", "cookie", "cookies", "consent", "gdpr",
    "notice", "alert", "banner", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "comment", "comments", "disqus", "replies", "reply", "respond", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "related", "newsletter",
    "subscribe", "subscription", "popup", "modal", "overlay", "widget", "pagination", "pager", "skip", "login", "signup", "search", "toolbar",
}
_CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "note"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"html", "body", "article", "main", "section", "div", "nav", "aside", "footer", "header", "form", "ul", "ol", "dl", "table", "blockquote", "td", "th"}
_NAME_PARTS = re.compile(r"[a-z]+")


def _cut(tag: str, attributes: str, in_main: bool) -> int:
    """2 if the element is never text of the page, 1 if its names say so, else 0."""
    if tag in _CUT_TAGS or tag == "header" and not in_main:
        return 2
    if not attributes.strip() or tag in ("html", "body", "main"):
        return 0
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
        return 2
    if values.get("role") in _CUT_ROLES:
        return 2
    return int(any(part in _CUT_NAMES for name in ("class", "id") for part in _NAME_PARTS.findall(values.get(name, ""))))


def _is_main(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or bool(attributes) and bool(re.search(r"""role\s*=\s*["']?main\b|articleBody""", attributes))


def page_lines(html: str) -> list[tuple[str, bool, bool]]:
    """(line, cut, main) of each text block in page order."""
    lines: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, cut, main; both hold for what is inside
    seen_main = False

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, cut, main = stack[-1] if stack else ("", 0, False)
            lines.append((text, cut > 0, main))

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at = 0
    end = len(html)
    while at < end:
        found = _TAG.search(html, at)
        if found is None:
            parts.append(unescape(html[at:]))
            break
        if found.start() > at:
            parts.append(unescape(html[at : found.start()]))
        at = found.end()
        if found[2] is None:  # a comment or declaration
            continue
        tag, attributes = found[2].lower(), found[3]
        if found[1]:
            if tag in _INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if stack[i][1] != (stack[i - 1][1] if i else 0):
                            flush()
                        if i == len(stack) - 1:
                            stack.pop()
                        break
                    if stack[i][0] in _SCOPES:
                        break
                continue
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        inline = tag in _INLINE
        _, cut, main = stack[-1] if stack else ("", 0, False)
        if tag == "br":
            parts.append(" ")
            continue
        if not inline:
            flush()
            closing = _CLOSED_BY.get(tag, set()) if tag in _CLOSED_BY else {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    close(i)
                    break
                if stack[i][0] in _SCOPES and stack[i][0] not in closing:
                    break
            _, cut, main = stack[-1] if stack else ("", 0, False)
        if tag in _VOID:
            continue
        own_main = _is_main(tag, attributes)
        if own_main and cut == 1 and not seen_main:
            cut = 0  # the first article of a page lies in a wrapper whose name only sounds like a sidebar
        own_cut = cut or _cut(tag, attributes, main)
        seen_main |= own_main and not own_cut
        if own_cut != (stack[-1][1] if stack else 0):
            flush()
        if tag in _RAW:
            finish = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(html, at)
            if tag == "textarea" or not own_cut:
                parts.append(unescape(html[at : finish.start()]) if not own_cut else "")
            at = finish.end()
            continue
        if attributes.rstrip().endswith("/") and tag not in _SCOPES and not inline:
            continue
        stack.append((tag, own_cut, main or (own_main and not own_cut)))
    flush()
    return lines


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _row_lengths(ours: list[int], theirs: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``ours`` with each prefix of ``theirs``.

    One integer holds a row of the length table, a bit per line of ``theirs`` (0 where the length
    goes up), so a line of ours costs a few operations on whole integers (Hyyrö, 2004).
    """
    n = len(theirs)
    places: dict[int, list[int]] = defaultdict(list)
    for j, line in enumerate(theirs):
        places[line].append(j)
    wide: dict[int, int] = {}  # of lines that stand often; others are built when they are met
    every = (1 << n) - 1
    row = every
    for line in ours:
        where = places.get(line)
        if where is None:
            continue
        mask = wide.get(line)
        if mask is None:
            bits = bytearray((n + 7) // 8)
            for j in where:
                bits[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(bits, "little")
            if len(where) > 64:
                wide[line] = mask
        up = row & mask
        row = ((row + up) | (row - up)) & every
    bits = np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8)
    rises = 1 - np.unpackbits(bits, bitorder="little")[:n].astype(np.int64)
    return np.concatenate([[0], np.cumsum(rises)])


def common_lines(ours: list[int], theirs: list[int]) -> list[int]:
    """Positions of ``ours`` in a longest common subsequence with ``theirs``.

    Equal ends are matched first. The middle is halved, and the other side is cut where the lengths
    of both halves add up to most (Hirschberg, 1975), so memory is linear in the lines.
    """
    found: list[int] = []
    todo = [(0, len(ours), 0, len(theirs))]
    while todo:
        low, high, begin, end = todo.pop()
        while low < high and begin < end and ours[low] == theirs[begin]:
            found.append(low)
            low, begin = low + 1, begin + 1
        while low < high and begin < end and ours[high - 1] == theirs[end - 1]:
            high, end = high - 1, end - 1
            found.append(high)
        if low == high or begin == end:
            continue
        if high - low == 1:
            if ours[low] in theirs[begin:end]:
                found.append(low)
            continue
        middle = (low + high) // 2
        before = _row_lengths(ours[low:middle], theirs[begin:end])
        after = _row_lengths(ours[middle:high][::-1], theirs[begin:end][::-1])[::-1]
        cut = begin + int(np.argmax(before + after))
        todo += [(low, middle, begin, cut), (middle, high, cut, end)]
    return sorted(found)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def parsed(pages: DataFrame, with_lines: bool) -> DataFrame:
    """(rk, site, path, lines or hashes, cut, main) of every page; rk numbers its content."""
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("rk"), *_site_and_path(), "html")
    name, kind = ("lines", pa.string()) if with_lines else ("hashes", pa.int64())

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {name: [], "cut": [], "main": []}
            for html in batch.column("html"):
                lines = page_lines(html.as_py() or "")
                out[name].append([line if with_lines else line_hash(line) for line, _, _ in lines])
                out["cut"].append([cut for _, cut, _ in lines])
                out["main"].append([main for _, _, main in lines])
            places = ["rk", "site", "path"]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(places).columns, pa.array(out[name], pa.list_(kind)), pa.array(out["cut"], pa.list_(pa.bool_())), pa.array(out["main"], pa.list_(pa.bool_()))], [*places, *out]
            )

    lists = f"{name} array<{'string' if with_lines else 'long'}>, cut array<boolean>, main array<boolean>"
    return keyed.mapInArrow(run, f"rk long, site string, path string, {lists}")


def _site_and_path() -> tuple:
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(F.col("url").isNotNull(), host).alias("site"), path.alias("path")


def shared_lines(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rk, shared): positions of the lines every page shares with its nearest neighbour."""
    return _shared(materialize(parsed(pages, False)), window)


def _shared(rows: DataFrame, window: int) -> DataFrame:
    """``shared_lines`` of parsed rows (rk, site, path, hashes, cut, main)."""
    once = rows.groupBy("rk").agg(*[F.any_value(c).alias(c) for c in ("site", "path", "hashes", "cut", "main")])
    own_lines = F.expr("filter(hashes, (h, i) -> not cut[i] and (main[i] or not exists(main, m -> m)))")
    order = ranked(once.withColumn("own_key", F.xxhash64(own_lines)), "site", "path")
    first = materialize(_compared(order, window))
    among_copies = first.filter("among_copies")
    if not among_copies.take(1):
        return first.select("rk", "shared")
    there = order.drop("rank").join(among_copies.select("site").distinct(), "site", "left_semi")
    once = there.groupBy("site", "own_key").agg(F.min(F.struct("path", "rk")).alias("least")).select("least.rk")
    distinct = there.join(once, "rk", "left_semi")
    # Pages of equal own lines keep the same of them, wherever these stand.
    verdict = materialize(_compared(ranked(distinct, "site", "path"), window).select("site", "own_key", F.col("shared_own").alias("found")))
    settled = among_copies.drop("shared").join(verdict, ["site", "own_key"]).select("rk", F.expr("transform(found, k -> own[k])").alias("shared"))
    return first.filter("not among_copies").select("rk", "shared").unionByName(settled)


def _compared(order: DataFrame, window: int) -> DataFrame:
    """(rk, site, own_key, shared, among_copies, own, shared_own): every page next to its nearest
    neighbour that is no copy; ``among_copies`` if there is none near an unmarked page. ``own`` are
    then the positions of its own lines, ``shared_own`` the places of the shared ones among its own."""

    def run(batches):
        for group in runs(batches, ["block"]):
            rows = group.to_pylist()
            for i, row in enumerate(rows):
                if not row["host"]:
                    continue
                near = []
                for j in (*range(i - 1, max(-1, i - 1 - window), -1), *range(i + 1, min(len(rows), i + 1 + window))):
                    other = rows[j]
                    if row["site"] is not None and other["site"] == row["site"] and abs(other["rank"] - row["rank"]) <= window:
                        near.append((-_prefix(row["path"], other["path"]), abs(j - i), j))
                marked = any(row["main"])
                own = [k for k, (cut, main) in enumerate(zip(row["cut"], row["main"])) if not cut and (main or not marked)]
                shared: list[int] = []
                among_copies = bool(near and own and not marked)
                for _, _, j in sorted(near):
                    found = common_lines(row["hashes"], rows[j]["hashes"])
                    if not own or not set(own) <= set(found):
                        shared, among_copies = found, False
                        break
                both = set(shared)
                columns = [
                    pa.array([row["rk"]], pa.int64()), pa.array([row["site"]], pa.string()), pa.array([row["own_key"]], pa.int64()),
                    pa.array([shared], pa.list_(pa.int32())), pa.array([among_copies]), pa.array([own if among_copies else None], pa.list_(pa.int32())),
                    pa.array([[k for k, at in enumerate(own) if at in both]], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["rk", "site", "own_key", "shared", "among_copies", "own", "shared_own"])

    dealt = gathered(overlapping_blocks(order, BLOCK, window, before=True), ["block"], ["rank"])
    return dealt.mapInArrow(run, "rk long, site string, own_key long, shared array<int>, among_copies boolean, own array<int>, shared_own array<int>")


def extract(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of ``pages`` (page_id, url, html).

    Every page is compared with its nearest neighbour: ``n_shared`` lines it shares with it. Those are
    deleted but for the lines of a marked article, which stay. Pages are parsed once for the hashes of
    their lines and once for the lines themselves, which are written nowhere and travel packed.
    """
    rows = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("rk"), "html")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def read(batches):
        for batch in batches:
            packed, places = [], []
            for html in batch.column("html"):
                found = page_lines(html.as_py() or "")
                marked = any(main for _, _, main in found)
                own = [i for i, (_, cut, main) in enumerate(found) if not cut and (main or not marked)]
                packed.append(zlib.compress(json.dumps([found[i][0] for i in own], ensure_ascii=False).encode(), 6))
                places.append(None if marked else own)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["page_id", "url", "rk"]).columns, pa.array(packed, pa.binary()), pa.array(places, pa.list_(pa.int32()))],
                ["page_id", "url", "rk", "packed", "own"],
            )

    def finish(batches):
        for batch in batches:
            text = []
            for packed, own, shared in zip(batch.column("packed"), batch.column("own").to_pylist(), batch.column("shared").to_pylist()):
                lines = json.loads(zlib.decompress(packed.as_py()))
                gone = set(shared or ()) if own is not None else ()
                text.append(" ".join([line for line, k in zip(lines, own) if k not in gone] if gone else lines))
            shared = batch.column("shared")
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["page_id", "url"]).columns, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                 pa.array([0 if s is None else len(s) for s in shared.to_pylist()], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_shared"],
            )

    shared = materialize(shared_lines(pages, window).withColumnRenamed("rk", "r"))
    lines = rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, rk long, packed binary, own array<int>")
    return lines.join(shared, F.expr("rk = r"), "left").select("page_id", "url", "packed", "own", "shared").mapInArrow(
        finish, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_shared long"
    )
