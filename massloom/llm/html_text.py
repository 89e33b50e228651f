"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.staging import release, stage
from massloom.llm.url_filter import host_of

#: Wrappers folded into one in one task; the folds are repeated until a host has one.
FOLD = 256
#: Bytes of all wrappers up to which they are broadcast; beyond, pages are joined to them by shuffle.
BROADCAST_BYTES = 16 << 20

# Element names and class words by their part on a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSED_BY = {
    "p": {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}
ASIDE = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video"}
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
MAIN = {"article", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@lru_cache(1 << 14)
def _signature(name: str, attributes: str) -> tuple[str, bool]:
    """(element with its first class or id, whether it is set aside from the main text by itself)."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(attributes)} if attributes.strip() else {}
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(found.get(k, ""))}
    aside = name in ASIDE or "hidden" in found or found.get("role", "").lower() in ASIDE_ROLES or (bool(words & ASIDE_WORDS) and name not in ("body", "html"))
    mark = (found.get("class", "").split() or found.get("id", "").split() or [""])[0]
    return f"{name}.{re.sub('[0-9]+', '0', mark)}" if mark else name, aside


def page_blocks(source: str) -> list[tuple[str, bool, str]]:
    """Blocks of text of a page in order: (path of elements, whether any is set aside, text)."""
    blocks: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool]] = []  # element, path to it, set aside
    text: list[str] = []

    def flush() -> None:
        words = " ".join("".join(text).split()) if text else ""
        text.clear()
        if words:
            _, path, aside = next((x for x in reversed(stack) if x[0] not in INLINE), ("", "", False))
            blocks.append((path, aside or any(x[2] for x in stack), words))

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            text.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in INLINE and any(x[0] not in INLINE for x in stack[i:]):
                        break  # an inline end does not close blocks
                    if text and name in INLINE and stack[i][2]:
                        flush()
                    del stack[i:]
                    break
            continue
        if name in VOID:
            continue
        while True:  # elements whose end is implied
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)
            if i < 0 or name not in CLOSED_BY.get(stack[i][0], ()):
                break
            del stack[i:]
        mark, aside = _signature(name, m[3])
        if aside and name in INLINE:
            flush()
        above = stack[-1] if stack else ("", "", False)
        if not m[3].rstrip().endswith("/"):
            stack.append((name, above[1] if name in INLINE else f"{above[1]}/{mark}", above[2] or aside))
    flush()
    return blocks


def main_path(path: str) -> bool:
    return any(p.partition(".")[0] in MAIN for p in path.split("/"))


# A wrapper is a list of slots [path, optional, repeated, pages, lowest text, highest text, characters, set aside]:
# the regular expression of the paths of a page's text blocks in order. Lowest = highest: the text is the template's own.
def page_wrapper(blocks: list[tuple[str, bool, str]]) -> list[list]:
    out: list[list] = []
    for path, aside, text in blocks:
        key = hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
        if out and out[-1][0] == path:
            last = out[-1]
            key = hashlib.blake2b((last[4] + key).encode(), digest_size=8).hexdigest()  # a run's texts in order
            last[2], last[4], last[5], last[6] = True, key, key, last[6] + len(text)
        else:
            out.append([path, False, False, 1, key, key, len(text), aside])
    return out


def align(x: list[list], y: list[list]) -> list[list]:
    """The wrapper of both: equal slots match; what only one has becomes optional."""
    a, b = [s[0] for s in x], [s[0] for s in y]
    if a == b:
        return [_both(s, t) for s, t in zip(x, y, strict=True)]
    out = []
    for _, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if a[i:j] == b[k:m]:
            out += [_both(s, t) for s, t in zip(x[i:j], y[k:m], strict=True)]
        else:
            out += [[s[0], True, *s[2:]] for s in (*x[i:j], *y[k:m])]
    return squash(out)


def squash(slots: list[list]) -> list[list]:
    """Neighbours with the same path become one repeated slot."""
    out: list[list] = []
    for s in slots:
        if out and out[-1][0] == s[0]:
            pages = max(out[-1][3], s[3])
            out[-1] = _both(out[-1], s)
            out[-1][2], out[-1][3] = True, pages
        else:
            out.append(s)
    return out


def _both(s: list, t: list) -> list:
    return [s[0], s[1] or t[1], s[2] or t[2], s[3] + t[3], min(s[4], t[4]), max(s[5], t[5]), s[6] + t[6], s[7] and t[7]]


def densest(parts: list[tuple[str, int]]) -> str:
    """The deepest element that holds nearly all of the characters of parts (path, characters); the one around it, if it is one block of text."""
    mass: dict[str, int] = {}
    own = {path for path, _ in parts}
    for path, n in parts:
        names = path.split("/")
        for k in range(2, len(names) + 1):
            mass["/".join(names[:k])] = mass.get("/".join(names[:k]), 0) + n
    if not mass:
        return ""
    most = max(mass.values())
    best = max((p for p, v in mass.items() if v >= 0.9 * most), key=lambda p: (p.count("/"), p))
    above = best.rpartition("/")[0]
    paragraph = best.rpartition("/")[2].partition(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td")
    if paragraph or (best in own and above.rpartition("/")[2].partition(".")[0] not in ("", "html", "body")):
        best = above
    return best


def below(path: str, element: str) -> bool:
    return path == element or path.startswith(element + "/")


def main_paths(wrapper: list[list]) -> tuple[list[str], list[str]]:
    """(paths of main text of the host's pages without an article or main element, paths of the template's own text).

    Main are those of the element whose own children have most text that varies between
    pages. Text is the template's own if it is equal on all of three or more pages that
    have it, on a host whose pages are not all equal.
    """
    slots = [s for s in wrapper if not s[7] and not main_path(s[0])]
    varied = [s for s in slots if s[4] != s[5] or s[3] < 3]
    if all(s[4] == s[5] for s in wrapper):
        varied = slots
    best = densest([(s[0], s[6]) for s in varied])
    paths = {s[0] for s in varied}
    return sorted(p for p in paths if below(p, best)), sorted({s[0] for s in slots} - paths)


def _page_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of a partition's pages, already aligned where host and paths are equal."""
    known: dict[tuple[str, tuple[str, ...]], list[list]] = {}

    def rows() -> pa.RecordBatch:
        hosts = [k[0] for k in known]
        found = [json.dumps(w) for w in known.values()]
        known.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = page_wrapper(page_blocks(source or ""))
            key = host, tuple(s[0] for s in w)
            known[key] = align(known[key], w) if key in known else w
        if len(known) > 10_000:
            yield rows()
    yield rows()


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    wrappers = sorted((json.loads(w) for w in group["wrapper"]), key=lambda w: (-sum(s[3] for s in w), json.dumps(w)))
    whole = wrappers[0]
    for w in wrappers[1:]:
        whole = align(whole, w)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(whole)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper a host from all pages (host, html): columns host, wrapper (JSON). Aligned in groups of about FOLD, round after round."""
    spark = pages.sparkSession
    now, path = stage(pages.select("host", "html").mapInArrow(_page_wrappers, "host string, wrapper string"), "html-wrappers")
    while (most := now.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // FOLD)
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(groups)) if groups > 1 else F.lit(0)
        after, after_path = stage(now.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(_fold, "host string, wrapper string"), "html-wrappers")
        release(spark, path)
        now, path = after, after_path
    return now


@lru_cache(4096)
def _main(wrapper: str) -> tuple[frozenset[str], frozenset[str]]:
    paths, template = main_paths(json.loads(wrapper))
    return frozenset(paths), frozenset(template)


def extract_text(source: str, wrapper: str) -> str:
    """Text in the page's own article or main element if it has one; else on the host's main paths; else in the page's own densest element."""
    learned, template = _main(wrapper)
    blocks = [(path, text) for path, aside, text in page_blocks(source) if not aside]
    found = [text for path, text in blocks if main_path(path)] or [text for path, text in blocks if path in learned]
    if not found and blocks:
        parts = [x for x in blocks if x[0] not in template] or blocks
        best = densest([(path, len(text)) for path, text in parts])
        found = [text for path, text in parts if below(path, best)] or [text for _, text in parts]
    return "\n".join(found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract_text(s or "", w or "[]") for s, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Two passes over the pages: wrappers are inferred for each host from all its pages, then
    each page's text is chosen by its own elements and the wrapper (see extract_text), so a
    page with a block that is not set aside is never without text. A br, like the start or end
    of any block element, ends a block. Null and empty html give an empty text; null urls and
    those without a host share one wrapper; repeated rows come out each. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = infer_wrappers(rows)
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
