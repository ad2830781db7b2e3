"""Main text of web pages by wrappers: union-free regular expressions over token streams, inferred per host.

A page becomes a stream of tag and text tokens, nested by the tags. Streams of one host are aligned one after the other, level by
level: texts that differ become a text slot, tokens that only one side has become optional, tokens or groups that follow
themselves become repeated. What results is the host's wrapper. Pages of equal structure are summed up first, wherever they are,
and structures are aligned in their own order, so a host with a third of all pages is no task of its own and the result does not
depend on how pages are dealt. Each text slot of the wrapper is then judged once, by what the alignment shows over all pages
(whether the text changes, how much of it is links, which part of the host's prose its element holds) with the element's name
and class as a prior. A page is read by the verdicts of its slots alone.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Total bytes of wrappers up to which they are sent to all tasks; beyond, pages are joined to them by host.
BROADCAST_BYTES = 32 << 20
#: Longest group of tokens that is looked for as a repeated group.
PERIOD = 3
#: Different pages that must have the same text in a slot, and no other, for it to count as part of the template.
STEADY = 8
#: Texts up to this length are kept as they are, longer ones as a hash.
SHOWN = 200
#: Elements nested more deeply are siblings.
DEPTH = 100
#: Comparisons of two lists of tokens beyond which they are aligned by symbol, whatever the order.
CELLS = 1 << 18
#: Structures of pages that a task holds; more are sent on and summed up later.
HELD = 2000
#: An element that holds more than this share of the host's prose is not aside for its class; one with more than this share of links is a menu.
MOST, LINKS = 0.5, 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|iframe|svg|math|object|textarea|title)\b[^>]*>.*?(?:</\1[^>]*>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|$)|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends open elements of these names, up to the next of those in _HOLDS.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table body article main section div".split())
_ASIDE = frozenset("nav footer aside form button select dialog menu head".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre code span b i em strong u q td th dd dt figcaption cite mark small".split())
_ASIDE_WORD = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|sidebar|side-?bar|menu\w*|nav\w*|footer|masthead|toolbar|cookies?|consent|gdpr|notices?|alert|promo\w*|related|recommend\w*"
    r"|share|sharing|social|comments?|reply|replies|respond|disqus|newsletter|subscribe|signup|login|breadcrumbs?|pagination|pager|popup|modal|overlay|widget"
    r"|sponsor\w*|search|tags|skip|toc|byline-share)(?:[^a-z]|$)",
    re.I,
)
_HEADER_WORD = re.compile(r"(?:^|[^a-z])header(?:[^a-z]|$)", re.I)
_ROOT_WORD = re.compile(r"(?:^|[^a-z])(?:article-?body|post-?body|post-?content|entry-?content|article-?content|story-?body)(?:[^a-z]|$)", re.I)

TEXT = "#"


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def parsed(source: str | None) -> list:
    """The nested token stream of a page: elements as [symbol, children], texts as strings with references decoded."""
    top: list = ["", []]
    stack: list[tuple[str, list, int]] = [("", top, 0)]
    for m in _TOKEN.finditer(source or ""):
        text = m[8]
        if text is not None:
            stack[-1][1][1].append(html_lib.unescape(text) if "&" in text else text)
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        if m[2] or m[5]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        ends = _ENDS.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _HOLDS:
                    break
        elif name in BLOCK and name != "br":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        attributes = m[4] or m[7] or ""
        symbol = name
        if "=" in attributes:
            for a in _NAMED.finditer(attributes):
                value = a[2] or a[3] or a[4]
                if value:
                    symbol += f".{re.sub(r'[0-9]+', '0', ' '.join(value.split()))}"
        node = [symbol, []]
        stack[-1][1][1].append(node)
        if name not in VOID and not attributes.endswith("/"):
            depth = stack[-1][2]
            if depth >= DEPTH and (depth >= DEPTH + 20 or not _is_aside(symbol, False)):
                node, depth = [symbol, stack[-1][1][1]], depth - 1  # what it holds stands beside it
            stack.append((name, node, depth + 1))
    return top[1]


# A wrapper is a list of items [symbol, optional, repeated, value, children, characters, characters in links, pages]. A text slot
# has the symbol TEXT and as its value the text that all pages have there, or None; pages are the lowest hashes of up to STEADY
# different pages that have that value. A repeated group has the symbol "(...)".


def general(children: list, page: int = 0, linked: bool = False) -> list:
    """The wrapper of one page; page is a hash of it."""
    items: list = []
    for c in children:
        if isinstance(c, str):
            value = " ".join(c.split())
            if value:
                n = len(value)
                items.append([TEXT, False, False, value if n <= SHOWN else f"\0{_hash(value)}", [], n, n if linked else 0, [page]])
        else:
            items.append([c[0], False, False, None, general(c[1], page, linked or c[0].split(".", 1)[0] == "a"), 0, 0, []])
    return folded(items)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big")


def _shape(items: list) -> str:
    """What two wrappers that differ in texts only have in common."""
    return "".join(f"{s}{'?' * o}{'+' * r}[{_shape(c)}]" for s, o, r, _, c, *_ in items)


def folded(items: list) -> list:
    """items with runs of one token, or of a group of up to PERIOD tokens, as one repeated item."""
    out: list = []
    for item in items:
        out.append(item)
        while True:
            if len(out) > 1 and out[-1][0] == out[-2][0]:
                last = out.pop()
                out[-1] = merged(out[-1], last)
                out[-1][2] = True
                continue
            p = len(out[-1][4])
            if out[-1][0].startswith("(") and len(out) > p and _group(out[-p - 1 : -1]) == out[-1][0]:
                # What stands before a repeated group and is like it is its first turn.
                whole = out.pop()
                whole[4] = [merged(a, b) for a, b in zip(out[-p:], whole[4], strict=True)]
                whole[1] = whole[1] and any(x[1] for x in out[-p:])
                out[-p:] = [whole]
                continue
            done = True
            for p in range(2, PERIOD + 1):
                tail = out[-p:]
                if len(out) > p and out[-p - 1][0] == _group(tail):
                    del out[-p:]
                    out[-1][4] = [merged(a, b) for a, b in zip(out[-1][4], tail, strict=True)]
                    done = False
                elif len(out) >= 2 * p and [x[0] for x in tail] == [x[0] for x in out[-2 * p : -p]]:
                    before = out[-2 * p : -p]
                    del out[-2 * p :]
                    out.append([_group(tail), False, True, None, [merged(a, b) for a, b in zip(before, tail, strict=True)], 0, 0, []])
                    done = False
                if not done:
                    break
            if done:
                break
    return out


def _group(items: list) -> str:
    return f"({' '.join(x[0] for x in items)})"


def merged(a: list, b: list) -> list:
    """One item for two of the same symbol."""
    value = a[3] if a[3] == b[3] else None
    pages = sorted({*a[7], *b[7]})[:STEADY] if value is not None else []
    return [a[0], a[1] or b[1], a[2] or b[2], value, aligned(a[4], b[4]) if a[4] or b[4] else [], a[5] + b[5], a[6] + b[6], pages]


def aligned(a: list, b: list) -> list:
    """The wrapper that covers both: common tokens in order are merged, all others become optional."""
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b, strict=True)):
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    if n * m > CELLS:
        return _by_symbol([*a, *b])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return folded(out)


def _by_symbol(items: list) -> list:
    """Very long lists: each symbol once, optional and repeated."""
    out: dict[str, list] = {}
    for x in items:
        for y in x[4] if x[0].startswith("(") else [x]:
            out[y[0]] = merged(out[y[0]], y) if y[0] in out else list(y)
    return [[y[0], True, True, *y[3:]] for y in out.values()]


def expression(items: list) -> str:
    """The wrapper as a regular expression over tokens, for reading."""
    parts = []
    for s, optional, repeated, value, children, *_ in items:
        if s == TEXT:
            part = "#PCDATA" if value is None or value.startswith("\0") else json.dumps(value, ensure_ascii=False)
        elif s.startswith("("):
            part = f"({expression(children)})"
        else:
            part = f"<{s}>{expression(children)}</>" if children else f"<{s}>"
        mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, repeated]
        parts.append(f"({part}){mark}" if mark else part)
    return " ".join(parts)


class Judged:
    """A host's wrapper with a verdict on each text slot: symbol to [slots of the children, verdict on pages with a root, on others]."""

    def __init__(self, items: list) -> None:
        self.prose = max(1, self._prose(items))
        self.top = self._judge(items, False, False, False, self._main(items), _all_steady(items))

    def _prose(self, items: list) -> int:
        """Characters of changing text outside of links, and outside of what is aside by name."""
        return sum(max(0, x[5] - x[6]) * (not _steady(x)) if x[0] == TEXT else 0 if _named_aside(x[0]) else self._prose(x[4]) for x in items)

    def _links(self, items: list) -> tuple[int, int]:
        chars, linked = 0, 0
        for x in items:
            own = (x[5], x[6]) if x[0] == TEXT else self._links(x[4])
            chars, linked = chars + own[0], linked + own[1]
        return chars, linked

    def _main(self, items: list) -> int | None:
        """For pages without a root: id() of the children of the element that holds most of the prose and has some of its own."""
        flat = [y for x in items for y in (x[4] if x[0].startswith("(") else [x])]
        if any(y[0] == TEXT or y[0].split(".", 1)[0] in _PROSE for y in flat if self._prose([y])):
            return id(items)
        for y in flat:
            if y[0] != TEXT and self._prose([y]) > 2 / 3 * self.prose:
                return self._main(y[4])
        return id(items)

    def _aside(self, x: list, inside: bool) -> bool:
        """Whether an element is aside: by its name, or by its class unless the host's pages show that it is not, or as a menu."""
        name, _, rest = x[0].partition(".")
        if _named_aside(x[0]) or (name == "header" and not inside):
            return True
        if name in ("html", "body", "article", "main"):
            return False
        if rest and (_ASIDE_WORD.search(rest) or (not inside and _HEADER_WORD.search(rest))):
            whole = any(_ASIDE_WORD.fullmatch(w) or _HEADER_WORD.fullmatch(w) for w in re.split(r"[ .]", rest))
            if (whole or name not in _PROSE) and self._prose(x[4]) <= MOST * self.prose:
                return True
        if not inside and name not in _PROSE and name != "a":
            chars, linked = self._links(x[4])
            return chars > 0 and linked > LINKS * chars
        return False

    def _judge(self, items: list, inside: bool, aside: bool, within: bool, main: int | None, steady: bool) -> dict:
        """steady: nothing in the block changes; a word that never changes in one that does is part of its sentence."""
        within = within or id(items) == main
        out: dict = {}
        for x in items:
            if x[0] == TEXT:
                good = not aside and not steady
                _joined(out, {TEXT: [{}, good and inside, good and within]})
            elif x[0].startswith("("):
                _joined(out, self._judge(x[4], inside, aside, within, main, steady))
            else:
                root = inside or _is_root(x[0])
                alike = _all_steady(x[4]) if x[0].split(".", 1)[0] in BLOCK else steady
                _joined(out, {x[0]: [self._judge(x[4], root, aside or self._aside(x, root), within, main, alike), False, False]})
        return out

    def text(self, children: list) -> str:
        """The texts of the slots that count, in page order: those in a root, or on a page that has none of these the main ones."""
        for verdict in (1, 2):
            parts: list[str] = []
            self._read(children, self.top, verdict, parts)
            if got := " ".join("".join(parts).split()):
                return got
        return ""

    def _read(self, children: list, slots: dict, verdict: int, parts: list[str]) -> None:
        for c in children:
            if isinstance(c, str):
                if TEXT in slots and slots[TEXT][verdict]:
                    parts.append(c)
                continue
            block = c[0].split(".", 1)[0] in BLOCK
            if block:
                parts.append(" ")
            if c[0] in slots:
                self._read(c[1], slots[c[0]][0], verdict, parts)
            if block:
                parts.append(" ")


def _steady(x: list) -> bool:
    return x[3] is not None and len(x[7]) >= STEADY


def _all_steady(items: list) -> bool:
    """Whether no text of a block changes, those in inner blocks aside."""
    return all(_steady(x) if x[0] == TEXT else x[0].split(".", 1)[0] in BLOCK or _all_steady(x[4]) for x in items)


def _joined(out: dict, more: dict) -> None:
    """Slots of the same symbol under one parent share a verdict, as their places in a repeated group do."""
    for s, (children, a, b) in more.items():
        if s in out:
            _joined(out[s][0], children)
            out[s][1] |= a
            out[s][2] |= b
        else:
            out[s] = [children, a, b]


def _is_root(symbol: str) -> bool:
    name, _, rest = symbol.partition(".")
    return name in ("article", "main") or bool(rest and _ROOT_WORD.search(rest))


def _named_aside(symbol: str) -> bool:
    return symbol.partition(".")[0] in _ASIDE


def _is_aside(symbol: str, inside: bool) -> bool:
    """By the name and class alone."""
    name, _, rest = symbol.partition(".")
    if name in ("html", "body", "article", "main"):
        return False
    return name in _ASIDE or (name == "header" and not inside) or bool(rest and _ASIDE_WORD.search(rest))


def _pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
    for batch in batches:
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield host_of(url), general(parsed(source), _hash(source or ""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), pages: one row per host. A null or odd url has the host "", a null html is an empty page."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list] = {}

        def sent() -> pa.RecordBatch:
            parts = [_hash(shape) % 256 for _, shape in known]
            rows = list(known.values())
            out = {"host": [h for h, _ in known], "part": pa.array(parts, pa.int32()), "wrapper": [json.dumps(w, ensure_ascii=False) for w, _ in rows], "pages": pa.array([n for _, n in rows], pa.int64())}
            known.clear()
            return pa.RecordBatch.from_pydict(out)

        for host, own in _pages_of(batches):
            key = (host, _shape(own))
            if key in known:
                # The same tokens in the same order: texts and counts are summed up, in any order alike.
                known[key] = [aligned(known[key][0], own), known[key][1] + 1]
            else:
                known[key] = [own, 1]
                if len(known) >= HELD:
                    yield sent()
        if known:
            yield sent()

    def joined(t: pa.Table) -> pa.Table:
        shapes: dict[str, list] = {}
        for w in map(json.loads, t.column("wrapper").to_pylist()):
            shape = _shape(w)
            shapes[shape] = aligned(shapes[shape], w) if shape in shapes else w
        whole = functools.reduce(aligned, (shapes[k] for k in sorted(shapes)))
        part = pa.array([t.column("part")[0].as_py() // 16], pa.int32())
        return pa.table({"host": [t.column("host")[0].as_py()], "part": part, "wrapper": [json.dumps(whole, ensure_ascii=False)], "pages": pa.array([sum(t.column("pages").to_pylist())], pa.int64())})

    schema = "host string, part int, wrapper string, pages long"
    parts = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(partial, schema)
    for _ in range(2):  # 256 parts of a host, then 16
        parts = parts.groupBy("host", "part").applyInArrow(joined, schema)
    return parts.groupBy("host").applyInArrow(joined, schema).drop("part")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row per page in any order.

    Null and empty pages have an empty text. Pages with a null url share the host "". Repeated rows give repeated rows. Elements
    nested more than DEPTH deep are read as siblings, so any nesting is fine. A text that never changes goes once STEADY different
    pages of the host have it; on hosts of fewer pages names and classes decide. Other columns are not read.
    """
    from .common import settle

    wrappers = settle(infer_wrappers(pages), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[str, Judged] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper not in judged:
                    if len(judged) >= 256:
                        judged.clear()
                    judged[wrapper] = Judged(json.loads(wrapper))
                texts.append(judged[wrapper].text(parsed(source)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    # The same rule as host_of.
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST.pattern, 1))
    asked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    given = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    matched = asked.join(given, "host").select("page_id", "url", "html", "wrapper")
    return matched.mapInArrow(read, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
