"""Main text of web pages: the suffix array of a host's pages, with markup as a vote on what it finds.

Text inside menus, headers, footers, sidebars, notices, adverts, forms and comments goes. The other blocks
of a host's pages are put through its suffix array as token streams, in page order, and runs of tokens
that enough of its distinct pages have are boilerplate. How long and how common a run must be depends
on the markup: text inside article or main (KEPT) is believed more than other text (LOOSE); see RULES.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.llm.tables import release, written
from densel.llm.tokens import distinct
from densel.llm.urls import host_of

MIN_RUN, LONG_RUN = 5, 8
#: What makes a run boilerplate: (tokens, whether text outside the body counts, least distinct pages, least share of the
#: host's). Loose blocks go whole if runs of the first rule cover them, and the tokens in runs of the second rule go from
#: any loose block; from articles go the tokens in runs of the third.
RULES = ((MIN_RUN, True, 2, 0.1), (LONG_RUN, True, 2, 0.1), (LONG_RUN, False, 3, 0.25))
#: If less than this part of its article's length were left of a page, the page is a near copy and keeps its article.
LEFT = 0.25
#: Tokens that one suffix array holds; a host with more is dealt over several by page, which changes no result.
ARRAY_TOKENS = 500_000
#: Characters of text that a task holds to pack pages of one array together before they are shuffled.
PART_CHARS = 16_000_000
#: Up to so many runs of large hosts are broadcast to the arrays; with more, both are shuffled by host.
BROADCAST_RUNS = 2_000_000

#: Elements whose whole content is no text: RAW go on to the end of the page if they are not closed, CLOSED then are only a tag.
RAW = "script|style|textarea|title|template|iframe"
CLOSED = "noscript|svg|object|canvas|select|button"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<svg\b[^>]*/>"
    rf"|<(?P<closed>{CLOSED})\b[^>]*>.*?</(?P=closed)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
#: Elements that end the text block before and after them.
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul").split())
#: Block elements whose end the stack waits for.
CONTAINERS = frozenset("article aside blockquote details dialog div fieldset figure footer form header main menu nav ol "
                       "section table ul head span".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog head".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu",
                   "menubar", "alertdialog", "toolbar"))
#: Words of class and id attributes that mark what is not the article.
NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo "
    "promotion reader-comments related respond share sharing sidebar social sponsor sponsored subscribe subscription "
    "topbar widget").split())
#: Lines of text that may be notices or adverts by their own class; their titles may well be called header or banner.
LINES = frozenset("p li dd td".split())
LINE_NAMES = NAMES - frozenset("header masthead banner topbar".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)

DROPPED, LOOSE, KEPT = 0, 1, 2


#: How an element is outside the article: not, by a part of a class word, or by its kind, role or a whole class word.
NO, PARTLY, WHOLLY = 0, 1, 2


def _outside(tag: str, attrs: str) -> int:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment."""
    if tag in OUTSIDE:
        return WHOLLY
    if "=" not in attrs and "hidden" not in attrs:
        return NO
    names, found = LINE_NAMES if tag in LINES else NAMES, NO
    for name, *values in ATTRIBUTE.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return WHOLLY
        if name in ("class", "id"):
            for word in value.split():
                if word in names:
                    return WHOLLY
                if names.intersection(re.split(r"[-_]+", word)):
                    found = PARTLY
    return found


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; character references decoded, white space single, no empty ones.

    A class word that only has a part of the kind ``has-sidebar`` takes nothing from an article: article and main
    are never outside by it, and an element that is lets go of an article that opens inside.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # (element, whether it is outside the article)
    buffer: list[str] = []
    outside = inside = at = 0

    def flush() -> None:
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append((DROPPED if outside else KEPT if inside else LOOSE, text))
            buffer.clear()

    def pop() -> None:
        nonlocal outside, inside
        tag, out_of_it = stack.pop()
        outside -= out_of_it > 0
        inside -= tag in ARTICLE and not out_of_it

    for m in TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in BLOCKS and tag not in CONTAINERS:
            continue
        if m["end"]:
            if tag in BLOCKS:
                flush()
            if tag in LINES and stack and stack[-1][0] == tag:
                pop()
            if tag in CONTAINERS and any(t == tag for t, _ in stack):
                # an end tag closes what was left open inside, but a stray inline one closes no block
                if tag == "span" and stack[-1][0] != "span":
                    continue
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        out_of_it = _outside(tag, m["attrs"] or "")
        if tag in ARTICLE and out_of_it == PARTLY:
            out_of_it = NO
        if tag in BLOCKS or out_of_it:
            flush()
        if tag in BLOCKS and stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in LINES):
            pop()  # a line that was left open ends with the next
        if tag in LINES and out_of_it:
            stack.append((tag, out_of_it))
            outside += 1
            continue
        if tag in ARTICLE and not out_of_it:
            for i, (t, how) in enumerate(stack):
                if how == PARTLY:
                    stack[i] = t, NO
                    outside -= 1
            while any(t in OUTSIDE for t, _ in stack):  # menus and the like hold no article: they were left open
                pop()
        if tag in CONTAINERS and not (m["attrs"] or "").endswith("/"):
            if tag == "span" and not out_of_it and not any(t == "span" for t, _ in stack):
                continue
            stack.append((tag, out_of_it))
            outside += out_of_it > 0
            inside += tag in ARTICLE and not out_of_it
    if at < len(page):
        buffer.append(entities.unescape(page[at:]))
    flush()
    return out


_STREAMS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("content", pa.int64()),
                      ("array", pa.int64()), ("arrays", pa.int64()), ("kinds", pa.binary()), ("blocks", pa.list_(pa.string()))])
#: Pages of one array, packed; a page whose content came before in the part has null for its number of blocks.
PARTS = ("host string, array long, arrays long, page_ids array<long>, urls array<string>, contents array<long>, "
         "n_blocks array<int>, kinds binary, texts binary")
_PARTS = pa.schema([("host", pa.string()), ("array", pa.int64()), ("arrays", pa.int64()), ("page_ids", pa.list_(pa.int64())),
                    ("urls", pa.list_(pa.string())), ("contents", pa.list_(pa.int64())), ("n_blocks", pa.list_(pa.int32())),
                    ("kinds", pa.binary()), ("texts", pa.binary())])
#: A whole array as one part, or the runs that it names for a rule.
ARRAYS = PARTS + ", rule int, keys array<long>"
_ARRAYS = _PARTS.append(pa.field("rule", pa.int32())).append(pa.field("keys", pa.list_(pa.int64())))
RESULT = "page_id long, url string, text string"
_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
RUNS = "host string, rule int, key long, n long"
_RUNS = pa.schema([("host", pa.string()), ("rule", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def packed(rows: list[dict]) -> dict:
    """Pages of one array as a part: their blocks compressed together, those of equal contents once."""
    held: dict[int, dict] = {}
    for r in rows:
        if r["blocks"] is not None:
            held.setdefault(r["content"], r)
    own = [held.pop(r["content"], None) for r in rows]
    texts = "\n".join(t for r in own if r for t in r["blocks"])  # a block's white space is single blanks
    return {"host": rows[0]["host"], "array": rows[0]["array"], "arrays": rows[0]["arrays"],
            "page_ids": [r["page_id"] for r in rows], "urls": [r["url"] for r in rows], "contents": [r["content"] for r in rows],
            "n_blocks": [None if r is None else len(r["blocks"]) for r in own], "kinds": b"".join(r["kinds"] for r in own if r),
            "texts": zstandard.compress(texts.encode("utf-8", "replace"))}


def unpacked(parts: pa.Table) -> pa.Table:
    """The pages of parts of one array; kinds and blocks are null where another row has them for the same content."""
    out = []
    for p in parts.select(_PARTS.names).to_pylist():
        blocks = zstandard.decompress(p["texts"]).decode().split("\n") if p["kinds"] else []
        at = 0
        for page_id, url, content, n in zip(p["page_ids"], p["urls"], p["contents"], p["n_blocks"], strict=True):
            mine = slice(at, at + (n or 0))
            at = mine.stop
            out.append({"page_id": page_id, "url": url, "host": p["host"], "content": content, "array": p["array"], "arrays": p["arrays"],
                        "kinds": None if n is None else p["kinds"][mine], "blocks": None if n is None else blocks[mine]})
    return pa.Table.from_pylist(out, schema=_STREAMS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as blocks and their kinds, packed by the array that they go to; equal pages of a part are parsed once."""
    held: dict[tuple[str, int], list[dict]] = {}
    seen: set[tuple[str, int, int]] = set()
    chars = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([packed(rows) for rows in held.values()], schema=_PARTS)
        held.clear()
        seen.clear()
        return out

    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            for r in whole.slice(lo, 500).to_pylist():
                page, array = r.pop("html") or "", (r["host"], r["array"])
                if (*array, r["content"]) in seen:
                    r |= {"kinds": None, "blocks": None}
                else:
                    seen.add((*array, r["content"]))
                    blocks = blocks_of(page)
                    r |= {"kinds": bytes(kind for kind, _ in blocks), "blocks": [t for _, t in blocks]}
                    chars += sum(len(t) for _, t in blocks)
                chars += 200  # about what a row itself takes
                held.setdefault(array, []).append(r)
                if chars >= PART_CHARS:
                    yield flush()
                    chars = 0
    if held:
        yield flush()


class SuffixArray:
    """Token streams, each followed by a separator of its own, with their suffixes ranked by their first tokens."""

    def __init__(self, streams: list[list[str]], content: list[int]):
        ids: dict[str, int] = {}
        flat, self.lengths = [], np.array([len(s) for s in streams], np.int64)
        for i, stream in enumerate(streams):
            flat += [ids.setdefault(t, len(ids)) for t in stream]
            flat.append(-1 - i)
        self.tokens, self.names = np.array(flat, np.int64), ids
        self.owner = np.repeat(np.arange(len(streams)), self.lengths + 1)
        ends = np.cumsum(self.lengths + 1)
        self.room = ends[self.owner] - 1 - np.arange(len(flat)) if flat else np.zeros(0, np.int64)
        self.kinds = np.unique(np.array(content, np.int64), return_inverse=True)[1]
        self.cuts = ends[:-1]
        self._ranks = {1: np.where(self.tokens < 0, len(ids) - 1 - self.tokens, self.tokens)}
        self._keys: dict[int, np.ndarray] = {}

    def rank(self, depth: int) -> np.ndarray:
        """Order of the suffixes' first ``depth`` tokens, by prefix doubling."""
        if depth not in self._ranks:
            step = 1 << ((depth - 1).bit_length() - 1)
            first = self.rank(step)
            rest = np.concatenate([first[depth - step:] + 1, np.zeros(min(depth - step, len(first)), first.dtype)])[:len(first)]
            self._ranks[depth] = np.unique(first * (int(rest.max()) + 1) + rest, return_inverse=True)[1]
        return self._ranks[depth]

    def starts(self, depth: int, streams: np.ndarray | None = None) -> np.ndarray:
        """Positions of runs of ``depth`` tokens that end in their stream, of the marked streams."""
        return np.flatnonzero((self.room >= depth) & (True if streams is None else streams[self.owner]))

    def support(self, depth: int, at: np.ndarray) -> np.ndarray:
        """How many different contents have a run, counted at the given positions; by rank."""
        if not len(at):
            return np.zeros(len(self.tokens) + 1, np.int64)
        rank, n = self.rank(depth), int(self.kinds.max()) + 1
        pairs = distinct(rank[at] * n + self.kinds[self.owner[at]])
        return np.bincount(pairs // n, minlength=int(rank.max()) + 1)

    def keys(self, depth: int) -> np.ndarray:
        """64-bit keys of the runs, alike in every array."""
        if 1 not in self._keys:  # of the tokens, each hashed once
            named = np.frombuffer(b"".join([hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest()
                                            for t in self.names]) or bytes(8), "<u8")
            self._keys[1] = named[np.maximum(self.tokens, 0)]
        if depth not in self._keys:
            token, out = self._keys[1], np.full(len(self.tokens), depth, np.uint64)
            for j in range(depth):
                out = out * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([token[j:], np.zeros(min(j, len(token)), np.uint64)])
            self._keys[depth] = out
        return self._keys[depth].view(np.int64)

    def covered(self, depth: int, hits: np.ndarray) -> list[np.ndarray]:
        """For each stream, which tokens lie in a run that starts at one of the positions."""
        edges = np.zeros(len(self.tokens) + 1, np.int64)
        edges[hits] += 1
        np.add.at(edges, hits + depth, -1)
        return [x[:-1] for x in np.split(np.cumsum(edges[:-1]) > 0, self.cuts)]


def repeated(streams: list[list[str]], content: list[int], min_run: int = MIN_RUN, least: float = 2) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a run of ``min_run`` that ``least`` different contents have."""
    if not streams:
        return []
    array = SuffixArray(streams, content)
    at = array.starts(min_run)
    return array.covered(min_run, at[array.support(min_run, at)[array.rank(min_run)[at]] >= least])


class _Host:
    """Pages of a host, or those dealt to one of its arrays; streams 2i and 2i + 1 are page i outside and in its body."""

    def __init__(self, group: pa.Table):
        self.rows = group.to_pylist()
        # equal pages are one
        self.page_of = {r["content"]: r for r in self.rows if r["blocks"] is not None}
        self.contents = list(self.page_of)
        self.loose = any(LOOSE in r["kinds"] for r in self.page_of.values())
        streams, self.blocks = [], []
        for r in self.page_of.values():
            split = [(k, t.split(" ")) for k, t in zip(r["kinds"], r["blocks"], strict=True)]
            body = [(k, words) for k, words in split if k != DROPPED]
            self.blocks.append(body)
            streams += [[w for k, words in split if k == DROPPED for w in words], [w for _, words in body for w in words]]
        self.array = SuffixArray(streams, [c for c in self.contents for _ in (0, 1)])
        self.bodies = np.arange(len(streams)) % 2 == 1

    def starts(self, rule: int) -> np.ndarray:
        depth, everywhere = RULES[rule][:2]
        return self.array.starts(depth, None if everywhere else self.bodies)

    def hits(self, rule: int, n_pages: int) -> np.ndarray:
        """Positions of runs that reach the rule's support on a host that lies in this array whole."""
        depth, at = RULES[rule][0], self.starts(rule)
        return at[self.array.support(depth, at)[self.array.rank(depth)[at]] >= wanted(rule, n_pages)] if len(at) else at

    def runs(self, rule: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, support) of the distinct runs."""
        depth, at = RULES[rule][0], self.starts(rule)
        ranks, first = np.unique(self.array.rank(depth)[at], return_index=True)
        return self.array.keys(depth)[at[first]], self.array.support(depth, at)[ranks]

    def texts(self, hits: list[np.ndarray]) -> pa.Table:
        """The pages' texts, by the positions of each rule's runs."""
        block, loose, kept = (self.array.covered(rule[0], h) for rule, h in zip(RULES, hits, strict=True))
        text = {}
        for i, (content, blocks) in enumerate(zip(self.contents, self.blocks, strict=True)):
            at, out, whole, left = 0, [], 0, 0
            for k, words in blocks:
                here = slice(at, at + len(words))
                at += len(words)
                if k == KEPT:
                    gone, whole = kept[2 * i + 1][here], whole + len(words)
                else:
                    gone = block[2 * i + 1][here]
                    gone = gone if gone.all() else loose[2 * i + 1][here]
                rest = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left += len(rest)
                out.append((k, words, rest))
            copy = left < whole * LEFT
            lines = [" ".join(words if copy and k == KEPT else rest) for k, words, rest in out]
            text[content] = "\n\n".join(line for line in lines if line)
        return pa.Table.from_pylist([{"page_id": r["page_id"], "url": r["url"], "text": text[r["content"]]} for r in self.rows],
                                    schema=_RESULT)


def wanted(rule: int, n_pages: int) -> float:
    """Distinct pages that must have a run for the rule, on a host of so many distinct pages."""
    _, _, least, share = RULES[rule]
    return max(least, share * n_pages)


def _clean_host(parts: pa.Table) -> pa.Table:
    """Texts of a host whose pages all lie in the parts."""
    host = _Host(unpacked(parts))
    # without loose text only the rule for articles has something to decide
    none = np.zeros(0, np.int64)
    return host.texts([host.hits(rule, len(host.contents)) if host.loose or not RULES[rule][1] else none
                       for rule in range(len(RULES))])


def _runs_table(host: str, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    keys, n = np.concatenate([k for _, k, _ in found]), np.concatenate([n for _, _, n in found])
    rules = np.repeat([rule for rule, _, _ in found], [len(k) for _, k, _ in found])
    return pa.table([pa.array([host] * len(keys), pa.string()), pa.array(rules, pa.int32()), pa.array(keys, pa.int64()),
                     pa.array(n, pa.int64())], schema=_RUNS)


def _candidates(group: pa.Table) -> pa.Table:
    """Runs that reach the wanted share in this array: a run that does on the host does so in one of its arrays."""
    host, pages = _Host(group), group.column("pages")[0].as_py()
    found = []
    for rule in range(len(RULES)):
        keys, n = host.runs(rule)
        enough = n >= wanted(rule, pages) * len(host.contents) / pages - 1e-9
        found.append((rule, keys[enough], n[enough]))
    return _runs_table(host.rows[0]["host"], found)


def _array(parts: pa.Table) -> pa.Table:
    """One array as a single part, and the runs that it names."""
    pages = unpacked(parts)
    found = _candidates(pages.append_column("pages", pa.array(np.full(pages.num_rows, parts.column("pages")[0].as_py()))))
    whole = packed(pages.to_pylist())
    runs = [{"host": whole["host"], "rule": rule, "keys": found.filter(pc.equal(found.column("rule"), rule)).column("key").to_pylist()}
            for rule in range(len(RULES))]
    return pa.Table.from_pylist([whole, *runs], schema=_ARRAYS)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Host, list[np.ndarray]]]:
    """Each array's pages and the keys that are asked of it, by rule."""
    for whole in batches:
        for i in range(whole.num_rows):
            row = pa.Table.from_batches([whole.slice(i, 1)])
            asked = row.column("asked")[0]
            yield _Host(unpacked(row)), [np.sort(keys.values.to_numpy()) for keys in asked.values] if asked.is_valid else [
                np.zeros(0, np.int64) for _ in RULES]


def among(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which keys are asked for; np.isin would sort all of them."""
    if not len(asked):
        return np.zeros(len(keys), bool)
    asked = np.sort(asked)
    return asked[np.minimum(np.searchsorted(asked, keys), len(asked) - 1)] == keys


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Support in each array of the candidates of all arrays of its host."""
    for host, asked in _arrays(batches):
        found = []
        for rule, candidates in enumerate(asked):
            at = host.starts(rule)
            keys = host.array.keys(RULES[rule][0])[at]
            mine = among(keys, candidates)
            which, n = np.searchsorted(candidates, keys[mine]), len(host.contents)
            support = np.bincount(distinct(which * n + host.array.kinds[host.array.owner[at[mine]]]) // n, minlength=len(candidates))
            found.append((rule, candidates[support > 0], support[support > 0]))
        yield from _runs_table(host.rows[0]["host"], found).to_batches()


def _clean_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the pages of each array, by the runs that reach the support on the whole host."""
    for host, asked in _arrays(batches):
        hits = []
        for rule, (depth, *_) in enumerate(RULES):
            at = host.starts(rule)
            hits.append(at[among(host.array.keys(depth)[at], asked[rule])])
        yield from host.texts(hits).to_batches()


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page: (page_id, url, text); ``pages`` has page_id, url and html, other columns are not read.

    Blocks come in page order, joined by an empty line. Null html and pages without text give an empty
    text. Pages of equal html count as one page when runs are repeated, so copies keep their text. A
    null url belongs to the host ''. Repeated rows each give a row.

    A host with more than ARRAY_TOKENS tokens is dealt over several suffix arrays by its pages' content.
    The arrays name the runs that are frequent in one of them, all count those, and the sums decide, so
    the texts are those of a single array.

    Blocks are shuffled once, packed by array in the tasks that parse them. An array is then a row of a
    written table, and counting and cutting read that table where it lies.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"),
                        F.xxhash64("html").alias("content"), "html")
    # about six characters to a token; a host is listed only if it needs several arrays
    sizes = rows.groupBy("host").agg(F.sum(F.length("html")).alias("_chars"))
    sizes = sizes.select("host", F.ceil(F.col("_chars") / F.lit(6.0 * ARRAY_TOKENS)).alias("arrays")).filter("arrays > 1")
    large = written(sizes, "large-hosts")
    rows = rows.join(F.broadcast(large), "host", "left").withColumn("arrays", F.coalesce("arrays", F.lit(1)))
    rows = rows.withColumn("array", F.pmod(F.xxhash64("content"), "arrays")).select(*_STREAMS.names[:6], "html")
    alone = rows.filter("arrays = 1").mapInArrow(_parts, PARTS).groupBy("host").applyInArrow(_clean_host, RESULT)
    if large.isEmpty():
        return alone
    dealt = rows.filter("arrays > 1")
    n_pages = written(dealt.groupBy("host").agg(F.count_distinct("content").alias("pages")), "host-pages")
    parts = dealt.mapInArrow(_parts, PARTS).join(F.broadcast(n_pages), "host")
    made = written(parts.groupBy("host", "array").applyInArrow(_array, ARRAYS), "page-arrays")
    release(pages.sparkSession)  # the shuffled parts
    arrays = made.filter("rule is null").drop("rule", "keys")

    def told(runs: DataFrame, how: str) -> DataFrame:
        """The arrays with the runs (host, rule, key) of their host, by rule."""
        per = runs.groupBy("host").agg(F.array(*[F.collect_list(F.when(F.col("rule") == r, F.col("key"))) for r in range(len(RULES))])
                                       .alias("asked"))
        return arrays.join(F.broadcast(per) if runs.count() <= BROADCAST_RUNS else per, "host", how)

    named = written(made.filter("rule is not null").select("host", "rule", F.explode("keys").alias("key")).distinct(), "candidate-runs")
    counted = told(named, "inner").mapInArrow(_counts, RUNS)
    total = counted.groupBy("host", "rule", "key").agg(F.sum("n").alias("n")).join(F.broadcast(n_pages), "host")
    least = F.element_at(F.array(*[F.greatest(F.lit(float(r[2])), F.lit(float(r[3])) * F.col("pages")) for r in RULES]),
                         F.col("rule") + 1)
    frequent = written(total.filter(F.col("n") >= least).select("host", "rule", "key"), "frequent-runs")
    release(pages.sparkSession)
    return alone.unionByName(told(frequent, "left").mapInArrow(_clean_dealt, RESULT))
