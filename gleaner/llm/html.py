"""HTML extraction: the main text of pages, with host suffix arrays for boilerplate (operator 6).

A linear, tolerant scan of the markup gives the blocks of a page with what their containers say: inside the article,
beside it, or open. The token streams of a host's pages (all but article text, in which the contract wants repeats kept)
are concatenated; a suffix array finds the long substrings that distinct pages share. Open blocks, and those that only a
doubtful name speaks against, are removed where such substrings cover them; for blocks beside the article they are
counted as evidence. Where a host takes several arrays, these exchange hashes of their windows.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, shuffle_width, stash
from .near_duplicates import _spread, _squeeze

#: Tokens of a repeated substring, pages that must share it, and the share of a block that it must cover.
RUN, PAGES, COVERED = 5, 2, 0.6
#: Characters of html in one suffix array: a host with more takes several, by a hash of the page. The result is the same.
ARRAY_CHARS = 16 << 20
_K = np.uint64(0x9E3779B97F4A7C15)

#: Elements whose text is never shown or never running text. The first hold raw text up to their end tag.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
SKIPPED = RAW | frozenset("template svg math object canvas audio video select button datalist head".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Containers beside the article.
BESIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in class or id that name something beside the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe signup "
    "sidebar related recommended recommendations trending sharing social breadcrumb breadcrumbs menu nav navbar navigation topnav toolbar pagination pager "
    "comment comments commentlist disqus replies footer masthead topbar".split()
)
#: Words that may also name a kind of article: alone they count; as a part of a name, inside an article, the host decides.
DOUBTFUL = frozenset("notice notices notification alert rail popular share respond reply discussion login search widget skip copyright disclaimer".split())
#: Unclosed blocks of the same kind end where the next begins.
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}

# possessive, and no class runs past the next tag: the scan is linear
_MARK = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>\"']*+)>|(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
_QUOTE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_TOKEN_WORD = re.compile(r"\S+")

ARTICLE, OPEN, BESIDE = 2, 1, 0
_NOTHING, _DOUBT, _SURE = 0, 1, 2


def _against(tag: str, attributes: str, in_article: bool) -> int:
    """What a container says against its text: that it surely, doubtfully or not stands beside the article."""
    if tag in BESIDE_TAGS or tag == "header" and not in_article:
        return _SURE
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return _NOTHING
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or found.get("role") in ROLES:
        return _SURE
    said = _NOTHING
    for name in (n for key in ("class", "id") for n in found.get(key, "").split()):
        parts = _NAME.findall(name)
        if name in DOUBTFUL or any(p in NAMES for p in parts):
            return _SURE
        if any(p in DOUBTFUL for p in parts):
            said = _DOUBT if in_article else _SURE
    return said


class _Scanner:
    """Tags and text of a page in order. Every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.loose = False  # a quoted value did not end: from there on tags end at the first >
        self.no_gt = self.no_comment_end = self.size + 1  # no such mark from this place on
        self.next_of: dict[str, tuple[int, int, bool]] = {}

    def _find_gt(self, at: int) -> int:
        if at >= self.no_gt:
            return -1
        end = self.page.find(">", at)
        if end < 0:
            self.no_gt = at
        return end

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at ``at``; quoted values are passed over."""
        first = self._find_gt(at)
        if first < 0 or self.loose:
            return first
        i = at
        while (m := _QUOTE.search(self.page, i)) is not None:
            if m[0] == ">":
                return m.start()
            i = m.end()
            if self.page[at : m.start()].rstrip().endswith("=") if m.start() - at < 64 else self.page[m.start() - 64 : m.start()].rstrip().endswith("="):
                close = self.page.find(m[0], i)
                if close < 0:
                    break
                i = close + 1
        self.loose = True
        return first

    def _same(self, tag: str, at: int) -> tuple[int, int, bool]:
        """(begin, end, closes) of the next tag of this kind; raw text knows only end tags. The size of the page if none."""
        if tag not in self.next_of or self.next_of[tag][0] < at:
            m = re.compile(rf"<({'/' if tag in RAW else '/?'}){tag}(?=[\s/>])[^>]*+>", re.I | re.A).search(self.page, at)
            self.next_of[tag] = (m.start(), m.end(), bool(m[1])) if m else (self.size, self.size, False)
        return self.next_of[tag]

    def marks(self):
        """(text before, tag, closing, attributes); tag is empty at the end. Skipped elements with an end tag are left out.

        A skipped element without an end tag of its own gives (text, tag, False, None): its text runs to the next block.
        Code without one runs to the end of the page.
        """
        page, at = self.page, 0
        begin = 0  # of the text that is not handed out yet
        pieces: list[str] = []
        while (m := _MARK.search(page, at)) is not None:
            tag, closing, attributes, end = m[2], bool(m[1]), m[3], m.end()
            if not tag:
                if m[4]:
                    close = -1 if m.start() >= self.no_comment_end else page.find("-->", m.start() + 4)
                    if close < 0:
                        self.no_comment_end = min(self.no_comment_end, m.start())
                    end = close + 3 if close >= 0 else self._find_gt(m.start()) + 1
                elif m[5]:
                    end = self._find_gt(m.start()) + 1
                else:
                    tag, closing = m[7], bool(m[6])
                    close = self._tag_end(m.end())
                    attributes, end = page[m.end() : max(close, m.end())], close + 1
                if end <= 0:  # nothing ends it: a plain character
                    at = m.start() + 1
                    continue
            pieces.append(page[begin : m.start()])
            begin = at = end
            if not tag:
                continue
            tag = tag.lower()
            if tag in SKIPPED:
                if closing:
                    continue
                _, stop, closes = self._same(tag, at)
                if closes:
                    begin = at = stop
                elif tag in ("script", "style"):  # code to the end: the page was cut off
                    begin = at = self.size
                elif tag != "head":
                    yield "".join(pieces), tag, False, None
                    pieces.clear()
                continue
            yield "".join(pieces), tag, closing, attributes
            pieces.clear()
        pieces.append(page[begin:])
        yield "".join(pieces), "", False, ""


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(ARTICLE, OPEN or BESIDE, text) of the blocks of a page in order.

    Blocks of <article>, or where there is none of <main>, are ARTICLE if they are at least as long in all as what stands
    open outside; else there is no telling, and all are OPEN. So are doubtful blocks inside an article.
    """
    out: list[tuple[bool, int, bool, bool, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, what is said against it, article, main
    state = (_NOTHING, False, False)
    mute = False
    depth: dict[str, int] = {}

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((*state, text))
            parts.clear()

    for before, tag, closing, attributes in _Scanner(page or "").marks():
        if before and not mute:
            parts.append(before)
        if attributes is None:  # its own text is hidden, up to the next block
            mute = True
            continue
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        mute = False
        if tag == "hr":
            continue
        if closing:
            if depth.get(tag):
                while True:
                    last = stack.pop()[0]
                    depth[last] -= 1
                    if last == tag:
                        break
            state = stack[-1][1:] if stack else (_NOTHING, False, False)
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            depth[stack.pop()[0]] -= 1
        against, article, main = stack[-1][1:] if stack else (_NOTHING, False, False)
        against = max(against, _against(tag, attributes, article))
        stack.append((tag, against, article or tag == "article" and against < _SURE, main or tag == "main"))
        depth[tag] = depth.get(tag, 0) + 1
        state = stack[-1][1:]
    flush()
    for region in (1, 2):
        inside = sum(len(b[3]) for b in out if b[region] and b[0] < _SURE)
        if inside and inside >= sum(len(b[3]) for b in out if not b[region] and b[0] < _SURE):
            kind = lambda b: BESIDE if b[0] == _SURE or not b[region] else OPEN if b[0] else ARTICLE
            return [(kind(b), b[3]) for b in out]
    return [(BESIDE if b[0] == _SURE else OPEN, b[3]) for b in out]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of small numbers, by prefix doubling; stops when RUN tokens are told apart.

    Longer common prefixes need no further order: a run is found from windows of RUN tokens.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < RUN:
        step = min(width, RUN - width)
        next_ = np.full(len(rank), -1, np.int64)
        next_[:-step] = rank[step:] if step < len(rank) else next_[:-step]
        key = rank * (rank.max(initial=0) + 2) + next_ + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        width += step
    return order


def repeated(streams: list[list[int]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens: which are covered by a substring of ``run`` tokens or more that ``pages`` pages share."""
    sizes = np.array([len(s) for s in streams], np.int64)
    if not sizes.sum():
        return [np.zeros(0, bool) for _ in streams]
    # a number of its own ends each page, so that no substring crosses pages
    flat = np.concatenate([np.array([*s, -1 - i], np.int64) for i, s in enumerate(streams)])
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    order = suffix_array(flat)
    # neighbours in the suffix array that agree in their first ``run`` tokens form a class
    agree = np.ones(max(0, len(order) - 1), bool)
    padded = np.concatenate((flat, np.arange(-len(streams) - 1, -len(streams) - 1 - run, -1)))
    for k in range(run):
        agree &= padded[order[1:] + k] == padded[order[:-1] + k]
    group = np.concatenate(([0], np.cumsum(~agree)))
    pairs = np.unique(group * len(streams) + page[order])
    n_pages = np.bincount(pairs // len(streams), minlength=group[-1] + 1)
    starts = order[(n_pages[group] >= pages)]
    change = np.zeros(len(flat) + run + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    covered = np.cumsum(change)[: len(flat)] > 0
    ends = np.cumsum(sizes + 1)
    return [covered[e - 1 - n : e - 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def windows(streams: list[list[int]], table: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, page, place in all tokens) of every window of ``run`` tokens within a page; ``table``: hashes of the tokens."""
    flat = np.array([t for s in streams for t in s], np.int64)
    page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    n = max(0, len(flat) - run + 1)
    hashes = np.zeros(n, np.uint64)
    for k in range(run):
        hashes = mix64(hashes * _K + table[flat[k : k + n]])
    place = np.flatnonzero(page[:n] == page[run - 1 :][:n])
    return hashes[place], page[place], place


def _tokens(pages) -> tuple[list[list[int]], dict[str, int]]:
    """Numbered tokens of all but the article blocks of each page (kinds, texts), and the numbers."""
    number: dict[str, int] = {}
    return [[number.setdefault(w, len(number)) for k, t in zip(*page) if k != ARTICLE for w in _TOKEN_WORD.findall(t)] for page in pages], number


def _hashes(host: str, number: dict[str, int]) -> np.ndarray:
    """Hashes of a host's tokens by their numbers."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(host.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in number), np.uint64, len(number))


def _groups(batches):
    """(host, part, rows) of Arrow batches that arrive sorted by their first two columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key and held:
                yield *key, held
                held = []
            key = row[:2]
            held.append(row[2:])
    if held:
        yield *key, held


def _host(url):
    """Host of a URL in lower case, without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def _distinct_windows(rows, host: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows, on how many pages each stands, PAGES at most) of the pages (kinds, texts) of a host."""
    streams, number = _tokens(rows)
    window, page, _ = windows(streams, _hashes(host, number))
    order = np.lexsort((page, window))
    window, page = window[order], page[order]
    first = np.ones(len(window), bool)
    first[1:] = (window[1:] != window[:-1]) | (page[1:] != page[:-1])
    window, n = np.unique(window[first], return_counts=True)
    return window, np.minimum(n, PAGES).astype(np.uint8)


def extract(pages: DataFrame, chars: int = ARRAY_CHARS) -> DataFrame:
    """page_id, url, text, n_chars, n_boilerplate, n_repeated for every row of ``pages`` (page_id, url, html).

    text has a line a block. n_boilerplate counts the blocks that were left out; n_repeated those of them that substrings
    cover which other pages of the host have as well. Null and empty pages give an empty text. A page all of whose open
    blocks are repeated (a copy of another page) keeps them: there is no unique text to prefer. Rows that repeat a
    page_id count as pages of their own. Other columns are ignored; no rows give none. Pages move once, compressed, to the
    array of their host; a host with more than ``chars`` characters has several, which ask each other for windows (by
    64 bits) that stand on pages of several.
    """
    import zstandard

    kind = pages.schema["page_id"].dataType.simpleString()
    width = shuffle_width(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _host(F.col("url")).alias("host"), "html")
    hosts = rows.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0))) / chars).alias("parts")).filter("parts > 1")
    # written: its size is known, and a join that reads an aggregate in place cannot split a hot host's pages
    hosts = stash(hosts.withColumnRenamed("host", "of"), "hosts")
    rows = rows.join(hosts, F.col("host") == F.col("of"), "left").drop("of")
    rows = rows.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.col("parts"))).otherwise(0).cast("long"))

    def scan(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = [blocks(h) for h in part.column(4).to_pylist()]
                packed = [packer.compress("\n".join(t for _, t in b).encode("utf-8", "surrogatepass")) for b in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(4)), pa.array([bytes(k for k, _ in b) for b in found], pa.binary()), pa.array(packed, pa.binary())], ["host", "part", "page_id", "url", "kinds", "packed"])

    def ask(batches):
        """Distinct windows of the pages of hot hosts with their numbers of pages, dealt by the window."""
        for batch in batches:
            held: dict = {}
            for host, part, page in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4))):
                held.setdefault((host, part), []).append(tuple(zip(*blocks(page))) or ((), ()))
            out = []
            for (host, part), found in held.items():
                window, n = _distinct_windows(found, host)
                cuts = np.searchsorted(((window >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32), np.arange(width + 1)).tolist()
                out += [(k, host, part, _squeeze(window[a:b], n[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.string(), pa.int64(), pa.binary()))], ["to", "host", "part", "windows"])

    def answer(batches):
        """To each array, those of its windows that are repeated over the host."""
        asked = [(h, p, *_spread(d)) for b in batches for h, p, d in zip(*(c.to_pylist() for c in b.columns[1:]))]
        if not asked:
            return
        window, at = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        often = (np.bincount(at, np.concatenate([x[3] for x in asked])) >= PAGES)[at]
        ends = np.cumsum([len(x[2]) for x in asked]).tolist()
        for (host, part, own, _), end in zip(asked, ends):
            found = own[often[end - len(own) : end]]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([part], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["host", "part", "windows"])

    def decide(batches):
        unpack, ids = zstandard.ZstdDecompressor(), None

        def typed(batches):
            nonlocal ids
            for batch in batches:
                ids = batch.column(2).type
                yield batch

        for host, _, held in _groups(typed(batches)):
            said = [np.frombuffer(r[4], np.uint64) for r in held if r[4] is not None]
            held = [r for r in held if r[4] is None]
            texts = [unpack.decompress(r[3]).decode("utf-8", "surrogatepass").split("\n") if r[2] else [] for r in held]
            streams, number = _tokens(zip((r[2] for r in held), texts))
            covers = repeated(streams)
            if said:
                window, _, place = windows(streams, _hashes(host, number))
                place = place[np.isin(window, np.concatenate(said))]
                change = np.zeros(sum(map(len, streams)) + RUN + 1, np.int64)
                np.add.at(change, place, 1)
                np.add.at(change, place + RUN, -1)
                elsewhere = np.cumsum(change)[: sum(map(len, streams))] > 0
                covers = [c | e for c, e in zip(covers, np.split(elsewhere, np.cumsum([len(s) for s in streams])[:-1]))]
            out = []
            for r, own, cover in zip(held, texts, covers):
                at, kept, open_, gone, again = 0, [], [], 0, 0
                for k, text in zip(r[2], own):
                    n = len(_TOKEN_WORD.findall(text)) if k != ARTICLE else 0
                    # a short block is decided by the run it lies in
                    bad = bool(n) and bool(cover[at : at + n].mean() >= COVERED)
                    at += n
                    if k == BESIDE or bad:
                        gone += 1
                        again += bad
                    else:
                        kept.append(text)
                    if k != BESIDE:
                        open_.append(text)
                if not kept and open_:
                    kept, gone, again = open_, gone - len(open_), again - len(open_)
                out.append((r[0], r[1], "\n".join(kept), gone, again))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (ids, pa.string(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "url", "text", "n_boilerplate", "n_repeated"])

    columns = ["host", "part", "page_id", "url", "html"]
    dealt = rows.select(*columns).mapInArrow(scan, f"host string, part long, page_id {kind}, url string, kinds binary, packed binary").withColumn("windows", F.lit(None).cast("binary"))
    if not hosts.isEmpty():
        asked = rows.filter("parts IS NOT NULL").select(*columns).mapInArrow(ask, "to int, host string, part long, windows binary")
        answers = asked.repartitionById(width, "to").mapInArrow(answer, "host string, part long, windows binary")
        dealt = dealt.unionByName(answers, allowMissingColumns=True)
    gathered = dealt.repartition(width, "host", "part").sortWithinPartitions("host", "part")
    decided = gathered.mapInArrow(decide, f"page_id {kind}, url string, text string, n_boilerplate long, n_repeated long")
    return decided.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate", "n_repeated")
