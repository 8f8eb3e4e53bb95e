"""Main text of web pages: host-wide repeats found with suffix arrays, and the structure of the page as the prior.

A tokenizer cuts a page into text blocks and notes for each whether it stands in the article, outside it, or in an element
that is a menu, footer, advert and the like by its name. The token streams of whole pages of one host, furniture included, are
concatenated and their suffixes sorted by doubling; neighbours in that order that share ``REPEAT`` tokens or more and come from distinct pages
give the repeated substrings, with the number of pages that hold each. What enough of the host's pages hold is boilerplate: outside an article the covered
tokens go and the unique runs stay; inside, only blocks that are covered whole, on nearly all pages, go. Furniture goes
by the prior whether it repeats or not (adverts and readers' comments differ from page to page), and a host with few pages has the prior alone.

A host larger than ``HOST_BYTES`` is dealt into buckets by a hash of the page's id. Each bucket has a suffix array; the page
counts of its repeated substrings are added up over the host, and pages are then cut by the host's sums. A substring that a bucket holds
on one page alone isn't reported, so a sum is a lower bound and the buckets without report give an upper one; a substring whose bounds
enclose a share that decides is counted once more on all pages. Counts are thus exact, and neither the size of the host nor how rows fall
into tasks changes a text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import parts, small_batches, stored
from tidelog.llm.wordhash import grams, hashed

REPEAT = 8
#: The share of a host's pages (and their least number) that must hold a substring: outside and inside an article.
OUTSIDE, INSIDE, LEAST_PAGES = 0.3, 0.9, 5
#: Bytes of one host's pages that share a suffix array; a larger host has several, whose counts are added up.
HOST_BYTES = 8 << 20
#: Where a block stands.
FURNITURE, PLAIN, ARTICLE = 0, 1, 2

# Element and attribute names of the HTML standard and common class names of page furniture.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object noframes xmp select button canvas video audio".split())
_SKIP = frozenset("nav footer aside form menu dialog fieldset".split())
_FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices notification sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus respond replies share sharing social related recommended recommendations newsletter subscribe subscription signup login popup popups modal overlay toolbar skip hidden widget widgets search searchbox contentinfo complementary".split())
_ONLY_OUTSIDE = frozenset("header masthead topbar banner".split())
_ATTRIBUTE = re.compile(r"""(?<![^\s"'>/=])([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TURN = re.compile(r"""[>"']""")
_WORD = re.compile(r"[a-z0-9]+")


def _furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in _SKIP or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    low = attributes.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|$|/)", low):
        return True
    for key, a, b, c in _ATTRIBUTE.findall(low):
        value = a or b or c
        if key in ("class", "id", "role", "data-role"):
            words = set(_WORD.findall(value))
            if words & _FURNITURE or not inside and words & _ONLY_OUTSIDE:
                return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or key == "aria-hidden" and value == "true":
            return True
    return False


def _article(name: str, attributes: str) -> bool:
    if name in ("article", "main"):
        return True
    low = attributes.lower()
    return "articlebody" in low or bool(re.search(r"role\s*=\s*[\"']?main\b", low))


class _Tags:
    """Where the tags of a page end, each step in time that doesn't depend on the page's length.

    A ``>`` between quotes doesn't end a tag. A quote without a partner is an ordinary character; once a tag has no end because of
    its quotes, quotes are ordinary in the rest of the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.turns = [(m.start(), m[0]) for m in _TURN.finditer(page)]
        self.places = [at for at, _ in self.turns]
        self.last = {q: page.rfind(q) for q in ">\"'"}
        self.quoting = True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, looked for from ``at``; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        k = bisect_left(self.places, at) if self.quoting else len(self.turns)
        while k < len(self.turns):
            place, turn = self.turns[k]
            if turn == ">":
                return place
            if self.last[turn] > place:
                k = bisect_left(self.places, self.page.index(turn, place + 1), k)
            k += 1
        self.quoting = False
        return self.page.find(">", at)


def page_blocks(page: str) -> list[tuple[str, int, float]]:
    """Text blocks in page order: text, where it stands, and the share of it that is link text. Time is linear in the page."""
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, article
    held: Counter[str] = Counter()  # names on the stack
    furniture = inside = links = 0
    text: list[str] = []
    linked = 0
    at, tags = 0, _Tags(page)

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append((words, FURNITURE if furniture else ARTICLE if inside else PLAIN, min(1.0, linked / len(words))))
            text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal furniture, inside
        while len(stack) > to:
            name_, f, a = stack.pop()
            held[name_] -= 1
            if f and furniture == 1:
                flush()
            furniture -= f
            inside -= a

    def plain(upto: int) -> None:
        nonlocal at, linked
        text.append(page[at:upto])
        if links:
            linked += upto - at
        at = upto

    while at < len(page):
        if page[at] != "<":
            begin = page.find("<", at)
            plain(len(page) if begin < 0 else begin)
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        closing = page.startswith("</", at)
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            end = page.find(">", at) if at <= tags.last[">"] and page[at + 1 : at + 2] in ("!", "?", "/") else -1
            if end < 0:
                plain(at + 1)
            else:
                at = end + 1
            continue
        end = tags.end(m.end())
        if end < 0:  # no tag ends from here on
            plain(len(page))
            continue
        name, attributes = m[0].lower(), page[m.end() : end]
        at = end + 1
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name in _BLOCK:
                flush()
            if held[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
            continue
        if name in _RAW:
            if not attributes.endswith("/"):
                end = re.compile("</" + re.escape(name), re.I | re.A).search(page, at)
                at = page.find(">", end.end()) + 1 or len(page) if end else len(page)
            text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            flush()
            closes = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",)}.get(name, ("p",))
            while stack and stack[-1][0] in (*closes, "p"):
                pop(len(stack) - 1)
        if name == "a":
            links += 1
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _BLOCK or attributes:
            a = _article(name, attributes)
            f = _furniture(name, attributes, inside > 0)
            if name in _BLOCK or f:
                if f and not furniture:
                    flush()
                stack.append((name, f, a and not f))
                held[name] += 1
                furniture += f
                inside += a and not f
    flush()
    return out


def suffix_order(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``length`` (a power of two) tokens, and the rank of each; doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < length:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-size] = rank[size:]
        rank = np.unique(rank * (len(rank) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        size *= 2
    return np.argsort(rank, kind="stable"), rank


def repeated(tokens: np.ndarray, page: np.ndarray, block: np.ndarray | None = None, length: int = REPEAT, spread: bool = True) -> np.ndarray:
    """For every token: the largest number of distinct pages that hold a substring which covers it, of ``length`` tokens or
    of a whole shorter block. Substrings stay inside one block (by default, one page). Without ``spread`` the number stands at the first token of each
    substring only (zero where none begins)."""
    block = page if block is None else block
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    size = np.diff(np.append(starts, n))
    # An end mark after each block: a shorter block is compared with its end, and no substring runs into the next block.
    at = np.arange(n) + np.repeat(np.arange(len(starts)), size)
    marked = np.zeros(n + len(starts), np.int64)
    marked[at] = np.unique(tokens, return_inverse=True)[1] + 1
    order, rank = suffix_order(marked, length)
    page_of = np.zeros(len(marked), np.int64)
    page_of[at] = page
    page_of[at[starts + size - 1] + 1] = page[starts]
    r, p = rank[order], page_of[order]  # stable: pages rise within equal ranks
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    pages = np.bincount(r, fresh)[rank].astype(np.int64)[at]
    left = np.repeat(starts + size, size) - np.arange(n)  # tokens of the block from here on
    first = np.where(left >= length, pages, 0)
    # A short block and its end mark fill less than ``length`` places; what follows must not decide, so blocks are compared as such.
    which = np.flatnonzero(size < length)
    held = np.zeros(0, np.int64)
    if len(which):
        names = np.array([hash(tuple(tokens[s : s + m].tolist())) for s, m in zip(starts[which], size[which])])
        pairs = np.unique(np.stack([names, page[starts[which]]]), axis=1)[0]
        values, counts = np.unique(pairs, return_counts=True)
        held = counts[np.searchsorted(values, names)]
    if not spread:
        first[starts[which]] = held
        return first
    cover = first.copy()
    cover[np.repeat(size < length, size)] = np.repeat(held, size[which])
    for k in range(1, length):
        cover[k:] = np.maximum(cover[k:], first[:-k])
    return cover


def candidates(page: str) -> list[tuple[str, int, float]]:
    """The blocks of a page as the host's stream takes them, in page order. Where the page has an article, what stands plainly outside it is furniture;
    elsewhere short blocks of links are."""
    own = page_blocks(page)
    article = any(where == ARTICLE for _, where, _ in own)
    menu = lambda text, links: links > 0.6 and len(text) < 200
    return [(text, FURNITURE if where == PLAIN and (article or menu(text, links)) else where, links) for text, where, links in own]


class Streams:
    """The token streams of pages: word hashes, and the page and the block of each."""

    def __init__(self, pages: list[str]):
        self.blocks = [candidates(p) for p in pages]
        each = [(text, k) for k, own in enumerate(self.blocks) for text, _, _ in own]
        found = list(hashed(pa.array([t.encode() for t, _ in each], pa.binary()))) if each else []
        self.size = np.concatenate([w.count for w in found]) if found else np.zeros(0, np.int64)
        self.tokens = np.concatenate([w.hashes for w in found]) if found else np.zeros(0, np.uint64)
        self.page = np.repeat(np.array([k for _, k in each], np.int64), self.size)
        self.block = np.repeat(np.arange(len(each)), self.size)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a substring of ``REPEAT`` tokens, or a whole shorter block, begins, and its hash."""
        begin = np.cumsum(self.size) - self.size
        left = np.repeat(begin + self.size, self.size) - np.arange(len(self.tokens))
        long = np.flatnonzero(left >= REPEAT)
        names = grams(self.tokens, REPEAT, 0x3C6EF372FE94F82B)[long] if len(long) else np.zeros(0, np.uint64)
        at, hashes = [long], [names]
        for n in range(1, REPEAT):
            short = begin[self.size == n]
            if len(short):
                at.append(short)
                hashes.append(grams(self.tokens, n, 0xA54FF53A5F1D36F1)[short])
        return np.concatenate(at), np.concatenate(hashes)

    def texts(self, outside: np.ndarray, inside: np.ndarray) -> tuple[list[str], list[int]]:
        """The main texts, and the number of words that were dropped as repeats rather than as furniture, from flags of covered tokens."""
        texts_, dropped, at, b = [], [], 0, 0
        for own in self.blocks:
            kept, gone = [], 0
            for text, where, _ in own:
                here = slice(at, at + int(self.size[b]))
                at, b = here.stop, b + 1
                if where == FURNITURE:
                    continue
                if where == ARTICLE:
                    if inside[here].all():
                        gone += here.stop - here.start
                    else:
                        kept.append(text)
                    continue
                common = outside[here]
                gone += int(common.sum())
                if not common.any():
                    kept.append(text)
                elif not common.all():
                    kept.append(" ".join([w for w, c in zip(text.split(" "), common) if not c]))
            texts_.append("\n\n".join(kept))
            dropped.append(gone)
        return texts_, dropped


def _cut(pages: list[str], repeats: bool = True) -> tuple[list[str], list[int]]:
    streams = Streams(pages)
    cover = repeated(streams.tokens, streams.page, streams.block) if repeats and len(pages) >= LEAST_PAGES else np.zeros(len(streams.tokens), np.int64)
    least = lambda share: max(LEAST_PAGES, share * len(pages))
    return streams.texts(cover >= least(OUTSIDE), cover >= least(INSIDE))


def host_texts(pages: list[str], repeats: bool = True) -> list[str]:
    """The main texts of all pages of one host; without ``repeats`` by the prior alone."""
    return _cut(pages, repeats)[0]


_OUT = "id bigint, url string, text string, n_chars bigint, n_repeated bigint"


def _rows(ids: list, urls: list, texts_: list[str], dropped: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts_, pa.string()), pa.array([len(t) for t in texts_], pa.int64()), pa.array(dropped, pa.int64())], ["id", "url", "text", "n_chars", "n_repeated"])


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, list, list, list[str]]]:
    """From rows sorted by the group's columns: their values, ids, urls and pages of each group. Pages without host come one by one."""
    group, ids, urls, pages = [], [], [], []
    for b in batches:
        for *name, i, u, p in zip(*(b.column(c).to_pylist() for c in [*columns, "id", "url", "html"])):
            if ids and (name != group or not name[0]):
                yield group, ids, urls, pages
                ids, urls, pages = [], [], []
            group = name
            ids.append(i)
            urls.append(u)
            pages.append(p or "")
    if ids:
        yield group, ids, urls, pages


def _whole_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, ids, urls, pages in _groups(batches, ["host"]):
        yield _rows(ids, urls, *_cut(pages))


_COUNTS = "host string, name bigint, pages bigint"


def _count_rows(host: str, names: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(names), 100_000):
        part = names[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([host] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(held[k : k + 100_000])], ["host", "name", "pages"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket of a large host: the substrings that ``least`` of its pages or more hold, and the number of those pages."""
    for (host, _, least), _, _, pages in _groups(batches, ["host", "bucket", "least"]):
        streams = Streams(pages)
        at, names = streams.windows()
        held = _page_counts(streams)[at]
        names, first = np.unique(names[held >= least], return_index=True)
        yield from _count_rows(host, names, held[held >= least][first])


def _page_counts(streams: Streams) -> np.ndarray:
    """For every token: the number of distinct pages that hold the substring which begins there (see ``windows``)."""
    return repeated(streams.tokens, streams.page, streams.block, spread=False)


def _by_host(b: pa.RecordBatch) -> Iterator[tuple[str, list[int], Streams]]:
    """The hosts in a batch, the rows of each, and the streams of their pages."""
    pages, of_host = b.column("html").to_pylist(), {}
    for i, host in enumerate(b.column("host").to_pylist()):
        of_host.setdefault(host, []).append(i)
    for host, own in of_host.items():
        yield host, own, Streams([pages[i] or "" for i in own])


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host in a batch: the substrings that are ``asked`` for, and the number of its pages there that hold them."""
    for b in batches:
        for host, own, streams in _by_host(b):
            at, names = streams.windows()
            hit = np.isin(names, np.asarray(b.column("asked")[own[0]].values).view(np.uint64))
            held = np.unique(np.stack([names[hit], streams.page[at[hit]].astype(np.uint64)]), axis=1)[0]
            yield from _count_rows(host, *np.unique(held, return_counts=True))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts pages by their host's repeated substrings; the pages of one host in a batch together."""
    for b in batches:
        texts_, dropped = [""] * b.num_rows, [0] * b.num_rows
        for _, own, streams in _by_host(b):
            at, names = streams.windows()
            ends = np.cumsum(streams.size)
            flags = []
            for c in ("outside", "inside"):
                known = b.column(c)[own[0]].values
                covered = np.zeros(len(streams.tokens) + 1, np.int64)
                hit = at[np.isin(names, np.asarray(known).view(np.uint64))] if known is not None else at[:0]
                np.add.at(covered, hit, 1)
                np.add.at(covered, np.minimum(hit + REPEAT, ends[streams.block[hit]]) if len(hit) else hit, -1)
                flags.append(np.cumsum(covered)[:-1] > 0)
            for i, text, gone in zip(own, *streams.texts(*flags)):
                texts_[i], dropped[i] = text, gone
        yield _rows(b.column("id").to_pylist(), b.column("url").to_pylist(), texts_, dropped)


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", host_bytes: int = HOST_BYTES) -> DataFrame:
    """Per row: id, url, ``text`` (blocks joined by two line breaks; empty where there is none), ``n_chars`` (code points) and
    ``n_repeated`` (words that went as repeats of the host, not as furniture).

    Null and empty html give an empty text. Pages without host (null or malformed urls) are judged alone. Repeated rows count as pages of
    their own; equal pages and ties are cut alike. Extra columns are left out. Very long pages and broken markup take time linear in their length. A host of at most
    ``host_bytes`` is judged by one suffix array in one task; a larger one in buckets of about that size, with the same page counts and texts. Its
    repeats, in number at most the words of a page divided by ``OUTSIDE``, and at most twice as many that are counted once more, are joined to its pages.
    Where pages are so long that buckets hold about six or fewer, every substring is reported, a row for each word.
    """
    small_batches(df.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))
    rows = df.select(host.alias("host"), F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    sizes = rows.where("host <> ''").groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0)).cast("bigint") + 1).alias("bytes"), F.count("*").alias("pages"))
    outside, inside = (F.greatest(F.lit(LEAST_PAGES), F.col("pages") * share) for share in (OUTSIDE, INSIDE))
    # What is reported in no bucket stands on ``least`` - 1 pages of each at most, which must not reach a share: with many buckets for few pages all is reported.
    large = sizes.where(F.col("bytes") > host_bytes).select(F.col("host").alias("large"), "pages", F.ceil(F.col("bytes") / host_bytes).alias("buckets"))
    large = stored(large.withColumn("least", F.when(2 * F.col("buckets") < outside, 2).otherwise(1)), "large-hosts")
    marked = rows.join(large, F.col("host") == F.col("large"), "left")
    small = marked.where("large is null").select("host", "id", "url", "html")
    count = parts(rows, 4 << 20)
    alone = F.when(F.col("host") == "", F.xxhash64("id", "url"))  # pages without host share nothing
    out = small.repartition(count, "host", alone).sortWithinPartitions("host", "id").mapInArrow(_whole_hosts, _OUT)
    if not large.isEmpty():
        of_large = marked.where("large is not null").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))
        counted = of_large.select("host", "bucket", "least", "id", "url", "html").repartition(count, "host", "bucket").sortWithinPartitions("host", "bucket", "id").mapInArrow(_counted, _COUNTS)
        sums = counted.groupBy("host", "name").agg(F.sum("pages").alias("held"), F.count("*").alias("seen")).join(large, F.col("host") == F.col("large"))
        sums = sums.withColumn("most", F.col("held") + (F.col("least") - 1) * (F.col("buckets") - F.col("seen"))).where(F.col("most") >= outside)
        sums = stored(sums.select("host", "name", "held", "most", outside.alias("outside"), inside.alias("inside")), "host-sums")
        unsure = [(F.col("held") < F.col(c)) & (F.col("most") >= F.col(c)) for c in ("outside", "inside")]
        asked = stored(sums.where(unsure[0] | unsure[1]).groupBy(F.col("host").alias("of")).agg(F.collect_list("name").alias("asked")), "host-asked")
        if not asked.isEmpty():
            recounted = of_large.select("host", "html").join(asked, F.col("host") == F.col("of")).select("host", "html", "asked").mapInArrow(_recounted, _COUNTS)
            exact = recounted.groupBy("host", "name").agg(F.sum("pages").alias("exact"))
            sums = sums.join(exact, ["host", "name"], "left").withColumn("held", F.coalesce("exact", "held"))
        names = [F.collect_list(F.when(F.col("held") >= F.col(c), F.col("name"))).alias(c) for c in ("outside", "inside")]
        sets = stored(sums.groupBy(F.col("host").alias("of")).agg(*names), "host-repeats")
        cut = of_large.select("host", "id", "url", "html").join(sets, F.col("host") == F.col("of"), "left").select("host", "id", "url", "html", "outside", "inside").mapInArrow(_applied, _OUT)
        out = out.unionByName(cut)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
