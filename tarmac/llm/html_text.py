"""Main text of web pages, with site templates found by counting element subtrees per host.

1. Every page's block elements, those inside its article too, are hashed with all they hold, and (host, hash)
   pairs are counted in Spark. Only the main element itself and what it stands in are spared, and
   table cells inside it, which say nothing alone (their rows and tables are counted).
2. A subtree that stands beside MIN_DISTINCT different texts on a host's pages is template, and is deleted from
   the pages of that host. What counts is the main text outside the subtree, so that copies of a page count
   once, and a text that fills its page is never a template; how many pages a host has doesn't matter.
   Templates reach pages by (host, hash), whatever number of them a host has.
3. What is left loses scripts, navigation, forms, adverts, notices and reader comments by element and by the
   tokens of class, id and role, unless such an element holds the only article of the page or most of its
   text outside links; if the page has an article or main element, only that counts.

Defined results: null and empty html give an empty text; a page without a host has no templates; repeated rows
count once and are extracted alike; unclosed and stray tags are read as browsers do, roughly; an empty
table gives an empty table; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, slices
from .url_filters import host_of

#: Different main texts beside a subtree that make it a template.
MIN_DISTINCT = 5

#: A comment, a declaration, or a tag; quoted values run to their closing quotes, whatever they hold.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>"'<=]+|[="'])*+)(?:>|(?=<)|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text to the end tag, and never main text.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"}
#: A start tag ends open elements of these kinds, up to the nearest container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What may be a template.
COUNTED = BLOCK - {"html", "head", "body", "br", "hr"}
CELLS = frozenset(("td", "th"))
_PRIME = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % _PRIME
SKIP = frozenset("nav footer aside form button select option dialog menu head object canvas audio video map fieldset datalist".split()) | RAW
#: Words of class, id or role that mark what isn't article text.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "comment comments disqus reply replies widget toolbar pagination pager masthead topbar disclaimer contentinfo complementary search alert paywall".split()
)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


#: Unwanted elements that page builders also put around everything: HOLDS if an article may stand in them only,
#: FULL if most of the page's text may as well.
HOLDS = frozenset("nav footer aside dialog menu".split())
FULL = frozenset("form fieldset header".split())
#: Parts of class names that say nothing: ad-box, comments-area.
FRAME = frozenset("area bar block box container inner list outer section wrap wrapper".split())
#: Marks that stay unwanted however much text they hold.
FIRM = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr popup modal overlay paywall comment comments disqus reply replies".split())


def _marks(attrs: dict[str, str]) -> set[str]:
    """Marks among the tokens of class, id and role: all parts of a token must be marks, or marks and FRAME."""
    found: set[str] = set()
    for token in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower().split():
        parts = {p for p in _PART.findall(token) if len(p) > 1}
        if parts <= MARKED | FRAME:
            found |= parts & MARKED
    return found


def _unwanted(tag: str, attrs: dict[str, str], in_main: bool) -> str:
    """'' if wanted, else 'always', or 'holds' or 'full' for what can make it wanted all the same."""
    hidden = attrs and tag not in ("html", "body", "main") and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")))
    if hidden or tag in SKIP - HOLDS - FULL:
        return "always"
    if tag in HOLDS:
        return "holds"
    if tag in FULL and (tag != "header" or not in_main):
        return "full"
    if tag in ("html", "body", "main") or not attrs:
        return ""
    marks = _marks(attrs)
    return "" if not marks else "full" if FIRM.isdisjoint(marks) else "holds"


class Page:
    """One pass over a page: text pieces with the elements they stand in."""

    def __init__(self, source: str):
        self.source = source
        self._start()
        forgiven = self._read(frozenset())
        if forgiven:
            self._start()
            self._read(forgiven)

    def _start(self) -> None:
        #: (tag, start, end, hash, is outermost main, holds main) of block elements that aren't unwanted.
        self.elements: list[tuple[str, int, int, int, bool, bool]] = []
        #: (at, text or None for a block's edge, in main, unwanted)
        self.pieces: list[tuple[int, str | None, bool, bool]] = []
        self.has_main = False
        self.mains = self.articles = 0

    def _read(self, forgiven: frozenset[int]) -> frozenset[int]:
        """Read the page; starts of unwanted elements that should be forgiven in a second reading."""
        s, at, stack = self.source, 0, []  # stack: [tag, start, in main, unwanted, holds main, is outermost main, hash before, length before, always unwanted, why, amount before, mains before]
        main = bad = never = False
        amount = lost = links = 0  # letters outside links that aren't always unwanted, mains in unwanted elements, open links
        soft: list[tuple[int, str, int, int]] = []
        h = n = 0  # polynomial hash and number of the tokens so far, so that any stretch's hash is one subtraction
        powers = [1]

        def token(a: int, b: int) -> None:
            nonlocal h, n
            words = s[a:b].split()
            if words:
                h = (h * _BASE + xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))) % _PRIME
                n += 1
                powers.append(powers[-1] * _BASE % _PRIME)

        def close(i: int, end: int) -> None:
            nonlocal main, bad, never, links
            while len(stack) > i:
                tag, start, in_main, wrong, holds, outermost, h0, n0, _, why, amount0, lost0 = stack.pop()
                links -= tag == "a"
                if why:
                    soft.append((start, why, amount - amount0, lost - lost0))
                if tag in COUNTED and not wrong:
                    self.elements.append((tag, start, end, (h - h0 * powers[n - n0]) % _PRIME, outermost, holds and not in_main))
                if holds and stack:
                    stack[-1][4] = True
            main, bad, never = (stack[-1][2], stack[-1][3], stack[-1][8]) if stack else (False, False, False)

        def edge(where: int) -> None:
            self.pieces.append((where, None, main, bad))

        while at < len(s):
            m = _TAG.search(s, at)
            if not m:
                break
            if m.start() > at:
                self.pieces.append((at, s[at : m.start()], main, bad))
                token(at, m.start())
                if not (never or links):
                    amount += len("".join(s[at : m.start()].split()))
            at = m.end()
            if m[2] is None:
                token(m.start(), at)
                continue
            tag = m[2].lower()
            if m[1]:
                i = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                if tag in BLOCK:
                    edge(m.start())
                token(m.start(), at)
                if i >= 0:
                    close(i, at)
                continue
            if tag in BLOCK:
                edge(m.start())
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(s, at)
                at = end.end() if end else len(s)
                token(m.start(), at)
                continue
            if tag in ENDS_P:
                self._end(stack, ("p",), close, m.start())
            if tag in ENDS:
                self._end(stack, ENDS[tag], close, m.start())
            h0, n0 = h, n
            token(m.start(), at)
            if tag in VOID or m[3].endswith("/"):
                continue
            attrs = _attributes(m[3])
            why = "" if m.start() in forgiven else _unwanted(tag, attrs, main)
            wrong = bad or why != ""
            is_main = tag in ("article", "main") or attrs.get("role") == "main"
            inside = main or is_main and not wrong
            outermost = inside and not main
            stack.append([tag, m.start(), inside, wrong, inside, outermost, h0, n0, never or why == "always", "" if why == "always" else why, amount, lost])
            never = stack[-1][8]
            links += tag == "a"
            lost += is_main and wrong and not never
            self.mains += outermost
            self.articles += inside and tag == "article"
            self.has_main |= inside
            main, bad = inside, wrong
        if at < len(s):
            self.pieces.append((at, s[at:], main, bad))
            token(at, len(s))
            if not (never or links):
                amount += len("".join(s[at:].split()))
        close(0, len(s))
        return frozenset(start for start, why, n_own, mains in soft if (mains and not self.has_main) or (why == "full" and 2 * n_own > amount))

    @staticmethod
    def _end(stack: list, tags: tuple, close, at: int) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                close(k, at)
                return
            if stack[k][0] in BLOCK and stack[k][0] not in ("td", "th", "li", "dd", "dt", "p") or stack[k][0] in ("table", "ul", "ol", "dl"):
                return

    def subtrees(self) -> dict[int, list[tuple[int, int]]]:
        """Hash of each element that may be a template: where it stands.

        Spared are elements around a main one, the main one itself and the only article in it. With several
        main ones, such as teasers in a row, none is the page's own.
        """
        found: dict[int, list[tuple[int, int]]] = {}
        for tag, a, b, h, outermost, around in self.elements:
            if around or (outermost and self.mains == 1) or (tag == "article" and self.articles == 1) or (tag in CELLS and self.has_main):
                continue
            found.setdefault(h, []).append((a, b))
        return found

    def bodies(self) -> set[tuple[int, int]]:
        """(hash of an element, hash of the main text outside it); elements without main or wanted text don't occur."""
        at = [p[0] for p in self.pieces]
        words = [None if t is None or bad else " ".join(html.unescape(t).split()) for _, t, _, bad in self.pieces]
        hashes = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) if w else 0 for w in words]
        # Sums over the pieces up to each: of what is shown, and of what holds any text.
        shown = [0, *accumulate(h if in_main or not self.has_main else 0 for h, (_, _, in_main, _) in zip(hashes, self.pieces, strict=True))]
        filled = [0, *accumulate(map(bool, hashes))]
        found = set()
        for h, places in self.subtrees().items():
            spans = [(i, j) for i, j in ((bisect_left(at, a), bisect_left(at, b)) for a, b in places) if filled[j] > filled[i]]
            if spans:
                outside = shown[-1] - sum(shown[j] - shown[i] for i, j in spans)
                found.add((h, (outside & (1 << 64) - 1) - (1 << 63)))
        return found

    def text(self, templates: frozenset | set = frozenset()) -> str:
        """Main text without template subtrees."""
        gone = sorted(p for h, places in self.subtrees().items() if h in templates for p in places) if templates else []
        out, k, reach = [], 0, -1
        for at, piece, in_main, unwanted in self.pieces:
            while k < len(gone) and gone[k][0] <= at:
                reach = max(reach, gone[k][1])
                k += 1
            if unwanted or at < reach or (self.has_main and not in_main):
                out.append(" ")
            else:
                out.append(" " if piece is None else html.unescape(piece))
        return " ".join("".join(out).split())


def _page() -> Column:
    """Stands for a row; repeated rows have the same."""
    return F.xxhash64("page_id", "url", "html")


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page, hash, body: each element of each page with a hash of the main text outside it."""

    def run(batches):
        for b in slices(batches, "html"):
            rows = [(host, page, *x) for host, page, source in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html")), strict=True) for x in Page(source).bodies()]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "page", "hash", "body"])

    hosted = pages.select(host_of(F.col("url")).alias("host"), _page().alias("page"), "html").where("host <> '' and html <> ''")
    return hosted.mapInArrow(run, "host string, page long, hash long, body long")


def templates(found: DataFrame, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """host, hash of template subtrees."""
    return found.select("host", "hash", "body").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_distinct).select("host", "hash")


def main_texts(pages: DataFrame, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Spark broadcasts written tables if they are small, and merges otherwise, where a partition can be split.
    """
    ws = Workspace(pages.sparkSession, "html-text")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = ws.write(subtrees(pages), "subtrees")
    known = ws.write(templates(found, min_distinct), "templates")
    own = ws.write(found.select("host", "page", "hash").join(known, ["host", "hash"], "left_semi").groupBy("page").agg(F.collect_set("hash").alias("hashes")), "page-templates")

    def run(batches):
        for b in slices(batches, "html"):
            texts = [Page(s).text(set(t or ())) if s else "" for s, t in zip(b.column("html").to_pylist(), b.column("hashes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = pages.withColumn("page", _page()).join(own, "page", "left").select("page_id", "url", "html", "hashes")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
