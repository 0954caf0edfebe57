"""Main text of web pages by consensus host paths.

1. Each page's containers are scored: the characters of the text blocks they hold, less those in links.
2. The containers vote, by host, for their generalised path: tags and classes, digits taken out, positions
   left out. Votes are summed in Spark before they are shuffled, so a host with most pages is one row.
3. The winning path of each host goes back to its pages, and the text is taken from the elements that it
   names; a page without such an element gives the text of its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and hidden elements are left
out by tag, role and the words of class and id.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64  # last steps of a path that name a container, however deep it lies
BROADCAST_HOSTS = 200_000  # hosts whose paths are sent to every executor at most; more are joined

# HTML's element kinds and the words that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("aside button canvas datalist dialog embed fieldset footer form head iframe input label menu nav noscript object script select style svg template textarea title".split())
WHOLE = frozenset(("article", "main"))
CLOSES = {  # a start tag ends an open one of these
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = frozenset("html body article aside main section div table td th ul ol dl blockquote form nav footer header".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar header comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations pagination pager login widget skip toolbar copyright".split()
)
# Marks that tell what a heading or paragraph is about, not that it is none of the text.
TOPICS = frozenset("header masthead comment comments notice social related recommended recommendations widget reply replies share sharing respond overlay login menu banner".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd td th pre blockquote figcaption caption b i em strong span a code mark u s small sub sup time cite q".split())
LISTS = frozenset("ul ol menu".split())

# A tag from its name on: attributes whose values are quoted, or run to white space or the end of the tag. No part
# is tried twice, so that a page is read in linear time.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(>?)")
ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text.strip(" /"):
        for m in ATTR.finditer(text):
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _skipped(tag: str, attrs: dict[str, str], inside_whole: bool) -> bool:
    if tag in SKIP or tag == "header" and not inside_whole:
        return True
    if not attrs:
        return False
    if tag in WHOLE or tag in ("html", "body"):
        return "hidden" in attrs
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if tag in TEXTUAL:  # a name that only holds a mark, as related-work does, says what the text is about
        return any(w in MARKS and w not in TOPICS for w in named.lower().split())
    found = {w.lower() for w in WORD.findall(named)} & MARKS
    return bool(found - {"header"} if inside_whole else found)


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A path's step: tag and sorted classes without digits."""
    classes = sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


class Page:
    """blocks: (container, text, link characters, list) in page order; containers: (path, enclosing containers).

    An element is (tag, container that its blocks belong to, whether it is left out, whether a link, outermost list).
    Of open elements the places by tag are kept, so that an end tag finds its start at once at any depth.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, int, int]] = []
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.whole: list[int] = [-1]  # the nearest article or main, itself included
        self._open: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        self._places: dict[str, list[int]] = defaultdict(list)
        self._parts: list[str] = []
        self._linked = 0
        self._block = (0, 0)
        self._lists = 0
        self._read(source)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            self.blocks.append((self._block[0], text, self._linked, self._block[1]))
        self._parts, self._linked = [], 0

    def _text(self, text: str) -> None:
        _, container, skipped, link, listed = self._open[-1]
        if skipped or not text:
            return
        if not self._parts:
            self._block = (container, listed)
        self._parts.append(text)
        if link:
            self._linked += len(text)

    def _close(self, at: int) -> None:
        """Ends open elements from place at on."""
        if any(tag in BLOCK for tag, *_ in self._open[at:]):
            self._flush()
        for tag, *_ in self._open[at:]:
            self._places[tag].pop()
        del self._open[at:]

    def _end(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Ends the last open element of the tag, unless one of within was opened after it."""
        places = self._places.get(tag)
        if places and not any(self._places.get(t, ()) and self._places[t][-1] > places[-1] for t in within):
            self._close(places[-1])

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCK:
            self._flush()
            self._end("p", SCOPE)
            for other in CLOSES.get(tag, ()):
                self._end(other, SCOPE - {"td", "th"} if other not in ("td", "th") else frozenset(("table",)))
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        _, container, skipped, link, listed = self._open[-1]
        skipped = skipped or _skipped(tag, attrs, self.whole[container] >= 0)
        if tag in BLOCK and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "ul", "ol", "dl", "tr", "tbody", "thead", "tfoot", "td", "th", "figure", "figcaption", "caption", "header", "hgroup") and not skipped:
            path = f"{self.paths[container]}>{_step(tag, attrs)}" if container else _step(tag, attrs)
            if path.count(">") >= STEPS:
                path = path.split(">", 1)[1]
            self.paths.append(path)
            self.parents.append(container)
            own = len(self.paths) - 1
            self.whole.append(own if tag in WHOLE else self.whole[container])
            container = own
        if tag in LISTS and not listed:
            self._lists += 1
            listed = self._lists
        self._places[tag].append(len(self._open))
        self._open.append((tag, container, skipped, link or tag == "a", listed))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            self._text(source[at : start if start >= 0 else n])
            if start < 0:
                break
            if source.startswith("<!--", start):
                end = source.find("-->", start + 2)  # <!--> is a whole comment
                at = n if end < 0 else end + 3
                continue
            m = TAG.match(source, start)
            if m is None:
                if source[start + 1 : start + 2] in ("!", "?", "/") and start + 2 < n:
                    end = source.find(">", start)
                    at = n if end < 0 else end + 1
                else:
                    self._text("<")
                    at = start + 1
                continue
            if not m[4]:  # a tag that never ends takes the rest of the page
                break
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if tag == "br":
                    self._text(" ")
                elif tag == "p" and not self._places.get("p"):
                    self._flush()
                else:
                    self._end(tag, frozenset(("article", "main")) - {tag} if tag not in ("html", "body") else frozenset())
            else:
                self._start(tag, _attributes(m[3]))
                if tag in RAW and not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}[^>]*+>", re.I).search(source, at)
                    self._end(tag)
                    at = end.end() if end else n
        self._flush()

    def scores(self) -> Counter:
        """Container -> score. Text counts for its article or main if it has one, links and all; else, less its links, for its container and half for the next."""
        out: Counter = Counter()
        for container, text, linked, _ in self.blocks:
            if self.whole[container] >= 0:
                out[self.whole[container]] += len(text)
            else:
                out[container] += len(text) - 2 * linked
                if self.parents[container] > 0:
                    out[self.parents[container]] += (len(text) - 2 * linked) / 2
        return out

    def votes(self) -> Counter:
        """Path -> the best score of its containers, for containers near the best."""
        scores = self.scores()
        best = max(scores.values(), default=0)
        out: Counter = Counter()
        for container, score in scores.items():
            if score > 0 and score >= best / 2:
                out[self.paths[container]] = max(out[self.paths[container]], score)
        return out

    def text(self, path: str | None) -> str:
        """The text under the elements of a path, or under the page's own best container."""
        chosen = {i for i, p in enumerate(self.paths) if p == path} if path is not None else set()
        kept = self._under(chosen)
        if not kept:
            scores = self.scores()
            if scores:
                kept = self._under({max(scores, key=lambda c: (scores[c], -c))})
        return "\n\n".join(kept)

    def _under(self, chosen: set[int]) -> list[str]:
        """The blocks inside the chosen containers, without lists that are links throughout and stand in no article: menus."""
        inside = [False] * len(self.paths)
        for i in range(len(self.paths)):
            inside[i] = i in chosen or (i > 0 and self.parents[i] >= 0 and inside[self.parents[i]])
        said, linked = Counter(), Counter()
        for _, text, links, listed in self.blocks:
            said[listed] += len(text)
            linked[listed] += links
        menus = {listed for listed in said if listed and linked[listed] >= 0.9 * said[listed]}
        return [text for container, text, _, listed in self.blocks if inside[container] and (listed not in menus or self.whole[container] >= 0)]


VOTES = "host string, path string, score double"
TEXT = "page_id long, url string, text string"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def winners(pages: DataFrame) -> DataFrame:
    """The path with most votes of each host: host, path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for host, source in zip(b.column(0), b.column(1), strict=True):
                for path, score in Page(source.as_py() or "").votes().items():
                    total[host.as_py(), path] += score
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array([float(s) for s in total.values()], pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, VOTES)
    return votes.groupBy("host", "path").agg(F.sum("score").alias("score")).groupBy("host").agg(F.max_by("path", F.struct(F.round("score").alias("score"), F.length("path").alias("n"), "path")).alias("path"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by an empty line; empty if there is none) for every row of pages.

    Null html is an empty page, a null or odd url belongs to the host "". Repeated rows give repeated
    results; pages of any length are read whole. Extra columns are unread.
    """
    from chronoloom.llm._shared import cut

    best = cut(winners(pages))
    best = F.broadcast(best) if best.count() <= BROADCAST_HOSTS else best
    given = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host")).join(best, F.col("_host") == F.col("host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = [Page(source.as_py() or "").text(path.as_py()) for source, path in zip(part.column(2), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return given.select("page_id", "url", "html", "path").mapInArrow(run, TEXT)
