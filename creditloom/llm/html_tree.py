"""Main text of web pages with a site style tree.

Every page becomes a small tree of elements (tag and classes) and text blocks.
The trees of a host are merged: an element's place is its path of tags and
classes, its presentations are the sequences of child tags seen there, its
contents the texts of its blocks.

* Content importance of a place: one minus the mean entropy of its texts, where a
  text found on c of the m pages that have the place has entropy log_m(c). Texts
  that all pages share give 0, texts of one page each give 1.
* Presentation importance of a place: the entropy, base m, of its presentations.
* Importance of a branch: ``(1 - GAMMA^l)`` of the presentation importance plus
  ``GAMMA^l`` of the mean content importance below it, for l presentations.

Blocks whose place and branch both lie below LOW are removed from each page.
Pages count once per distinct content, and places on fewer than LEAST distinct
pages are left alone, so copies of a page do not make its text look like a frame.

Entropy cannot tell an advert or menu with a new text on every page from an
article, so markup decides first: elements that name their role (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles) have no
importance, and text straight below an article or main element has full
importance. A class or id names a role only as a whole and only on a container;
one that merely holds such a word leaves its element to the tree, and so does
the id of a section or list item in an article. The tree decides the rest:
classed boxes inside an article, and whole pages without such an element.

Counting is by partial sums on (host, path, text hash), so a hot host is no
single task's work; each host's few unimportant paths are joined to those pages
only that have an undecided block. Null, empty and unparsable html gives an empty
text; unclosed elements end with their parents; a tag cut off at the end of the
page is left out; a malformed declaration or marked section counts as a comment.
Rows that repeat a page count once in the tree and each give their text. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.rows import texts
from creditloom.llm.url_filter import parts
from creditloom.session import materialize

GAMMA, LOW, LEAST = 0.9, 0.2, 8

# Names of HTML elements and of page roles.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title template noscript iframe object svg canvas select textarea button datalist".split())
ROLES = frozenset("nav header footer aside form dialog menu".split())
MAIN = ("article", "main")
ROLE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer"
    " discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification"
    " notifications overlay pagination pager popup promo promotion promoted related replies reply respond search share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
# Words that say where or how large, beside a role word in the same name (share-buttons, site-header).
PART_WORDS = frozenset(
    "area bar bars block bottom box button buttons container global group icons inner item items link links list main page panel primary"
    " secondary section site slot strip top unit wrap wrapper zone".split()
)
# Elements that a class or id can give a role; headings, paragraphs and inline elements are text of what they stand in.
CONTAINERS = frozenset("div section ul ol li dl table tbody tr td fieldset figure details center".split())
ARIA = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation note search status".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption hgroup article main"
    " address details summary center".split()
)

DROPPED, KEPT, OPEN = 0, 1, 2


def names_role(name: str) -> bool:
    """Whether a whole class or id names a role, and not only holds a role's word (with-sidebar, related-work)."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in ROLE_WORDS for w in words) and all(w in ROLE_WORDS or w in PART_WORDS for w in words)


def digest(*parts_of: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts_of).encode("utf-8", "replace")) - (1 << 63)


class Page(HTMLParser):
    """Elements in page order (parent, tag, classes) and the text pieces of each block.

    Open elements are found by their tag's own list of depths and by the innermost
    block at each depth, so a page of any nesting is read in time linear in its length.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.role, self.classes = [-1], ["#page"], [False], [""]
        self.holds_main = [False]
        self.stack, self.inner = [0], [0]
        self.depths: dict[str, list[int]] = {}
        self.children: dict[int, list[str]] = {}
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self.pieces: list[tuple[int, str]] = []

    def parse_marked_section(self, i, report=1):
        """A marked section counts as a comment up to the next ``>``, whatever it holds."""
        return self.parse_bogus_comment(i, 0)

    def _flush(self) -> None:
        if self.pieces:
            self.blocks.append((self.inner[-1], self.pieces))
            self.pieces = []

    def _innermost(self, names) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _close(self, depth: int) -> None:
        """Close all elements from this depth on."""
        if self.inner[-1] != self.inner[depth - 1]:
            self._flush()
        while len(self.stack) > depth:
            self.depths[self.tag[self.stack.pop()]].pop()
            self.inner.pop()

    def _close_innermost(self, names, border=()) -> None:
        """Close the innermost open element of these names, unless a border element is open inside it."""
        depth = self._innermost(names)
        if depth > (self._innermost(border) if border else 0):
            self._close(depth)

    def _close_block(self, names) -> None:
        """Close the innermost block if it has one of these names."""
        if self.tag[self.inner[-1]] in names:
            self._close(self._innermost({self.tag[self.inner[-1]]}))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
            if tag not in ("html", "body"):
                self._close_block({"p"})
            if tag in HEADINGS:
                self._close_block(HEADINGS)
        if tag in CLOSED_BY:
            names, border = CLOSED_BY[tag]
            self._close_innermost(names, border)
        if tag == "br":
            self.pieces.append((self.stack[-1], " "))
        own = len(self.tag)
        given = dict(attrs)
        classes = (given.get("class") or "").lower()
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        names = classes.split()
        if not (tag in ("section", "li") or "section" in names) or not self._innermost(MAIN):
            # Ids of sections and items of an article are made from their headings.
            names += (given.get("id") or "").lower().split()
        named = tag in CONTAINERS and any(map(names_role, names))
        self.role.append(named or tag in ROLES or (given.get("role") or "").lower() in ARIA)
        self.classes.append(" ".join(sorted(re.sub(r"\d+", "#", classes).split())))
        self.holds_main.append(False)
        self.children.setdefault(self.stack[-1], []).append(tag)
        if tag in MAIN:
            for e in reversed(self.stack):
                if self.holds_main[e]:  # so do all above it
                    break
                self.holds_main[e] = True
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.stack))
            self.stack.append(own)
            self.inner.append(own if tag in BLOCKS else self.inner[-1])

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        if tag not in VOID:
            self._close_innermost({tag})

    def handle_data(self, data):
        self.pieces.append((self.stack[-1], data))


def _whole_tags(html: str) -> str:
    """The page without a tag that its end cuts off: what follows the last ``>`` is read up to the next opening of a tag."""
    end = html.rfind(">") + 1
    cut = re.compile(r"<(?=[A-Za-z/!?]|\Z)").search(html, end)
    return html[: cut.start()] if cut else html


def read_page(html: str) -> list[tuple[int, int, int, int, int, str]]:
    """(path, branch, presentation of the branch, text hash, state, text) of every block with text, in page order."""
    page = Page()
    page.feed(_whole_tags(html))
    page.close()
    page._flush()
    count = len(page.tag)
    dropped, path, main, plain = [False] * count, [0] * count, [""] * count, [False] * count
    for e in range(1, count):
        up, tag = page.parent[e], page.tag[e]
        role = page.role[e] and tag not in ("html", "body")
        dropped[e] = dropped[up] or tag in SILENT or role and not page.holds_main[e]
        path[e] = digest(str(path[up]), tag, page.classes[e])
        main[e] = "" if dropped[e] else tag if tag == "article" or tag == "main" and main[up] != "article" else main[up]
        plain[e] = tag in MAIN or plain[up] and (tag not in BLOCKS or tag in PLAIN and not page.classes[e])
    wanted = next((m for m in MAIN if m in main), "")
    shapes: dict[int, int] = {}
    out = []
    for owner, pieces in page.blocks:
        kept = " ".join("".join(t for e, t in pieces if not dropped[e]).split())
        whole = kept or " ".join("".join(t for _, t in pieces).split())
        if not whole:
            continue
        if not kept or wanted and main[owner] != wanted:
            state = DROPPED
        else:
            state = KEPT if wanted and plain[owner] else OPEN
        branch = max(page.parent[owner], 0)
        if branch not in shapes:
            shapes[branch] = digest(*(t for t, _ in groupby(page.children.get(branch, ()))))
        out.append((path[owner], path[branch], shapes[branch], digest(whole), state, kept if state else None))
    return out


_BLOCK = "path long, branch long, shape long, content long, state int, text string"
_BLOCK_ARROW = pa.struct(
    [(n, t) for n, t in zip(("path", "branch", "shape", "content", "state", "text"), [pa.int64()] * 4 + [pa.int32(), pa.string()], strict=True)]
)


def read_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``blocks``, ``open`` (undecided blocks), ``print`` (hash of all contents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _BLOCK_ARROW]
        for batch in batches:
            rows = [read_page((h or b"").decode("utf-8", "replace")) for h in texts(batch, "html")]
            blocks = pa.array([[dict(zip(names, b, strict=True)) for b in r] for r in rows], pa.list_(_BLOCK_ARROW))
            opened = pa.array([sum(b[4] == OPEN for b in r) for r in rows], pa.int32())
            prints = pa.array([digest(*(str(b[3]) for b in r)) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], blocks, opened, prints], ["page_id", "url", "host", "blocks", "open", "print"]
            )

    host = parts(F.col("url"))[0].alias("host")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host, "html")
    return read.mapInArrow(run, f"page_id long, url string, host string, blocks array<struct<{_BLOCK}>>, open int, print long")


def site_tree(read: DataFrame) -> DataFrame:
    """``host``, ``branch``, ``path``, ``pages``, ``content_importance``, ``importance`` of every place of every host."""
    once = read.select("host", "print", F.explode("blocks").alias("b")).select("host", "print", "b.path", "b.branch", "b.shape", "b.content")
    place = ["host", "branch", "path"]
    # Distinct page contents; the sums over them need no second look at single texts, so no hot place is joined.
    pages = once.select(*place, "print").distinct().groupBy(place).agg(F.count("*").alias("pages"))
    contents = once.select(*place, "content", "print").distinct().groupBy(*place, "content").agg(F.count("*").alias("c"))
    spread = contents.groupBy(place).agg(F.avg(F.log("c")).alias("mean_log"))
    content = F.when(F.col("pages") > 1, 1 - F.col("mean_log") / F.log("pages")).otherwise(1.0)
    leaf = spread.join(pages, place).select(*place, "pages", content.alias("content_importance"))
    shapes = once.select("host", "branch", "shape", "print").distinct().groupBy("host", "branch", "shape").agg(F.count("*").alias("c"))
    looks = shapes.groupBy("host", "branch").agg(
        F.count("*").alias("l"), F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("c_log_c")
    )
    look = F.when(F.col("m") > 1, 1 - F.col("c_log_c") / F.col("m") / F.log("m")).otherwise(1.0)
    below = leaf.groupBy("host", "branch").agg(F.avg("content_importance").alias("inner"))
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    branches = looks.join(below, ["host", "branch"]).select(
        "host", "branch", ((1 - weight) * look + weight * F.col("inner")).alias("importance")
    )
    return leaf.join(branches, ["host", "branch"])


def unimportant(tree: DataFrame) -> DataFrame:
    """``host``, ``noise``: the paths of each host that are removed."""
    low = tree.filter((F.col("pages") >= LEAST) & (F.col("content_importance") < LOW) & (F.col("importance") < LOW))
    return low.groupBy("host").agg(F.collect_set("path").alias("noise"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    read = materialize(read_pages(pages), "pages")
    undecided = read.filter("open > 0")
    noise = unimportant(site_tree(read.filter("host is not null")).filter("path is not null"))
    judged = undecided.join(noise, "host", "left")
    keep = lambda b: (b["state"] == KEPT) | (b["state"] == OPEN) & ~F.coalesce(F.array_contains("noise", b["path"]), F.lit(False))
    chosen = judged.select("page_id", "url", F.filter("blocks", keep).alias("blocks")).union(
        read.filter("open = 0").select("page_id", "url", F.filter("blocks", lambda b: b["state"] == KEPT).alias("blocks"))
    )
    text = F.concat_ws("\n\n", F.transform("blocks", lambda b: b["text"]))
    return chosen.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
