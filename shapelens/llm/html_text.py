"""Main text of web pages by consensus container paths of their host.

First pass: each page is read into blocks of text inside containers (article,
main, section, div, ...), without parts that are menus, footers, adverts, forms
and so on by their tag, role, class or id; class and id are weighed against the
text, so that no word there takes out most of a page. A container's path is the
list of tags and classes down to it, without digits, so that pages of one template
share it; a block's key is its container's path and its own element (``h1``, ``p.lead``).
Each page votes with its text by path and by key: its share of the page, how much
of it is no link, where on the page it begins and ends, and a digest. Spark adds the votes up by host, equal pages once for the digests:

* a path or key on several pages with the same text on most of them is repeated;
* a path's score is the text at it and below it, less links and repeated paths, nine
  tenths for each level between; the path with the largest score of a host wins;
* a key outside the winner is kept if it isn't repeated nor mostly links, and begins,
  on average, before the winner's end (titles, leads, parts between) or holds at least
  a tenth of the winner's text (a second region).

Second pass: the text below every container at its host's winning path, but for
repeated containers in there, and the blocks outside with a kept key. Blocks
directly in the winning container stay whether they repeat or not. In a page where
the winner holds less than half of the text of the page's own best container, that one
counts as well. Paths and keys on fewer than ``LEAST`` pages or one page in ``SUPPORT``
of their host have no votes; a page judges them by its own text, so a
host's votes are few, however many pages and class names it has.

Text blocks end where a block element begins or ends. Character references are
decoded, white space in a block is one space, blocks are joined by one newline.

Edge cases: null, empty and text-free pages give the empty text; pages without
a host (null URL or none in it) vote together; equal scores go to the smaller
path; containers more than ``DEEPEST`` levels down share the path of the one there;
a page cut off inside a tag or comment ends there; repeated rows come out each;
other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelens.llm.common import ascii_lower, pieces, scratch_name, shared_table, tidy

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^\"'>]++)*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: A start tag ends an open element of these names, if no container or list stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("article aside body details div dl fieldset figure footer form header html main menu nav ol "
                   "section table td th ul".split())

DROPPED_TAGS = frozenset("aside audio button canvas dialog footer menu nav object select svg video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu navigation search".split())
#: Words in a class or id that mark parts beside the article; the second list as beginnings.
DROPPED_WORDS = frozenset(
    "ad ads aside consent cookie footer gdpr legal login menu modal nav notice notices overlay pager popup promo "
    "respond replies reply share signup social toolbar topbar tracking widget widgets".split())
DROPPED_STARTS = ("adsense", "advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "masthead", "navbar",
                  "navig", "newsletter", "notification", "pagina", "promo", "recommend", "related", "sharing",
                  "sidebar", "sponsor", "subscri")
#: Words that begin like the ones above and mean something else.
OTHER_WORDS = frozenset("commentaries commentary commentator pagina paginas relatedness".split())
#: Of the words above, those that stand in the class or id of text as well: such an element goes if it is short or mostly links.
WEAK_WORDS = frozenset("legal notice notices widget widgets".split())
WEAK_STARTS = ("notification", "recommend", "related")
#: Characters beside links that keep an element marked by a weak word.
ENOUGH = 140
HEADS = frozenset(("banner", "header"))
ARTICLE_WORDS = frozenset("article content entry main post story text body".split())

#: A path needs this many pages of its host, and one page in ``SUPPORT``, for votes.
LEAST, SUPPORT = 3, 100
#: Containers below this level share the path of the one at it.
DEEPEST = 48
#: Weight of a container by its tag, in its score.
WEIGHTS = {"article": 1.5, "main": 1.3, "body": 0.7, "html": 0.5}
#: Part of a container's score that the one around it gets.
FADE = 0.9
#: Parts of the winner's text that a region after it needs: one in so many.
REGION = 10


class Page:
    """Containers (parent, path, weight) and text blocks (text, characters outside links, container) of a page."""

    def __init__(self, source: str):
        self.containers: list[tuple[int, str, float]] = [(-1, "", 0.5)]
        self.blocks: list[tuple[str, int, int]] = []
        self.headings: set[int] = set()  # numbers of blocks
        self.loose: set[int] = set()  # blocks outside every block element
        self.elements: list[str] = []  # of each block: its element inside the container
        self._open: list[tuple[str, int, bool, int, str]] = []  # name, container, dropped, mark, element
        self._marks: list[tuple[int, str]] = []  # parent, kind of the marked elements
        self._marked: list[int] = []  # of each block
        self._articles: set[int] = set()  # marks around an article or main
        self._text: list[str] = []
        self._linked = 0
        self._links = 0
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                at = self._open[-1][1] if self._open else 0
                if any(x[0] in HEADINGS for x in self._open):
                    self.headings.add(len(self.blocks))
                if not any(x[0] in BLOCKS for x in self._open):
                    self.loose.add(len(self.blocks))
                self._marked.append(self._open[-1][3] if self._open else -1)
                self.elements.append(self._open[-1][4] if self._open else "")
                self.blocks.append((text, max(0, len(text) - self._linked), at))
            self._text, self._linked = [], 0

    def _add(self, text: str) -> None:
        if text and not (self._open and self._open[-1][2]):
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _close(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        if any(name in BLOCKS for name, *_ in self._open[i:]):
            self._flush()
        self._links -= sum(name == "a" for name, *_ in self._open[i:])
        del self._open[i:]

    def _find(self, names: set[str] | frozenset[str], scopes: frozenset[str]) -> int | None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in names:
                return i
            if self._open[i][0] in scopes:
                return None
        return None

    def _begin(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            if (i := self._find({"p"}, SCOPES)) is not None:
                self._close(i)
            self._flush()
        if name in ENDS and (i := self._find(ENDS[name], SCOPES - ENDS[name])) is not None:
            self._close(i)
        if name == "br":
            self._add("\n")
        if name in VOID:
            return
        at, dropped, mark, element = self._open[-1][1:] if self._open else (0, False, -1, "")
        words: set[str] = set()
        classes = ""
        if rest and not dropped:
            for m in ATTRIBUTE.finditer(rest):
                value = m[2] or m[3] or m[4] or ""
                kind = m[1].lower()
                if kind in ("class", "id"):
                    classes += f" {value}" if kind == "class" else ""
                    words.update(w.lower() for w in TOKEN.findall(value))
                elif kind == "role":
                    dropped = dropped or value.lower() in DROPPED_ROLES
                elif kind == "style":
                    dropped = dropped or "display:none" in re.sub(r"\s", "", value.lower())
                elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                    dropped = True
        if not dropped:
            dropped = name in DROPPED_TAGS
        if not dropped:
            kind = self._beside(name, words, at)
            if kind:
                self._marks.append((mark, kind))
                mark = len(self._marks) - 1
            elif name in ("article", "main") and mark >= 0:
                self._articles.add(mark)
        if name in CONTAINERS and not dropped:
            element = ""
            label = ".".join([name, *sorted({re.sub(r"\d+", "", c) for c in classes.split()} - {""})])
            around = self.containers[at][1]
            path = f"{around}>{label}" if around.count(">") < DEEPEST else around
            self.containers.append((at, path, WEIGHTS.get(name, 1.0)))
            at = len(self.containers) - 1
        elif name in BLOCKS and not dropped:
            element = ".".join([name, *sorted({re.sub(r"\d+", "", c) for c in classes.split()} - {""})])
        self._links += name == "a"
        self._open.append((name, at, dropped, mark, element))

    def _beside(self, name: str, words: set[str], at: int) -> str:
        """How an element of that name, with these words in class and id, is marked as beside the article, if so."""
        if name in ("html", "body"):
            return ""
        words = words - OTHER_WORDS
        if any(w.startswith("comment") for w in words):
            return "plain" if name in ("article", "main") else "comment"
        if name in ("article", "main"):
            return ""
        if name == "form":
            return "plain"
        if name == "header" or words & HEADS and not words & ARTICLE_WORDS:
            inside = f"{self.containers[at][1]}>"
            return "" if ">article" in inside or ">main" in inside else "plain"
        found = {w for w in words if w in DROPPED_WORDS or w.startswith(DROPPED_STARTS)}
        weak = {w for w in found if w in WEAK_WORDS or w.startswith(WEAK_STARTS)}
        return "plain" if found - weak else "weak" if weak else ""

    def _drop_marked(self) -> None:
        """Takes out the blocks of marked elements, but for those that hold the page's text.

        An element stays that holds an article or main, or most of the page's
        text beside links; comments, which may be longer than the article, stay
        if next to nothing else is there; an element with a weak mark also stays
        if it is no short text and no list of links.
        """
        if not self._marks:
            return
        n = len(self._marks)
        size, held = [0] * n, [0] * n
        for (text, own, _), m in zip(self.blocks, self._marked):
            if m >= 0:
                size[m] += len(text)
                held[m] += own
        around = [m in self._articles for m in range(n)]
        for m in range(n - 1, -1, -1):  # parents come before their children
            up, kind = self._marks[m]
            if up >= 0:
                size[up] += size[m]
                held[up] += held[m]
                around[up] = around[up] or around[m] and kind != "comment"
        total = sum(own for _, own, _ in self.blocks)
        gone = [False] * n
        for m, (up, kind) in enumerate(self._marks):
            most = 10 * held[m] > 9 * total if kind == "comment" else 2 * held[m] > total
            text = kind == "weak" and held[m] >= ENOUGH and 2 * held[m] >= size[m]
            gone[m] = up >= 0 and gone[up] or not (most or text or around[m] and kind != "comment")
        stay = [i for i, m in enumerate(self._marked) if m < 0 or not gone[m]]
        self.headings = {k for k, i in enumerate(stay) if i in self.headings}
        self.loose = {k for k, i in enumerate(stay) if i in self.loose}
        self.blocks = [self.blocks[i] for i in stay]
        self.elements = [self.elements[i] for i in stay]

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            i = self._find({name}, frozenset())
        else:
            i = self._find({name}, BLOCKS)
        if i is not None:
            self._close(i)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            self._add(source[at:m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            name = name.lower()
            if m["end"] or m["end2"]:
                self._end(name)
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                end = source.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else size
            else:
                self._begin(name, m["rest"] or m["rest2"] or "")
        self._flush()
        self._drop_marked()

    def scores(self) -> list[float]:
        """Of each container: text below it, less links, nine tenths for each container between."""
        out = [0.0] * len(self.containers)
        for _, own, at in self.blocks:
            out[at] += own
        for i in range(len(out) - 1, 0, -1):  # parents come before their children
            out[self.containers[i][0]] += FADE * out[i]
        return [s * c[2] for s, c in zip(out, self.containers)]

    def best(self) -> set[int]:
        """The container with the highest score and those below it."""
        scores = self.scores()
        return self._below({scores.index(max(scores))})

    def tallies(self) -> dict[tuple[str, str | None], list]:
        """Of each path (element None) and key: characters outside links, all, where its text begins and ends, text."""
        out: dict[tuple[str, str | None], list] = {}
        place = 0
        for i, ((text, own, at), element) in enumerate(zip(self.blocks, self.elements)):
            own = len(text) if i in self.headings else own
            for part in (None, element):
                sums = out.setdefault((self.containers[at][1], part), [0, 0, place, 0, []])
                sums[0] += own
                sums[1] += len(text)
                sums[3] = place + len(text)
                sums[4].append(text)
            place += len(text)
        return out

    def votes(self) -> list[tuple[str, str | None, int, int, int, int, int, int]]:
        """(path, element, own, whole, begin, end in millionths of the page's text, digest of the text, of the page)."""
        total = max(1, sum(len(text) for text, _, _ in self.blocks))
        page = _digest([text for text, _, _ in self.blocks])
        out = [("", None, 0, 0, 0, 0, 0, page)] if self.blocks else []  # counts the page
        return out + [(path, element, *(round(1e6 * n / total) for n in sums[:4]), _digest(sums[4]), page)
                      for (path, element), sums in self.tallies().items() if path]

    def text(self, winner: str | None = None, repeated: frozenset[str] = frozenset(),
             known: dict[tuple[str, str], bool] | None = None) -> str:
        """Text at the host's winning path, without ``repeated`` paths below it, and outside blocks by ``known`` keys.

        A key that is not in ``known`` is judged by this page alone.
        """
        if not self.blocks:
            return ""
        paths = [c[1] for c in self.containers]
        inside = self._below({i for i, p in enumerate(paths) if p == winner})
        best = {at for at in self.best() if paths[at] not in repeated}
        if 2 * self._held(inside) < self._held(best) or best and not any(at in inside for _, _, at in self.blocks):
            inside |= best
        enough = self._held(inside) / REGION
        tallies = self.tallies()
        until = sum(len(text) for text, _, _ in self.blocks[:max((i for i, b in enumerate(self.blocks) if b[2] in inside), default=-1) + 1])

        def stays(i: int, at: int) -> bool:
            if at in inside:
                return paths[at] == winner or paths[at] not in repeated
            key = paths[at], self.elements[i]
            if known and key in known:
                return known[key]
            own, whole, begin, _, _ = tallies[key]
            return i not in self.loose and 2 * own >= whole and (own > 0 and begin < until or own >= enough)

        return "\n".join(text for i, (text, _, at) in enumerate(self.blocks) if stays(i, at))

    def _held(self, inside: set[int]) -> int:
        return sum(own for _, own, at in self.blocks if at in inside)

    def _below(self, tops: set[int]) -> set[int]:
        inside: set[int] = set()
        for i, (parent, _, _) in enumerate(self.containers):
            if i in tops or parent in inside:
                inside.add(i)
        return inside


def _digest(texts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63)


VOTE = "host string, path string, element string, own bigint, whole bigint, begin bigint, end bigint, digest bigint, page bigint"


def consensus(votes: DataFrame) -> DataFrame:
    """One row for a host from the votes of its pages: ``winner``, and ``model`` (JSON of repeated paths and judged keys).

    Votes are added up by (host, path, element, digest, page) first, so a host
    or a page with a third of all rows is spread, and shrinks before it meets in one task.
    """
    key = ["host", "path", "element"]
    sums = [F.sum(c).alias(c) for c in ("n", "own", "whole", "begin", "end")]
    by_text = (votes.withColumn("n", F.lit(1)).groupBy(*key, "digest", "page").agg(*sums)
               .groupBy(*key, "digest").agg(*sums, F.count("*").alias("pages")))
    by_key = by_text.groupBy(*key).agg(*sums, F.sum("pages").alias("pages"), F.count("*").alias("texts"))
    by_key = shared_table(by_key, "host-votes")
    hosts = by_key.where("path = ''").select("host", F.col("pages").alias("of"))
    heard = (by_key.where("path != ''").join(hosts, "host")
             .where((F.col("pages") >= F.least(F.lit(LEAST), F.col("of"))) & (SUPPORT * F.col("pages") >= F.col("of")))
             .withColumn("repeated", (F.col("pages") >= LEAST) & (2 * F.col("texts") <= F.col("pages"))))

    # Each path's text goes to all paths around it: the beginnings of the path.
    parts = F.split(F.substring("path", 2, 1 << 30), ">")
    around = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(
        F.concat(F.lit(">"), F.array_join(F.slice("parts", 1, n), ">")).alias("at"),
        (F.col("own") * F.pow(F.lit(FADE), F.size("parts") - n)).alias("part")))
    tag = F.regexp_extract("at", r">([^>.]*)[^>]*$", 1)
    weight = F.coalesce(*(F.when(tag == t, w) for t, w in WEIGHTS.items()), F.lit(1.0))
    scores = (heard.where("element IS NULL AND NOT repeated AND own > 0").withColumn("parts", parts)
              .select("host", F.explode(around).alias("a")).select("host", "a.*")
              .groupBy("host", "at").agg((F.sum(F.round(F.col("part"))).cast("bigint")).alias("score"))
              .select("host", "at", F.round(F.col("score") * weight).cast("bigint").alias("score")))
    winners = scores.groupBy("host").agg(F.min_by("at", F.struct(-F.col("score"), "at")).alias("winner"))

    below = F.coalesce((F.col("path") == F.col("winner")) | F.startswith("path", F.concat("winner", F.lit(">"))), F.lit(False))
    held = (heard.where("element IS NULL AND NOT repeated").join(winners, "host").where(below)
            .groupBy("host").agg(F.sum("own").alias("held"), F.max(F.col("end") / F.col("n")).alias("until")))
    judged = heard.join(winners, "host", "left").join(held, "host", "left")
    stays = (~F.col("repeated") & (2 * F.col("own") >= F.col("whole"))
             & ((F.col("begin") / F.col("n") < F.col("until")) & (F.col("own") > 0)
                | (REGION * F.col("own") >= F.coalesce("held", F.lit(0)))))
    stays = F.coalesce(stays, F.lit(False))  # a host without a winner has links alone
    told = F.when(F.col("element").isNull(), F.when(F.col("repeated"), F.struct("path", "element", F.lit(False).alias("keep")))
                  ).when(~below, F.struct("path", "element", stays.alias("keep")))
    return judged.groupBy("host").agg(
        F.first("winner").alias("winner"), F.to_json(F.array_sort(F.collect_list(told))).alias("model"))


@functools.lru_cache(256)
def _model(text: str | None) -> tuple[frozenset[str], dict[tuple[str, str], bool]]:
    rows = json.loads(text) if text else []
    return (frozenset(r["path"] for r in rows if r.get("element") is None),
            {(r["path"], r["element"]): r["keep"] for r in rows if r.get("element") is not None})


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", text: str = "text",
            keep: list[str] | None = None, salts: int = 32) -> DataFrame:
    """Append the main text to the ``keep`` columns (all) of every page.

    The votes by host and their outcome (one row for a host) are written to the shared
    folder. The join with the pages is left to the planner; should the hosts be too many to
    broadcast, ``salts`` spreads the pages of one host over as many keys.
    """
    kept = [c for c in keep or pages.columns if c.lower() != text.lower()]
    host, salt, winner, model, body = (scratch_name(pages, c) for c in ("host", "salt", "winner", "model", "body"))
    address = ascii_lower(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1))
    rows = pages.withColumn(host, F.coalesce(address, F.lit("")))
    types = [pa.string()] * 3 + [pa.int64()] * 6

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in VOTE.split(", ")]
        for batch in batches:
            for piece in pieces(batch, "html"):
                found = [(h, *v) for h, source in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist())
                         for v in Page(source or "").votes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[i] for row in found], t) for i, t in enumerate(types)], names=names)

    votes = rows.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(tidy(vote), VOTE)
    told = shared_table(consensus(votes), "host-paths")
    told = told.select(F.col("host").alias(host), F.col("winner").alias(winner), F.col("model").alias(model),
                       F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt))
    spread = F.pmod(F.xxhash64(F.col(url), F.length(html)), F.lit(salts)).cast("int")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, body):
                found = [Page(source or "").text(p, *_model(m)) for source, p, m in zip(
                    *(piece.column(c).to_pylist() for c in (body, winner, model)))]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, text])

    joined = (rows.select(*kept, F.col(html).alias(body), host, spread.alias(salt))
              .join(told, [host, salt], "left").select(*kept, body, winner, model))
    return joined.mapInArrow(tidy(again), pages.select(*kept).schema.add(text, "string"))
