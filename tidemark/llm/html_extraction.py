"""Operator 7. Main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, small, written

#: Least pages that share an occurrence vector, and least different pages on which an element's text must be the same to be the template's.
SUPPORT, FIXED = 2, 3
#: Characters from which a path is told by a digest.
MAX_PATH = 1000

#: What may begin markup; a tag whose quotes are all closed; a tag up to its first ">".
_BEGIN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_CUT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Tags of a page whose quotes are looked for to the page's end in vain; each costs a pass, so that beyond them a tag ends at its first ">".
VAIN = 20
_LABEL = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HEADING = re.compile("h[1-6]")
_DIGITS = re.compile(r"\d+")
_NAMES = re.compile(r"[a-z]+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea xmp noframes".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = set("head nav footer aside form script style title textarea noscript template button select iframe object svg canvas audio video map menu dialog xmp noframes".split())
#: Names of dropped parts, as whole class tokens (or ids of elements that aren't in an article), alone or as compounds of such names and neutral ones.
_HINTS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal comment comments disqus share sharing social related newsletter subscribe teaser widget".split()
)
#: Names that say nothing of what an element holds: compounds of them and a dropped part's name are its names too.
_NEUTRAL = set("area bar block box container inner item items list slot unit wrap wrapper".split())
#: Names of those that may as well be an article's own: what they hold is dropped where no template tells, but for headings.
_SOFT = {"header", "masthead"}
#: Blocks that are prose: links in them are part of the text.
_PROSE = set("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 p pre".split())
#: Elements that no class or id drops; of a section a class does, and its id is the name of what it is about.
_KEPT = set("html body article main h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figure".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: An open element that a tag ends, unless one of the stops is between them.
_ENDS = {"p": ({"p"}, {"table", "button", "td", "div", "section", "article"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _named(value: str) -> tuple[bool, bool]:
    """Whether class tokens (or an id) name a dropped part, and whether only one that an article may have."""
    found = [set(_NAMES.findall(x)) for x in value.split()]
    parts = [names - _NEUTRAL for names in found if names - _NEUTRAL and _HINTS >= names - _NEUTRAL]
    return bool(parts), all(_SOFT.issuperset(names) for names in parts)


def _pieces(page: str):
    """(text, closes, tag, attributes, whole element) in page order: the text before a piece of markup, and the tag, if it is one.

    An element of raw text is passed over as a whole. An unclosed comment takes the rest of the page, and a tag
    whose quotes never close ends at its first ">"; "<" that begins nothing is text. Linear in the page's length."""
    at = begin = vain = 0
    size, last = len(page), page.rfind(">")
    while m := _BEGIN.search(page, begin):
        start = m.start()
        if m[0] == "<!--":
            end = page.find("-->", start + 4)
            yield page[at:start], False, "", "", False
            at = begin = size if end < 0 else end + 3
        elif start > last:
            begin = start + 1
        elif m[0] in ("<!", "<?"):
            yield page[at:start], False, "", "", False
            at = begin = page.find(">", start) + 1
        else:
            tag = _TAG.match(page, start) if vain < VAIN else None
            if tag is None:
                vain, tag = vain + 1, _CUT_TAG.match(page, start)
            name, after = tag[2].lower(), tag.end()
            raw = not tag[1] and name in _RAW and not tag[3].endswith("/")
            if raw:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, after)
                after = end.end() if end else size
            yield page[at:start], bool(tag[1]), name, tag[3], raw
            at = begin = after
    yield page[at:], False, "", "", False


class Page:
    """A walk over a page. ``paths``: by path of labelled elements, how many there are, characters of kept text in them, depth, and
    a sum of hashes of that text; ``size`` and ``sum``: those of the page, links outside of prose not counted.
    ``blocks``: texts of the blocks under the first of the ``roots`` that has any (all, if none), in page order, without elements
    whose path is ``fixed``."""

    def __init__(self, page: str, roots: tuple | list = (), fixed: tuple | list = ()) -> None:
        self.paths: dict[str, list[int]] = {}
        self.size = self.sum = 0
        self._roots, self._fixed = {path: 1 << k for k, path in enumerate(roots)}, frozenset(fixed)
        self._found: list[tuple[int, bool, str]] = []  # roots that it is in, whether in a soft part, text
        self._buffer: list[str] = []
        self._stack: list[list] = []  # tag, path, dropped, roots, in a link outside of prose, in prose, in a soft part, characters, sum
        self._open_tags: Counter[str] = Counter()
        self._mask, self._dropped, self._link, self._prose, self._soft = 0, False, False, False, False
        for text, closes, tag, rest, after in _pieces(page):
            self._text(text)
            if not tag:
                continue
            if closes:
                self._close(tag)
            else:
                self._open(tag, rest)
                if after:
                    self._close(tag)
        while self._stack:
            self._pop()
        self._flush()
        bit = next((b for b in self._roots.values() if any(mask & b for mask, _, _ in self._found)), 0)
        self.blocks = [text for mask, soft, text in self._found if (mask & bit if bit else not soft)]

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            self._buffer = []
            if text:
                self._found.append((self._mask, self._soft, text))

    def _text(self, text: str) -> None:
        if not text or self._dropped or not self._stack and not text.strip():
            return
        if "&" in text:
            text = html.unescape(text)
        if not self._link and (run := " ".join(text.split())):
            size = 0 if self._soft else len(run)
            mark = int.from_bytes(hashlib.blake2b(run.encode(errors="replace"), digest_size=8).digest(), "little")
            self.size, self.sum = self.size + size, self.sum + mark
            if self._stack:
                self._stack[-1][7] += size
                self._stack[-1][8] += mark
        self._buffer.append(text)

    def _open(self, tag: str, rest: str) -> None:
        if tag in _ENDS or tag in _BLOCK:
            targets, stops = _ENDS["p"] if tag in _BLOCK and tag not in _ENDS else _ENDS[tag]
            for k in range(len(self._stack) - 1 if any(self._open_tags[t] for t in targets) else -1, -1, -1):
                name = self._stack[k][0]
                if name in targets:
                    while len(self._stack) > k:
                        self._pop()
                    break
                if name in stops:
                    break
        if tag in _BLOCK:
            self._flush()
        elif tag == "br" and self._buffer:
            self._buffer.append(" ")
        if tag in _VOID:
            return
        label, drop, soft = tag, tag in _DROPPED, False
        if rest and ("=" in rest or "hidden" in rest):
            for name, value in _LABEL.findall(rest):
                value, name = value.strip("\"'").lower(), name.lower()
                if name in ("class", "id"):
                    label += ("." if name == "class" else "#") + _DIGITS.sub("0", " ".join(sorted(value.split())))
                    named, mild = _named(value)
                    if named and tag not in _KEPT and (name == "class" or tag != "section" and not self._in_article()):
                        soft, drop = soft or mild, drop or not mild
                elif name == "role":
                    drop = drop or value in _ROLES
                else:
                    drop = drop or name == "hidden" or value == "true"
        if tag == "header":
            drop = drop or not self._in_article()
        path = f"{self._stack[-1][1]}>{label}" if self._stack else label
        if len(path) > MAX_PATH:  # of very deep nesting, or of very long labels
            path = "#" + hashlib.blake2b(path.encode(), digest_size=12).hexdigest()
        drop = drop or path in self._fixed and tag in _BLOCK
        self._open_tags[tag] += 1
        self._prose = self._prose or tag in _PROSE
        self._dropped, self._link = self._dropped or drop, (self._link or tag == "a") and not self._prose
        self._soft = (self._soft or soft) and not self._in_article() and not _HEADING.fullmatch(tag)
        self._mask |= self._roots.get(path, 0)
        self._stack.append([tag, path, self._dropped, self._mask, self._link, self._prose, self._soft, 0, 0])

    def _in_article(self) -> bool:
        return self._open_tags["article"] + self._open_tags["main"] > 0

    def _pop(self) -> None:
        if self._stack[-1][0] in _BLOCK:
            self._flush()
        tag, path, _, _, _, _, _, size, mark = self._stack.pop()
        self._open_tags[tag] -= 1
        seen = self.paths.setdefault(path, [0, 0, len(self._stack), 0])
        seen[0] += 1
        seen[1] += size
        seen[3] += mark
        if self._stack:
            self._stack[-1][7] += size
            self._stack[-1][8] += mark
            _, _, self._dropped, self._mask, self._link, self._prose, self._soft, _, _ = self._stack[-1]
        else:
            self._dropped = self._link = self._prose = self._soft = False
            self._mask = 0

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        for k in range(len(self._stack) - 1 if self._open_tags[tag] else -1, -1, -1):
            if self._stack[k][0] == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if tag not in _BLOCK and self._stack[k][0] in _BLOCK:
                return  # an inline end tag doesn't end a block


def _signed(x: int) -> int:
    """The low 64 bits."""
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def _tokens(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for host, rid, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            walk = Page(page or "")
            whole = _signed(walk.sum)
            rows += [(host, rid, path, n, size, depth, walk.size - size, _signed(walk.sum - mark), whole, _signed(mark)) for path, (n, size, depth, mark) in walk.paths.items()]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["host", "page", "token", "n", "size", "depth", "outside", "rest", "text", "own"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """Templates by host: host, roots (content slots' paths, those of the classes of fewest pages first), fixed (paths of the templates' own text).
    ``pages``: host, page, html.

    A token is an element with its path of labelled ancestors. Tokens with one occurrence vector over a host's
    pages are an equivalence class; a class is valid if it spans SUPPORT pages (a host of fewer pages: all) and each of
    its tokens occurs once a page, so that its tokens are nested in one order on all of them. A class is
    a template, and other tokens' classes are nested in the slots between its tokens: a class of some of another's pages goes first.
    A template's content slot is that of its deepest container outside of which all its pages have the same kept text - so it
    holds all text that isn't the template's, in as many slots as there are - or its article's, if it has one. Where the pages of a
    class don't tell (a single one, or all with the same text), it is the deepest container outside of which there is none.
    Text that stands in the same words in an element that FIXED pages of different text have once each is the template's, also
    inside of a slot; articles are taken as they are. Lists of links outside of prose aren't taken for text here.

    An occurrence vector is summed up in four sums of 32 bits of hashes of (page, count), so that neither a host's
    pages nor a vector are ever gathered, and equal rows count as often as they are there."""
    seen = pages.mapInArrow(_tokens, "host string, page long, token string, n int, size long, depth int, outside long, rest long, text long, own long")
    hashes = [F.xxhash64(F.lit(k), "page", "n") for k in (1, 2)]
    vector = [F.sum(part).alias(f"v{k}{j}") for k, h in enumerate(hashes) for j, part in enumerate((h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)))]
    vs = ["v00", "v01", "v10", "v11"]
    varied = [(F.min(c) != F.max(c)).alias(f"{c}_varies") for c in ("rest", "text", "own")]
    different = F.size(F.collect_set(F.pmod("text", F.lit(64)))).alias("different")  # of 64 kinds of pages' texts: a set of bounded size
    sums = [F.count(F.lit(1)).alias("support"), F.max("n").alias("most"), F.sum("size").alias("size"), F.sum("outside").alias("outside")]
    tokens = seen.groupBy("host", "token", "depth").agg(*vector, *sums, *varied, different)
    tokens, _ = written(tokens, "html-tokens")
    hosts = tokens.groupBy("host").agg(F.max("support").alias("pages"))
    valid = tokens.filter("most = 1 and size > 0").join(small(hosts), "host").filter((F.col("support") >= SUPPORT) | (F.col("pages") < SUPPORT))
    # a slot is a container, and an article is one as a whole, whatever varies outside of it
    container = r"(?:^|>)(?:html|body|article|main|section|div|center|table|tbody|tr|td|dl|ul|ol)(?:[.#][^>]*)?$|^#"
    article = F.regexp_extract("token", r"^(?:.*?>)?(?:article|main)(?:[.#][^>]*)?(?=>|$)", 0)
    holds = F.when(F.col("text_varies"), ~F.col("rest_varies")).otherwise(F.col("outside") == 0) | (F.col("token") == article)
    slots = valid.filter(holds & F.col("token").rlike(container)).withColumn("token", F.when(article == "", F.col("token")).otherwise(article))
    roots = slots.groupBy("host", *vs, "support").agg(F.max_by("token", F.struct("depth", "token")).alias("root"), F.max("depth").alias("depth"))
    roots = roots.groupBy("host", "root").agg(F.min("support").alias("support"), F.max("depth").alias("depth"))
    roots = roots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("support", (-F.col("depth")).alias("order"), "root"))).alias("roots"))
    fixed = valid.filter((F.col("different") >= FIXED) & ~F.col("own_varies") & (article == "")).groupBy("host").agg(F.collect_set("token").alias("fixed"))
    return roots.join(fixed, "host", "full").select("host", F.coalesce(F.col("roots.root"), F.array().cast("array<string>")).alias("roots"), F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"))


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        pages = zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True)
        out = ["\n\n".join(Page(page or "", roots or (), fixed or ()).blocks) for page, roots, fixed in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Templates are deduced for each host; of a page, the blocks in the content slot of the first of its host's
    templates that gives any are joined in page order, without dropped parts (menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles, comments) and the templates' own text. A page that no template fits gives all its kept blocks.
    A part that is only named a header goes where no template tells, but for its headings. Repeated rows change nothing for others.
    Null html is an empty page; pages without a host in their url are one host. Rows are never joined with each
    other, so null and repeated ids each give their own row, and a host of any number of pages is only met as
    aggregates and as one template row."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    found, _ = written(templates(rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")), "html-templates")
    whole = rows.join(small(found), "host", "left").select("page_id", "url", "html", "roots", "fixed")
    return whole.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
