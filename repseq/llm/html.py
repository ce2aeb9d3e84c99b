"""Main-text extraction by line-block distribution."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.llm._common import table

#: One markup token. Quoted attribute values may hold ">"; what is never closed runs to the end of the page.
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<(?=[a-z])[^>]*(?:>|\Z)",
    re.I | re.S,
)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that are never main text.
BOILERPLATE = frozenset("aside button canvas dialog footer form head header input label menu nav noscript object option search select svg template".split())
#: Words in a class, id or role that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|disqus|footer|form|gdpr|header|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|replies|reply|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Names that say what an element has, not what it is.
_ABOUT = re.compile(r"(?:has|with|without|no|is|show|hide)[_-]", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tag may be left out: a block that starts or ends around them ends them.
LOOSE = frozenset("p li dt dd option".split())

#: Lines in a window; letters in a window that make a surge where no element says where the article is.
WINDOW, SURGE = 3, 86


#: Headings name what follows: their class or id never marks them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 html body".split())
#: Boilerplate elements that may wrap a whole page, which their text then decides.
WRAPPERS = frozenset("form header".split())


def _ends(tokens: list[re.Match]) -> dict[int, tuple[int, bool]]:
    """For each opening tag that something closes: the closing token's number, and whether that is its own end tag."""
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    for k, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if not tag or tag in VOID:
            continue
        if not m["close"]:
            while stack and stack[-1][0] in LOOSE and (stack[-1][0] == tag or (stack[-1][0] == "p" and tag in BLOCKS) or {stack[-1][0], tag} == {"dt", "dd"}):
                ends[stack.pop()[1]] = (k, False)
            stack.append((tag, k))
            continue
        at = len(stack) - 1
        while at >= 0 and stack[at][0] != tag and (tag in BLOCKS or stack[at][0] not in BLOCKS):
            at -= 1
        if at < 0 or stack[at][0] != tag:
            continue
        for _, other in stack[at + 1 :]:
            ends[other] = (k, False)
        ends[stack[at][1]] = (k, True)
        del stack[at:]
    return ends


def boilerplate(html: str, tokens: list[re.Match]) -> dict[int, tuple[int, bool]]:
    """Which opening tags start boilerplate, with their ends (see ``_ends``).

    Element names and marks in a class, id or role are hints only. What is never closed, or holds the page's ``article`` or
    ``main``, is none; nor is a marked element that holds the only text to make a surge: it wraps the page.
    """
    ends = _ends(tokens)
    letters, seen, last, hidden = [0], 0, 0, 0
    for k, m in enumerate(tokens):  # letters before each token, without those in menus, footers and the like
        if k >= hidden:
            seen += len("".join(html[last : m.start()].split()))
        letters.append(seen)
        last = m.end()
        tag = (m["tag"] or "").lower()
        if k >= hidden and tag in BOILERPLATE and tag not in WRAPPERS and not m["close"] and k in ends:
            hidden = ends[k][0]
    total = seen + len("".join(html[last:].split()))
    mains = [k for k, m in enumerate(tokens) if m["tag"] and not m["close"] and m["tag"].lower() in ("article", "main")]
    out, inside = {}, [(k, ends[k][0] if k in ends else len(tokens)) for k in mains]
    for k, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if not tag or m["close"] or k not in ends or tag in HEADINGS:
            continue
        named = " ".join(x or y or z for x, y, z in _NAMED.findall(m["attrs"])) if m["attrs"] else ""
        marked = bool(named) and any(MARKED.search(n) and not _ABOUT.match(n) for n in named.split())
        if tag in BOILERPLATE and not (tag == "header" and any(a < k < b for a, b in inside)):
            marked, sure = True, tag not in WRAPPERS
        else:
            sure = False
        if not marked or any(k < x < ends[k][0] for x in mains):
            continue
        within = letters[ends[k][0]] - letters[k]
        if not sure and within >= SURGE > total - within:
            continue
        out[k] = ends[k]
    return out


def lines(html: str) -> tuple[list[str], list[int], list[bool], bool]:
    """The page's lines with markup stripped, each line's length for the distribution, whether it may be
    main text, and whether an article is marked.

    Boilerplate leaves a gap of empty lines as long as the window. Link text does not count towards a length; a link that
    is never closed ends with its block. Where ``article`` or ``main`` marks the main text, lines outside count nothing.
    """
    out: list[str] = []
    lengths: list[int] = []
    inside_marks: list[bool] = []
    words: list[str] = []
    linked = depth = anchors = at = 0
    seen, k = False, 0
    tokens = list(_TOKEN.finditer(html))
    skipped = boilerplate(html, tokens)

    def end_line():
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            out.append(text)
            lengths.append(max(0, len(text) - linked))
            inside_marks.append(depth > 0)
            words.clear()
            linked = 0

    def gap():
        end_line()
        for _ in range(WINDOW):
            out.append("")
            lengths.append(0)
            inside_marks.append(depth > 0)

    def text_until(stop: int):
        nonlocal linked
        if stop > at:
            text = unescape(html[at:stop])
            words.append(text)
            if anchors:
                linked += len(" ".join(text.split()))

    while k < len(tokens):
        m = tokens[k]
        text_until(m.start())
        at = m.end()
        tag, closes = (m["tag"] or "").lower(), bool(m["close"])
        if k in skipped:
            gap()
            end, own = skipped[k]
            k, at = (end + 1, tokens[end].end()) if own else (end, tokens[end].start())
            continue
        k += 1
        if not tag:
            continue
        if tag in ("article", "main"):
            end_line()
            seen |= not closes
            depth = max(0, depth - 1) if closes else depth + 1
        if tag in BOILERPLATE and not closes and tag not in VOID:
            gap()
        elif tag in BLOCKS:
            if closes or (tag in LOOSE and linked):
                anchors = 0
            end_line()
        elif tag == "a":
            anchors = 0 if closes or not _HREF.search(m["attrs"]) else 1
        elif tag in ("br", "td", "th"):
            words.append(" ")
    text_until(len(html))
    end_line()
    if seen:
        lengths = [n if mark else 0 for n, mark in zip(lengths, inside_marks, strict=True)]
        return out, lengths, inside_marks, True
    return out, lengths, [True] * len(out), False


def regions(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """Runs of lines from a surge point, where a window's length first exceeds ``surge``, to the dive to 0 after it."""
    n, out, i = len(lengths), [], 0
    total = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    while i < n:
        if total[i] > surge:
            start = i
            while start and total[start - 1] > 0:
                start -= 1
            while i < n and total[i] > 0:
                i += 1
            out.append((start, i))
        else:
            i += 1
    return out


def extract(html: str | None) -> str:
    """The main text of a page: all lines of a marked article, else its lines between surge and dive points.

    Without a mark, runs of lines with only gaps between them are one run, and those that surge (``SURGE`` letters outside
    links in a window) are the text; if nothing surges, all runs are.
    """
    if not html:
        return ""
    text, lengths, inside, seen = lines(html)
    if seen:
        return "\n".join(t for t, mark in zip(text, inside, strict=True) if t and mark)
    joined: list[list[tuple[int, int]]] = []
    for run in regions(lengths, 0):
        if joined and not any(text[joined[-1][-1][1] : run[0]]):
            joined[-1].append(run)
        else:
            joined.append([run])
    total = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    surging = [g for g in joined if any(max(total[a:b]) > SURGE for a, b in g)]
    return "\n".join(text[i] for g in surging or joined for a, b in g for i in range(a, b) if text[i])


def extract_text(df: DataFrame, html: str = "html", *, out: str = "text") -> DataFrame:
    """Adds the column ``out`` with each row's main text; empty where the page is NULL or holds none.

    Rows stay where they are (no shuffle), whole pages are read, and repeated rows give repeated results. A column named
    like ``out`` is replaced.
    """

    @F.pandas_udf("string")
    def main_text(pages: pd.Series) -> pd.Series:
        return pages.map(extract, na_action=None)

    return df.withColumn(out, main_text(F.coalesce(F.col(html), F.lit(""))))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
