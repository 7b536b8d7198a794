"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one judges each block alone, by stop-word density, length and link density,
and by the element that holds it: menus, headers, footers, asides, forms, adverts, notices and comment sections are out,
and so is all that stands outside the article where a page marks one. Only an article that holds at least half of the text that could
be main text marks a page, so teasers and related links do not. Inside it a single block of links is not decided by itself; three or
more in a row are a list of links and out. A page without any listed stop word is in another language: there length and links decide
alone. Pass two gives blocks that pass one could not decide, most of them short, the label of the nearest decided block; two equally near
ones of different labels keep the block inside an article and drop it elsewhere; with no decided block in reach an article's blocks stay.

Defined results: null and empty html, and pages without main text, give an empty text; repeated rows each get their own; very long pages are
read whole; unclosed tags, comments, scripts and quotes end where the page ends; character references are decoded within a run of
text, never across a tag; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.quality_rules import STOP_WORDS

_STOP = frozenset(STOP_WORDS)
_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<raw>{_RAW})\b(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<more>(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][A-Za-z0-9:-]*+)(?P<more2>[^>]*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog head fieldset".split())
ARTICLE = frozenset("article main".split())
_HINT = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_BAD_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|respond|replies|cookies?|consent|gdpr|notice|popup|modal|overlay|sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|newsletter|subscribe|subscription|share|sharing|social|related|recommended|pagination|pager|login|signup|search|skip|toolbar|contentinfo|complementary|alert)(?:$|[\s_-])",
    re.IGNORECASE,
)
_GOOD_HINT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post-?body|post-?content|entry-?content|article-?content|article-?body|main-?content|story-?body|story)(?:$|[\s_-])", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: Thresholds of pass one, in code points and shares.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.08, 0.18
LINKS = 0.4


def blocks(html: str) -> list[tuple[str, float, bool, bool]]:
    """(text, share of it inside links, outside the main text by its container, inside an article) for every block that has text."""
    out: list[tuple[str, float, bool, bool]] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    held: dict[str, int] = {}
    bad = art = 0
    linked = 0

    def close() -> None:
        if not parts:
            return
        plain = [(unescape(t) if "&" in t else t, a) for t, a in parts]
        text = _SPACE.sub(" ", "".join(t for t, _ in plain)).strip()
        if text:
            inside = sum(len(t.strip()) for t, a in plain if a)
            out.append((text, min(1.0, inside / len(text)), bad > 0, art > 0))
        parts.clear()

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append((html[at : m.start()], linked > 0))
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append((" ", False))
            continue
        if name in BLOCKS:
            close()
        if name in VOID:
            continue
        if m["end"] or m["end2"]:
            if held.get(name):
                while True:
                    top, b, a = stack.pop()
                    held[top] -= 1
                    bad -= b
                    art -= a
                    linked -= top == "a"
                    if top == name:
                        break
            continue
        if name in ("p", "li", "a", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            top, b, a = stack.pop()
            held[top] -= 1
            bad -= b
            art -= a
            linked -= top == "a"
        more = m["more"] or m["more2"] or ""
        if more.rstrip().endswith("/") and name not in BLOCKS:
            continue
        hints = " ".join(x[1].strip("\"'") for x in _HINT.findall(more)) if "=" in more else ""
        b = (name in OUTSIDE and not (name == "header" and art)) or (name not in ("html", "body", "article", "main") and bool(_BAD_HINT.search(hints))) or bool(more and _HIDDEN.search(more))
        a = name in ARTICLE or bool(_GOOD_HINT.search(hints))
        stack.append((name, b, a))
        held[name] = held.get(name, 0) + 1
        bad += b
        art += a
        linked += name == "a"
    if at < len(html):
        parts.append((html[at:], linked > 0))
    close()
    return out


def _link_lists(found: list[tuple[str, float, bool, bool]], least: int = 3) -> set[int]:
    """Blocks in runs of at least `least` neighbours that are mostly links."""
    out, run = set(), []
    for i, (_, links, _, _) in enumerate([*found, ("", 0.0, False, False)]):
        if links > LINKS:
            run.append(i)
            continue
        if len(run) >= least:
            out.update(run)
        run = []
    return out


def main_blocks(html: str) -> list[str]:
    found = blocks(html)
    could = [len(t) * (article or -1) for t, links, outside, article in found if not outside and (article or links <= LINKS)]
    marked = any(n > 0 for n in could) and sum(could) >= 0
    lists = _link_lists(found) if marked else set()
    counted = []
    for text, links, outside, article in found:
        words = _WORD.findall(text.lower()) if len(text) >= SHORT and not outside else ()
        counted.append((sum(map(_STOP.__contains__, words)), len(words)))
    foreign = not any(n for n, _ in counted)
    label: list[bool | None] = []
    for i, ((text, links, outside, article), (n, of)) in enumerate(zip(found, counted, strict=True)):
        stop = n / of if of else 0.0
        if outside or (marked and not article) or i in lists or (links > LINKS and not marked):
            label.append(False)
        elif links > LINKS:
            label.append(None)
        elif len(text) >= SHORT and stop >= STOP_HIGH or len(text) >= LONG and (foreign or stop >= STOP_LOW):
            label.append(True)
        elif not marked and len(text) >= LONG and stop < STOP_LOW / 4:
            label.append(False)
        else:
            label.append(None)
    # Pass two. An article's own blocks look only at one another: what surrounds it is decided by the container, not the text.
    place = [i for i, (_, _, outside, article) in enumerate(found) if not marked or (article and not outside)]
    near: list[tuple[int, bool] | None] = [None] * len(found)
    seen = None
    for k, i in enumerate(place):
        if label[i] is not None:
            seen = (k, label[i])
        near[i] = seen
    out, seen = list(label), None
    for k in range(len(place) - 1, -1, -1):
        i = place[k]
        if label[i] is not None:
            seen = (k, label[i])
            continue
        before, after = near[i], seen
        if before is None and after is None:
            out[i] = marked
        elif before is None or (after is not None and after[0] - k < k - before[0]):
            out[i] = after[1]
        elif after is None or k - before[0] < after[0] - k:
            out[i] = before[1]
        else:
            out[i] = before[1] if before[1] == after[1] else marked
    return [found[i][0] for i in range(len(found)) if out[i]]


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: page_id, url, text (blocks joined by a line feed), n_chars (its code points), n_blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                made = [main_blocks(h) if h else [] for h in part.column(2).to_pylist()]
                text = ["\n".join(x) for x in made]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(x) for x in made], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    own = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
