"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive where their surroundings are those of content and
negative in menus, notices and the like; tags score negative. The weights are log-odds from labelled pages, those
with exactly one article element: what lies in it is content. Where no element names an article, plain words are
weighed as those of labelled pages read without their article and main elements. One linear scan finds the contiguous region with the
highest total. Its words, less those in surroundings that score negative, are the text.

Defined results: a null or empty page gives an empty text; an unclosed comment, script or style hides what follows
it; a page without any positive word gives an empty text; repeated rows are extracted each; an empty table gives no
rows; other columns are carried in a struct, so their names can't clash.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsieve.llm.common import map_batches, texts

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|head|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|</?[a-z][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary
table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b big cite code del em font i ins kbd mark q s small strong sub sup time tt u var".split())
TAGS = BLOCKS | VOID | INLINE | {"span", "label"}
#: Elements whose name tells what they hold, and words of class, id or role that do.
ELEMENT_ROLES = {"nav": "menu", "menu": "menu", "footer": "footer", "header": "header", "aside": "sidebar",
                 "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "article": "article",
                 "main": "article"}
NAME_ROLES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs",
    "footer": "footer bottom copyright colophon contentinfo",
    "header": "header masthead banner topbar",
    "sidebar": "sidebar aside widget related recommended trending popular rail complementary",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe paywall dialog",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "form": "form login signup search",
    "comment": "comment comments disqus reply replies discussion respond",
    "share": "share sharing social follow",
}
_ROLE_OF = {word: role for role, words in NAME_ROLES.items() for word in words.split()}
BOILER = frozenset(NAME_ROLES)

#: Words counted in favour and against before any page is seen.
PRIOR = {"article": (20.0, 1.0), "plain": (4.0, 2.0), "unnamed": (4.0, 2.0)}
BOILER_PRIOR = (1.0, 20.0)
#: Bounds of the weights. Words and tags of page furniture cost little each, so that an advert within an article
#: does not cut off what follows it, while a menu's many tags still part it from the article.
MAX_WORD, MIN_WORD = 3.0, -0.25
MAX_TAG, MIN_TAG = -0.05, -1.0
LABELLED_PAGES = 2000


def role_of(name: str, attributes: str) -> str | None:
    """What an element holds, by its name or else by a word of its class, id or role."""
    if name in ELEMENT_ROLES:
        return ELEMENT_ROLES[name]
    if attributes and "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            for word in re.split(r"[^a-z]+", m[2].lower()):
                if word in _ROLE_OF:
                    return _ROLE_OF[word]
    return None


def parse(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", words with references decoded, role of the surroundings) and ("tag", name, role) in page order.

    Elements need not be closed: a closing tag ends all inside its element, and one without an opening is passed over.
    """
    open_: list[tuple[str, str]] = []
    role, at = "plain", 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            yield "text", html.unescape(page[at:m.start()]), role
        at = m.end()
        if not m[3]:
            yield "tag", "hidden", role
            continue
        name = m[3].lower()
        if m[2]:
            if any(x[0] == name for x in open_):
                while open_.pop()[0] != name:
                    pass
                role = open_[-1][1] if open_ else "plain"
        elif name not in VOID and not m[4].endswith("/"):
            if name in BLOCKS and open_ and open_[-1][0] == "p":
                open_.pop()
                role = open_[-1][1] if open_ else "plain"
            own = role_of(name, m[4])
            if own or name not in INLINE | {"p", "li", "tr", "td", "th", "option"}:
                role = role if role in BOILER and own in (None, "article") else own or role
                open_.append((name, role))
        yield "tag", name if name in TAGS else "other", role
    if at < len(page):
        yield "text", html.unescape(page[at:]), role


def counts(page: str) -> Counter:
    """How often each word role and tag occurs inside and outside the one article of a labelled page."""
    found: Counter = Counter()
    inside = False
    for kind, what, role in parse(page):
        if kind == "tag":
            if what == "article":
                inside = not inside
                continue
            found["tag:" + what, inside and role not in BOILER] += 1
        else:
            found["word:" + role, inside and role not in BOILER] += len(what.split())
            if role not in BOILER:  # what the page would show without its article and main elements
                found["word:unnamed", inside] += len(what.split())
    return found


def weights_from(found: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Log-odds of content. Words are bounded both ways; a tag always scores below 0."""
    total = {side: sum(n for (f, s), n in found.items() if s == side and f.startswith("tag:")) + len(TAGS)
             for side in (True, False)}
    out = {}
    for role in ["plain", "article", "unnamed", *sorted(BOILER)]:
        yes, no = PRIOR.get(role, BOILER_PRIOR)
        odds = (found.get(("word:" + role, True), 0) + yes) / (found.get(("word:" + role, False), 0) + no)
        out["word:" + role] = max(MIN_WORD, min(MAX_WORD, math.log(odds)))
    for tag in sorted(TAGS | {"other", "hidden"}):
        odds = ((found.get(("tag:" + tag, True), 0) + 1) / total[True]) / ((found.get(("tag:" + tag, False), 0) + 1) / total[False])
        out["tag:" + tag] = max(MIN_TAG, min(MAX_TAG, math.log(odds)))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest total above 0; of equal ones the first and shortest."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, white space made single, joined by two line feeds."""
    parts = list(parse(page))
    if not any(kind == "text" and role == "article" and what.strip() for kind, what, role in parts):
        parts = [(kind, what, "unnamed" if role == "plain" else role) for kind, what, role in parts]
    scores = [weights["tag:" + what] if kind == "tag" else weights["word:" + role] * len(what.split())
              for kind, what, role in parts]
    start, end = best_region(scores)
    blocks, held = [], []
    for kind, what, role in parts[start:end]:
        if kind == "text":
            if weights["word:" + role] > 0:
                held.append(what)
        elif what in BLOCKS:
            blocks.append("".join(held))
            held = []
        elif what == "br":
            held.append(" ")
    blocks.append("".join(held))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def learn(pages: DataFrame, limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``limit`` labelled pages, those whose hashed id comes first."""
    labelled = pages.filter(F.lower("html").rlike("(?s)^(?!.*<article.*<article).*<article"))
    chosen = labelled.select(F.xxhash64("page_id", "html").alias("_key")).distinct().orderBy("_key").limit(limit)
    sample = labelled.select(F.xxhash64("page_id", "html").alias("_key"), "html").join(F.broadcast(chosen), "_key")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in source:
            for page in texts(batch.column(0)):
                found.update(counts(page))
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([f for f, _ in found], pa.string()), "inside": pa.array([s for _, s in found], pa.bool_()),
            "n": pa.array([float(n) for n in found.values()], pa.float64())})

    got = map_batches(sample.select("html"), run, "feature string, inside boolean, n double")
    return weights_from({(r["feature"], r["inside"]): r["n"]
                         for r in got.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, weights: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row, text) of every page; weights are learned from the pages themselves if none are given."""
    weights = weights or learn(pages)
    inputs = pages.select(F.struct(*(keep or pages.columns)).alias("row"), "html")
    schema = T.StructType([inputs.schema["row"], T.StructField("text", T.StringType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [main_text(page, weights) for page in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["row", "text"])

    return map_batches(inputs, run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    found = extract(pages, keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
