"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags, grouped into blocks (what stands
between block-level tags).  Words score positive and tags negative; what stands
below an element known for boilerplate scores nothing.  One linear scan finds the
contiguous run of blocks with the highest total (Kadane), and what stands in
boilerplate elements within the run is left out.

The weights come from labelled pages: those with exactly one ``article`` (or,
without one, ``main``) element, whose inside is content.  They give log odds to
the names of elements (tag, classes, id, role), to words by the block and link
they stand in, and to tags.  A short list of names known for boilerplate or
content is the prior.  The fit takes a bounded sample: the ``sample`` labelled
pages with the smallest hash of page_id.  All pages are extracted whole.

Defined cases: null or empty html, and a page without a word of content, give an
empty text; unclosed and truncated markup is read as browsers mostly do; line
breaks (``br``) are white space inside a block; repeated rows give repeated
rows; an empty table gives an empty result; without labelled pages the prior
alone decides; extra columns are kept by :func:`extract`, those named ``text``
or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled pages in the fit; weight of a name in the prior, in words; log odds at which a name decides.
SAMPLE, PRIOR, DECIDES = 2000, 200, 1.0

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that say nothing about what they hold.
PLAIN = frozenset("html body p div section ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption center address details summary hgroup".split()) | INLINE
#: Prior: names of content, of boilerplate, and of boilerplate that an article inside doesn't outweigh (but by learnt odds).
CONTENT = frozenset("article main articlebody".split())
BOILERPLATE = frozenset(
    "head title header banner masthead script style noscript template iframe svg canvas object form button select option textarea label fieldset legend input dialog search "
    "menu navbar navigation topbar toolbar breadcrumb breadcrumbs ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert warning popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending pagination pager "
    "widget copyright legal contentinfo complementary skip sidebar".split())
FIRM = frozenset("nav footer aside comment comments commentlist respond disqus replies discussion".split())
MARKED = frozenset(f"!{n}" for n in FIRM)


def names_of(tag: str, attributes: str) -> frozenset[str]:
    """What an element is called: its tag unless plain, and the words of its class, id, role and itemprop.

    A firm name counts as the tag or a whole word only, not as a part of one, and
    not on an inline element.  It is marked ("!nav"), but on an article or main.
    """
    found, whole = set() if tag in PLAIN else {tag}, {tag}
    if "=" in attributes and tag not in ("html", "body"):
        for m in NAMED.finditer(attributes):
            for word in (m[1] or m[2] or m[3] or "").split():
                whole.add(word.lower())
                found.add(word.lower())
                found.update(x.lower() for x in PART.findall(word))
    if clear := found & FIRM:
        kept = clear & whole if tag not in INLINE else set()
        found -= clear - kept
        found.update(f"!{n}" for n in kept if tag not in CONTENT)
    return frozenset(found)


@dataclass
class Block:
    """What stands between block-level tags, or a part of it in an inline element that has names."""

    line: int  # parts of one block share it
    tag: str
    path: tuple[frozenset[str], ...]  # names of the open elements, outermost first
    labelled: bool  # below the article (or main)
    tags: list[str] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0


def blocks(page: str) -> list[Block]:
    stack: list[tuple[str, frozenset[str]]] = []
    content = "article" if re.search(r"<article[\s>]", page, re.I) else "main"

    def fresh(line: int) -> Block:
        return Block(line, next((t for t, _ in reversed(stack) if t not in INLINE), ""), tuple(n for _, n in stack if n), any(t == content for t, _ in stack))

    out, links, at = [fresh(0)], 0, 0
    for m in [*MARK.finditer(page), None]:
        now = out[-1]
        if piece := page[at : m.start() if m else len(page)]:
            piece = entities.unescape(piece)
            n = len(piece.split())
            now.pieces.append(piece)
            now.words += n
            now.linked += n if links else 0
        if m is None:
            return out
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        now.tags.append(tag)
        if tag in VOID:
            if tag in INLINE:
                now.pieces.append(" " if tag == "br" else "")
            else:
                out.append(fresh(now.line + 1))
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif not attributes.endswith("/"):
            if tag not in INLINE and (open_ := [i for i, (t, _) in enumerate(stack) if t == "p"]) and all(t in INLINE for t, _ in stack[open_[-1] + 1 :]):
                del stack[open_[-1] :]  # a block ends an open paragraph
            stack.append((tag, names_of(tag, attributes)))
        links = sum(t == "a" for t, _ in stack)
        if tag not in INLINE:
            out.append(fresh(now.line + 1))
        elif now.path != tuple(n for _, n in stack if n):
            out.append(fresh(now.line))


@dataclass
class Weights:
    """Log odds of being content: of element names, of words by (block tag, in a link), of tags."""

    names: dict[str, float]
    words: dict[tuple[str, bool], float]
    tags: dict[str, float]

    def boilerplate(self, path: tuple[frozenset[str], ...]) -> bool:
        """The innermost element that decides counts, unless a firm one (that isn't learnt to be content) stands around it."""
        if any(self.names.get(x[1:], 0.0) < DECIDES for n in path for x in n & MARKED):
            return True
        inside = {i for i, n in enumerate(path) if n & CONTENT}
        for i in range(len(path) - 1, -1, -1):
            known = [self.names[x] for x in path[i] if x in self.names and not (x == "header" and any(j < i for j in inside))]
            if known and min(known) <= -DECIDES:
                return True
            if known and max(known) >= DECIDES:
                return False
        return False

    def score(self, block: Block) -> float:
        if self.boilerplate(block.path):
            return 0.0
        tags = sum(self.tags.get(t, -0.1) for t in block.tags)
        plain = self.words.get((block.tag, False), 0.5) * (block.words - block.linked)
        return tags + plain + self.words.get((block.tag, True), 0.1) * block.linked


def prior() -> dict[str, float]:
    return {n: 3.0 for n in CONTENT} | {n: -3.0 for n in BOILERPLATE | FIRM}


DEFAULT = Weights(prior(), {}, {})


def main_text(page: str | None, weights: Weights) -> str:
    found = blocks(page or "")
    best, run, start = (0.0, 0, 0), 0.0, 0
    for i, block in enumerate(found):
        if run <= 0:
            run, start = 0.0, i
        run += weights.score(block)
        if run > best[0]:
            best = (run, start, i + 1)
    lines: dict[int, list[str]] = {}
    for block in found[best[1] : best[2]]:
        if not weights.boilerplate(block.path):
            lines.setdefault(block.line, []).extend(block.pieces)
    return "\n".join(filter(None, (" ".join("".join(pieces).split()) for pieces in lines.values())))


def evidence(page: str) -> Counter:
    """(kind, key, inside) -> words or tags of a labelled page."""
    seen: Counter = Counter()
    for block in blocks(page):
        names = set().union(*block.path) if block.path else set()
        if block.labelled:
            below = next((i for i, n in enumerate(block.path) if n & CONTENT), -1)
            names = set().union(*block.path[below + 1 :]) if block.path[below + 1 :] else set()
        for n in names - CONTENT - MARKED:
            seen["name", n, block.labelled] += block.words
        if not DEFAULT.boilerplate(block.path):
            seen["word", f"{block.tag} 0", block.labelled] += block.words - block.linked
            seen["word", f"{block.tag} 1", block.labelled] += block.linked
            for t in block.tags:
                seen["tag", t, block.labelled] += 1
            seen["all", "tags", block.labelled] += len(block.tags)
    return seen


def weigh(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Log odds from the evidence; the prior counts as ``PRIOR`` words for or against a name.

    Words are kept positive (0.1 to 1; in links -1 to 1) and tags negative (-2 to -0.05).
    """
    known = prior()

    def odds(kind: str, key: str, for_: float = 1.0, against: float = 1.0) -> float:
        return math.log((counts.get((kind, key, True), 0) + for_) / (counts.get((kind, key, False), 0) + against))

    keys = {kind: {k for c, k, _ in counts if c == kind} for kind in ("name", "word", "tag")}
    names = {n: odds("name", n, PRIOR if known.get(n, 0) > 0 else 5, PRIOR if known.get(n, 0) < 0 else 5) for n in keys["name"] | known.keys()}
    words = {}
    for key in keys["word"]:
        tag, linked = key.rsplit(" ", 1)
        words[tag, linked == "1"] = min(1.0, max(-1.0 if linked == "1" else 0.1, odds("word", key, 10, 5)))
    inside, outside = (counts.get(("all", "tags", x), 0) + 1 for x in (True, False))
    tags = {t: min(-0.05, max(-2.0, odds("tag", t) - math.log(inside / outside))) for t in keys["tag"]}
    return Weights(names, words, tags)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from the labelled ones of ``pages`` (page_id, html)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in batches:
            for page in part["html"]:
                seen.update(evidence(page))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "name", "inside", "n"])

    one = lambda tag: F.regexp_count("html", F.lit(f"(?i)<{tag}[\\s>]")) == 1
    none = F.regexp_count("html", F.lit("(?i)<article[\\s>]")) == 0
    labelled = pages.where(F.col("page_id").isNotNull() & (one("article") | (none & one("main")))).select("page_id")
    chosen = labelled.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    rows = pages.join(F.broadcast(chosen), "page_id").select("html").mapInPandas(count, "kind string, name string, inside boolean, n long")
    total = rows.groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()  # names on the sampled pages
    return weigh({(r.kind, r.name, r.inside): r.n for r in total})


def extract(pages: DataFrame, weights: Weights = DEFAULT) -> DataFrame:
    """The columns of ``pages`` but html, plus ``text`` and ``n_chars`` (code points)."""
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema])

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col("html").alias("_html")).mapInArrow(run, schema)


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every whole page of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit(pages))
