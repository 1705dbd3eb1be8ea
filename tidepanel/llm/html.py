"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; the
contiguous subsequence of the highest sum is the content. The weights are log-odds of
being inside the content, by kind of token (for words: in a link or not, and the length
of the run of words they stand in; for tags: their name), learned from pages that mark
their content with an ``article`` element. These marks themselves are taken out of every
page before scoring. About ``fit_pages`` marked pages are used, taken by hash of the id.

The best region is found by one scan over prefix sums. A ``<`` that opens no tag, comment
or declaration is text; a tag without its ``>`` loses that sign and counts as words. Rows: a NULL html gives a NULL
text; a page without words gives an empty one; of equal regions the first, then shortest,
wins; a NULL id is kept; repeated rows are treated alike; other columns are ignored; with
no marked page the weights are ``DEFAULT``; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import spread, table

FIT_PAGES = 4000
#: Comments, scripts, styles and tags, whose quoted values may hold a >; the rest are words. A < that opens no tag is text.
TOKEN = re.compile(r"""<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-zA-Z](?:[^<>"']|"[^"<]*"|'[^'<]*')*>|<[a-zA-Z/!?][^<>]*>|(?:[^<\s]|<(?![a-zA-Z/!?]))+""", re.S | re.I)
OPENS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?")
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
MARKS = {"article", "main"}
TAGS = set(
    "a abbr address aside audio b blockquote body br button canvas caption cite code dd div dl dt em figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input label li link meta nav ol option p pre q s section select small span strong style script sub sup svg table "
    "tbody td textarea tfoot th thead title tr u ul video".split()
)
BLOCKS = TAGS - set("a abbr b cite code em i q s small span strong sub sup u".split())
#: Least magnitude of a weight: words stay positive and tags negative.
LEAST = 0.05
DEFAULT_WORD, DEFAULT_TAG = 1.0, -3.0
DEFAULT: dict[str, float] = {}


def tokenize(page: str) -> tuple[list[str], list[str], int, int]:
    """(tokens, kinds, start, end): start and end are the marked content, or -1."""
    out, names, start, end, link = [], [], -1, -1, False
    for t in TOKEN.findall(page):
        if t[0] != "<" or t[1:2] not in OPENS:
            out.append(t)
            names.append("wa" if link else "w")
            continue
        m = NAME.match(t)
        name = m.group(1).lower() if m else "!"
        closing = t[1:2] == "/"
        if name in MARKS:
            if closing:
                end = len(out)
            elif start < 0:
                start = len(out)
            continue
        if name == "a":
            link = not closing
        out.append(t)
        names.append(("/" if closing else "") + (name if name in TAGS else "other"))
    kinds, n, i = names, len(names), 0
    while i < n:
        if names[i][0] == "w":
            j = i
            while j < n and names[j][0] == "w":
                j += 1
            size = "0" if j - i < 4 else "1" if j - i < 12 else "2"
            for k in range(i, j):
                kinds[k] = names[k] + size
            i = j
        else:
            kinds[i] = "<" + names[i]
            i += 1
    return out, kinds, start, end


def weights(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weights from (kind, tokens inside, tokens outside the content)."""
    out = {}
    for kind, inside, outside in counts:
        odds = float(np.log((inside + 0.5) / (outside + 0.5)))
        out[kind] = min(-LEAST, odds) if kind[0] == "<" else max(LEAST, odds)
    return out


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """First shortest [start, end) of the highest sum; (0, 0) if nothing is positive."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    low = np.minimum.accumulate(sums)
    gain = sums[1:] - low[:-1]
    end = int(gain.argmax())
    if gain[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(sums[: end + 1] == low[end])[-1]), end + 1


def extract(page: str, w: dict[str, float]) -> str:
    tokens, kinds, _, _ = tokenize(page)
    scores = np.array([w[k] if k in w else DEFAULT_TAG if k[0] == "<" else DEFAULT_WORD for k in kinds])
    start, end = best_region(scores)
    parts = []
    for t, k in zip(tokens[start:end], kinds[start:end]):
        if k[0] != "<":
            parts.append(t)
            parts.append(" ")
        elif k[1:].lstrip("/") in BLOCKS and parts and parts[-1] != "\n":
            parts[-1:] = ["\n"] if parts[-1] == " " else [parts[-1], "\n"]
    return entities.unescape("".join(parts)).strip()


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights from about ``fit_pages`` of the pages that mark their content."""

    def count(batches):
        totals: dict[str, list[int]] = {}
        for batch in batches:
            for h in batch.column("html"):
                _, kinds, start, end = tokenize(h.as_py())
                if 0 <= start < end:
                    for i, k in enumerate(kinds):
                        totals.setdefault(k, [0, 0])[0 if start <= i < end else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([x for x, _ in totals.values()], pa.int64()), pa.array([y for _, y in totals.values()], pa.int64())],
            names=["kind", "inside", "outside"],
        )

    marked = pages.where(F.col("html").contains("</article>"))
    n = marked.count()
    share = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, fit_pages / max(1, n))))
    # a few hundred kinds at most: names outside TAGS are one kind
    rows = marked.where(share).select("html").mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside"), F.sum("outside")).collect()
    return weights([tuple(r) for r in rows]) if rows else DEFAULT


def content(pages: DataFrame, w: dict[str, float]) -> DataFrame:
    """(page_id, text, n_words) of every page."""

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py(), w) if h.is_valid else None for h in batch.column("html")]
            n = [None if t is None else len(t.split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["page_id", "text", "n_words"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string, n_words int")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return content(pages, fit(pages))
