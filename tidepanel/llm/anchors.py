"""Substring dedup by fixed-block anchors.

Every document is a reference: its blocks of 25 tokens at multiples of 25 are indexed,
and every window of 25 tokens of every document probes the index. Any repeat of 50
tokens holds a whole block of each of its documents, so that a window of 50 tokens
without a hit in its first 25 starts is not repeated. Where there are hits, they are
extended: the windows of 50 tokens around them are matched exactly with those of the other
documents, and successive windows are joined as long as the same places hold them. Matching
by window instead of by pair of occurrences makes a passage of m documents cost m, not m
squared: each row names one partner, and rows of equal ``repeat_id`` hold the same text.
Where some of those places share more text, it follows as the next span, which overlaps by
49 tokens; ``common.by_pair`` joins the spans of each pair of documents. Windows of 50
tokens count as equal where 96 bits of two independent hashes are, so that among 10^13
windows less than one false pair in a thousand corpora is expected.

Both matches run inside buckets of the hashes; entries travel packed, a row a chunk and
bucket. The number of buckets grows with the corpus, a bucket does not.

Rows: NULL ids and NULL texts are left out; texts under 50 tokens hold no repeat; a
passage repeated only inside one document is none; rows that repeat an id are one
document, whose texts, where they differ, have positions of their own; very long texts count whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import FOUND, PACKED, WordIds, cut, found, matched, mix, pack, rolling, spans, spread, table, token_chunks, unpack_versions, versions, window_starts

MIN_TOKENS = 50
BLOCK = 25
ENTRIES_PER_BUCKET = 2_000_000
EXACT_PER_BUCKET = 1_000_000
_EXACT = np.dtype([("h", "<u8"), ("check", "<u4")])


def probes(documents: DataFrame, buckets: int, block: int) -> DataFrame:
    """Every window of ``block`` tokens: bucket and 32 further bits of its hash."""

    def emit(batches):
        memo = WordIds()
        for doc_ids, offsets, ids, (version,) in token_chunks(batches, memo, ("version",)):
            ok, doc = window_starts(offsets, block)
            p = np.flatnonzero(ok)
            if len(p):
                h = mix(rolling(ids, block)[p])
                yield pack((h >> np.uint64(32)).astype(np.int64) % buckets, doc[p], p - offsets[doc[p]], h.astype(np.uint32), np.stack((doc_ids, version), axis=1), buckets)

    return documents.mapInArrow(emit, PACKED)


def probe(t: pa.Table, block: int) -> pa.Table:
    """Windows that equal an indexed block of another document (up to a hash of this bucket)."""
    who, ids, pos, h = unpack_versions(t, np.uint32)
    doc = ids[:, 0]
    indexed = np.flatnonzero(pos % block == 0)
    front = np.zeros(1 << 23, bool)
    front[h[indexed] & np.uint32((1 << 23) - 1)] = True
    maybe = np.flatnonzero(front[h & np.uint32((1 << 23) - 1)])
    order = indexed[np.lexsort((who[indexed], h[indexed]))]
    kinds, starts = np.unique(h[order], return_index=True)
    if not len(kinds):
        return found(pos[:0], pos[:0], pos[:0], pos[:0], pos[:0])
    low, high = doc[who[order[starts]]], doc[who[order[np.concatenate((starts[1:], [len(order)])) - 1]]]
    k = np.minimum(np.searchsorted(kinds, h[maybe]), len(kinds) - 1)
    own = doc[who[maybe]]
    other = np.where(low[k] != own, low[k], high[k])
    hit = (kinds[k] == h[maybe]) & (other != own)
    own, maybe, other = own[hit], maybe[hit], other[hit]
    return found(own, ids[who[maybe], 1], pos[maybe], other, np.zeros(len(own), np.uint64))


def exact_windows(documents: DataFrame, hits: DataFrame, buckets: int, width: int, block: int) -> DataFrame:
    """Windows of ``width`` tokens with a hit in reach, of the documents that have hits."""
    near = hits.groupBy("doc_id", "version").agg(F.collect_list("pos").alias("hits"))
    reach = width - block

    def emit(batches):
        memo = WordIds()
        for doc_ids, offsets, ids, (hit, version) in token_chunks(batches, memo, ("hits", "version")):
            ok, doc = window_starts(offsets, width)
            marks = np.zeros(len(ids) + 1, np.int64)
            for k, blobs in enumerate(hit):
                marks[offsets[k] + np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)] = 1
            total = np.concatenate(([0], np.cumsum(marks)))
            at = np.arange(len(ids))
            ok &= total[np.minimum(at + reach + 1, len(ids))] > total[at]
            p = np.flatnonzero(ok)
            if len(p):
                h = np.empty(len(p), _EXACT)
                h["h"], h["check"] = mix(rolling(ids, width)[p]), mix(rolling(mix(ids), width)[p]) >> np.uint64(32)
                yield pack((h["h"] >> np.uint64(32)).astype(np.int64) % buckets, doc[p], p - offsets[doc[p]], h, np.stack((doc_ids, version), axis=1), buckets)

    return documents.join(near, ["doc_id", "version"]).mapInArrow(emit, PACKED)


def repeated(t: pa.Table, width: int) -> pa.Table:
    """Windows whose hash occurs in another document."""
    who, ids, pos, h = unpack_versions(t, np.uint64)
    return matched(h, who, ids, pos, width)


def repeated_exactly(t: pa.Table, width: int) -> pa.Table:
    """As ``repeated``, by both hashes."""
    who, ids, pos, h = unpack_versions(t, _EXACT)
    order = np.lexsort((h["check"], h["h"]))
    same = h[order]
    cls = np.empty(len(h), np.int64)
    cls[order] = np.cumsum(np.concatenate(([False], (same["h"][1:] != same["h"][:-1]) | (same["check"][1:] != same["check"][:-1])))[: len(h)])
    return matched(cls, who, ids, pos, width)


def spans_of(documents: DataFrame, width: int = MIN_TOKENS, block: int = BLOCK) -> DataFrame:
    """Exact repeats across documents (``common.spans``): (doc_id, start_token, n_tokens, other_doc_id, repeat_id, version)."""
    assert width >= 2 * block - 1
    docs = spread(versions(documents))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-chars // (6 * ENTRIES_PER_BUCKET)))
    hits = cut(probes(docs, buckets, block).groupBy("bucket").applyInArrow(lambda t: probe(t, block), FOUND).select("doc_id", "version", "pos"), "hits")
    # a hit is in reach of so many windows
    windows = min(int(hits.agg(F.sum(F.length("pos") / 4)).first()[0] or 0) * (width - block + 1), chars // 6)
    buckets = max(8, -(-windows // EXACT_PER_BUCKET))
    same = cut(exact_windows(docs, hits, buckets, width, block).groupBy("bucket").applyInArrow(lambda t: repeated_exactly(t, width), FOUND), "repeated")
    return spans(same, width)


def repeats(documents: DataFrame, width: int = MIN_TOKENS, block: int = BLOCK) -> DataFrame:
    """``spans_of`` without the repeat's id and the text's hash."""
    return spans_of(documents, width, block).drop("repeat_id", "version")


def brute(documents: list[tuple[int, str]], width: int) -> dict[int, set[int]]:
    """Tokens of each document that lie in a window of ``width`` found in another one; for tests."""
    from tidepanel.llm.common import words

    at: dict[tuple, set[int]] = {}
    rows = [(d, words(t)) for d, t in documents if d is not None and t is not None]
    for d, w in rows:
        for p in range(len(w) - width + 1):
            at.setdefault(tuple(w[p : p + width]), set()).add(d)
    out: dict[int, set[int]] = {}
    for d, w in rows:
        for p in range(len(w) - width + 1):
            if len(at[tuple(w[p : p + width])]) > 1:
                out.setdefault(d, set()).update(range(p, p + width))
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents"))
