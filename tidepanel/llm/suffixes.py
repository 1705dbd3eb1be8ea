"""Substring dedup by a suffix array built blockwise with a difference cover.

A distributed suffix array would move every suffix with the 16 tokens and the five cover
ranks that its comparisons need, some 100 bytes a token, so suffixes are first dealt to
blocks in which they share their text: by the smallest hash of the 12-token grams in
their first 50 tokens. Suffixes that share 50 tokens share the block, and neighbouring
suffixes share it too, so that a block receives short runs of text. Gram hashes seen in
one document only are settled by a first, narrow exchange: their suffixes have no long
tie. Of the rest, the suffix array of each block's text is built one suffix bucket at a
time:

1. ranks of the difference-cover sample (5 of 16 positions) to the end of the text are
   computed before any bucket, by doubling over the sample alone;
2. splitters on the first two tokens cut the suffixes into lexicographic buckets of about
   ``SUFFIXES``, of which one is in memory at a time;
3. a bucket is sorted by the first 16 tokens; longer ties are resolved by the sample
   ranks at the offset, below 16, at which both suffixes fall on the cover;
4. neighbours in the array that agree in 50 tokens form groups, and a group with two
   documents or more is repeated text. Successive windows are joined as long as the same
   places hold them, as in ``anchors``.

Memory is bounded by the block's text (``BLOCK_TOKENS``, cut at whole gram hashes; equal
runs are sorted once) and one bucket; the number of blocks grows with the corpus. The
places of one gram hash are in one task, however many there are.

Rows: NULL ids and NULL texts are left out; texts under 50 tokens hold no repeat; a
passage repeated only inside one document is none; rows that repeat an id are one
document, whose texts, where they differ, have positions of their own; very long texts count whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.anchors import repeated
from tidepanel.llm.common import FOUND, PACKED, WordIds, cut, matched, mix, pack, rolling, spans, spread, table, token_chunks, versions, window_starts

MIN_TOKENS = 50
GRAM = 12
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
RUNS_PER_BUCKET = 500_000
BLOCK_TOKENS = 1_000_000
#: Suffixes that are sorted at once.
SUFFIXES = 250_000
RUNS = "bucket int, key binary, docs binary, versions binary, pos binary, suffixes binary, tokens binary"
_RUNS = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("key", "docs", "versions", "pos", "suffixes", "tokens")])
_IN_COVER = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
#: Offset at which positions of two residues both fall on the cover.
OFFSET = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def runs_of(offsets: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, suffixes, smallest gram hash, document) of the runs of windows of equal hash."""
    ok, doc = window_starts(offsets, width)
    least, span, size = mix(rolling(ids, GRAM)), width - GRAM + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    p = np.flatnonzero(ok)
    if not len(p):
        return p, p, least[:0], p
    v, d = least[p], doc[p]
    starts = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1))))
    return p[starts], np.diff(np.concatenate((starts, [len(p)]))), v[starts], d[starts]


def _narrow(documents: DataFrame, buckets: int, width: int) -> DataFrame:
    """The gram hash of every run, where it starts."""

    def emit(batches):
        memo = WordIds()
        for doc_ids, offsets, ids, (version,) in token_chunks(batches, memo, ("version",)):
            start, _, key, doc = runs_of(offsets, ids, width)
            if len(start):
                yield pack((key >> np.uint64(32)).astype(np.int64) % buckets, doc, start - offsets[doc], key, np.stack((doc_ids, version), axis=1), buckets)

    return documents.mapInArrow(emit, PACKED)


def _runs(documents: DataFrame, hits: DataFrame, buckets: int, width: int) -> DataFrame:
    """Text of the runs whose gram hash occurs in another document."""
    near = hits.groupBy("doc_id", "version").agg(F.collect_list("pos").alias("hits"))

    def emit(batches):
        memo = WordIds()
        for doc_ids, offsets, ids, (hit, version) in token_chunks(batches, memo, ("hits", "version")):
            start, n, key, doc = runs_of(offsets, ids, width)
            wanted = np.zeros(len(ids), bool)
            for k, blobs in enumerate(hit):
                wanted[offsets[k] + np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)] = True
            keep, version = wanted[start], np.array(version, np.int64)
            bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            order = np.flatnonzero(keep)[np.argsort(bucket[keep], kind="stable")]
            start, n, key, doc, bucket = (x[order] for x in (start, n, key, doc, bucket))
            rows, firsts = [[] for _ in range(7)], np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(order) else []
            for a, b in zip(firsts, [*firsts[1:], len(order)]):
                size = n[a:b] + width - 1
                at = np.repeat(start[a:b] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                cols = (key[a:b], doc_ids[doc[a:b]], version[doc[a:b]], (start - offsets[doc])[a:b].astype(np.uint32), n[a:b].astype(np.uint32), ids[at].astype(np.uint32))
                for r, x in zip(rows, (int(bucket[a]), *(c.tobytes() for c in cols))):
                    r.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, _RUNS.types)], schema=_RUNS)

    return documents.join(near, ["doc_id", "version"]).mapInArrow(emit, RUNS)


def _dense(key: np.ndarray) -> np.ndarray:
    """1-based ranks."""
    return np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)


def _paired(rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _dense(rank << np.uint64(32) | after)


def columns(text: np.ndarray, end: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The PERIOD tokens from each position, two to a column; 0 beyond the run's end."""
    padded = np.concatenate((text, np.zeros(PERIOD, text.dtype))).astype(np.uint64)
    token = lambda s: np.where(at + s < end[at], padded[at + s], np.uint64(0))
    return [token(s) << np.uint64(32) | token(s + 1) for s in range(0, PERIOD, 2)]


def changes(cols: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each row in order differs from the one before."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        v = c[order]
        new[1:] |= v[1:] != v[:-1]
    return new


def cover_ranks(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks, to the ends of their runs, of the positions on the cover (0 elsewhere). Tokens are 1 or more."""
    at = np.flatnonzero(_IN_COVER[np.arange(len(text)) % PERIOD])
    out = np.zeros(len(text), np.uint64)
    if not len(at):
        return out
    cols = columns(text, end, at)
    order = np.lexsort(cols[::-1])
    r = np.empty(len(at), np.uint64)
    r[order] = np.cumsum(changes(cols, order)).astype(np.uint64)
    size, longest = PERIOD, int((end[at] - at).max())
    while True:
        out[at] = r
        if size >= longest or int(r.max()) == len(r):
            return out
        there = at + size < end[at]
        after = np.zeros(len(at), np.uint64)
        after[there] = out[at[there] + size]
        r = _paired(r, after)
        size *= 2


def buckets_of(text: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The suffixes dealt by splitters on their first two tokens, in the buckets' order."""
    key = text[at].astype(np.uint64) << np.uint64(32) | text[at + 1]
    n = -(-len(at) // size)
    if n <= 1:
        return [at]
    sample = np.sort(key[:: max(1, len(key) // (64 * n))])
    splitters = np.unique(sample[np.arange(1, n) * len(sample) // n])
    bucket = np.searchsorted(splitters, key, "right")
    order = np.argsort(bucket.astype(np.uint16), kind="stable") if n < 65536 else np.argsort(bucket, kind="stable")
    return [x for x in np.split(at[order], np.cumsum(np.bincount(bucket, minlength=len(splitters) + 1))[:-1]) if len(x)]


def sorted_bucket(text: np.ndarray, end: np.ndarray, at: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes ``at`` in order, whether each ties with the one before in PERIOD tokens). Each has PERIOD tokens or more."""
    cols = columns(text, end, at)
    order = np.lexsort(cols[::-1])
    new = changes(cols, order)
    at = at[order]
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((firsts, [len(at)])))
    inside = np.arange(len(at)) - np.repeat(firsts, sizes)
    size = np.repeat(sizes, sizes)
    # short ties: odd-even transposition, all ties at once
    for step in range(8):
        i = np.flatnonzero((size <= 8) & (size > step) & (inside % 2 == step % 2) & (inside + 1 < size))
        a, b = at[i], at[i + 1]
        d = OFFSET[a % PERIOD, b % PERIOD]
        swap = cover[a + d] > cover[b + d]
        i = i[swap]
        at[i], at[i + 1] = at[i + 1], at[i]
    # long ties: a suffix's place is the number of smaller ones in each residue class, found
    # by binary search, as a class is sorted by the cover ranks at any offset on the cover
    big = np.flatnonzero(size > 8)
    if len(big):
        tie = np.repeat(np.arange(len(firsts)), sizes)[big].astype(np.uint64) << np.uint64(32)
        suffix, place = at[big], np.zeros(len(big), np.int64)
        classes = []
        for c in range(PERIOD):
            m = np.flatnonzero(suffix % PERIOD == c)
            classes.append(m[np.argsort(tie[m] | cover[suffix[m] + OFFSET[c, c]], kind="stable")])
        for c, mc in enumerate(classes):
            if not len(mc):
                continue
            for x, mx in enumerate(classes):
                d = OFFSET[x, c]
                keys = tie[mc] | cover[suffix[mc] + d]
                side = "left" if c >= x else "right"  # equal suffixes: by residue class
                if c == x:
                    place[mx] += np.arange(len(mx)) - np.searchsorted(tie[mc], tie[mx], "left")
                else:
                    place[mx] += np.searchsorted(keys, tie[mx] | cover[suffix[mx] + d], side) - np.searchsorted(tie[mc], tie[mx], "left")
        out = np.empty(len(big), np.int64)
        out[big.searchsorted(firsts[np.repeat(np.arange(len(firsts)), sizes)[big]]) + place] = suffix
        at[big] = out
    return at, ~new


def suffix_array(text: np.ndarray, end: np.ndarray, at: np.ndarray, width: int, size: int = SUFFIXES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes in order, whether each shares ``width`` tokens with the one before), a bucket at a time."""
    text = _dense(text).astype(np.uint32)
    cover = cover_ranks(text, end)
    for bucket in buckets_of(text, at, size):
        order, same = sorted_bucket(text, end, bucket, cover)
        i = np.flatnonzero(same)
        for s in range(PERIOD, width):  # ties thin out fast
            i = i[text[order[i] + s] == text[order[i - 1] + s]]
        same = np.zeros(len(order), bool)
        same[i] = True
        yield order, same


def sort_bucket(t: pa.Table, width: int, limit: int = BLOCK_TOKENS) -> pa.Table:
    """Suffixes of the bucket that share ``width`` tokens with another document's."""
    cols = [np.concatenate([np.frombuffer(x.as_py(), k) for x in t.column(n)]) for n, k in (("key", np.uint64), ("docs", np.int64), ("versions", np.int64), ("pos", np.uint32), ("suffixes", np.uint32), ("tokens", np.uint32))]
    key, doc, version, pos, n, tokens = cols[0], cols[1], cols[2], cols[3].astype(np.int64), cols[4].astype(np.int64), cols[5]
    size = n + width - 1
    start = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    out = []
    ends = np.cumsum(size[order])
    edges = np.flatnonzero(np.concatenate((key[order][1:] != key[order][:-1], [True]))) + 1
    a = 0
    while a < len(order):
        base = ends[a - 1] if a else 0
        k = max(int(np.searchsorted(ends[edges - 1], base + limit, "right")) - 1, int(np.searchsorted(edges, a, "right")))
        b = int(edges[k])
        out.append(_sort_runs(*(x[order[a:b]] for x in (doc, version, pos, n, size, start)), tokens, width))
        a = b
    return pa.concat_tables(out)


def _sort_runs(doc, version, pos, n, size, start, tokens, width) -> pa.Table:
    # equal runs are sorted once, for their two lowest documents' sake
    take = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text = tokens[take]
    first = np.cumsum(size) - size
    weight = mix(text.astype(np.uint64) + (np.arange(len(text)) - np.repeat(first, size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    digest = np.add.reduceat(weight, first)
    kind, inverse = np.unique(np.stack((digest, size.astype(np.uint64)), axis=1), axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.lexsort((doc, inverse))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(inverse[by]) != 0)))
    low = doc[by[starts]]
    high = doc[by[np.concatenate((starts[1:], [len(by)])) - 1]]
    one = by[starts]
    # concatenated text of one run a kind
    s1, n1 = size[one], n[one]
    take = np.repeat(first[one] - (np.cumsum(s1) - s1), s1) + np.arange(s1.sum())
    text, first1 = text[take], np.cumsum(s1) - s1
    end = np.repeat(first1 + s1, s1)
    at = np.repeat(first1 - (np.cumsum(n1) - n1), n1) + np.arange(n1.sum())
    run_at = np.repeat(np.arange(len(one)), s1)
    group, n_groups = np.full(len(text), -1, np.int64), 0
    for order, same in suffix_array(text, end, at, width):
        groups = np.flatnonzero(~same)
        sizes = np.diff(np.concatenate((groups, [len(order)])))
        r = run_at[order]
        hit = np.repeat(np.minimum.reduceat(low[r], groups) != np.maximum.reduceat(high[r], groups), sizes)
        group[order[hit]] = n_groups + np.repeat(np.arange(len(groups)), sizes)[hit]
        n_groups += len(groups)
    # back to all runs of each kind
    take = np.repeat(first1[inverse] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    k = group[take]
    ok = k >= 0
    where = (np.repeat(pos - (np.cumsum(n) - n), n) + np.arange(n.sum()))[ok]
    ids, who = np.unique(np.stack((doc, version), axis=1), axis=0, return_inverse=True)
    return matched(k[ok], np.repeat(who.ravel(), n)[ok], ids, where, width)


def spans_of(documents: DataFrame, width: int = MIN_TOKENS) -> DataFrame:
    """Exact repeats across documents (``common.spans``): (doc_id, start_token, n_tokens, other_doc_id, repeat_id, version)."""
    docs = spread(versions(documents))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-chars // (6 * 20 * RUNS_PER_BUCKET)))
    hits = cut(_narrow(docs, buckets, width).groupBy("bucket").applyInArrow(lambda t: repeated(t, width), FOUND).select("doc_id", "version", "pos"), "runs")
    runs = hits.agg(F.sum(F.length("pos") / 4)).first()[0] or 0
    buckets = max(8, -(-int(runs) * 70 // BLOCK_TOKENS))
    same = cut(_runs(docs, hits, buckets, width).groupBy("bucket").applyInArrow(lambda t: sort_bucket(t, width), FOUND), "suffixes")
    return spans(same, width)


def repeats(documents: DataFrame, width: int = MIN_TOKENS) -> DataFrame:
    """``spans_of`` without the repeat's id and the text's hash."""
    return spans_of(documents, width).drop("repeat_id", "version")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents"))
