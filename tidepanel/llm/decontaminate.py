"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed set of token positions inside a window; the others are ignored. Over
windows of 16 tokens the six masks keep two of four blocks of four tokens, so that any
16 aligned tokens with up to two substitutions agree under at least one mask: the search
is lossless for the overlaps that verification accepts. Items of 8 to 15 tokens are one
window with two half masks (one substitution), items of 4 to 7 tokens must occur as they
are, and shorter ones are never matched, as prose holds them by chance.

The masked hashes of the benchmark make a table and, for the workers, a Bloom filter that
takes ``bits_per_key`` bits a hash and ``filter_bits`` at most; a larger benchmark gets a
fuller filter and more false candidates, not another plan. Training windows whose hash
passes travel with their 16 tokens and are joined with the benchmark's hashes; texts stay
where they are. A joined pair of windows is verified token by token, and since every
accepted pair has a hit of its own, verification needs nothing around it. Accepted
windows of one diagonal are joined while they touch: a row is a maximal union of them.

Rows: a NULL or empty text, or a NULL id, has no row in ``leaks``; ``clean`` judges a row
by its text alone, with or without an id, and keeps NULL and empty texts. Repeated rows
give one result row; the texts of one id have positions of their own, as have those of
one item; very long texts count whole; other columns are ignored by ``leaks`` and kept by
``clean``; an empty benchmark matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm.common import WordIds, cut, fresh, mix, rolling, spread, table, token_chunks, words

SPAN = 16
BITS_PER_KEY = 32
FILTER_BITS = 1 << 30
PROBES = 4
#: Texts to remove whose hashes are sent to every task; more are joined by a shuffle.
BROADCAST_TEXTS = 4_000_000
WINDOWS = "key long, doc_id long, version long, pos int, span int, tokens binary"
_WINDOWS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("span", pa.int32()), ("tokens", pa.binary())])
PAIRS = "doc_id long, version long, item_id long, item_version long, span int, diagonal int, q int, matches int"
_PAIRS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("item_id", pa.int64()), ("item_version", pa.int64())] + [(n, pa.int32()) for n in ("span", "diagonal", "q", "matches")])


def span_of(n: int) -> int:
    """Window length for an item of n tokens; 0: too short to match."""
    return 0 if n < 4 else min(n, SPAN)


def tolerance(span: int) -> int:
    return 2 if span == SPAN else 1 if span >= 8 else 0


def _masks(span: int) -> list[tuple[tuple[int, int], ...]]:
    """Each mask as (start, length) blocks of kept positions."""
    if span == SPAN:
        return [((4 * a, 4), (4 * b, 4)) for a, b in combinations(range(4), 2)]
    if span >= 8:
        return [((0, span // 2),), ((span // 2, span - span // 2),)]
    return [((0, span),)]


def _keys(ids: np.ndarray, span: int, cache: dict) -> Iterator[np.ndarray]:
    """Key of every window of ``span`` tokens, by mask."""
    n = len(ids) - span + 1
    if n <= 0:
        return
    for m, blocks in enumerate(_masks(span)):
        key = np.full(n, span * 64 + m, np.uint64)
        for start, length in blocks:
            if length not in cache:
                cache[length] = rolling(ids, length)
            key = key * np.uint64(0xD6E8FEB86659FD93) + cache[length][start : start + n]
        yield mix(key)


def _batch(key, doc_ids, versions, doc, at, offsets, span, ids) -> pa.RecordBatch:
    """Windows at ``at``, with their tokens by 32 bits each, padded with zeros to SPAN."""
    short = np.concatenate((ids.astype(np.uint32), np.zeros(SPAN, np.uint32)))
    tokens = short[at[:, None] + np.arange(SPAN)]
    tokens[:, span:] = 0
    ends = np.arange(len(at) + 1, dtype=np.int32) * (4 * SPAN)
    blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(tokens))])
    cols = [key.view(np.int64), doc_ids[doc], versions[doc], (at - offsets[doc]).astype(np.int32), np.full(len(at), span, np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), blob], schema=_WINDOWS)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """All masked windows of the items, ``doc_id`` being the item's id."""

    def emit(batches):
        memo = WordIds()
        for item_ids, offsets, ids, (versions,) in token_chunks(batches, memo, ("version",)):
            versions = np.array(versions, np.int64)
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                if span := span_of(int(b - a)):
                    cache: dict = {}
                    for key in _keys(ids[a:b], span, cache):
                        at = a + np.arange(len(key))
                        yield _batch(key, item_ids, versions, np.full(len(key), i), at, offsets, span, ids)

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return items.distinct().mapInArrow(emit, WINDOWS)


def slots(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's bit for each probe; ``bits`` is a power of two."""
    step = (key >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (key + np.uint64(i) * step) & np.uint64(bits - 1)


def bloom(keys: DataFrame, bits_per_key: int, filter_bits: int) -> np.ndarray:
    """Packed bits of a Bloom filter over ``key``, built by bitmap aggregation; its size is bounded."""
    n = max(1, keys.count())
    bits = min(filter_bits, max(1 << 15, 1 << (n * bits_per_key - 1).bit_length()))

    def probe(batches):
        for batch in batches:
            for s in slots(batch.column("key").to_numpy().view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64) + 1)], names=["slot"])

    page = keys.select("key").mapInArrow(probe, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in page.toLocalIterator():
        out[(row.page - 1) * 4096 : row.page * 4096] = np.frombuffer(row.bits, np.uint8)[: len(out)]
    return out


def passing(key: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Indexes of the keys that the filter may hold."""
    at = np.arange(len(key))
    for i in range(PROBES):
        k = key[at]
        s = (k + np.uint64(i) * ((k >> np.uint64(32)) | np.uint64(1))) & np.uint64(8 * len(found) - 1)
        at = at[(found[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def candidates(docs: DataFrame, windows: DataFrame, bits_per_key: int, filter_bits: int) -> DataFrame:
    """Windows of ``docs`` (doc_id, version, text) whose hash the filter may hold."""
    spans = sorted(r.span for r in windows.select("span").distinct().collect())
    found = docs.sparkSession.sparkContext.broadcast(bloom(windows, bits_per_key, filter_bits))

    def scan(batches):
        memo = WordIds()
        for doc_ids, offsets, ids, (versions,) in token_chunks(batches, memo, ("version",)):
            versions, cache = np.array(versions, np.int64), {}
            for span in spans:
                for key in _keys(ids, span, cache):
                    at = passing(key, found.value)
                    doc = np.searchsorted(offsets, at, "right") - 1
                    ok = at + span <= offsets[doc + 1]
                    if ok.any():
                        yield _batch(key[at[ok]], doc_ids, versions, doc[ok], at[ok], offsets, span, ids)

    return spread(docs).mapInArrow(scan, WINDOWS)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], np.uint32, SPAN * len(column), 4 * SPAN * column.offset).reshape(-1, SPAN)


def overlaps(docs: DataFrame, benchmark: DataFrame, bits_per_key: int, filter_bits: int) -> DataFrame:
    """Verified pairs of windows: where they are, and which of their tokens are equal, by bits."""
    windows = cut(benchmark_windows(benchmark), "windows")
    item = windows.select("key", "span", F.col("doc_id").alias("item_id"), F.col("version").alias("item_version"), F.col("pos").alias("q"), F.col("tokens").alias("item_tokens"))

    def verify(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_numpy() for n in ("doc_id", "version", "item_id", "item_version", "span", "pos", "q")}
            same = _rows(batch.column("tokens")) == _rows(batch.column("item_tokens"))
            span = col["span"]
            inside = np.arange(SPAN) < span[:, None]
            wrong = (~same & inside).sum(axis=1)
            ok = wrong <= np.where(span == SPAN, 2, np.where(span >= 8, 1, 0))
            matches = ((same & inside) << np.arange(SPAN)).sum(axis=1)
            cols = (col["doc_id"], col["version"], col["item_id"], col["item_version"], span, col["pos"] - col["q"], col["q"], matches)
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]).cast(t) for c, t in zip(cols, _PAIRS.types)], schema=_PAIRS)

    return candidates(docs, windows, bits_per_key, filter_bits).join(item, ["key", "span"]).mapInArrow(verify, PAIRS)


def leaks(documents: DataFrame, benchmark: DataFrame, bits_per_key: int = BITS_PER_KEY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_matched): a row for each stretch of touching windows."""
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    line = ["doc_id", "version", "item_id", "item_version", "diagonal", "span"]
    pairs = overlaps(docs, benchmark, bits_per_key, filter_bits).groupBy(*line, "q").agg(F.max("matches").alias("matches"))
    w = W.partitionBy(*line).orderBy("q")
    step = F.col("q") - F.lag("q").over(w)
    new = F.coalesce(F.col("step") > F.col("span"), F.lit(True))
    # of a window that overlaps the one before, the last ``step`` tokens are new
    fresh_matches = F.bit_count(F.when(new, F.col("matches")).otherwise(F.expr("shiftright(matches, span - step)")))
    parts = pairs.withColumn("step", step).withColumns({"n": fresh_matches, "part": F.sum(new.cast("int")).over(w)})
    q, end = F.min("q"), F.max(F.col("q") + F.col("span"))
    out = parts.groupBy(*line, "part").agg(q.alias("item_start"), (end - q).alias("n_tokens"), F.sum("n").cast("int").alias("n_matched"))
    return out.select("doc_id", "item_id", (F.col("item_start") + F.col("diagonal")).alias("doc_start"), "item_start", "n_tokens", "n_matched").distinct()


def clean(
    documents: DataFrame, benchmark: DataFrame, bits_per_key: int = BITS_PER_KEY, filter_bits: int = FILTER_BITS, broadcast_texts: int = BROADCAST_TEXTS
) -> DataFrame:
    """The documents, all columns, without those whose text overlaps a benchmark item.

    The texts to remove go by hash and length; their number is checked before they are
    sent to every task, and beyond ``broadcast_texts`` the documents are joined to them.
    """
    hashes = {fresh(documents, n): e for n, e in (("text_hash", F.xxhash64("text")), ("text_length", F.length("text")))}
    bad_hash, bad_length = (fresh(documents, n) for n in ("bad_hash", "bad_length"))
    rows = documents.withColumns(hashes)
    h, n = hashes
    # of the 64-bit hash, ``version`` is what the windows carry, and the length stands in for the id
    texts = documents.where("text is not null").select(F.length("text").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    found = overlaps(texts, benchmark, bits_per_key, filter_bits).select(F.col("version").alias(bad_hash), F.col("doc_id").alias(bad_length)).distinct()
    bad = cut(found, "contaminated")
    side = F.broadcast(bad) if bad.count() <= broadcast_texts else bad.hint("merge")
    return rows.join(side, (F.col(h) == F.col(bad_hash)) & (F.col(n) == F.col(bad_length)), "left_anti").drop(h, n)


def brute(documents: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple[int, int, int, int, int, int]]:
    """``leaks`` by comparing every window with every window; for tests."""
    out = set()
    for i, t in items:
        a = words(t or "")
        span = span_of(len(a))
        for d, text in documents:
            w = words(text or "")
            if not span or d is None or i is None:
                continue
            good: dict[int, list[int]] = {}
            for p in range(len(w) - span + 1):
                for q in range(len(a) - span + 1):
                    if sum(x != y for x, y in zip(w[p : p + span], a[q : q + span])) <= tolerance(span):
                        good.setdefault(p - q, []).append(q)
            for diagonal, starts in good.items():
                covered = sorted({x for q in starts for x in range(q, q + span)})
                while covered:
                    n = next((k for k in range(1, len(covered)) if covered[k] != covered[0] + k), len(covered))
                    q, covered = covered[0], covered[n:]
                    out.add((d, i, q + diagonal, q, n, sum(a[x] == w[x + diagonal] for x in range(q, q + n))))
    return out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
#: Windows of one benchmark item are compared where they agree under a mask, written out token by token.
_KEYS = """case when span = 16 then [list_concat(t[1:4], t[5:8], ['01']), list_concat(t[1:4], t[9:12], ['02']), list_concat(t[1:4], t[13:16], ['03']),
    list_concat(t[5:8], t[9:12], ['12']), list_concat(t[5:8], t[13:16], ['13']), list_concat(t[9:12], t[13:16], ['23'])]
    when span >= 8 then [list_concat(t[1:span // 2], ['0']), list_concat(t[span // 2 + 1:span], ['1'])] else [t] end"""
SQL = rf"""
with items as (select item_id, w, least(len(w), 16) as span from (select distinct item_id, {_TOKENS} as w from benchmark where item_id is not null and text is not null) where len(w) >= 4),
docs as (select doc_id, row_number() over () as version, w from (select distinct doc_id, {_TOKENS} as w from documents where doc_id is not null and text is not null)),
iw as (select item_id, w, span, q, w[q + 1:q + span] as t from (select *, unnest(range(len(w) - span + 1)) as q from items)),
dw as (select doc_id, version, span, p, w[p + 1:p + span] as t from (select *, unnest(range(len(w) - span + 1)) as p from docs, (select distinct span from items) where len(w) >= span)),
ik as (select * exclude (k), unnest(k) as k from (select *, {_KEYS} as k from iw)),
dk as (select * exclude (k), unnest(k) as k from (select *, {_KEYS} as k from dw)),
pairs as (select distinct doc_id, version, item_id, ik.w as item, ik.span, p - q as diagonal, q, dk.t as dt, ik.t as it from dk join ik on ik.span = dk.span and ik.k = dk.k),
good as (select *, list_transform(range(span), lambda j: (dt[j + 1] = it[j + 1])::int) as same from pairs
    where len(list_filter(range(span), lambda j: dt[j + 1] <> it[j + 1])) <= case when span = 16 then 2 when span >= 8 then 1 else 0 end),
stepped as (select *, q - lag(q) over w as step from good window w as (partition by doc_id, version, item_id, item, span, diagonal order by q)),
parts as (select *, case when step is null or step > span then list_sum(same) else list_sum(same[span - step + 1:span]) end as n,
    sum(case when step is null or step > span then 1 else 0 end) over (partition by doc_id, version, item_id, item, span, diagonal order by q) as part from stepped)
select distinct doc_id, item_id, cast(min(q) + diagonal as integer) as doc_start, cast(min(q) as integer) as item_start, cast(max(q) + any_value(span) - min(q) as integer) as n_tokens, cast(sum(n) as integer) as n_matched
from parts group by doc_id, version, item_id, item, diagonal, part
"""
