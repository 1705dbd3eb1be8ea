"""Shared pieces: table access, intermediate tables, tokens and the packed exchange.

Ids that carry no key (NULL ``doc_id``) and NULL texts never enter a search: such a
row cannot be referred to, or has nothing to compare. Each operator states what
becomes of those rows.
"""

from __future__ import annotations

import contextlib
import contextvars
import re
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words remembered by a Python worker before its memo is emptied.
MEMO_WORDS = 200_000
#: Tokens that a worker turns into arrays at once.
CHUNK_TOKENS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition a core: a small file of one row group is otherwise one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session inside one JVM (tests) may leave it unset."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return base.rstrip("/")


_cutting, _lock, _before = 0, threading.Lock(), None


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    This cuts the lineage in a way that outlives executors, and lets Spark drop the
    shuffle files behind the written table at once instead of at the end of the job. The
    setting for that is the session's, so that it is restored when the last write ends.
    """
    global _cutting, _before
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _lock:
        if not _cutting:
            _before = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _cutting += 1
    try:
        df.write.parquet(path)
    finally:
        with _lock:
            _cutting -= 1
            if not _cutting:
                spark.conf.unset(_CLEAN) if _before is None else spark.conf.set(_CLEAN, _before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """The results of ``cut`` made inside, which are deleted at the end if they are still listed."""
    token = _made.set(made := [])
    try:
        yield made
    finally:
        _made.reset(token)
        for df in made:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut`` that nothing will read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # one that is gone already does no harm


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one derived from it that no column of ``df`` has in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# == tokens
class WordIds(dict):
    """word -> 64-bit id, remembered for as long as the memo stays small."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


def words(text: str) -> list[str]:
    """Lower-case runs of word characters: the token of every text operator here."""
    return WORD.findall(text.lower())


def word_ids(text: str, memo: WordIds) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(memo.__getitem__, w), dtype=np.uint64, count=len(w))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that any bits of a polynomial hash can serve as a key."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_B = 0x9E3779B97F4A7C15


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every n-token window, by doubling; unmixed."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    part, width, out, done = ids, 1, None, 0
    while True:
        if n & width:
            if out is None:
                out, done = part, width
            else:
                shifted = part[done : done + len(out)]
                size = min(len(out), len(shifted))
                out = out[:size] * np.uint64(pow(_B, width, 1 << 64)) + shifted[:size]
                done += width
        width *= 2
        if width > n:
            break
        half = width // 2
        part = part[: len(part) - half] * np.uint64(pow(_B, half, 1 << 64)) + part[half:]
    return out[: len(ids) - n + 1]


def token_chunks(
    batches: Iterator[pa.RecordBatch], memo: WordIds, extra: tuple[str, ...] = ()
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """(doc ids, offsets of length docs+1, token ids, [extra columns' values]) by chunk.

    Rows without id or text are skipped; a chunk closes once it holds CHUNK_TOKENS, and
    a longer document is a chunk of its own.
    """
    ids, arrays, more, size = [], [], [[] for _ in extra], 0

    def out():
        lens = np.fromiter(map(len, arrays), np.int64, len(arrays))
        offsets = np.concatenate(([0], np.cumsum(lens)))
        return np.array(ids, np.int64), offsets, np.concatenate(arrays), more

    for batch in batches:
        doc, text = batch.column("doc_id"), batch.column("text")
        cols = [batch.column(c) for c in extra]
        for i in range(batch.num_rows):
            d, t = doc[i].as_py(), text[i].as_py()
            if d is None or t is None:
                continue
            a = word_ids(t, memo)
            if size and size + len(a) > CHUNK_TOKENS:
                yield out()
                ids, arrays, more, size = [], [], [[] for _ in extra], 0
            ids.append(d)
            arrays.append(a)
            for m, c in zip(more, cols):
                m.append(c[i].as_py())
            size += len(a)
    if ids:
        yield out()


def window_starts(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of starts of n-token windows inside one document, document of each token)."""
    lens = np.diff(offsets)
    doc = np.repeat(np.arange(len(lens)), lens)
    total = int(offsets[-1])
    ok = np.zeros(total, bool)
    if total >= n:
        ok[: total - n + 1] = doc[: total - n + 1] == doc[n - 1 :]
    return ok, doc


# == packed exchange
#: One row carries all entries of one chunk for one bucket, as packed arrays. A row-wise
#: exchange of fixed-width integers takes four times the bytes and ten times the CPU.
PACKED = "bucket int, docs binary, counts binary, pos binary, value binary"
PACKED_ARROW = pa.schema(
    [("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("pos", pa.binary()), ("value", pa.binary())]
)


def pack(
    bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, value: np.ndarray, doc_ids: np.ndarray, buckets: int
) -> pa.RecordBatch:
    """Entries (doc is an index into doc_ids, ascending) as one row a bucket. An id may have several columns."""
    kind = np.uint8 if buckets <= 256 else np.uint16 if buckets <= 65536 else np.uint32
    order = np.argsort(bucket.astype(kind), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    doc, pos, value = doc[order], pos[order].astype(np.uint32), value[order]
    rows, start = [[], [], [], [], []], 0
    for b in np.flatnonzero(np.diff(np.concatenate(([0], ends)))):
        start, end = (int(ends[b - 1]) if b else 0), int(ends[b])
        d = doc[start:end]
        firsts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        p = pos[start:end]
        rows[0].append(int(b))
        rows[1].append(doc_ids[d[firsts]].astype(np.int64).tobytes())
        rows[2].append(np.diff(np.concatenate((firsts, [len(d)]))).astype(np.uint32).tobytes())
        rows[3].append(b"\x02" + p.astype(np.uint16).tobytes() if p.max() < 65536 else b"\x04" + p.tobytes())
        rows[4].append(value[start:end].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, PACKED_ARROW.types)], schema=PACKED_ARROW)


def unpack(t: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc id, position, value) of all entries of one bucket."""
    who, ids, pos, value = unpack_versions(t, kind, 1)
    return ids[who, 0], pos, value


def unpack_versions(t: pa.Table, kind, columns: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the second, distinct ids in order, position, value) of all entries of one bucket."""
    ids, counts, pos, value = [], [], [], []
    for d, c, p, v in zip(*(t.column(n) for n in ("docs", "counts", "pos", "value"))):
        p, width = p.as_py(), None
        width = p[0]
        ids.append(np.frombuffer(d.as_py(), np.int64).reshape(-1, columns))
        counts.append(np.frombuffer(c.as_py(), np.uint32))
        pos.append(np.frombuffer(p, np.uint16 if width == 2 else np.uint32, offset=1).astype(np.int64))
        value.append(np.frombuffer(v.as_py(), kind))
    ids, who = np.unique(np.concatenate(ids), axis=0, return_inverse=True)
    return np.repeat(who.ravel().astype(np.int32), np.concatenate(counts)), ids, np.concatenate(pos), np.concatenate(value)


#: Ratio of the powers by which ``held_by`` weighs positions.
_R = 0xD1342543DE82EF95


def further(steps: np.ndarray) -> np.ndarray:
    """_R to the power of each of the steps."""
    powers = np.full(int(steps.max(initial=0)) + 1, _R, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)[steps]


def held_by(doc: np.ndarray, version: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Weights of occurrences: a text's sum over all of its occurrences names their set.

    One token further on, the sum is that times _R (mod 2**64) exactly where the text
    there has the same occurrences, each one token further on.
    """
    return mix(mix(doc.astype(np.uint64) + np.uint64(_B)) + version.astype(np.uint64)) * further(pos)


def versions(documents: DataFrame) -> DataFrame:
    """(doc_id, version, text) of the rows that have both: an id's texts are told apart by their hash."""
    docs = documents.where("doc_id is not null and text is not null")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


#: Found positions of one text, a partner and the set of occurrences (held_by) of each.
FOUND = "doc_id long, version long, pos binary, other binary, held binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.binary()), ("other", pa.binary()), ("held", pa.binary())])


def found(doc: np.ndarray, version: np.ndarray, pos: np.ndarray, other: np.ndarray, held: np.ndarray) -> pa.Table:
    """A row for each text among the entries, with its positions, partner documents and occurrences."""
    order = np.lexsort((pos, version, doc))
    doc, version, pos, other, held = doc[order], version[order], pos[order].astype(np.uint32), other[order].astype(np.int64), held[order].astype(np.uint64)
    firsts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])))) if len(doc) else np.empty(0, int)
    ends = np.concatenate((firsts[1:], [len(doc)])) if len(doc) else firsts
    blobs = [pa.array([x[a:b].tobytes() for a, b in zip(firsts, ends)], pa.binary()) for x in (pos, other, held)]
    return pa.Table.from_arrays([pa.array(doc[firsts], pa.int64()), pa.array(version[firsts], pa.int64()), *blobs], schema=FOUND_ARROW)


def matched(cls: np.ndarray, who: np.ndarray, ids: np.ndarray, pos: np.ndarray, width: int) -> pa.Table:
    """Occurrences of the windows (equal ``cls``) that two documents have.

    ``who`` is a row of ``ids``, (doc_id, version) in order. Where a document's occurrences
    of a window overlap (a word said over and over), the k-th of such a series is matched
    with the k-th of others, and from the start again where all others are shorter.
    """
    doc, none = ids[:, 0], np.iinfo(np.int64).max
    order = np.lexsort((pos, who, cls))
    cls, who, pos = cls[order], who[order], pos[order]
    same = (cls[1:] == cls[:-1]) & (who[1:] == who[:-1]) if len(cls) else np.empty(0, bool)
    once = np.concatenate(([True], ~same | (pos[1:] != pos[:-1])))[: len(cls)]  # a row that is repeated adds none
    cls, who, pos = cls[once], who[once], pos[once]
    firsts = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))[: len(cls)])
    sizes = np.diff(np.concatenate((firsts, [len(cls)])))
    two = np.repeat(doc[who[firsts]] != doc[who[firsts + sizes - 1]], sizes)
    cls, who, pos = np.repeat(np.arange(len(firsts)), sizes)[two], who[two], pos[two]
    if not len(cls):
        return found(pos, pos, pos, pos, pos)
    new = np.concatenate(([True], (cls[1:] != cls[:-1]) | (who[1:] != who[:-1]) | (pos[1:] - pos[:-1] >= width)))
    at = np.arange(len(cls))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    if rank.any():
        order = np.lexsort((who, rank, cls))
        cls, who, pos, rank = cls[order], who[order], pos[order], rank[order]
    first = np.concatenate(([True], (cls[1:] != cls[:-1]) | (rank[1:] != rank[:-1])))
    starts, group = np.flatnonzero(first), np.cumsum(first) - 1
    d = doc[who]
    low = d[starts]
    second = np.minimum.reduceat(np.where(d != low[group], d, none), starts)
    held = np.add.reduceat(held_by(d, ids[who, 1], pos), starts)
    # groups of one document: its series is longer than all others
    full = second != none
    base = np.maximum.accumulate(np.where(rank[starts] == 0, np.arange(len(starts)), 0))
    ranks = np.add.reduceat(full.astype(np.int64), np.flatnonzero(rank[starts] == 0))[np.cumsum(rank[starts] == 0) - 1]
    g = np.where(full, np.arange(len(starts)), base + rank[starts] % ranks)[group]
    return found(d, ids[who, 1], pos, np.where(low[g] != d, low[g], second[g]), held[g])


SPANS = "doc_id long, start_token int, n_tokens int, other_doc_id long, repeat_id long, version long"
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("start_token", pa.int32()), ("n_tokens", pa.int32()), ("other_doc_id", pa.int64()), ("repeat_id", pa.int64()), ("version", pa.int64())])


def spans(hits: DataFrame, width: int) -> DataFrame:
    """Join found windows, by text of a document, as far as the same occurrences hold them.

    A span ends where the set of places that hold its windows changes, so that each of
    them holds the whole span. They have the span's ``repeat_id`` in common: m rows for m
    occurrences. ``other_doc_id`` is the lowest id of another document among them;
    ``version`` is the hash of the text that the positions are in.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[np.empty(0, np.int64)] for _ in SPANS_ARROW.types]
            for d, v, *blobs in zip(*(batch.column(c) for c in ("doc_id", "version", "pos", "other", "held"))):
                p, o, s = (np.frombuffer(b"".join(x.as_py()), k) for x, k in zip(blobs, (np.uint32, np.int64, np.uint64)))
                p, order = np.unique(p.astype(np.int64), return_index=True)
                o, s = o[order], s[order]
                firsts = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (s[1:] != s[:-1] * np.uint64(_R)))))
                lasts = np.concatenate((firsts[1:], [len(p)])) - 1
                n = p[lasts] + width - p[firsts]
                name = mix(s[firsts] + mix(n.astype(np.uint64))).view(np.int64)
                for r, x in zip(rows, (np.full(len(n), d.as_py()), p[firsts], n, o[firsts], name, np.full(len(n), v.as_py()))):
                    r.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)).cast(t) for r, t in zip(rows, SPANS_ARROW.types)], schema=SPANS_ARROW)

    lists = [F.collect_list(c).alias(c) for c in ("pos", "other", "held")]
    return hits.groupBy("doc_id", "version").agg(*lists).mapInArrow(merge, SPANS)


def by_pair(repeats: DataFrame, width: int) -> DataFrame:
    """Maximal exact repeats of each pair of documents: spans that both hold, joined on their diagonal.

    This has a row for each pair: a passage of m documents costs m squared here. Of words
    said over and over it has the diagonal on which their series start together.
    """
    mine = repeats.select("repeat_id", "doc_id", "version", "start_token", "n_tokens")
    other = repeats.select("repeat_id", F.col("version").alias("other_version"), F.col("doc_id").alias("other_doc_id"), F.col("start_token").alias("other_start"))
    both = mine.join(other, "repeat_id").where("doc_id <> other_doc_id").withColumn("shift", F.col("start_token") - F.col("other_start"))
    keys = ["doc_id", "version", "other_doc_id", "other_version", "shift"]
    line = W.partitionBy(*keys).orderBy("start_token")
    new = F.coalesce(F.col("start_token") > F.lag(F.col("start_token") + F.col("n_tokens")).over(line) - width + 1, F.lit(True))
    parts = both.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(line))
    whole = parts.groupBy(*keys, "part").agg(F.min("start_token").alias("start_token"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    return whole.select("doc_id", "start_token", (F.col("end") - F.col("start_token")).alias("n_tokens"), "other_doc_id", (F.col("start_token") - F.col("shift")).alias("other_start"))
