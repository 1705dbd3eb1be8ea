"""Best-fit packing planned over a histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. Best-fit decreasing then
runs over (length, count) pairs: all pieces of one length are placed together, and bins
with the same room are one interval of bin numbers, so that the plan's size depends on
the capacity and not on the corpus. A piece takes its planned slot by joining on its
length and its rank within that length. Ranks come from row numbers inside (length,
salt) cells and the cells' running counts; a length has a salt for every ``CELL_ROWS`` of
its pieces, so that no length, however common, is one task, at any size of the corpus.
``sequences`` then fills the bins with their token ids.

Rows: a NULL id or a text without tokens (NULL, empty) has nothing to pack and gets no
slot; repeated rows are packed each; very long texts are cut into as many pieces as they
need; ties in length are ordered by salt, then id, piece and text; other columns are
ignored; an empty table gives no bins.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm.common import cut, spread, table

CAPACITY = 2048
#: Pieces of one length that are ranked by one task.
CELL_ROWS = 500_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces of text whose token counts a worker remembers.
MEMO_PIECES = 200_000
SLOTS = "length int, rank_from long, rank_to long, bin_from long, per_bin int, start int"


class PieceCounts(dict):
    """Pre-token -> number of BPE tokens. Pieces are encoded apart, so counts add up."""

    def __init__(self, path: str):
        import tiktoken

        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < MEMO_PIECES:
            self[piece] = n
        return n


class PieceTokens(PieceCounts):
    """Pre-token -> its BPE tokens, packed."""

    def __init__(self, path: str, kind: str):
        super().__init__(path)
        self.kind = kind

    def __missing__(self, piece: str) -> bytes:
        b = np.array(self.encoding.encode_ordinary(piece), self.kind).tobytes()
        if len(self) < MEMO_PIECES:
            self[piece] = b
        return b


def shipped(spark: SparkSession, tokenizer: str) -> str:
    """The name under which every worker finds the tokenizer's file."""
    spark.sparkContext.addFile(tokenizer)
    return tokenizer.rsplit("/", 1)[-1]


def token_kind(tokenizer: str) -> str:
    """The packed type of a token: two bytes where the vocabulary fits."""
    return "<u2" if len(Path(tokenizer).read_bytes().splitlines()) <= 1 << 16 else "<u4"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) under the byte-level BPE at ``tokenizer``, which is sent to the workers."""
    name = shipped(documents.sparkSession, tokenizer)

    def count(batches):
        import regex

        pieces, counts = regex.compile(PATTERN), PieceCounts(SparkFiles.get(name))
        for batch in batches:
            n = [sum(map(counts.__getitem__, pieces.findall(t.as_py()))) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    ids = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(ids).mapInArrow(count, "doc_id long, n_tokens long")


def token_ids(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, version, n_tokens, tokens): as ``token_counts``, with the packed tokens; version is the text's hash."""
    name, kind = shipped(documents.sparkSession, tokenizer), token_kind(tokenizer)

    def encode(batches):
        import regex

        pieces, tokens = regex.compile(PATTERN), PieceTokens(SparkFiles.get(name), kind)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                blobs = [b"".join(map(tokens.__getitem__, pieces.findall(t.as_py()))) if t.is_valid else b"" for t in batch.column("text")]
                n = [len(b) // int(kind[-1]) for b in blobs]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "version", "n_tokens", "tokens"])

    ids = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return spread(ids).mapInArrow(encode, "doc_id long, version long, n_tokens long, tokens binary")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank_from, rank_to, bin_from, per_bin, start).

    The piece of rank r goes to bin bin_from + (r - rank_from) // per_bin.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, bins = [], 0

    def put(r: int, first: int, count: int):
        if r and count:
            if not room.get(r):
                room[r] = []
                insort(sizes, r)
            room[r].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                r = sizes[k]
                first, count = room[r].pop()
                if not room[r]:
                    sizes.pop(k)
            else:
                r, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            per = r // length
            full = min(count, left // per)
            rest = left - full * per if full < count else 0
            rest = min(rest, per)
            used = full * per + rest
            out.append((length, rank, rank + used, first, per, capacity - r))
            put(r - per * length, first, full)
            if rest:
                put(r - rest * length, first + full, 1)
            put(r, first + full + bool(rest), count - full - bool(rest))
            rank, left = rank + used, left - used
    return out


def best_fit(lengths: DataFrame, capacity: int = CAPACITY, cell_rows: int = CELL_ROWS, width: int = 0) -> DataFrame:
    """Slots for (doc_id, n_tokens, ...): (bin_id, start, doc_id, piece, n_tokens, ...).

    ``lengths`` may have a ``version``, which orders the rows of an id, and ``tokens`` of
    ``width`` bytes each, of which a slot gets its piece's part.
    """
    spark = lengths.sparkSession
    n, c = F.col("n_tokens"), F.lit(capacity)
    more = [x for x in ("version", "tokens") if x in lengths.columns]
    pieces = (
        lengths.where("doc_id is not null and n_tokens > 0")
        .select("doc_id", "n_tokens", *more, F.explode(F.sequence(F.lit(0), F.ceil(n / c).cast("int") - 1)).alias("piece"))
        .select("doc_id", "piece", *(F.substring("tokens", F.col("piece") * (capacity * width) + 1, F.lit(capacity * width)).alias(x) if x == "tokens" else x for x in more), F.least(c.cast("long"), n - F.col("piece") * c).cast("int").alias("length"))
    )
    # at most ``capacity`` rows
    sizes = [(r.length, max(1, -(-r.n // cell_rows))) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]
    salts = spark.createDataFrame(sizes, "length int, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int")).drop("salts")
    # a row for every ``cell_rows`` pieces, besides a row for each length
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()
    histogram: dict[int, int] = {}
    befores = []
    for row in sorted(cells):
        befores.append((row.length, row.salt, histogram.get(row.length, 0)))
        histogram[row.length] = histogram.get(row.length, 0) + row.n
    before = spark.createDataFrame(befores, "length int, salt int, before long")
    slots = spark.createDataFrame(plan(histogram, capacity), SLOTS)
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "piece", *more[:1])
    rank = salted.withColumn("k", F.row_number().over(inside) - 1).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("k") + F.col("before"))
    nth = F.col("rank") - F.col("rank_from")
    return (
        rank.join(F.broadcast(slots), "length")
        .where("rank >= rank_from and rank < rank_to")
        .select(
            (F.col("bin_from") + F.floor(nth / F.col("per_bin"))).alias("bin_id"),
            (F.col("start") + F.pmod(nth, F.col("per_bin")) * F.col("length")).cast("int").alias("start"),
            "doc_id",
            "piece",
            F.col("length").alias("n_tokens"),
            *more,
        )
    )


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts once over the corpus, kept as a narrow table, then the slots."""
    return best_fit(cut(token_counts(documents, tokenizer), "lengths"), capacity)


def sequences(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, cell_rows: int = CELL_ROWS // 10) -> DataFrame:
    """The bins, filled: (bin_id, n_tokens, doc_ids, pieces, starts, tokens), pieces in the order of their starts.

    Cells are smaller than those of ``pack_documents``, as their rows hold tokens.
    """
    kind = token_kind(tokenizer)
    slots = best_fit(cut(token_ids(documents, tokenizer), "tokens"), capacity, cell_rows, int(kind[-1]))
    filled = slots.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", "piece", "tokens"))).alias("slots"))
    parts = filled.select("bin_id", F.col("slots.doc_id").alias("doc_ids"), F.col("slots.piece").alias("pieces"), F.col("slots.start").alias("starts"), F.col("slots.tokens").alias("parts"))

    def unpack(batches):
        for batch in batches:
            lists = batch.column("parts")
            blobs, ends = lists.flatten(), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
            tokens = np.frombuffer(b"".join(x.as_py() for x in blobs), kind).astype(np.int32)
            sizes = np.concatenate(([0], np.cumsum([len(x.as_py()) // int(kind[-1]) for x in blobs]))).astype(np.int32)
            at = pa.array(sizes[ends])
            n = pa.array(np.diff(sizes[ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("bin_id"), n, *(batch.column(c) for c in ("doc_ids", "pieces", "starts")), pa.ListArray.from_arrays(at, pa.array(tokens))], names=["bin_id", "n_tokens", "doc_ids", "pieces", "starts", "tokens"])

    return parts.mapInArrow(unpack, "bin_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<int>, tokens array<int>")


def brute(lengths: list[int], capacity: int) -> int:
    """Bins that best-fit decreasing over single pieces opens; for tests."""
    pieces = [p for n in lengths for p in [capacity] * (n // capacity) + [n % capacity] if p]
    rooms: list[int] = []
    for p in sorted(pieces, reverse=True):
        k = bisect_left(rooms, p)
        r = rooms.pop(k) if k < len(rooms) else capacity
        insort(rooms, r - p)
    return len(rooms)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
