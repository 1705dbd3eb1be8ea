"""Line dedup by a log-template tree.

Lines are parsed down a tree of fixed depth: number of tokens, then the leading tokens,
where any token with a digit is a variable field. Inside a leaf, lines join the most
similar template if at least ``similarity`` of the positions agree; positions that differ
become variable. A template of which less than half is constant says nothing (rows of
numbers) and does not join different lines: each of its lines recurs by itself alone. A
template's recurrence is the number of documents, by distinct
id, that hold any of its lines; one that reaches ``min_docs`` is boilerplate, and all its
lines go except the first of them (lowest document id, then line number), so that no
passage leaves the corpus altogether.

Lines are counted inside each batch before the shuffle, so that a line of every document
is a row a batch and not a row a document, and equal lines meet before templates are
formed: a leaf holds distinct lines only. Their counts add up to an upper bound for the
template; where it reaches ``min_docs``, documents are counted over the occurrences.

Rows: a NULL id or NULL text is neither counted nor changed; very long texts and lines
count whole; blank lines are kept; a
document of which no line is left goes; a line repeated in one document counts once
there; ties between templates go to the earlier one, lines being taken most frequent
first, then by text; repeated rows and repeated ids are cut alike; other columns are kept; an empty
table stays empty; a column ``n_dropped`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import cut, fresh, spread, table

LEADING = 3
SIMILARITY = 0.7
MIN_DOCS = 5
VARIABLE = "<*>"
LINES = "leaf long, line string, n long, doc_id long, line_no int"
CANDIDATES = "line string, keep_doc long, keep_line int, template string, cluster long"
_LINES = pa.schema([("leaf", pa.int64()), ("line", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32())])
_CANDIDATES = pa.schema([("line", pa.string()), ("keep_doc", pa.int64()), ("keep_line", pa.int32()), ("template", pa.string()), ("cluster", pa.int64())])


def tokens(line: str) -> list[str]:
    """Tokens with variable fields masked."""
    t = line.split()
    if line.isalpha() or not any(c.isdigit() for c in line):
        return t
    return [VARIABLE if any(c.isdigit() for c in x) else x for x in t]


def leaf(line: str) -> int:
    t = tokens(line)
    return xxhash.xxh3_64_intdigest(f"{len(t)} " + " ".join(t[:LEADING])) - (1 << 63)


def templates(lines: list[str], counts: list[int], similarity: float = SIMILARITY) -> list[tuple[list[int], list[str]]]:
    """Clusters of the lines of one leaf: (members' indexes, template tokens).

    A template that agrees in all but ``spare`` positions agrees in one of any
    ``spare`` + 1 of them, so that a line meets only the templates that share its rarest
    tokens, and a leaf of many unlike lines costs little more than its length.
    """
    ids: dict[str, int] = {}
    rows = [tokens(x) for x in lines]
    matrix = np.array([[ids.setdefault(t, len(ids)) for t in r] for r in rows], np.int64).reshape(len(rows), -1)
    width = matrix.shape[1]
    spare = int(np.floor(width - similarity * width + 1e-9))
    found, members, having = np.empty((16, width), np.int64), [], {}
    for i in sorted(range(len(lines)), key=lambda k: (-counts[k], lines[k])):
        row = matrix[i]
        cells = [(p, t) for p, t in enumerate(row.tolist())]
        lists = sorted((having.get(c, ()) for c in cells), key=len)[: spare + 1]
        near = np.array(sorted(set().union(*lists)), np.int64)
        if len(near):
            same = (found[near] == row).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= similarity * width:
                best = int(near[best])
                found[best][found[best] != row] = -1
                members[best].append(i)
                continue
        if len(members) == len(found):
            found = np.concatenate((found, np.empty_like(found)))
        for c in cells:
            having.setdefault(c, []).append(len(members))
        found[len(members)] = row
        members.append([i])
    names = list(ids)
    return [(m, [VARIABLE if k < 0 else names[k] for k in t]) for m, t in zip(members, found)]


def says_something(template: list[str]) -> bool:
    return 2 * template.count(VARIABLE) <= len(template)


def cluster_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _count_lines(batches):
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for d, t in zip(batch.column("doc_id"), batch.column("text")):
            if not (d.is_valid and t.is_valid):
                continue
            doc, own = d.as_py(), set()
            for k, line in enumerate(t.as_py().split("\n")):
                if line in own or not line or line.isspace():
                    continue
                own.add(line)
                if (was := seen.get(line)) is None:
                    seen[line] = [1, doc, k]
                else:
                    was[0] += 1
                    if doc < was[1]:
                        was[1:] = doc, k
        lines = list(seen)
        n, doc, k = zip(*seen.values()) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([leaf(x) for x in lines], lines, n, doc, k), _LINES.types)], schema=_LINES)


def candidates(documents: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Each line of a template whose lines' counts reach ``min_docs``, with the occurrence to keep."""

    def group(rows):
        lines, n, first = zip(*rows)
        if sum(n) < min_docs:
            return
        clusters = templates(lines, n, similarity) if len(lines) > 1 else [([0], tokens(lines[0]))]
        for members, template in clusters:
            joined = [(members, " ".join(template))] if says_something(template) else [([i], lines[i]) for i in members]
            for own, name in joined:
                if sum(n[i] for i in own) >= min_docs:
                    keep, cluster = min(first[i] for i in own), cluster_id(lines[own[0]])
                    for i in own:
                        yield lines[i], *keep, name, cluster

    def parse(batches):
        pending, at = [], None
        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            if not len(leaves):
                continue
            n, out = batch.column("n").to_numpy(), []
            starts = np.flatnonzero(np.concatenate(([True], leaves[1:] != leaves[:-1])))
            ends = np.concatenate((starts[1:], [len(leaves)]))
            sums = np.add.reduceat(n, starts)
            line, doc, no = (batch.column(c) for c in ("line", "doc_id", "line_no"))
            for g, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                edge = g == 0 or g == len(starts) - 1
                if not edge and sums[g] < min_docs:
                    continue
                rows = [(line[i].as_py(), int(n[i]), (doc[i].as_py(), no[i].as_py())) for i in range(a, b)]
                if leaves[a] == at:
                    pending += rows
                    continue
                if pending:
                    out += group(pending)
                pending, at = rows, leaves[a]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, _CANDIDATES.types)], schema=_CANDIDATES)
        if pending:
            out = list(group(pending))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, _CANDIDATES.types)], schema=_CANDIDATES)

    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    return (
        docs.mapInArrow(_count_lines, LINES)
        .repartition("leaf")
        .groupBy("leaf", "line")
        .agg(F.sum("n").alias("n"), first)
        .select("leaf", "line", "n", "first.doc_id", "first.line_no")
        .sortWithinPartitions("leaf", "line")
        .mapInArrow(parse, CANDIDATES)
    )


def _occurrences(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(id, no, cluster, keep_doc, keep_line) wherever a line of ``found`` stands."""
    keys = [F.xxhash64("line").alias("h"), F.hash("line").alias("g")]
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.select("id", "no", *keys).join(found.select(*keys, "cluster", "keep_doc", "keep_line"), ["h", "g"]).drop("h", "g")


def _enough(at: DataFrame, min_docs: int) -> DataFrame:
    """(cluster, n_docs) of the clusters that stand in ``min_docs`` documents."""
    return at.select("cluster", "id").distinct().groupBy("cluster").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def recurring(documents: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Each line of a recurring template, with the occurrence to keep and the template's documents."""
    found = cut(candidates(documents, min_docs, similarity), "candidates")
    return found.join(_enough(_occurrences(documents, found), min_docs), "cluster").drop("cluster")


def drop_recurring(documents: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, without recurring lines, plus ``n_dropped``."""
    found = cut(candidates(documents, min_docs, similarity), "candidates")
    at = cut(_occurrences(documents, found), "occurrences")
    hits = at.join(_enough(at, min_docs), "cluster", "left_semi").where("not (id = keep_doc and no = keep_line)")
    by_id, drop, kept, lines = (fresh(documents, n) for n in ("drops_id", "drops", "kept_text", "text_lines"))
    drops = cut(hits.groupBy(F.col("id").alias(by_id)).agg(F.collect_set("no").alias(drop)), "drops")
    # the same plan at every size: an automatic broadcast would switch to this one anyway
    out = documents.join(drops.hint("merge"), F.col("doc_id") == F.col(by_id), "left")
    # the body of a lambda is computed for every element: an explode keeps the split below it,
    # where the optimizer would otherwise put it back into the lambda
    out = out.withColumn(lines, F.explode(F.array(F.when(F.col(drop).isNotNull(), F.split("text", "\n")))))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(F.col(lines), i))
    out = out.withColumn(kept, F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    out = out.where(F.col(drop).isNull() | F.col(kept).rlike(r"\S"))
    own = [(c, t) for c, t in documents.dtypes if c != "n_dropped"]
    cols = [F.col(kept).alias(c) if c == "text" else F.length(kept).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in own]
    return out.select(*cols, F.coalesce(F.size(drop), F.lit(0)).alias("n_dropped"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
