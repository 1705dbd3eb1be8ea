"""Chat formatting after cumulative-snapshot collapse.

Loggers often store a conversation anew at every turn, so that one log is a prefix of the
next. Every prefix of a conversation gets a rolling hash: the running sums, over the
turns up to there, of two 60-bit parts of the SHA-256 of (position, role, text), so that
a turn is hashed once and a conversation of n turns costs n steps. A conversation whose
full hash is a proper prefix of another one goes by an anti-join, as does all but the
lowest id among equal ones. What is left is rendered, so no prompt is rendered twice.

Rows: a NULL conv_id or NULL turn can't be placed and is left out; repeated rows count
once; equal turns with different content are ordered by role, then text; a NULL role or
text is a turn of its own kind, rendered empty, and differs from an empty one; empty and
very long texts count whole, as do conversations of very many turns; other columns are
ignored; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm.common import cut, table

HASH = ["k", "h1", "h2"]


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, h1, h2, n): the rolling hash after each of a conversation's n turns."""
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").distinct()  # one shuffle serves this and the windows
    log = W.partitionBy("conv_id")
    order = log.orderBy("turn", "role", "text")
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    placed = rows.withColumn("k", F.row_number().over(order))
    turn = F.sha2(F.concat(F.col("k").cast("string"), F.lit("|"), mark("role"), mark("text")), 256)
    part = lambda a: F.conv(F.substring("turn_hash", a, 15), 16, 10).cast("decimal(28,0)")
    hashed = placed.select("conv_id", "k", turn.alias("turn_hash")).select("conv_id", "k", part(1).alias("a"), part(16).alias("b"))
    so_far = log.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return hashed.select("conv_id", "k", F.sum("a").over(so_far).alias("h1"), F.sum("b").over(so_far).alias("h2"), F.count("*").over(log).alias("n"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations that neither prefix nor repeat another one."""
    hashes = cut(prefixes(conversations), "prefixes")
    whole = hashes.where("k = n").groupBy(*HASH).agg(F.min("conv_id").alias("conv_id"))
    kept = whole.join(hashes.where("k < n").select(*HASH), HASH, "left_anti").select("conv_id")
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    # rows are told apart inside their conversation, by the shuffle that brings it together
    return rows.join(kept.hint("merge"), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def render(kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, prompt): each turn between role and end markers."""
    turn = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))
    return kept.select("conv_id", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", turn), "").alias("prompt"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal(table(spark, sf_dir, "conversations")))


SQL = r"""
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
m as (select *, coalesce('=' || length(role) || ':' || role, '-') || coalesce('=' || length(text) || ':' || text, '-') as piece,
        row_number() over w as k, count(*) over (partition by conv_id) as n
      from t window w as (partition by conv_id order by turn, role nulls first, text nulls first)),
p as (select conv_id, k, n, md5(string_agg(piece, '|') over (partition by conv_id order by k)) as h from m),
whole as (select h, min(conv_id) as conv_id from p where k = n group by h),
kept as (select conv_id from whole where h not in (select h from p where k < n))
select m.conv_id, cast(max(m.n) as integer) as n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' order by k) as prompt
from m join kept using (conv_id) group by m.conv_id
"""
