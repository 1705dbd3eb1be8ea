"""Quality rules with host-level verdicts.

Each document is measured once. A *gross* failure rejects it by itself; a *mild* one is
left to the verdict on its host (``source``): the share of a host's documents with any
failure is shrunk towards the shares of all hosts by a beta prior whose parameters come
from their mean and variance (method of moments), and where the shrunk share exceeds
``host_limit`` the mild failures of that host are rejected too. Documents without a
failure stay, whatever their host.

Rules, gross (mild) limits: no words at all (under 3 words); symbol characters over 4 %
(2 %); upper-case letters over 25 % (15 %) from 20 characters on; distinct words under
30 % (40 %) from 20 words on; distinct lines under 50 % (70 %) from 4 lines on; two different
words (one word) of the abusive vocabulary. That vocabulary is learned from ``labels``: words in at
least 1 % (and 5) of the toxic documents and nine times as many toxic as other ones,
over at most ``labelled`` labelled documents, taken by hash of their id.

Rows: very long texts are measured whole; a NULL text has no words and is rejected; a NULL source is a host of its own; a
NULL id is judged like any other; repeated rows are judged and counted each; other
columns are kept; with no labels the vocabulary is empty; with one host, or hosts of
equal rates, the prior weighs ``PRIOR_MAX`` documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import cut, spread, table

HOST_LIMIT = 0.4
LABELLED = 20_000
PRIOR_MAX = 1000.0
#: Hosts whose figures, or bad hosts whose names, are sent to every task; more are joined by key.
BROADCAST_HOSTS = 200_000
FLAGS = ["n_gross", "n_mild"]


def _words(text):
    return F.array_remove(F.split(F.lower(text), r"[ \t\n\r.,;:!?]+"), "")


def vocabulary(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> list[str]:
    """Abusive words; its size is bounded by the words of the labelled sample."""
    rows = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").distinct()
    sample = rows.orderBy(F.md5(F.col("doc_id").cast("string")), "toxic").limit(labelled)
    seen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    words = seen.select("toxic", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    toxic, other = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)
    least = sample.agg(F.greatest(F.lit(5.0), F.count_if(F.col("toxic") == 1) * 0.01).alias("least"))
    found = words.groupBy("word").agg(toxic.alias("t"), other.alias("o")).where("t >= 5 and t >= 9 * o")
    return sorted(r.word for r in found.join(F.broadcast(least), F.col("t") >= F.col("least")).select("word").collect())


def measure(documents: DataFrame, abusive: list[str]) -> DataFrame:
    """The documents with ``n_gross`` and ``n_mild``: how many rules they fail so."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    out = documents.withColumns({
        "_w": _words(text),
        "_n": n,
        "_symbols": n - F.length(F.regexp_replace(text, r"[#$%&*|<>{}^~=]", "")),
        "_upper": n - F.length(F.regexp_replace(text, "[A-ZÀ-ÖØ-Þ]", "")),
        "_l": lines,
    }).withColumns({"_lines": F.size("_l"), "_line_kinds": F.size(F.array_distinct("_l")), "_words": F.size("_w"), "_kinds": F.size(F.array_distinct("_w")), "_abusive": F.size(F.array_intersect("_w", F.lit(abusive))) if abusive else F.lit(0)})
    c = F.col
    gross = [
        c("_words") == 0,
        c("_symbols") * 25 > c("_n"),
        (c("_upper") * 4 > c("_n")) & (c("_n") >= 20),
        (c("_kinds") * 10 < c("_words") * 3) & (c("_words") >= 20),
        (c("_line_kinds") * 2 < c("_lines")) & (c("_lines") >= 4),
    ]
    mild = [
        c("_words") < 3,
        c("_symbols") * 50 > c("_n"),
        (c("_upper") * 20 > c("_n") * 3) & (c("_n") >= 20),
        (c("_kinds") * 10 < c("_words") * 4) & (c("_words") >= 20),
        (c("_line_kinds") * 10 < c("_lines") * 7) & (c("_lines") >= 4),
    ]
    if abusive:
        gross.append(c("_abusive") >= 2)
        mild.append(c("_abusive") >= 1)
    count = lambda flags: sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return out.withColumns(dict(zip(FLAGS, (count(gross), count(mild))))).drop("_w", "_l", "_n", "_symbols", "_upper", "_lines", "_line_kinds", "_words", "_kinds", "_abusive")


def hosts(measured: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_bad): rates shrunk by the beta prior."""
    failed = F.count_if((F.col("n_gross") > 0) | (F.col("n_mild") > 0))
    by = measured.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("host_docs"), failed.alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = by.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    weight = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(PRIOR_MAX), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(PRIOR_MAX))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("k")) / (F.col("host_docs") + F.col("k"))
    return (
        by.crossJoin(F.broadcast(prior.withColumn("k", weight)))
        .withColumn("host_rate", F.round(shrunk, 6))
        .withColumn("host_bad", F.col("host_rate") > host_limit)
        .drop("m", "v", "k")
    )


def kept(documents: DataFrame, labels: DataFrame, host_limit: float = HOST_LIMIT, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(doc_id, source, n_mild, host figures) of the documents that stay; one pass over texts.

    Every row names its host's figures, so that all hosts are joined: narrow rows, whose
    shuffle beyond ``broadcast_hosts`` hosts adaptive execution splits where one is hot.
    """
    abusive = vocabulary(documents, labels)
    narrow = cut(measure(documents.select("doc_id", "source", "text"), abusive).drop("text"), "measured")
    verdicts = cut(hosts(narrow, host_limit), "hosts")
    side = F.broadcast(verdicts) if verdicts.count() <= broadcast_hosts else verdicts.hint("merge")
    joined = narrow.where("n_gross = 0").join(side, F.col("source").eqNullSafe(F.col("host")))
    return joined.where("not (host_bad and n_mild > 0)").drop("host", "n_gross")


def clean(documents: DataFrame, labels: DataFrame, host_limit: float = HOST_LIMIT, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The documents that stay, with their own columns.

    Texts are measured once and written with their flags (rejected ones without their
    text); a verdict concerns only mild failures of bad hosts. The bad hosts are sent to
    every task, or, beyond ``broadcast_hosts`` of them, the mild failures alone are
    shuffled: no text without a failure ever moves by its host.
    """
    own = [F.col(f"`{c}`").alias(f"in_{c}") for c in documents.columns]
    abusive = vocabulary(documents, labels)
    flags = measure(documents.select(*own, "text", "source"), abusive)
    text = F.when(F.col("n_gross") == 0, F.col("in_text")).alias("in_text")
    measured = cut(flags.select("source", *FLAGS, *(text if c == "text" else F.col(f"`in_{c}`") for c in documents.columns)), "measured")
    bad = cut(hosts(measured, host_limit).where("host_bad").select("host"), "bad_hosts")
    of_host = F.col("source").eqNullSafe(F.col("host"))
    rows = measured.where("n_gross = 0")
    if bad.count() <= broadcast_hosts:
        rows = rows.join(F.broadcast(bad), of_host & (F.col("n_mild") > 0), "left_anti")
    else:
        rows = rows.where("n_mild = 0").unionByName(rows.where("n_mild > 0").join(bad.hint("merge"), of_host, "left_anti"))
    return rows.select(*(F.col(f"`in_{c}`").alias(c) for c in documents.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


_DOC_WORDS = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r.,;:!?]+', ' ', 'g'), ' '), lambda x: x <> '')"

#: CTEs up to ``judged``.
CTES = rf"""
sample as (select distinct doc_id, toxic from labels where doc_id is not null and toxic is not null order by md5(cast(doc_id as varchar)), toxic limit {LABELLED}),
doc_words as (select s.doc_id, s.toxic, unnest(list_distinct({_DOC_WORDS})) as word from documents d join sample s using (doc_id)),
abusive as (select word from doc_words group by word having count(*) filter (where toxic = 1) >= 9 * count(*) filter (where toxic <> 1)
   and count(*) filter (where toxic = 1) >= greatest(5.0, 0.01 * (select count(*) from sample where toxic = 1))),
m0 as (select *, {_DOC_WORDS} as _w, length(coalesce(text, '')) as _n,
   length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#$%&*|<>{{}}^~=]', '', 'g')) as _s,
   length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-ZÀ-ÖØ-Þ]', '', 'g')) as _u,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as _l from documents),
m1 as (select *, len(_w) as _c, len(list_distinct(_w)) as _k, len(_l) as _lc, len(list_distinct(_l)) as _lk,
   len(list_distinct(list_intersect(_w, coalesce((select list(word) from abusive), [])))) as _a from m0),
measured as (select *,
   (_c = 0)::int + (_s * 25 > _n)::int + (_u * 4 > _n and _n >= 20)::int + (_k * 10 < _c * 3 and _c >= 20)::int + (_lk * 2 < _lc and _lc >= 4)::int + (_a >= 2)::int as n_gross,
   (_c < 3)::int + (_s * 50 > _n)::int + (_u * 20 > _n * 3 and _n >= 20)::int + (_k * 10 < _c * 4 and _c >= 20)::int + (_lk * 10 < _lc * 7 and _lc >= 4)::int + (_a >= 1)::int as n_mild from m1),
by_host as (select source as host, count(*) as host_docs, count(*) filter (where n_gross > 0 or n_mild > 0) as host_failed from measured group by source),
prior as (select m, case when v > 0 then greatest(1.0, least({PRIOR_MAX}, m * (1 - m) / v - 1)) else {PRIOR_MAX} end as k
   from (select avg(host_failed / host_docs) as m, var_samp(host_failed / host_docs) as v from by_host)),
verdicts as (select host, host_docs, host_failed, round((host_failed + m * k) / (host_docs + k), 6) as host_rate from by_host, prior),
judged as (select measured.*, host_docs, host_failed, host_rate, host_rate > {HOST_LIMIT} as host_bad from measured join verdicts on source is not distinct from host
   where n_gross = 0 and not (host_rate > {HOST_LIMIT} and n_mild > 0))
"""
SQL = f"with {CTES} select doc_id, source, n_mild, host_docs, host_failed, host_rate, host_bad from judged"
