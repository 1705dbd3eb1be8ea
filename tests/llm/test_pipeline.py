"""The pipeline against a brute-force version of all its stages."""

import random
from pathlib import Path

import corpus_pipeline
import numpy as np
from test_operators import EDGE, brute_lines, distances, groups, prose, signatures_of

from tidepanel.llm import decontaminate, lines, packing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


TOXIC = set(range(400, 412))


def source(d):
    """Host ``bad`` has gross failures mostly; a mild one there goes by its verdict."""
    return "bad" if d is not None and 500 <= d < 600 else f"s{(d or 0) % 3}"


def write(spark, folder, rows, items):
    full = [(d, t, None if d == 7 else "en", source(d), None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(d, 1, int(d in TOXIC)) for d, _ in rows if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus(rng):
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows = [(d, "\n".join(prose(rng, rng.randint(8, 40)) for _ in range(4))) for d in range(10, 70)]
    rows = [(d, t + "\nAll rights reserved by us." if d % 4 == 0 else t) for d, t in rows]
    rows += [(100 + d, rows[d][1].replace("wbord", "changed")) for d in range(8)]
    rows += [(200 + i, prose(rng, 40) + " " + items[i][1]) for i in range(5)]
    rows += [(d, prose(rng, 40) + " scumword slurword") for d in sorted(TOXIC)] + [(415, prose(rng, 40) + " slurword")]
    rows += [(500 + i, "### $$$ %%% ***" * 3) for i in range(60)] + [(590, mild := prose(rng, 40) + " #" * 7), (591, prose(rng, 40))] + [(420, prose(rng, 40) + mild[-14:])]
    rows += [(300, "### $$$ %%% ***"), (301, "NO " * 40), (302, "again " * 40), *EDGE]
    return rows, items


def brute_quality(rows):
    """All rules and the verdicts in plain Python; the toxic words are those that the corpus plants."""
    judged = []
    for d, t in rows:
        t = t or ""
        w = t.lower()
        for ch in ",.;:!?\t\n\r":
            w = w.replace(ch, " ")
        words = [x for x in w.split(" ") if x]
        text_lines = [x for x in t.split("\n") if x.strip(" ")]
        symbols = sum(c in "#$%&*|<>{}^~=" for c in t)
        upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in t)
        abusive, kinds, line_kinds = len({"scumword", "slurword"} & set(words)), len(set(words)), len(set(text_lines))
        fails = lambda few, sym, up, kind, line, bad: (
            len(words) < few
            or symbols * sym > len(t)
            or (upper * 100 > len(t) * up and len(t) >= 20)
            or (kinds * 10 < len(words) * kind and len(words) >= 20)
            or (line_kinds * 10 < len(text_lines) * line and len(text_lines) >= 4)
            or abusive >= bad
        )
        judged.append((d, t, fails(1, 25, 25, 3, 5, 2), fails(3, 50, 15, 4, 7, 1)))
    by = {}
    for d, _, gross, mild in judged:
        by.setdefault(source(d), []).append(gross or mild)
    rates = [sum(x) / len(x) for x in by.values()]
    m, v = np.mean(rates), np.var(rates, ddof=1)
    k = max(1.0, min(1000.0, m * (1 - m) / v - 1))
    bad = {h for h, x in by.items() if (sum(x) + m * k) / (len(x) + k) > 0.4}
    assert bad == {"bad"}
    return [(d, t) for d, t, gross, mild in judged if not gross and not (mild and source(d) in bad)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = corpus(random.Random(21))
    sf = write(spark, tmp_path, rows, items)
    want = dict(brute_quality(rows))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    results = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        results.append(docs)
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        got = {r.doc_id: r.text for r in docs.collect()} if k < 4 else None
        if k == 0:
            assert got == want and not {1, 2, 3, 5, 300, 301, 302, 590, *TOXIC} & set(want) and {415, 420, 591} <= set(want)
        elif k == 1:
            want = brute_lines(list(want.items()), lines.MIN_DOCS)
            assert got == want and sum("All rights" in (t or "") for t in want.values()) == 1
        elif k == 2:
            ids = [d for d in want if d is not None and any(c.isalnum() for c in want[d] or "")]
            sig = dict(zip(ids, signatures_of([want[d] for d in ids])))
            pairs = [(a, b) for a in sig for b in sig if a < b and distances(sig[a], sig[b]) <= simhash.MAX_BITS]
            gone = groups(pairs, ids)
            want = {d: t for d, t in want.items() if d not in gone}
            assert set(want) <= set(got) and len(set(got) - set(want)) <= 0.05 * len(gone) and len(gone) >= 5
            want = got
        elif k == 3:
            leaked = {x[0] for x in decontaminate.brute(list(want.items()), items)}
            want = {d: t for d, t in want.items() if d not in leaked}
            assert got == want and leaked == {200, 201, 202, 203, 204}
    counts = packing.PieceCounts(packing.TOKENIZER)
    tokens = {d: counts.encoding.encode_ordinary(t) for d, t in want.items() if d is not None}
    bins, packed = results[-1].collect(), {}
    for r in bins:
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.starts, [*r.starts[1:], r.n_tokens]):
            packed.setdefault(d, {})[p] = r.tokens[a:b]
    assert {d: [x for p in sorted(parts) for x in parts[p]] for d, parts in packed.items()} == {d: t for d, t in tokens.items() if t}
    assert len(bins) == packing.brute([len(t) for t in tokens.values()], packing.CAPACITY)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, bins))
    # what is left: the last stage's input and its own table of tokens
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before) == ["benchmark-decontamination", "tokens"]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).count() == 0
