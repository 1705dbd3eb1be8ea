"""Every operator against a brute-force version, and on its edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import anchors, chat, decontaminate, html, lines, packing, quality, simhash, suffixes, warc
from tidepanel.llm.common import WordIds, by_pair, rolling, words

#: With names that the operators use themselves.
EXTRA = ["drops", "gone", "host", "n_mild", "_w", "in_text", "hits", "s", "root", "bucket", "id", "line"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def docs(spark, rows):
    """Documents with an extra column; rows are (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1]) if r[1] is not None else None, *[None, "x"] * (len(EXTRA) // 2)) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=4000):
    spell = lambda k: str(k).translate({48 + d: 97 + d for d in range(10)})
    return " ".join(f"w{spell(int(vocabulary * rng.random() ** 2))}ord" for _ in range(n))


EDGE = [(None, "a text without id " * 20), (1, None), (2, ""), (3, "   \n "), (4, "word"), (5, "long " * 60_000)]


def test_rolling_is_a_polynomial():
    ids = np.arange(1, 40, dtype=np.uint64)
    for n in (1, 2, 5, 12, 25):
        b = 0x9E3779B97F4A7C15
        want = [sum(int(ids[p + i]) * pow(b, n - 1 - i) for i in range(n)) % (1 << 64) for p in range(len(ids) - n + 1)]
        assert rolling(ids, n).tolist() == want
    assert len(rolling(ids[:3], 5)) == 0


# == decontamination
def contaminated(rng):
    items = [(i, prose(rng, rng.choice([3, 5, 9, 15, 20, 40]))) for i in range(30)]
    rows = []
    for d in range(120):
        text = prose(rng, rng.randint(0, 150)).split()
        if d % 3 == 0:
            w = items[d % 30][1].split()
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = "changed"
            a = rng.randrange(len(text) + 1)
            text[a:a] = w[rng.randrange(3) :] if d % 2 else w
        rows.append((d, " ".join(text)))
    return items, rows


@pytest.mark.parametrize("filter_bits", [decontaminate.FILTER_BITS, 1 << 15])
def test_leaks_equal_brute_force(spark, filter_bits):
    items, rows = contaminated(random.Random(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r[c] for c in ("doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_matched")) for r in decontaminate.leaks(docs(spark, rows), bench, filter_bits=filter_bits).collect()}
    want = decontaminate.brute(rows, items)
    assert found == want and len({x[:2] for x in want}) >= 20
    for limit in (decontaminate.BROADCAST_TEXTS, 0):
        kept = {r.doc_id for r in decontaminate.clean(docs(spark, rows), bench, filter_bits=filter_bits, broadcast_texts=limit).collect()}
        assert kept == {d for d, _ in rows} - {x[0] for x in want}


def test_a_full_filter_changes_no_result(spark):
    items, rows = contaminated(random.Random(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    full = decontaminate.leaks(docs(spark, rows), bench, bits_per_key=1, filter_bits=1 << 15)
    assert sorted(full.collect()) == sorted(decontaminate.leaks(docs(spark, rows), bench).collect())


def test_stretches_are_unions_of_windows(spark):
    item = prose(random.Random(44), 100)
    a, b = item.split()[:20], item.split()[-20:]
    rows = [(1, " ".join(a + ["x"] * 60 + b)), (2, " ".join(a + ["x"] * 59 + b)), (1, item)]
    bench = spark.createDataFrame([(9, item), (9, prose(random.Random(45), 30))], "item_id long, text string")
    got = decontaminate.leaks(docs(spark, rows), bench).collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, 9, 0, 0, 22, 20), (1, 9, 78, 78, 22, 20), (1, 9, 0, 0, 100, 100), (2, 9, 0, 0, 22, 20), (2, 9, 77, 78, 22, 20)])
    assert {tuple(r) for r in got} == decontaminate.brute(rows, [(9, item)])


def test_leaks_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six", 5), (2, None, 5), (None, "a b c d e", 5), (3, "", 5), (1, "one two three four five six", 5)], "item_id long, text string, key int")
    leak = "so ONE two, three four -- five six!"
    rows = [*EDGE, (7, leak), (7, leak), (None, leak), (8, "the a b c d e text")]
    out = decontaminate.leaks(docs(spark, rows), bench).collect()
    assert [(r.doc_id, r.item_id, r.doc_start, r.n_tokens) for r in out] == [(7, 1, 1, 6)]
    cleaned = decontaminate.clean(docs(spark, rows), bench)
    assert cleaned.columns == docs(spark, rows).columns and sorted((r.doc_id for r in cleaned.collect()), key=str) == sorted([*(d for d, _ in EDGE), 8], key=str)
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0 and decontaminate.clean(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0 and decontaminate.clean(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_filter_holds_all_keys(spark):
    keys = np.random.default_rng(46).integers(0, 1 << 64, 5000, dtype=np.uint64)
    found = decontaminate.bloom(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"), 32, 1 << 20)
    assert len(decontaminate.passing(keys, found)) == 5000
    assert len(decontaminate.passing(np.random.default_rng(47).integers(0, 1 << 64, 50_000, dtype=np.uint64), found)) < 100


# == substring dedup
def repeating(rng):
    shared = [prose(rng, n) for n in (50, 51, 64, 75, 120, 49, 30)]
    rows = []
    for d in range(90):
        parts = [prose(rng, rng.randint(0, 90))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            s = rng.choice(shared)
            parts += [s if rng.random() < 0.7 else " ".join(s.split()[rng.randint(0, 9) :]), prose(rng, rng.randint(0, 40))]
        rows.append((d, " ".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(12)]
    rows += [(200, "same " * 300), (201, "same " * 180), (202, prose(rng, 200)), (203, "x y " * 200)]
    return rows


def covered(df):
    out = {}
    for r in df.collect():
        assert r.other_doc_id != r.doc_id and r.n_tokens >= 50
        out.setdefault(r.doc_id, set()).update(range(r.start_token, r.start_token + r.n_tokens))
    return out


@pytest.mark.parametrize("method", [anchors.repeats, suffixes.repeats])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, method, seed):
    rows = repeating(random.Random(seed))
    want = anchors.brute(rows, 50)
    assert covered(method(docs(spark, rows))) == want and len(want) > 20


@pytest.mark.parametrize("method", [anchors.repeats, suffixes.repeats])
def test_repeats_edges(spark, method):
    passage = prose(random.Random(3), 60)
    rows = [*EDGE, (7, passage), (7, passage), (8, "before " + passage.upper() + " after"), (None, passage), (9, passage[:100])]
    out = sorted(tuple(r) for r in method(docs(spark, rows)).collect())
    assert out == [(7, 0, 60, 8), (8, 1, 60, 7)]
    assert method(docs(spark, [])).count() == 0
    assert method(docs(spark, [(1, passage), (1, passage)])).count() == 0


@pytest.mark.parametrize("method", [anchors.spans_of, suffixes.spans_of])
def test_repeats_are_held_whole_by_their_partners(spark, method):
    rng = random.Random(31)
    core, left, right = prose(rng, 50), prose(rng, 75), prose(rng, 75)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, f"{prose(rng, 20)} {core} {prose(rng, 20)}"), (2, f"{prose(rng, 9)} {left} {core} {right} {prose(rng, 9)}"), (3, f"{left} {core} {right}")]
    rows += [(4, a), (5, b), (6, f"{a} {b}"), (7, "same " * 170), (8, "same " * 80), (9, "a b c " * 90), (10, "a b c " * 90)]
    out = method(docs(spark, rows)).cache()
    text, by_id = {d: words(t) for d, t in rows}, {}
    for r in out.collect():
        own, other = text[r.doc_id][r.start_token : r.start_token + r.n_tokens], text[r.other_doc_id]
        assert len(own) == r.n_tokens >= 50 and any(other[p : p + r.n_tokens] == own for p in range(len(other)))
        by_id.setdefault(r.repeat_id, []).append((r.doc_id, r.start_token, tuple(own)))
    assert all(len({x[2] for x in rows}) == 1 for rows in by_id.values())
    assert {1, 2, 3} in [{x[0] for x in rows} for rows in by_id.values()]
    assert {(r.doc_id, r.start_token, r.n_tokens) for r in out.collect() if r.doc_id > 6} >= {(7, 0, 80), (8, 0, 80), (9, 0, 270), (10, 0, 270)}
    assert out.where("doc_id = 7").count() < 9 and out.where("doc_id > 7").count() == 3
    out, want = out.where("doc_id < 7"), set()
    text = {d: w for d, w in text.items() if d < 7}
    for d, w in text.items():
        for e, v in text.items():
            for p in range(len(w)):
                for q in range(len(v) if d != e else 0):
                    if w[p] == v[q] and not (p and q and w[p - 1] == v[q - 1]):
                        n = next((k for k in range(min(len(w) - p, len(v) - q)) if w[p + k] != v[q + k]), min(len(w) - p, len(v) - q))
                        if n >= 50:
                            want.add((d, p, n, e, q))
    assert {(2, 9, 200, 3, 0), (3, 75, 50, 1, 20), (6, 0, 60, 4, 0), (6, 60, 60, 5, 0)} <= want
    assert sorted(tuple(r) for r in by_pair(out, 50).collect()) == sorted(want)


@pytest.mark.parametrize("method", [anchors.spans_of, suffixes.spans_of])
def test_texts_of_one_id_have_their_own_positions(spark, method):
    rng = random.Random(33)
    passage = prose(rng, 60)
    long, short = f"{prose(rng, 3000)} {passage}", f"{prose(rng, 5)} {passage}"
    rows = [(1, long), (1, short), (1, short), (2, prose(rng, 70)), (3, passage), (4, prose(rng, 70)), (5, passage[:100])]
    out = method(docs(spark, rows).coalesce(1)).collect()
    assert sorted(tuple(r)[:4] for r in out) == [(1, 5, 60, 3), (1, 3000, 60, 3), (3, 0, 60, 1)]
    assert len({r.version for r in out}) == 3 and len({r.repeat_id for r in out}) == 1
    assert method(docs(spark, rows[:3])).count() == 0


def test_both_methods_find_the_same_spans(spark):
    rows = repeating(random.Random(32))
    assert sorted(anchors.spans_of(docs(spark, rows)).collect()) == sorted(suffixes.spans_of(docs(spark, rows)).collect())


@pytest.mark.parametrize("size", [suffixes.SUFFIXES, 100])
def test_suffix_array_is_sorted(size):
    rng = np.random.default_rng(5)
    for trial in range(20):
        sizes = rng.integers(60, 160, 12)
        base = rng.integers(0, 3, 160)
        texts = [(base if k % 2 else rng.integers(0, 2, 160))[:n].copy() for k, n in enumerate(sizes)]
        text = np.concatenate(texts).astype(np.uint32)
        first = np.cumsum(sizes) - sizes
        end = np.repeat(first + sizes, sizes)
        at = np.concatenate([np.arange(f, f + n - 50) for f, n in zip(first, sizes)])
        parts = list(suffixes.suffix_array(text, end, at, 50, size))
        assert size > 100 or len(parts) > 1
        order = np.concatenate([o for o, _ in parts])
        same = np.concatenate([s for _, s in parts])
        key = lambda p: tuple(text[p : end[p]])
        assert sorted(order) == sorted(at)
        assert all(key(a) <= key(b) for a, b in zip(order, order[1:]))
        assert same.tolist() == [False, *(key(a)[:50] == key(b)[:50] for a, b in zip(order, order[1:]))]


# == simhash
def near_copies(rng):
    rows, d = [], 0
    for g in range(60):
        w = prose(rng, rng.randint(40, 300)).split()
        rows.append((d, " ".join(w)))
        d += 1
        for _ in range(rng.choice([0, 1, 2, 5])):
            c = list(w)
            for _ in range(int(len(c) * rng.choice([0, 0.02, 0.05]))):
                c[rng.randrange(len(c))] = f"changed{rng.randrange(10**6)}"
            rows.append((d, " ".join(c)))
            d += 1
    return rows


def groups(pairs, ids):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids if top(i) != i}


def signatures_of(texts):
    memo = WordIds()
    return simhash.signature_block([simhash.features(t, memo) for t in texts])


def distances(sig, other):
    return np.bitwise_count(sig ^ other).sum(axis=-1)


def near(sig):
    return [(a, b) for a in range(len(sig)) for b in range(a) if distances(sig[a], sig[b]) <= simhash.MAX_BITS]


def test_signature_bits_are_weighted_majorities():
    memo = WordIds()
    sets = [simhash.features(t, memo) for t in ("the cat sat on the mat", "elephants walking elephants", " ".join(f"w{k}word" for k in range(2 * simhash.PART + 5)))]
    for (ids, weights), sig in zip(sets, simhash.signature_block(sets)):
        for lane in (0, simhash.LANES - 1):
            bits = np.unpackbits(simhash.mix(ids + simhash._SEEDS[lane]).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
            want = (bits * weights[:, None].astype(np.int64)).sum(axis=0) * 2 > int(weights.sum())
            assert np.packbits(want).view(np.uint64)[0] == sig[lane]


def test_one_word_more_moves_a_signature_little():
    rng = random.Random(41)
    for n in range(4, 12):  # about eight long words nothing changes
        base = prose(rng, n).split() + "the cat sat on my old mat and ate it all up by one so we are off now".split()
        sig = signatures_of([" ".join(base), " ".join(base[1:])])
        assert distances(sig[0], sig[1]) < 0.2 * simhash.BITS


def test_duplicates_recall_against_brute_force(spark):
    rows = near_copies(random.Random(4))
    sig = signatures_of([t for _, t in rows])
    want = groups(near(sig), range(len(rows)))
    got = {r.doc_id: r.duplicate_of for r in simhash.duplicates(docs(spark, rows)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and len(want) > 50
    kept = {r.doc_id for r in simhash.clean(docs(spark, rows)).collect()}
    assert kept == {d for d, _ in rows} - set(got)


def flipped(sig, bits):
    out = sig.copy()
    for at in bits:
        out[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    return out


def hard_signatures(rng):
    """Pairs at and just beyond the limit, and a hub that is too far from members near each other."""
    fresh = lambda: rng.integers(0, 1 << 64, simhash.LANES, dtype=np.uint64)
    even = lambda n: [int(x) * simhash.BITS // n + int(rng.integers(0, simhash.BITS // n)) for x in range(n)]
    out = []
    for k in range(60):
        base, n = fresh(), simhash.MAX_BITS + k % 2
        out += [base, flipped(base, even(n) if k % 3 else rng.choice(simhash.BITS, n, replace=False).tolist())]
    for _ in range(20):
        hub, bits = fresh(), rng.permutation(simhash.BITS)
        out += [hub, flipped(hub, bits[:130].tolist()), flipped(hub, bits[100:230].tolist()), flipped(hub, bits[20:140].tolist())]
    return np.array(out)


def test_no_link_within_the_limit_is_left_out(spark, monkeypatch):
    sig = hard_signatures(np.random.default_rng(70))
    table = spark.createDataFrame([(d, d, s.tobytes()) for d, s in enumerate(sig)], "doc_id long, version long, s binary")
    monkeypatch.setattr(simhash, "signatures", lambda documents: table)
    want = groups(near(sig), range(len(sig)))
    assert len(want) > 60
    for sizes in ({}, {"FEW": 0}, {"FEW": 0, "CHUNK": 70}):  # all pairs, the index, and the index by pairs of chunks
        for name, value in sizes.items():
            monkeypatch.setattr(simhash, name, value)
        assert {r.doc_id: r.duplicate_of for r in simhash.duplicates(docs(spark, [])).collect()} == want


def test_index_meets_all_words_within_the_limit():
    rng = np.random.default_rng(71)
    words = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    for k in range(1, 400, 2):
        words[k] = flipped(words[k - 1 : k], rng.choice(64, k % 13, replace=False).tolist())[0]
    words[100:150] = words[99] ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64))  # a hot list
    bits = np.bitwise_count(words[:, None] ^ words)
    for limit in (0, 1, 2, 5, 9, 10):
        met = [p for i, j in simhash.within(words, None, limit) for p in zip(i.tolist(), j.tolist())]
        assert {(min(p), max(p)) for p in met} == {(a, b) for a, b in zip(*np.nonzero(bits <= limit)) if a < b}
        met = {p for i, j in simhash.within(words[:150], words[150:], limit) for p in zip(i.tolist(), j.tolist())}
        assert met == set(zip(*np.nonzero(bits[:150, 150:] <= limit)))
    assert sum(x + 1 for x in simhash.shares(simhash.MAX_BITS + 1, simhash.LANES)) == simhash.MAX_BITS + 1


def test_index_compares_few_unrelated_words(monkeypatch):
    rng, compared, count = np.random.default_rng(72), [], np.bitwise_count
    words = rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)
    for k in range(1, 2000, 2):
        words[k] = flipped(words[k - 1 : k], rng.choice(64, 9, replace=False).tolist())[0]

    def counted(x):
        compared.append(x.size * (x.dtype == np.uint64))
        return count(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    met = {(min(p), max(p)) for i, j in simhash.within(words, None, 9) for p in zip(i.tolist(), j.tolist())}
    assert met >= {(k - 1, k) for k in range(1, 2000, 2)}
    assert sum(compared) < 0.0002 * len(words) ** 2  # lists of near keys compare ten times as many


def test_masks_leave_out_any_bits_within_the_limit():
    rng = np.random.default_rng(73)
    for width, bits in ((7, 0), (12, 3), (45, 6), (46, 7)):
        m = simhash.masks(width, bits)
        assert len(m) <= (2 << bits) - 1 and all(0 < x < 1 << width for x in m.tolist())
        for _ in range(300):
            out = sum(1 << int(x) for x in rng.choice(width, bits, replace=False))
            assert any(x & out == 0 for x in m.tolist())


def test_any_two_points_of_a_plane_have_a_line():
    for n, q in ((1, 1), (10, 1), (11, 2), (25, 3), (41, 5), (61, 7), (75, 11)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(simhash, "CHUNK", 10)
            assert simhash.plane(n) == q
        lines = np.array(simhash.lines_of(np.arange(q * q), q)).T
        assert (lines[:, None, :] == lines[None]).any(axis=2).all()
        assert set(np.bincount(lines.ravel())) == {q}


def test_long_runs_are_met_by_label(monkeypatch):
    rng = np.random.default_rng(74)
    words = np.repeat(rng.integers(0, 1 << 45, 12, dtype=np.uint64), rng.integers(1, 60, 12))
    label = rng.integers(0, 4, len(words)).astype(np.int32)
    want = {(a, b) for a, b in zip(*np.nonzero((words[:, None] == words) & (label[:, None] != label))) if a < b}
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    met = {(min(p), max(p)) for i, j in simhash.within(words, None, 0, 45, label=label) for p in zip(i.tolist(), j.tolist())}
    assert met == want and len(want) > 1000


def test_linked_spans_the_whole_list():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (5, simhash.LANES), dtype=np.uint64)
    lanes = base[rng.integers(0, 5, 300)] ^ (np.uint64(1) << rng.integers(0, 60, (300, simhash.LANES)).astype(np.uint64))
    assert groups(simhash.linked(lanes, simhash.MAX_BITS), range(300)) == groups(near(lanes), range(300))


def test_groups_of_many_edited_copies(spark):
    rng = random.Random(51)
    rows, d = [], 0
    for _ in range(4):
        w = prose(rng, 150).split()
        for _ in range(60):
            c = list(w)
            for _ in range(rng.randint(0, 9)):
                c[rng.randrange(len(c))] = f"other{rng.randrange(10**6)}"
            rows.append((d, " ".join(c)))
            d += 1
    rng.shuffle(rows)
    sig = dict(zip((d for d, _ in rows), signatures_of([t for _, t in rows])))
    pairs = [(a, b) for a in sig for b in sig if b < a and distances(sig[a], sig[b]) <= simhash.MAX_BITS]
    assert {r.doc_id: r.duplicate_of for r in simhash.duplicates(docs(spark, rows)).collect()} == groups(pairs, sig)
    assert max(distances(sig[a], sig[b]) for a in range(60) for b in range(a)) > simhash.MAX_BITS


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    out = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_duplicates_edges(spark):
    same = prose(random.Random(8), 80)
    rows = [*EDGE, (11, same), (10, same), (10, same), (12, same.upper()), (None, same), (13, ""), (14, "word"), (15, "?!"), (15, "?!")]
    got = {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(docs(spark, rows)).collect()}
    assert got == {(11, 10), (12, 10), (14, 4)}
    out = simhash.clean(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*(d for d, _ in EDGE), 10, None, 13, 15, 15], key=str)
    assert simhash.duplicates(docs(spark, [])).count() == 0 and simhash.clean(docs(spark, [])).count() == 0


def test_every_text_of_an_id_is_looked_up(spark):
    rng = random.Random(42)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (2, b), (3, c), (3, a), (3, b), (3, c), (4, c), (5, a), (5, a)]
    assert {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(docs(spark, rows)).collect()} == {(3, 1), (3, 2), (4, 3), (5, 1)}
    assert sorted((r.doc_id, r.text) for r in simhash.clean(docs(spark, rows)).collect()) == [(1, a), (2, b), (3, c)]


# == quality
def test_quality_gross_mild_and_hosts(spark):
    clean = prose(random.Random(9), 60)
    mild = clean + " #" * int(len(clean) * 0.03)
    rows = [(i, clean, "good") for i in range(20)] + [(20, mild, "good")]
    rows += [(100 + i, "### $$$ %%%", "bad") for i in range(20)] + [(120, mild, "bad"), (121, clean, "bad")]
    rows += [(200, None, "good"), (201, "", "good"), (202, "OH NO THIS IS ALL SHOUTED", None), (None, clean, None), (203, "no " * 50, "good"), (204, clean, "good"), (204, clean, "good")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id for r in quality.kept(docs(spark, rows), labels).collect()), key=lambda x: (x is None, x))
    assert got == [*range(21), 121, 204, 204, None]
    for limit in (quality.BROADCAST_HOSTS, 0):  # either way of joining the hosts
        full = quality.clean(docs(spark, rows), labels, broadcast_hosts=limit)
        assert full.columns == docs(spark, rows).columns and sorted((r.doc_id for r in full.collect()), key=lambda x: (x is None, x)) == got
        assert all(r.text for r in full.collect())
        assert sorted((r.doc_id for r in quality.kept(docs(spark, rows), labels, broadcast_hosts=limit).collect()), key=lambda x: (x is None, x)) == got
    assert quality.kept(docs(spark, []), labels).count() == 0 and quality.clean(docs(spark, []), labels).count() == 0


def test_quality_learns_abusive_words(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 50) + (" scumword slurword" if i < 30 else " slurword" if i == 99 else "")) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    few = labels.withColumn("toxic", F.when(F.col("doc_id") < 30, 1).otherwise(F.col("toxic")))
    few = few.withColumns({"text": F.lit("other"), "source": F.lit("x"), "word": F.lit(1)})  # names that the operator uses
    assert quality.vocabulary(docs(spark, rows), few) == ["scumword", "slurword"]
    assert {r.doc_id for r in quality.kept(docs(spark, rows), few).collect()} == set(range(30, 100))


def test_quality_measures_long_texts_whole(spark):
    text = " ".join(f"word{k}" for k in range(60_000))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id for r in quality.kept(docs(spark, [(1, text), (2, text + " #" * len(text)), (3, text)]), labels).collect()}
    assert got == {1, 3}


# == WARC
@pytest.mark.parametrize("limit", [warc.BROADCAST_CAPTURES, 0])
def test_warc_round_trip(spark, tmp_path, limit):
    long = "é" * 300_000
    pages = [(3, "http://a", "<p>é one</p>"), (1, "http://b", "<p>é one</p>"), (2, None, "two\r\n\r\nlines"), (4, "http://d", ""), (5, "http://e", None), (None, "x", "y"), (3, "http://a", "<p>é one</p>"), (6, "u", long), (6, "u", long)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, uri string")
    index = {r.capture_id: r for r in warc.deduplicate(warc.captures(df), str(tmp_path / "warc"), limit).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in index.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 6: ("response", None)}
    read = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path / "warc")).collect()}
    assert len(read) == 5 and not (tmp_path / "warc" / "_temporary").exists()
    ids = {k: r.header.split("WARC-Record-ID: ")[1].split("\r\n")[0] for k, r in index.items()}
    block = {k: bytes(read[v].block) for k, v in ids.items()}
    assert block[1].endswith("\r\n\r\n<p>é one</p>".encode()) and block[6].endswith(b"\r\n\r\n" + long.encode())
    assert block[2].endswith(b"two\r\n\r\nlines") and read[ids[3]].refers_to == ids[1] and block[3].endswith(b"\r\n\r\n")
    assert all(len(block[k]) == r.content_length for k, r in index.items())


def test_warc_has_a_gzip_member_for_each_record(spark, tmp_path):
    rows = [(k, "response", f"2024-01-0{k}T00:00:00Z", "u", f"d{k % 3}", bytes([k % 3, 0, 255, 13, 10, 13, 10])) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "capture_id long, kind string, date string, uri string, digest string, payload binary").coalesce(2)
    index = warc.deduplicate(df, str(tmp_path / "w")).collect()
    assert sorted((r.capture_id, r.refers_to) for r in index) == [(1, None), (2, None), (3, None), (4, 1), (5, 2), (6, 3), (7, 1)]
    records = 0
    for f in (tmp_path / "w").iterdir():
        data, kinds = f.read_bytes(), []
        while data:
            z = zlib.decompressobj(31)
            record = z.decompress(data) + z.flush()
            data = z.unused_data
            ((head, block),) = warc.parse([record])
            assert len(block) == int(head["Content-Length"]) and record.endswith(b"\r\n\r\n")
            kinds.append(head["WARC-Type"])
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        records += len(kinds) - 1
    assert records == 7
    blocks = {r.digest: bytes(r.block).split(b"\r\n\r\n", 1)[1] for r in warc.read_archive(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    assert blocks == {f"d{k}": bytes([k, 0, 255, 13, 10, 13, 10]) for k in range(3)}


def test_warc_parses_any_cut_of_the_stream():
    records = [warc.info("a"), warc.info("b" * 300)]
    whole, packed = b"".join(r + b"\r\n\r\n" for r in records), b"".join(map(warc.member, records))
    want = list(warc.parse([whole]))
    for size in (1, 7, 64, 10_000):
        for data in (whole, packed):
            chunks = [data[k : k + size] for k in range(0, len(data), size)]
            if size > 1 or data is whole:
                assert list(warc.parse(warc.inflated(chunks))) == want
    with pytest.raises(ValueError):
        list(warc.parse([whole[:-9]]))


def test_warc_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.deduplicate(warc.captures(none), str(tmp_path / "none")).count() == 0
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("limit", [warc.BROADCAST_CAPTURES, 0])
def test_warc_keeps_each_payload_of_an_id(spark, tmp_path, limit):
    pages = [(1, "http://a", "<p>one</p>"), (1, "http://a", "<p>another, longer</p>"), (2, "http://b", "<p>another, longer</p>"), (3, "http://c", "three")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.deduplicate(warc.captures(df), str(tmp_path / "warc"), limit).collect()
    assert sorted((r.capture_id, r.record_type, r.refers_to or 0) for r in index) == [(1, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0)]
    read = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path / "warc")).collect()}
    assert len(read) == 4
    blocks = {r.digest: bytes(r.block).split(b"\r\n\r\n", 1)[1].decode() for r in read.values() if r.record_type == "response"}
    assert blocks == {"sha1:" + hashlib.sha1(p.encode()).hexdigest(): p for _, _, p in pages}
    (revisit,) = (r for r in read.values() if r.record_type == "revisit")
    assert read[revisit.refers_to].digest == revisit.digest


def test_warc_logged_revisits(spark):
    rows = [(1, "revisit", "a", "u1", "d1"), (2, "response", "c", "u2", "d1"), (3, "response", "b", "u3", "d1"), (4, "revisit", "a", "u4", "d9"), (5, "revisit", "a", "u5", None), (3, "response", "b", "u3", "d1")]
    columns = "capture_id long, kind string, date string, uri string, digest string"
    got = {r.capture_id: (r.record_type, r.refers_to, r.refers_to_date) for r in warc.resolve(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: ("revisit", 3, "b"), 2: ("revisit", 3, "b"), 3: ("response", None, None), 4: ("revisit", None, None)}
    assert warc.resolve(spark.createDataFrame([], columns)).count() == 0


# == lines
def brute_lines(rows, min_docs):
    """``drop_recurring`` in plain Python, without any of its functions."""
    digit = lambda w: any(c.isdigit() for c in w)
    leaves = {}
    for d, t in rows:
        if d is None or t is None:
            continue
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                masked = tuple("*" if digit(w) else w for w in line.split())
                found = leaves.setdefault((len(masked), masked[:3]), {}).setdefault(line, (masked, []))
                found[1].append((d, k))
    gone = {}
    for leaf in leaves.values():
        clusters = []  # [template, lines]
        n_docs = {x: len({d for d, _ in at}) for x, (_, at) in leaf.items()}
        for line in sorted(leaf, key=lambda x: (-n_docs[x], x)):
            masked = leaf[line][0]
            agree = [sum(a == b for a, b in zip(c[0], masked)) for c in clusters]
            best = max(range(len(clusters)), key=lambda i: (agree[i], -i), default=None)
            if best is not None and agree[best] >= 0.7 * len(masked):
                clusters[best][0] = tuple(a if a == b else None for a, b in zip(clusters[best][0], masked))
                clusters[best][1].append(line)
            else:
                clusters.append([masked, [line]])
        for template, members in clusters:
            variable = sum(x in (None, "*") for x in template)
            for own in [members] if 2 * variable <= len(template) else [[x] for x in members]:
                places = [p for x in own for p in leaf[x][1]]
                if len({d for d, _ in places}) >= min_docs:
                    gone |= {x: min(places) for x in own}
    out = {}
    for d, t in rows:
        left = t if d is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if gone.get(x, (d, k)) == (d, k))
        if left == t or left.strip():
            out[d] = left
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for d in range(80):
        t = [prose(rng, rng.randint(1, 12), 60) for _ in range(rng.randint(1, 6))]
        if d % 2:
            t.insert(rng.randrange(len(t)), f"Posted by user{d} on day {d % 9} at noon")
        if d % 7 == 0:
            t = ["All rights reserved.", ""] + t
        rows.append((d, "\n".join(t)))
    rows += [(90, "All rights reserved.")]
    got = {r.doc_id: r.text for r in lines.drop_recurring(docs(spark, rows)).collect()}
    want = brute_lines(rows, lines.MIN_DOCS)
    assert got == want and sum(len(t or "") for _, t in rows) > sum(len(t or "") for t in want.values()) and 90 not in got
    assert "Posted by user1" in got[1] and not any("Posted by" in got.get(d, "") for d in range(3, 80, 2))


@pytest.mark.parametrize("seed", range(4))
def test_lines_that_vary_equal_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    shapes = ["user {} wrote on {} at the old forum about {}", "{} {} {} of {}", "see {} and {} for more of it all", "a line that never changes", "{}: {}"]
    fill = lambda: rng.choice([str(rng.randrange(30)), rng.choice("red blue green".split()), "x9"])
    rows = []
    for d in range(60):
        t = [rng.choice(shapes) for _ in range(rng.randint(1, 5))]
        rows.append((d, "\n".join(" ".join(fill() if w == "{}" else w for w in x.split()) for x in t)))
    got = {r.doc_id: r.text for r in lines.drop_recurring(docs(spark, rows)).collect()}
    want = brute_lines(rows, lines.MIN_DOCS)
    assert got == want and want != dict(rows)


def test_templates_equal_a_scan_of_all():
    rng = random.Random(110)
    texts = sorted({" ".join(rng.choice("abcdefg") for _ in range(9)) for _ in range(600)})
    counts = [rng.randint(1, 5) for _ in texts]
    clusters = []
    for i in sorted(range(len(texts)), key=lambda k: (-counts[k], texts[k])):
        w = texts[i].split()
        agree = [sum(a == b for a, b in zip(t, w)) for t, _ in clusters]
        if agree and max(agree) >= 0.7 * 9:
            t, m = clusters[agree.index(max(agree))]
            t[:] = [a if a == b else "<*>" for a, b in zip(t, w)]
            m.append(i)
        else:
            clusters.append((w, [i]))
    assert lines.templates(texts, counts) == [(m, t) for t, m in clusters] and any(len(m) > 1 for _, m in clusters)


def test_lines_of_a_long_document(spark):
    text = "\n".join(f"entry {k % 7} of the list" if k % 2 else f"only {'x' * (k % 50)}{k} here once {k}" for k in range(20_000))
    rows = [(d, text if d == 0 else "\n".join(f"entry {k} of the list" for k in range(3))) for d in range(5)]
    (got,) = lines.drop_recurring(docs(spark, rows)).where("doc_id = 0").collect()
    assert got.text.count("entry") == 1 and got.n_dropped > 9_000


def test_lines_count_documents(spark):
    steps = "\n".join(f"Step {k} of the guide" for k in range(9))
    rows = [(1, steps), *[(2, "All of this text")] * 6, *((10 + i, f"Page {i} of the book\nPage {i + 50} of the book") for i in range(5)), *((20 + i, f"Note {i} in the margin\nNote {i + 50} in the margin") for i in range(4))]
    got = {r.doc_id: r.text for r in lines.drop_recurring(docs(spark, rows)).collect()}
    assert got == {d: t for d, t in rows if not 10 < d < 20} | {10: "Page 0 of the book"}
    assert {(r.template, r.n_docs) for r in lines.recurring(docs(spark, rows)).collect()} == {("Page <*> of the book", 5)}


def test_lines_of_numbers_recur_by_themselves(spark):
    rows = [(i, f"own text {'x' * i}\n+1-800-555-0100\n2024-01-01 00:0{i}\n2024-01-01 00:00") for i in range(6)]
    rows += [(10 + i, f"Tel: 555 123 4567\nTel: 555 123 456{i}\nmore {'y' * i}") for i in range(5)]
    got = {r.doc_id: r.text for r in lines.drop_recurring(docs(spark, rows)).collect()}
    assert got == {0: rows[0][1].removesuffix("\n2024-01-01 00:00")} | {i: f"own text {'x' * i}\n2024-01-01 00:0{i}" for i in range(1, 6)} | {10: rows[6][1]} | {
        10 + i: f"Tel: 555 123 456{i}\nmore {'y' * i}" for i in range(1, 5)
    }


def test_lines_edges(spark):
    rows = [*EDGE, *((10 + i, "the same line here\nown words number" + "x" * i) for i in range(6)), (10, "the same line here\nown words number")]
    out = lines.drop_recurring(docs(spark, rows), min_docs=6)
    got = [(r.doc_id, r.text) for r in out.collect() if r.doc_id is None or r.doc_id < 10]
    assert sorted(got, key=str) == sorted(EDGE, key=str)
    assert out.columns == docs(spark, rows).columns + ["n_dropped"]
    assert out.where("text is not null and n_chars <> length(text)").count() == 0
    assert lines.drop_recurring(docs(spark, [])).count() == 0


def test_templates_generalise():
    assert lines.says_something(["a", "<*>"]) and not lines.says_something(["<*>", "a", "<*>"])
    found = lines.templates(["a b c d e f g", "a b c x e f g", "q b c d z z z"], [5, 1, 1])
    assert sorted((sorted(m), t) for m, t in found) == [([0, 1], "a b c <*> e f g".split()), ([2], "q b c d z z z".split())]


# == packing
@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 512])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 40, 800]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    slots, used = packing.plan(histogram, capacity), {}
    for length, a, b, first, per, start in slots:
        for r in range(a, b):
            used.setdefault(first + (r - a) // per, []).append((start + (r - a) % per * length, length))
    assert len(used) == packing.brute(lengths, capacity)
    for spans in used.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= capacity
    assert sum(map(len, used.values())) == len(lengths)


@pytest.mark.parametrize("cell_rows", [packing.CELL_ROWS, 7])
def test_packing_places_every_token(spark, cell_rows):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 1, 5, 64, 65, 200, rng.randint(1, 300)])) for i in range(400)] + [(7, 30), (7, 30), (None, 5)]
    out = packing.best_fit(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 64, cell_rows).collect()
    lengths = [n for i, n in rows if i is not None]
    assert sum(r.n_tokens for r in out) == sum(lengths)
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append((r.start, r.n_tokens))
    assert len(bins) == packing.brute(lengths, 64) and set(bins) == set(range(len(bins)))
    for spans in bins.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64


def test_sequences_hold_the_texts(spark):
    rng = random.Random(49)
    texts = [(i, prose(rng, rng.randint(1, 90))) for i in range(40)] + [(3, "another text of that id"), (5, None), (None, "no id"), (6, "")]
    counts = packing.PieceCounts(packing.TOKENIZER)
    out = packing.sequences(docs(spark, texts), 64).collect()
    found = {}
    for r in out:
        assert len(r.tokens) == r.n_tokens <= 64 and r.starts[0] == 0
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.starts, [*r.starts[1:], r.n_tokens]):
            found.setdefault(d, {}).setdefault(p, []).append(r.tokens[a:b])
    assert sorted(r.bin_id for r in out) == list(range(len(out)))
    for d, t in texts:
        if t and d is not None:
            want = counts.encoding.encode_ordinary(t)
            assert all(want[k : k + 64] in found[d][k // 64] for k in range(0, len(want), 64))
    assert sum(r.n_tokens for r in out) == sum(len(counts.encoding.encode_ordinary(t)) for d, t in texts if t and d is not None)
    assert packing.sequences(docs(spark, [])).count() == 0


def test_token_counts_equal_the_encoder(spark):
    texts = ["Plain words, here's 12 numbers!\n\n  two   spaces ", "été über 中文 🙂\t\r\n", "", None, "a" * 3000]
    counts = packing.PieceCounts(packing.TOKENIZER)
    want = {i: len(counts.encoding.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs(spark, list(enumerate(texts)))).collect()}
    assert got == want
    assert packing.pack_documents(docs(spark, [])).count() == 0
    assert {r.doc_id for r in packing.pack_documents(docs(spark, EDGE)).collect()} == {3, 4, 5}


# == HTML
def page(rng, k):
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in prose(rng, 5).split())
    body = "".join(f"<p>{prose(rng, rng.randint(15, 60))}</p>" for _ in range(rng.randint(2, 6)))
    return f"<html><head><title>{prose(rng, 4)}</title><script>x<1</script></head><body><ul>{nav}</ul><article>{body}</article><footer>{prose(rng, 4)}</footer></body></html>"


def test_html_held_out_accuracy(spark):
    rng = random.Random(13)
    pages = [(i, page(rng, i)) for i in range(160)]
    fit = spark.createDataFrame(pages[:80], "page_id long, html string")
    w = html.fit(fit)
    assert all(v > 0 for k, v in w.items() if k[0] == "w") and all(v < 0 for k, v in w.items() if k[0] == "<")
    right = 0.0
    for _, p in pages[80:]:
        want = " ".join(html.extract("<div>" + p.split("<article>")[1].split("</article>")[0], w).split()).split()
        got = html.extract(p, w).split()
        common = len(set(want) & set(got))
        right += 2 * common / max(1, len(set(want)) + len(set(got)))
    assert right / 80 > 0.95


def test_best_region_equals_brute_force():
    rng = np.random.default_rng(14)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(0, 14)).astype(float)
        best = max([(s[a:b].sum(), -b, a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)], default=(0, 0, 0))
        assert html.best_region(s) == ((best[2], -best[1]) if best[0] > 0 else (0, 0))


def brute_tokens(page):
    """(token, is a tag) by one walk over the characters; the marks of the content are left out."""
    out, i, low = [], 0, page.lower()
    while i < len(page):
        if page[i].isspace():
            i += 1
            continue
        end = -1
        if low.startswith("<!--", i):
            end = low.find("-->", i) + 3 if low.find("-->", i) >= 0 else -1
        elif low.startswith(("<script", "<style"), i):
            close = low.find("</script>" if low[i + 2] == "c" else "</style>", i)
            end = low.find(">", close) + 1 if close >= 0 else -1
        if end < 0 and page[i] == "<" and page[i + 1 : i + 2] and (page[i + 1].isalpha() or page[i + 1] in "/!?"):
            end = page.find(">", i) + 1
        if end > 0:
            if not low[i:end].strip("</>").startswith("article"):
                out.append((page[i:end], True))
            i = end
            continue
        j = i + 1
        while j < len(page) and not page[j].isspace() and not (page[j] == "<" and (page[j + 1 : j + 2].isalpha() or page[j + 1 : j + 2] in ("/", "!"))):
            j += 1
        out.append((page[i:j], False))
        i = j
    return out


def test_extraction_equals_brute_force():
    rng = random.Random(43)
    w = html.weights([("w0", 3, 9), ("w1", 9, 3), ("w2", 40, 1), ("wa0", 1, 30), ("<p", 30, 3), ("</p", 30, 3), ("<li", 1, 30), ("</li", 1, 30)])
    for k in range(40):
        p = page(rng, k).replace("</p>", " 3 < 4 &amp; b<3</p><!-- <p>no</p> -->", 1)
        got, kinds, _, _ = html.tokenize(p)
        tokens = brute_tokens(p)
        assert got == [t for t, _ in tokens] and [x[0] == "<" for x in kinds] == [tag for _, tag in tokens]
        scores = [w.get(x, html.DEFAULT_TAG if x[0] == "<" else html.DEFAULT_WORD) for x in kinds]
        best, a, b = 0.0, 0, 0
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > best + 1e-9:
                    best, a, b = total, i, j + 1
        words_in = " ".join(t for t, tag in tokens[a:b] if not tag).replace("&amp;", "&")
        assert html.extract(p, w).split() == words_in.split() and len(words_in) > 50


def test_html_signs_that_open_no_tag():
    assert html.extract("if a < b and c holds <3 then", {}) == "if a < b and c holds <3 then"
    assert html.extract('<p title="x > y">one two</p>', {}) == "one two"
    assert html.extract("before <b unclosed", {}) == "before b unclosed"
    assert html.fit.__defaults__ == (html.FIT_PAGES,)


def test_html_fit_on_an_empty_table(spark):
    assert html.fit(spark.createDataFrame([], "page_id long, html string")) == html.DEFAULT


def test_html_edges(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "no tags &amp; entities", "t"), (4, "<p><br>", "t"), (None, "<b>word", "t"), (3, "no tags &amp; entities", "t"), (5, "<p>" + "word " * 50_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [(r.page_id, r.text if r.page_id != 5 else r.n_words) for r in html.content(df, html.fit(df)).collect()]
    assert sorted(got[:6], key=str) == sorted([(1, None), (2, ""), (3, "no tags & entities"), (4, ""), (None, "word"), (3, "no tags & entities")], key=str)
    assert got[6] == (5, 50_000)
    assert html.content(df.limit(0), {}).count() == 0


# == chat
def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(15)
    logs = {}
    for c in range(60):
        base = logs[rng.choice(list(logs))] if logs and rng.random() < 0.6 else []
        cut = base[: rng.randint(0, len(base))]
        logs[c] = cut + [(rng.choice(["user", "assistant"]), rng.choice(["hi", "a:b", None, "x" * 9])) for _ in range(rng.randint(0 if cut else 1, 2))]
    rows = [(c, t, r, x, "e") for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    got = {r.conv_id for r in chat.render(chat.maximal(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string"))).collect()}
    want = {c for c, t in logs.items() if not any((len(u) > len(t) and u[: len(t)] == t) or (u == t and o < c) for o, u in logs.items() if o != c)}
    assert got == want


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, None, "user", "b"), (None, 0, "user", "c"), (3, 0, "user", ""), (4, 0, "user", None)]
    got = {r.conv_id: r.prompt for r in chat.render(chat.maximal(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: "<|user|>\na<|end|>\n<||>\n<|end|>\n", 3: "<|user|>\n<|end|>\n", 4: "<|user|>\n<|end|>\n"}
    assert chat.maximal(spark.createDataFrame([], schema)).count() == 0


def test_chat_of_very_many_and_very_long_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 3000), (2, 2999), (3, 3000)) for t in range(n)]
    rows[-1] = (3, 2999, "user", "x" * 400_000)
    got = {r.conv_id: (r.n_turns, len(r.prompt)) for r in chat.render(chat.maximal(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {1, 3} and got[1][0] == got[3][0] == 3000 and got[3][1] > 400_000


def test_words_are_lower_case_runs():
    assert words("It's ÉTÉ, x_1!") == ["it", "s", "été", "x_1"]
