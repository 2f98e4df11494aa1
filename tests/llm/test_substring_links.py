"""Links of near-duplicate passages against brute force over all pairs."""

import numpy as np
import pyarrow as pa

from tilewright.llm import substring
from tilewright.llm.vectors import utf8


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 1 << 40, n)]


def test_a_crowd_has_all_its_links(spark):


    rng = np.random.default_rng(12)
    shared = words(rng, 80)
    texts = []
    for k in range(30):
        own = list(shared)
        for at in rng.integers(0, 80, k % 4):
            own[at] = f"edit{k}"
        texts.append(" ".join(words(rng, 40) + own + words(rng, 40)))
    texts += [" ".join(words(rng, 100)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring.near_passages(docs).collect()}
    grams = [{tuple(t.split()[i : i + 50]) for i in range(len(t.split()) - 49)} for t in texts]
    h, offsets = substring.shingles(*utf8(pa.array(texts)))
    rows = [h[offsets[k] : offsets[k + 1]] for k in range(len(texts))]
    exact, near = ({(x, y) for x in range(len(texts)) for y in range(x) if linked(x, y)} for linked in (lambda x, y: grams[x] & grams[y], lambda x, y: substring.aligned(rows[x], rows[y])))
    label = list(range(len(texts)))
    for x, y in sorted(near):
        low, high = sorted((label[x], label[y]))
        label = [low if v == high else v for v in label]
    for k, r in got.items():
        assert r.component_id == label[k], k
        first = min((y for x, y in exact if x == k), default=None)
        assert first is None or r.first_id <= max(y for x, y in near if x == k)
        own = texts[k].split()
        covered = {p for y in range(k) for i in range(len(own) - 49) if tuple(own[i : i + 50]) in grams[y] for p in range(i, i + 50)}
        assert r.n_dup_words >= len(covered), k
    assert len(exact) > 2 * len(texts)


def brute(x, y, least=46, similarity=0.8):
    """Places of x in a stretch that some window of y shares enough with, as multisets."""
    from collections import Counter

    places = set()
    for i in range(len(x) - least + 1):
        have = Counter(x[i : i + least])
        for a in range(len(y)):
            own, k, hit = Counter(), 0, False
            for b in range(a, min(len(y), a + 58)):
                own[y[b]] += 1
                k += own[y[b]] <= have[y[b]]
                hit = hit or (k >= 41 and k >= similarity * (least + b - a + 1 - k) - 1e-9)
            if hit:
                places |= set(range(i, i + least))
                break
    return places


def test_a_repeated_line_hides_no_later_repeat():
    line, other, body = np.arange(20), np.arange(100, 130), np.arange(200, 230)
    x, y = (np.concatenate(p).astype(np.uint32) for p in ((line, body), (line, other, line, body)))
    x = np.append(x, np.uint32(999))  # no whole repeat
    assert substring.aligned(x, y) and brute(x.tolist(), y.tolist()) <= set(range(*substring.aligned(x, y)[0]))


def test_aligned_is_the_overlap_of_windows():
    rng = np.random.default_rng(21)
    for case in range(60):
        size = (40, 300, 10_000)[case % 3]
        x = rng.integers(0, size, rng.integers(46, 110))
        y = np.concatenate((rng.integers(0, size, rng.integers(0, 30)), x[: rng.integers(20, 60)], x, rng.integers(0, size, 10)))
        for at in rng.integers(0, len(y), rng.integers(0, 16)):
            y[at] = rng.integers(0, size)
        y = np.delete(y, rng.integers(0, len(y), rng.integers(0, 8)))
        got = {p for s, e in substring.aligned(x.astype(np.uint32), y.astype(np.uint32)) for p in range(s, e)}
        assert got == brute(x.tolist(), y.tolist()), case


def template(rng, phrases, unique=18):
    """A passage of three common phrases among words of its own."""
    parts = []
    for k in rng.choice(len(phrases), 3, replace=False):
        parts += phrases[k] + words(rng, unique // 3)
    return parts


def test_recall_on_templates(spark):
    """Planted repeats among passages that all share common phrases: exact ones all, near ones nearly all."""
    rng = np.random.default_rng(33)
    phrases = [words(rng, 12) for _ in range(10)]
    texts = [words(rng, 30) + template(rng, phrases) + words(rng, 30) for _ in range(960)]
    exact, near = [], []
    for k in range(60):
        i, j = 2 * k, 900 - 7 * k
        own = texts[i][30:84]
        if k % 2:
            at = rng.choice(54, 1)
            own = [w if p not in at else "edited" for p, w in enumerate(own)]
            near.append((i, j))
        else:
            exact.append((i, j))
        texts[j] = words(rng, 25) + own + words(rng, 25)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    # Few classes, so that the phrases are crowded.
    got = {r.doc_id: r.component_id for r in substring.near_passages(docs, classes=16, leaders=4).collect()}
    rows = []
    for i, j in near:
        h, o = substring.shingles(*utf8(pa.array([" ".join(texts[k]) for k in (i, j)])))
        if brute(h[o[1] : o[2]].tolist(), h[: o[1]].tolist()):
            rows.append((i, j))
    assert len(rows) >= 20
    assert all(got[i] == got[j] for i, j in exact)
    assert sum(got[i] == got[j] for i, j in rows) >= 0.95 * len(rows)
    planted = {k for pair in exact + near for k in pair}
    assert all(got[k] == k for k in range(960) if k not in planted)


def test_a_crowd_beyond_the_classes(spark):
    """One passage in far more documents than a key names, whole and edited; and a repeat of 50 words alone."""
    rng = np.random.default_rng(34)
    shared, other = words(rng, 60), words(rng, 50)
    texts = []
    for k in range(200):
        own = list(shared)
        if k % 3 == 2:
            own[int(rng.integers(0, 60))] = f"edit{k}"
        texts.append(words(rng, 20) + own + words(rng, 20))
    texts += [words(rng, 20) + shared[:30] + other + words(rng, 5), words(rng, 9) + other + shared[30:] + words(rng, 7)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substring.near_passages(docs, classes=8, leaders=4).collect()}
    assert all(got[k].component_id == 0 and got[k].n_dup_words >= 50 for k in range(1, 200) if k % 3 != 2)
    near = [got[k].component_id == 0 for k in range(200) if k % 3 == 2]
    assert np.mean(near) >= 0.95
    assert got[200].component_id == got[201].component_id == 200


def test_copies_and_repeated_rows(spark):
    rng = np.random.default_rng(35)
    long = " ".join(words(rng, 80))
    rows = [(5, "a short text"), (3, "a short text"), (9, long)] + [(9, long)] * 40 + [(11, long), (12, ""), (13, None), (None, long), (None, None)]
    got = {}
    for r in substring.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[5][0].component_id == 3 and got[3][0].component_id == 3
    assert len(got[9]) == 41 and {r.component_id for r in got[9]} == {9} and got[11][0].component_id == 9
    assert got[12][0].component_id == 12 and got[13][0].component_id == 13 and {r.component_id for r in got[None]} == {9, None}


def test_sketches_rule_out_no_shared_passage():
    rng = np.random.default_rng(3)
    for _ in range(200):
        y = rng.integers(0, 1 << 63, 150).astype(np.uint64)
        x = rng.integers(0, 1 << 63, 130).astype(np.uint64)
        at, size = rng.integers(0, 60), rng.integers(30, 70)
        x[at : at + size] = y[20 : 20 + size]
        x[rng.integers(0, 130, 5)] = rng.integers(0, 1 << 63, 5).astype(np.uint64)
        short = rng.integers(0, 1 << 63, 20).astype(np.uint64)
        first, stop = substring.possible_parts([short.astype(np.uint16), x.astype(np.uint16)], y.astype(np.uint16))
        assert stop[0] == 0
        parts = substring.aligned(x, y)
        assert all(first[1] <= a and b <= stop[1] for a, b in parts)
        if stop[1]:
            cut = substring.aligned(x[first[1] : stop[1]], y)
            assert [(a + first[1], b + first[1]) for a, b in cut] == parts
        else:
            assert not parts


def test_edited_copies_under_crowded_keys_are_linked(spark):
    """Pairs of edited copies that only crowded keys name, and no leader is like."""
    rng = np.random.default_rng(31)
    common = [words(rng, 12) for _ in range(3)]
    texts = []
    for _ in range(40):
        own = [w for c in common for w in (*c, *words(rng, 8))]
        other = list(own)
        other[37] = "edit"
        texts += [" ".join(own), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    h, offsets = substring.shingles(*utf8(pa.array(texts)))
    rows = [h[offsets[k] : offsets[k + 1]] for k in range(len(texts))]
    near = {k for k in range(1, len(texts), 2) if substring.aligned(rows[k], rows[k - 1])}
    assert len(near) == 40
    got = {r.doc_id: r for r in substring.near_passages(docs, classes=0, leaders=0).collect()}
    for k in range(len(texts)):
        assert got[k].component_id == k - (k in near), k
        assert (got[k].n_passages, got[k].first_id) == ((1, k - 1) if k in near else (0, None)), k


def test_the_rarest_places_meet_what_is_shared():
    rng = np.random.default_rng(5)
    count = rng.integers(1, 50, 200)
    chosen = substring.rarest(count, np.array([0, 90, 100, 200]))
    for i in [*range(45), *range(100, 155)]:
        assert np.sort(count[i : i + 46])[:6].max() <= np.sort(count[i : i + 46][chosen[i : i + 46]])[:6].max()
        assert chosen[i : i + 46].sum() >= 6
    assert not chosen[90:100].any()


def windows_of(y, reach=57):
    from collections import Counter

    return [Counter(y[a : a + reach]) for a in range(len(y))]


def test_tokens_meet_what_is_shared_and_long_runs_meet_no_short_ones():
    """Of the rarest tokens of a passage one is held by all that shares enough with it, repeated shingles counted."""
    from collections import Counter

    rng = np.random.default_rng(8)
    met = 0
    for case in range(40):
        x = rng.integers(0, (6, 40, 1000)[case % 3], 70).astype(np.uint64)
        y = np.concatenate((rng.integers(0, 1000, 20).astype(np.uint64), x[: rng.integers(46, 70)], x[:10]))
        y[rng.integers(0, len(y), rng.integers(0, 6))] = 7
        offsets = np.array([0, len(x), len(x) + len(y)])
        h = np.concatenate((x, y))
        held, row, _ = substring.held_tokens(h, offsets)
        assert len(held) == len(np.unique(np.stack((held, row.astype(np.uint64))), axis=1).T)
        counts = np.bincount(substring._cells(held), minlength=substring.CELLS)
        token, first = substring.asked_tokens(h, offsets, counts)
        theirs = set(held[row == 1].tolist())
        for i in range(len(x) - 45):
            have = Counter(x[i : i + 46].tolist())
            if any((have & w).total() >= 41 for w in windows_of(y.tolist())):
                met += 1
                assert theirs & set(token[first == i].tolist()), (case, i)
    assert met > 200
    # A word that stands 60 times asks nothing of texts that have it 20 times.
    h, offsets = np.concatenate((np.full(60, 5), np.full(20, 5), np.arange(100, 140))).astype(np.uint64), np.array([0, 60, 120])
    held, row, _ = substring.held_tokens(h, offsets)
    assert ((row == 0).sum(), (row == 1).sum()) == (57, 60)
    assert not len(substring.asked_tokens(h, offsets, np.bincount(substring._cells(held), minlength=substring.CELLS))[0])


def test_a_crowd_of_runs_makes_few_pairs():
    """Stretches that all have a run of one word, of different lengths, and words of their own: none is like another, and
    the join names no pair, where each place of a run used to meet every place of all others."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(300):
        h = np.concatenate((rng.integers(100, 1 << 60, 40), np.full(10 + k % 20, 5), rng.integers(100, 1 << 60, 40))).astype(np.uint64)
        rows.append({"uid": k, "start": 0, "root": k, "spans": None, "asks": np.array([k, 0]).tobytes() + h.tobytes()})
    schema = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("root", pa.int64()), ("spans", pa.binary()), ("asks", pa.binary())])
    batches = pa.Table.from_pylist(rows, schema=schema).to_batches()
    cells = next(iter(substring._count_cells(iter(batches)))).column("cells").to_pylist()
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in cells])
    table = pa.Table.from_batches(list(substring._crowd_keys(1, counts)(iter(batches))))
    assert not len(substring._crowd_pairs(1)(table))
    # Copies are named, once for each.
    rows.append(rows[3] | {"uid": 1000, "root": 1000, "asks": np.array([1000, 0]).tobytes() + rows[3]["asks"][16:]})
    batches = pa.Table.from_pylist(rows, schema=schema).to_batches()
    table = pa.Table.from_batches(list(substring._crowd_keys(1, counts + 1)(iter(batches))))
    found = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 6) for x in substring._crowd_pairs(1)(table)["asks"].to_pylist()])
    assert (found[:, 2] == 1000).any() and [3, 0, 1000, 0, 0, 93] in found.tolist()
