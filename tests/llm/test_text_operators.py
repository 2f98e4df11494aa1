"""The text operators against brute-force versions on small fixtures with awkward rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import components, html_extract, langid, lm, media, mixing, packing, quality, simhash, substring, suffix_dedup
from tilewright.llm.vectors import nearest_smaller

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(rng, n):
    syllables = "the and ing er on tion re at en ou ha st le des ver ch un".split()
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = [prose(rng, int(n)) for n in rng.integers(1, 300, 40)]
    shared = prose(rng, 70)
    out = [(k, t) for k, t in enumerate(base)]
    out += [(100 + k, base[k]) for k in range(10)]  # copies
    out += [(120 + k, base[20] + " " + shared + " " + base[k]) for k in range(6)]
    words = base[30].split()
    out += [(140 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for k in range(min(20, len(words)))]
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "é" * 80), (204, "é" * 90), (205, "a" * 200), (206, "a" * 300), (207, "x y"), (208, prose(rng, 20000)), (None, base[5]), (None, "no id " * 30), (7, base[7]), (7, "other text of the same id " * 4)]
    return [(i, t, ("en", "fr", None)[k % 3], ("b", "a", None, "c")[k % 4], None) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns with the names that the operators use inside.
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("row", "size", "rank", "uid", "b2", "words", "kept", "n_words", "chunk", "bucket")}).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_nearest_smaller():
    rng = np.random.default_rng(0)
    v, link = rng.integers(0, 50, 400), rng.integers(0, 9, 400)
    prev, least = nearest_smaller(v, link)
    for i in range(400):
        j = max((k for k in range(i) if v[k] < v[i]), default=-1)
        assert prev[i] == j
        assert least[i] == (link[j + 1 : i + 1].min() if j >= 0 else 0)


def test_components(spark):
    rng = np.random.default_rng(5)
    for n, m in ((300, 150), (120, 0)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        chain = np.arange(900, 940)
        a, b = np.concatenate((a, chain)), np.concatenate((b, chain + 1))
        label = {int(x): int(x) for x in np.concatenate((a, b))}
        for _ in range(1000):
            new = dict(label)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                new[x] = new[y] = min(new[x], new[y])
            if new == label:
                break
            label = new
        links = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")
        got = {r.node: r.root for r in components.connect(links).collect()}
        assert got == {x: y for x, y in label.items() if x != y}
        fa, fb = components.forest(a, b)
        assert dict(zip(fa.tolist(), fb.tolist(), strict=True)) == got


# 1. SimHash


def reference_print(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_components(prints, distance=2):
    names = sorted(set(prints))
    label = {p: k for k, p in enumerate(names)}
    for p in names:
        for q in names:
            if bin(p ^ q).count("1") <= distance and label[p] != label[q]:
                low, high = sorted((label[p], label[q]))
                label = {x: low if y == high else y for x, y in label.items()}
    return label


def test_simhash(docs, rows):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(r[0], reference_print(r[1])) for r in rows]
    label = reference_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    assert got == Counter((i, f"{p:016x}", least.get(label[p])) for i, p in prints)


@pytest.mark.parametrize("limit, group", [(65.0, 512), (0.5, 512), (65.0, 2)])
def test_simhash_crowds(spark, monkeypatch, limit, group):
    """Crowded fingerprints: as planned, all by neighbours, and by the fallback in a block."""
    monkeypatch.setattr(simhash, "PLAN_LIMIT", limit)
    monkeypatch.setattr(simhash, "GROUP_LIMIT", group)
    rng = np.random.default_rng(11)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre}
    while len(prints) < 260:
        p = centre
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            p ^= 1 << int(b)
        prints.add(p)
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    plan = simhash.make_plan(nodes)
    assert sorted(b for part in plan.parts for b in part) == list(range(64))
    chosen, _ = plan.thresholds(np.array(prints, np.uint64))
    assert (chosen.sum(1) == 2 - len(plan.parts) + 1).all()
    deal, link = simhash._deal(plan, 7), simhash._link(2)
    links = nodes.mapInArrow(deal, simhash.MAPPED).groupBy("bucket").applyInArrow(link, simhash.LINKS)
    root = {r.node: r.root for r in components.connect(links).collect()}
    label = reference_components(prints)
    groups = {}
    for p, s in zip(prints, signed, strict=True):
        groups.setdefault(label[p], set()).add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_simhash_at_other_distances(spark, distance):
    rng = np.random.default_rng(13)
    prints = {int(x) for x in rng.integers(0, 1 << 62, 100)}
    for p in list(prints)[:60]:
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            p ^= 1 << int(b)
        prints.add(p)
    centre = int(rng.integers(0, 1 << 62))
    prints |= {centre ^ 1 << b for b in range(30)} | {centre}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    plan = simhash.make_plan(nodes, distance)
    links = nodes.mapInArrow(simhash._deal(plan, 5), simhash.MAPPED).groupBy("bucket").applyInArrow(simhash._link(distance), simhash.LINKS)
    root = {r.node: r.root for r in components.connect(links).collect()}
    label = reference_components(prints, distance)
    assert len({(label[p], root.get(s, s)) for p, s in zip(prints, signed, strict=True)}) == len(set(label.values())) == len({root.get(s, s) for s in signed})


def test_keep_one(docs, rows):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert not set(range(100, 110)) & set(kept) and set(range(3)) <= set(kept)
    assert kept.count(None) == 2


# 2. Suffix arrays


def reference_removal(rows, length=50):
    rank = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], 1 << 63), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < rank(i):
                gone[s : s + length] = True
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [None, 2])
def test_suffix_dedup(docs, rows, hot):
    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert Counter(tuple(r) for r in got) == reference_removal([r[:2] for r in rows])


def test_suffix_dedup_repeated_rows(spark):
    rng = np.random.default_rng(14)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(4, a)] * 60 + [(2, b)] * 3 + [(6, a + " " + b), (7, b), (None, None), (None, None), (8, "x" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == reference_removal(rows)
    kept = suffix_dedup.remove_repeats(docs.withColumn("uid", F.lit("clash")), keep_text=True).collect()
    assert Counter((r.doc_id, r.row.uid, r.kept == a) for r in kept if r.doc_id == 4) == {(4, "clash", True): 60}


def test_suffix_dedup_text_and_other_columns(docs):
    out = suffix_dedup.remove_repeats(docs, keep_text=True)
    r = {x["doc_id"]: x for x in out.collect()}
    assert r[105].kept == "" and r[0].kept and r[0].row.uid == 1


def test_previous_factors():
    rng = np.random.default_rng(2)
    rows, rank = rng.integers(0, 2, (150, 8)).astype(np.uint8), rng.integers(0, 40, 150)
    got = suffix_dedup.previous_factors(rows, rank)
    for i in range(150):
        best = 0
        for j in range(150):
            if rank[j] < rank[i]:
                differ = np.flatnonzero(rows[i] != rows[j])
                best = max(best, int(differ[0]) if len(differ) else 8)
        assert got[i] == best


# 3. Mixing


def test_mixing(spark, docs, rows):
    got = mixing.taken_words(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    taken, target = Counter(), {}
    mixed = mixing.mix_sources(docs).select("source", "size", "source_size", "target", "taken").collect()
    for r in mixed:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == totals[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(totals.values()))
    for s, t in target.items():
        assert t <= 3 * totals[s] + 1e-9 and abs(taken[s] - t) <= 1
    again = mixing.taken_words(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixed_documents_have_the_words_taken(docs):
    words = mixing.mixed_documents(docs).select("source", F.size(quality.words_of(F.col("text"))).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    taken = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("n"))
    assert {r.source: r.n for r in words.collect()} == {r.source: r.n for r in taken.collect() if r.n}


def test_mixing_inclusion_follows_the_probabilities(spark, monkeypatch):
    """Over many seeds documents are sampled about as often as p says, and without the division they are not."""
    rng = np.random.default_rng(12)
    rows = [(k, " ".join(["w"] * int(n)), "ab"[k % 2]) for k, n in enumerate(rng.choice([2, 1500], 140))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    hits, p, rounds = Counter(), {}, 16
    base = docs.select("doc_id", "source", F.size(quality.words_of(F.col("text"))).cast("long").alias("size"))
    for seed in range(rounds):
        for r in mixing._take(base, (3.0, 2.0), 3.0, f"s{seed}").collect():
            p[r.doc_id] = r.p
            hits[r.doc_id] += r.taken > r.copies * r["size"]
    kinds = {}
    for k, _, source in rows:
        kinds.setdefault((source, round(p[k], 9)), []).append(hits[k] / rounds)
    assert len(kinds) == 4
    for source in "ab":
        (low, a), (high, b) = sorted((q, f) for (s, q), f in kinds.items() if s == source)
        # The boundary document is partly taken: a share of one document in each sample.
        assert np.mean(a) == pytest.approx(low, abs=0.08) and np.mean(b) == pytest.approx(high, abs=0.08) and high > low + 0.05


def test_mixing_ranks_by_inclusion_odds(spark, sf_dir):
    """Ranking by the random numbers alone would sample other documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r for r in mixing.mix_sources(docs).select("doc_id", "source", "size", "p", "copies", "taken").collect() if r.p > 0 and r["size"]]
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(mixing.SEED, F.col("doc_id")).alias("u")).collect()}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    odds = lambda r: u[r.doc_id] / (1 - u[r.doc_id]) / (r.p / (1 - r.p))
    extra = lambda r: r.taken - r.copies * r["size"]
    differ = 0
    for own in by.values():
        ranked = sorted(own, key=odds)
        taken = [r.doc_id for r in ranked if extra(r)]
        assert taken == [r.doc_id for r in ranked[: len(taken)]]
        differ += set(taken) != {r.doc_id for r in sorted(own, key=lambda r: u[r.doc_id])[: len(taken)]}
    assert differ


def test_mixing_repeated_rows(spark):
    rows = [(7, "one two three four", "a")] * 300 + [(None, "five six", "a")] * 200 + [(8, "x", None)] * 50 + [(9, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [Counter(map(tuple, mixing.taken_words(docs.repartition(n)).collect())) for n in (1, 6)]
    assert got[0] == got[1] and sum(got[0].values()) == len(rows)
    total, target = Counter(), {}
    for (_, size, source_size, t, _, taken), n in got[0].items():
        total[source_size] += n * taken
        target[source_size] = t
        assert 0 <= taken <= 3 * size
    assert all(abs(total[s] - target[s]) <= 1 for s in target)


# 4. Language ID


def test_language_id(spark):
    rng = np.random.default_rng(8)
    parts = {"en": "the and of ing tion was with is to".split(), "de": "der und die ung keit sch nicht ein".split(), "es": "el los ción mente que para con la".split()}
    data = []
    for k in range(240):
        lang = ("en", "de", "es")[k % 3]
        data.append((k, " ".join("".join(rng.choice(parts[lang], rng.integers(1, 3))) for _ in range(60)), lang))
    data += [(1000, None, "en"), (1001, "123 --- ! ² ½ Ⅷ", "de"), (1002, "the and " * 3000, None), (None, "der und die", "de")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in data[:240] if got[i].held_out]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "en" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_forward_algorithm_sums_all_segmentations():
    names = ["a", "ab", "b", "ba", "▁", "▁a"]
    p = np.array([[0.2], [0.1], [0.3], [0.05], [0.15], [0.2]])
    prob = dict(zip(names, p[:, 0], strict=True))

    def total(w):
        return 1.0 if not w else sum(prob[x] * total(w[len(x) :]) for x in names if w.startswith(x))

    words = ["▁ab", "▁aba", "▁bbab"]
    got = langid.word_scores(words, langid.Pieces(names), langid._table(p))
    assert np.exp(got[:, 0]) == pytest.approx([total(w) for w in words])


def test_long_words_of_rare_pieces_have_a_score():
    pieces = langid.Pieces(["▁", "a"])
    table = langid._table(np.full((2, 2), 1e-9))
    got = langid.word_scores(["▁" + "a" * 32, "▁" + "ж" * 32], pieces, table)
    assert got[0] == pytest.approx([33 * np.log(1e-9)] * 2) and np.isfinite(got).all()


# 5. Compact windows


def test_compact_windows():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    h[50:60] = h[50]
    offsets = np.array([0, 3, 3, 150, 400])
    got = set(zip(*(x.tolist() for x in substring.compact_windows(h, offsets, 10)), strict=True))
    want = set()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for c in range(a, b):
            low = c
            while low > a and (h[low - 1] >> np.uint64(20), low - 1) > (h[c] >> np.uint64(20), c):
                low -= 1
            high = c
            while high + 1 < b and (h[high + 1] >> np.uint64(20), high + 1) > (h[c] >> np.uint64(20), c):
                high += 1
            if high - low + 1 >= 10:
                want.add((low, c, high))
    assert got == want


def test_near_passages(docs, rows):
    got = {}
    for r in substring.near_passages(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    text = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 7}
    words = {i: WORD.findall(lower(t or "")) for i, t in text.items()}
    grams = {i: [tuple(w[k : k + 50]) for k in range(len(w) - 49)] for i, w in words.items()}
    first = {}
    for i in sorted(grams):
        for g in grams[i]:
            first.setdefault(g, i)
    for i, own in grams.items():
        r = got[i][0]
        assert r.n_words == len(words[i])
        if any(first[g] < i for g in own):
            assert r.n_dup_words >= 50 and r.component_id < i and r.first_id is not None, i
    for i in (11, 12, 31, 32, 200, 201, 202, 208):
        assert got[i][0].n_dup_words == 0 and got[i][0].component_id == i, i


# 6. Quality


def test_quality(docs, rows):
    got = Counter(tuple(r)[1:8] for r in quality.score_quality(docs.select("doc_id", "text")).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    want = Counter()
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want[(len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed)] += 1
    short = Counter()
    for k, n in got.items():
        short[k[:6]] += n
    assert short == want
    assert not any(k[5] and k[6] for k in got)


def test_quality_filter_keeps_the_columns(docs):
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_verdict(spark):
    clean = "The house of the old man was by the river and it was in the town that he had seen on that day with his friend. " * 1 + "It is not far from here to the place."
    data = [(1, clean), (2, " ".join(w + "###" for w in clean.split())), (3, clean.upper().replace(" ", "!! ")), (4, " | ".join(clean.split())), (5, "zz qq vv " * 1 + " ".join(f"xx{k}" for k in range(40)))]
    got = {r.id: r.kept for r in quality.score_quality(spark.createDataFrame(data, "id long, text string")).select("row.id", "kept").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


# 7. HTML


ARTICLE = "<p>The text of the page, which is long enough to be dense and goes on for some time, so that it counts.</p>" * 4
ARTICLE_TEXT = " ".join(["The text of the page, which is long enough to be dense and goes on for some time, so that it counts."] * 4)


@pytest.mark.parametrize(
    "html, want",
    [
        # An article about comments keeps its sections; reader comments go.
        (f"<main>{ARTICLE}<section class='comment-styles'><p>How to style comments.</p></section></main>", ARTICLE_TEXT + " How to style comments."),
        (f"<article>{ARTICLE}<div class='user-reviews'><p>Nice text, I have read it twice and liked it.</p></div></article>", ARTICLE_TEXT),
        # No semantic element: menus of links go, headings and leads beside the body stay.
        (f"<div><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About</a></ul></div><div><h1>Title</h1><div>{ARTICLE}</div></div>", "Title " + ARTICLE_TEXT),
        (f"<div><div><p>A lead that is dense as well and stands beside the body, long enough to be more than a tenth of it.</p></div><div>{ARTICLE}</div></div>", "A lead that is dense as well and stands beside the body, long enough to be more than a tenth of it. " + ARTICLE_TEXT),
        (f"<main><h1>T</h1><p>Lead.</p><div itemprop=articleBody>{ARTICLE}</div></main>", "T Lead. " + ARTICLE_TEXT),
        (None, ""),
        ("", ""),
        ("<p>One&amp;two<br>three", "One&two three"),
        ("<nav>menu</nav><div id=side class='sidebar'>x</div><article><h1>T</h1><p>a <b>b</b>c</p><p>d</p><script>z</script></article><footer>f</footer>", "T a bc d"),
        ("<header>h</header><main><p>long text that is the article of this page</p><form><label>l</label></form><section class=comments><p>nice</p></section></main>", "long text that is the article of this page"),
        ("<table><tr><td><a href=1>x</a> <a>y</a></td><td><p>The text of the page, which is long enough to be dense and goes on for some time.</p><p>Short.</p></td></tr></table>", "The text of the page, which is long enough to be dense and goes on for some time. Short."),
        ("<article><p>a</div></span></p><p>b<ul><li>c<li>d</ul></article", "a b c d"),
    ],
)
def test_main_text(html, want):
    assert html_extract.main_text(html) == want


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", "<p>é x</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(rows).collect()) == [(1, "é x", 3), (2, "", 0), (2, "", 0)]


def test_pages_without_semantic_names(spark, sf_dir):
    """With article, nav and footer renamed to div and no classes, ratios and clusters find most articles."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    same, share = 0, []
    for r in pages:
        want = html_extract.main_text(r.html)
        got = html_extract.main_text(re.sub(r"(</?)(article|nav|footer|main|header|aside)\b", r"\1div", re.sub(r' class="[^"]*"', "", r.html)))
        same += got == want
        share.append(len(want) / max(len(got), 1) if want in got else 0)
    assert same >= 0.6 * len(pages) and np.median(share) > 0.9


def test_long_and_deep_pages_take_linear_time():
    import time

    def seconds(n):
        t = time.perf_counter()
        for part in ("<div>a", "<p><td><x><h1>b", "</section>", "<b><li>c</p>"):
            html_extract.main_text(part * n)
        return time.perf_counter() - t

    seconds(200)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.05)


# 8. Language model


def test_lm_scores(docs, rows):
    got = lm.score_documents(docs).collect()
    tokens = lambda t: [*WORD.findall(lower(t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, *_ in rows if i is not None and not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = tokens(t)
        want[(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)


# 9. Media


def test_codec_tables():
    mu, al = media.mu_law_table(), media.a_law_table()
    assert len(set(mu.tolist())) == 255 and len(set(al.tolist())) == 256
    assert (mu[0], mu[128], mu[255]) == (-32124, 32124, 0) and (al[0x55], al[0xD5]) == (-8, 8)
    assert (mu[:128] == -mu[128:]).all() and (al[:128] == -al[128:]).all()


def scalar_adpcm(block):
    """One block, sample by sample."""
    value, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = media.STEP_SIZES[index]
            delta = step // 8 + (step if nibble & 4 else 0) + (step // 2 if nibble & 2 else 0) + (step // 4 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - delta if nibble & 8 else value + delta))
            index = max(0, min(88, index + media.INDEX_STEPS[nibble & 7]))
            out.append(value)
    return out


def test_adpcm_against_a_scalar_decoder():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (40, 36)).astype(np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [scalar_adpcm(b.tobytes()) for b in blocks]


def test_adpcm_follows_a_signal():
    t = np.arange(64 * 40)
    for f in (5.0, 9.0, 20.0):
        pcm = (6000 * np.sin(t / f)).astype(np.int16)
        rows = media.adpcm_rows(pcm)
        blocks = media.encode_adpcm(rows)
        assert blocks.shape == (40, 36) and (rows[:, 1:].ravel() == pcm).all()
        out = media.decode_adpcm(blocks)[:, 1:].ravel()
        assert np.sqrt(np.mean((out.astype(float) - pcm) ** 2)) < 600


def test_resample():
    assert media.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]


def test_media_round_trip(docs, rows):
    got = media.store_media(docs, files=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
        codec, rate, payload = media.read_wav(bytes(r.media))
        assert (codec, rate) == (7, 8000) and hashlib.sha256(payload).hexdigest() == r.payload_sha256
        assert zlib.crc32(payload[-64:]) == r.tail_crc32 and len(r.media) == r.media_bytes
        codec, rate, pcm = media.read_wav(bytes(r.pcm))
        assert (codec, rate) == (1, 16000) and len(pcm) == 4 * r.payload_bytes and len(r.pcm) == r.pcm_bytes and hashlib.sha256(r.pcm).hexdigest() == r.pcm_sha256
        assert (np.frombuffer(pcm, "<i2")[::2] == media.mu_law_table()[np.frombuffer(payload, np.uint8)]).all()
        blocks = np.frombuffer(r.adpcm, np.uint8).reshape(-1, 36)
        assert 64 * len(blocks) == r.payload_bytes and f";adpcm={zlib.crc32(r.adpcm):08x};" in r.feature
        assert payload[r.n_bytes :].strip(b"\0") == b""
    assert all(len(x) == 1 for x in by.values())
    sizes = Counter((r.doc_id, r.n_bytes) for r in got)
    assert sizes == Counter((r[0], len((r[1] or "").encode())) for r in rows)


# 10. Packing


def test_packing(docs, rows):
    got = packing.pack_documents(docs, ids=True).collect()
    tokens = packing.Tokens()
    want = Counter((r[0], tuple(tokens.slow.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) and r.length == len(r.ids) > 0
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and len(pieces) <= packing.SEGMENTS
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    single = {i: n for (i, ids), n in want.items() if sum(m for (j, _), m in want.items() if j == i) == 1}
    for (i, ids), n in want.items():
        if i in single:
            pieces = sorted((p for p in got if p.doc_id == i), key=lambda p: p.start)
            assert sum((list(p.ids) for p in pieces), []) == list(ids) and {p.doc_tokens for p in pieces} == {len(ids)}
    assert sum(p.length for p in got) == sum(len(ids) * n for (_, ids), n in want.items())


def losses(rng, n):
    return np.concatenate(([0], np.cumsum(rng.random(n) < rng.random())))


def packed(items, limits, batch=50):
    out = []
    packer = packing.Packer(lambda item, start, length, sequence, offset: out.append((item, start, length, sequence, offset)), limits)
    for k in range(0, len(items), batch):
        packer.pack(items[k : k + batch])
    packer.finish()
    return out


def test_packing_limits():
    rng = np.random.default_rng(1)
    items = [(k, losses(rng, int(n))) for k, n in enumerate(rng.integers(1, 150, 300))]
    loss = dict(items)
    cover, used = {}, {}
    for item, start, length, sequence, offset in packed(items, (64, 4, 20)):
        cover.setdefault(item, []).append((start, length))
        tokens, segments, lossy = used.get(sequence, (0, 0, 0))
        assert offset == tokens
        used[sequence] = (tokens + length, segments + 1, lossy + int(loss[item][start + length] - loss[item][start]))
    for k, x in items:
        at = 0
        for start, length in sorted(cover[k]):
            assert start == at
            at += length
        assert at == len(x) - 1
    assert all(t <= 64 and s <= 4 and x <= 20 for t, s, x in used.values())


def test_packing_takes_the_largest_product():
    """The first placement of a sequence against all examples' products; and loss decides between equal lengths."""
    rng = np.random.default_rng(4)
    items = [(k, losses(rng, int(n))) for k, n in enumerate(rng.integers(1, 64, 60))]
    first = packed(items, (64, 8, 40), 60)[0]
    product = {k: (len(x) - 1) / 64 + 1 / 8 + x[-1] / 40 for k, x in items if x[-1] <= 40}
    assert product[first[0]] >= 0.9 * max(product.values())
    silent, all_loss = np.zeros(21, int), np.arange(21)
    assert packed([(0, silent), (1, all_loss)], (64, 8, 40))[0][0] == 1


def test_packing_time_is_linear():
    import time

    def seconds(n):
        t = time.perf_counter()
        packed([(k, packing.all_but_first(1 + k % 7)) for k in range(n)], (2048, 256, 2048), n)
        return time.perf_counter() - t

    seconds(1000)
    assert seconds(32_000) < 14 * max(seconds(8_000), 0.02)


def test_conversations(spark):
    rng = np.random.default_rng(6)
    turns = [(c, t, ("user", "assistant", None)[(t + c) % 3], prose(rng, int(rng.integers(0, 400)))) for c in range(40) for t in range(int(rng.integers(1, 9)))]
    turns += [(None, 0, "assistant", "no id"), (50, 0, "assistant", None), (50, 0, "assistant", None), (51, 1, "user", prose(rng, 30_000)), (51, None, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("part", F.lit("clash")).repartition(3)
    got = packing.pack_conversations(df).collect()
    tokens = packing.Tokens()
    want, loss = {}, Counter()
    for c, _, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        ids = tokens.ids(text).tolist()
        want.setdefault(c, []).extend(ids)
        loss[c] += len(ids) * (role == "assistant")
    for c, ids in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.loss_tokens) for r in got if r.conv_id == c)
        at = 0
        for start, length, crc, _ in pieces:
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids) and sum(p[3] for p in pieces) == loss[c]
    tot, lossy = Counter(), Counter()
    for r in got:
        tot[r.sequence_id] += r.length
        lossy[r.sequence_id] += r.loss_tokens
    assert all(n == 2048 or n & (n - 1) == 0 for n in tot.values()) and max(lossy.values()) <= 1024
    assert packing.pack_conversations(df.limit(0)).count() == 0


def test_ids_are_those_of_tokenizers():
    from hypothesis import given, settings, strategies as st

    tokens = packing.Tokens()
    pieces = st.sampled_from(["the ", "'s", "\n\n", "  ", "\t", "12345", "é", "ß", "日本", "🙂", "\u200d", "<|", "endoftext", "|>", "'LL", "\x00", "\r\n", "a" * 40, "क्षि", "_-_", "\u2028"])

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.lists(pieces, max_size=30).map("".join)))
    def same(text):
        assert tokens.ids(text).tolist() == tokens.slow.encode(text, add_special_tokens=False).ids + [1]

    same()


def test_special_token_text():
    tokens = packing.Tokens()
    text = "a <|endoftext|> b"
    assert tokens.ids(text).tolist() == tokens.slow.encode(text, add_special_tokens=False).ids + [1]


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert substring.near_passages(empty).count() == 0
    assert quality.score_quality(empty.select("doc_id", "text")).count() == 0
    assert lm.score_documents(empty).count() == 0
    assert media.store_media(empty).count() == 0 and packing.pack_documents(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(pages).count() == 0


def test_smallest_pieces_need_little_memory_and_texts_come_in_small_batches(spark):
    import tracemalloc

    from tilewright.llm import storage, suffix_dedup

    data = np.random.default_rng(4).integers(97, 101, 1_500_000).astype(np.uint8)
    tracemalloc.start()
    got = suffix_dedup.smallest_pieces(data, 50, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * got.nbytes
    edge = [0, *(k * suffix_dedup.PIECE_STARTS + d for k in (1, 2) for d in (-1, 0)), len(got) - 1]
    assert all(got[i] == suffix_dedup.smallest_pieces(data[i : i + 50], 50, 20)[0] for i in edge)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [len(batch)]})

    before = spark.conf.get(storage.BATCH_ROWS)
    with storage.text_batches(spark):
        rows = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "id long").collect()
    assert max(r.id for r in rows) <= storage.TEXT_ROWS
    assert spark.conf.get(storage.BATCH_ROWS) == before
