"""The pipeline's stages on the small tables, each against its definition on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tilewright.llm import mixing, packing, quality, simhash, suffix_dedup
from tilewright.llm.storage import materialize

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input and output of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf_dir), name)
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix_dedup", "mixing", "packing"]


def test_all_but_the_last_have_the_columns_of_documents(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns


def test_quality_keeps_what_the_rules_accept(stages):
    before, after = stages["quality"]
    kept = {r.doc_id for r in quality.score_quality(before).where("kept").select("row.doc_id").collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(kept) and 0 < len(kept) < before.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages["simhash"]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))


def test_repeated_strings_are_gone(stages):
    before, after = stages["suffix_dedup"]
    left = {r.doc_id: r for r in after.collect()}
    first = {}
    rows = sorted((r.doc_id, r.text.encode()) for r in before.collect())
    for i, b in rows:
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    assert len(left) == len(rows)
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        want = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert left[i].text == want and left[i].n_chars == len(want)


def test_mix_takes_the_words_of_the_plan(stages):
    before, after = stages["mixing"]
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.taken_words(before).collect()}
    words, copies = Counter(), Counter()
    for r in after.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        copies[r.doc_id] += 1
    assert words == Counter({i: t for i, (t, _) in taken.items() if t})
    assert all(copies[i] == -(-t // n) for i, (t, n) in taken.items() if t)


def test_every_token_is_packed_once(stages):
    before, after = stages["packing"]
    tokens = packing.Tokens()
    total = sum(len(tokens.ids(r.text)) for r in before.collect())
    rows = after.collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(used.values()) == total and all(n == 2048 or n & (n - 1) == 0 for n in used.values())


def test_run_is_the_stages_after_one_another(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    _, last = stages["packing"]
    assert got.columns == last.columns
    assert Counter((r.doc_id, r.doc_tokens) for r in got.where("start = 0").collect()) == Counter((r.doc_id, r.doc_tokens) for r in last.where("start = 0").collect())


def test_suffix_stage_matches_the_operator(stages):
    before, after = stages["suffix_dedup"]
    counts = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(before).collect()}
    assert all(len(r.text.encode()) <= counts[r.doc_id] for r in after.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, uid string, rank double, size long, kept boolean"


@pytest.mark.parametrize("rows", ["some", "none"])
def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf_dir, rows):
    """Every stage on rows with nulls everywhere, repeated rows, empty texts and columns named like its own."""
    clean = "The house of the old man was by the river and it was in the town that he had seen on that day with his friend near the place."
    data = [(k, f"{clean} {k} " + " ".join(f"of the word{k}x{j}" for j in range(30)), "en", "ab"[k % 2], None) for k in range(8)]
    data += [data[0]] * 5 + [(50, None, None, None, None), (None, clean, None, None, 3), (None, None, None, None, None), (51, "", "", "", 0), (52, clean * 40, "en", None, 9)]
    docs = spark.createDataFrame([(*r, None, None, None, None, None) for r in data if rows == "some"], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf_dir), name)
        assert (after.count() > 0) == (rows == "some"), name
        if name == "packing":
            break
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        docs = after
