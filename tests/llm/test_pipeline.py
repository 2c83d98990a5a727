"""The stages of the pipeline against brute force on the small table, and on odd rows."""

import collections

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from doccensus.llm import near_duplicates, rules
from doccensus.llm.shared import normal_words, written

from .test_duplicates import components_of, cut_by_hand, edit_distance
from .test_quality import base_counts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, made = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF_DIR), "stage")
        made.append((docs, out))
        docs = out
    return made


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "suffix array", "decontamination", "packing"]


def test_columns(stages):
    assert all(given.dtypes == out.dtypes for given, out in stages[:-1])


def test_quality_stage(stages):
    given, out = stages[0]
    kept = {r["doc_id"] for r in out.collect()}
    for r in given.collect():
        n = base_counts(r["text"])
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert r["doc_id"] not in kept
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet")
    good = set(labels[labels["quality"] == 1]["doc_id"]) & {r["doc_id"] for r in given.collect() if base_counts(r["text"])[0] >= rules.MIN_WORDS}
    assert len(good - kept) <= 0.01 * len(good)


def test_near_duplicate_stage(stages):
    given, out = stages[1]
    words = {r["doc_id"]: normal_words(r["text"]) for r in given.collect()}
    ids = sorted(words)
    links = []
    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = words[a], words[b]
            limit = int((1 - near_duplicates.SIMILARITY) * max(len(x), len(y)) + 1e-9)
            common = sum((collections.Counter(x) & collections.Counter(y)).values())
            if max(len(x), len(y)) - common <= limit and edit_distance(x, y) <= limit:
                links.append((a, b))
    heads = set(components_of(links, ids).values())
    assert {r["doc_id"] for r in out.collect()} == heads


def test_suffix_array_stage(stages):
    given, out = stages[2]
    rows = given.collect()
    expected = {r["doc_id"]: x[3].decode(errors="ignore") for r, x in zip(rows, cut_by_hand([r["text"] for r in rows], 200))}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_decontamination_stage(stages):
    given, out = stages[3]
    bench = [" ".join(normal_words(t)) for t in pd.read_parquet(f"{SF_DIR}/benchmark.parquet")["text"]]
    leaks = {r["doc_id"] for r in given.collect() if any(f" {b} " in f" {' '.join(normal_words(r['text']))} " for b in bench)}
    before, after = {r["doc_id"] for r in given.collect()}, {r["doc_id"] for r in out.collect()}
    assert leaks <= before - after and len(before - after - leaks) <= 2


def test_packing_stage(stages):
    given, out = stages[4]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in given.collect()}
    pieces = collections.defaultdict(int)
    for r in rows:
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
        pieces[r["doc_id"]] += r["length"]
    assert all(pieces[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_stages_on_odd_and_empty_tables(spark, clashing, empty):
    for docs in (clashing, empty):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.pack(spark, docs, SF_DIR).count() >= docs.count()


def test_repeated_rows_stay_once(spark, clashing):
    def text(k, n=120):
        return " ".join(f"t{k}word{i}" for i in range(n))

    # the head of a class in three rows, its near copy, equal texts without ids, two texts under one id, one known elsewhere
    rows = [(1, text(1))] * 3 + [(2, text(1) + " more")] + [(None, text(2))] * 3 + [(None, text(1))]
    rows += [(5, text(5)), (5, text(6)), (6, text(6)), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    expected = [(1, text(1)), (None, text(2)), (5, text(5)), (5, text(6)), (7, None), (8, "")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter(expected)
    left = corpus_pipeline.suffix_array_stage(spark, written(kept, "stage"), SF_DIR)
    assert collections.Counter((r["doc_id"], r["text"]) for r in left.collect()) == collections.Counter(expected)
    assert near_duplicates.keep_one(clashing).columns == clashing.columns


def test_clean_documents_stay_beside_junk_copies(spark):
    prose = "The house of the old man stood at the end of the road, and it was as it is on this day; nobody in town knew who had built it or for whom. "
    clean = [(i, prose + " ".join(f"Word{chr(97 + i)}{chr(97 + k % 26)}" for k in range(30)), "en", "a", 1) for i in range(20)]
    for junk in ("###\n" * 100, "0123456789 " * 60):
        docs = spark.createDataFrame(clean + [(100 + i, junk, "en", "a", 1) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
        assert {r["doc_id"] for r in rules.keep_good(docs).collect()} == set(range(20))
    # sound copies weigh as one text
    copies = " ".join(f"{i}{i + 7}#" for i in range(200))
    docs = spark.createDataFrame(clean + [(100 + i, copies, "en", "a", 1) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in rules.keep_good(docs).collect()} == set(range(20))


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF_DIR).count() == stages[-1][1].count()
