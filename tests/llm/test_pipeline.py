from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as P
from kantar.llm import decontaminate as D
from tests.llm.test_line_dedup import brute as brute_lines

WHERE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, written and read again."""
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    out = []
    for name, f in P.STAGES:
        kept = P.cut(f(spark, docs, WHERE), "test-" + name.replace(" ", "-"))
        out.append((docs.collect(), kept.collect(), docs.columns, kept.columns))
        docs = kept
    return out


def test_columns_stay(stages):
    assert all(after == before for _, _, before, after in stages[:-1])


def test_quality_follows_the_labels(spark, stages):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{WHERE}/labels.parquet").collect()}
    before, after, *_ = stages[0]
    kept = {r.doc_id for r in after}
    told = [(r.doc_id in kept) == bool(truth[r.doc_id]) for r in before if r.doc_id in truth]
    assert sum(told) / len(told) > 0.98


def test_lines_equal_brute_force(stages):
    before, after, *_ = stages[1]
    want = {}
    for r, text in zip(before, brute_lines([(r.doc_id, r.text) for r in before])):
        if text == r.text or text.strip():
            want[r.doc_id] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == want


def test_near_duplicates_against_all_pairs(stages):
    before, after, *_ = stages[2]
    grams = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in before if (w := r.text.lower().split())}
    holders = {}
    for d, g in grams.items():
        for x in g:
            holders.setdefault(x, []).append(d)
    shared = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    near = {}
    for (a, b), n in shared.items():
        j = n / (len(grams[a]) + len(grams[b]) - n)
        near.setdefault(b, []).append(j)
        near.setdefault(a, []).append(j)
    kept = {r.doc_id for r in after}
    assert all(max(near.get(d, [0])) > 0.6 for d in grams if d not in kept)
    similar = [(a, b) for (a, b), n in shared.items() if n / (len(grams[a]) + len(grams[b]) - n) >= 0.8]
    assert similar and not [(a, b) for a, b in similar if a in kept and b in kept]


def test_leaks_equal_brute_force(spark, stages):
    items = [D.normal(r.text) for r in spark.read.parquet(f"{WHERE}/benchmark.parquet").collect()]
    before, after, *_ = stages[3]
    holds = {r.doc_id for r in before if any(i in D.normal(r.text) for i in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == holds


def test_mix_reads_every_document(spark, stages):
    before, after, *_ = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    most = Counter(r.doc_id for r in after)
    assert max(most.values()) <= 4
    assert P.run(spark, WHERE).count() == len(after)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality_score int, tokens string, hits int, n_removed int, _gone int, tid int"
    rows = [(None,) * 11, (1, "", None, "s", None, 1, "t", 2, 3, 4, 5), (2, "one\ntwo\nthree", "en", None, 13, None, None, None, None, None, None)]
    rows += [rows[2], (3, "word " * 50_000, "en", "s", 250_000, 0, "", 0, 0, 0, 0)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, f in P.STAGES:
            out = P.cut(f(spark, docs, WHERE), "test-odd")
            assert out.columns[: len(docs.columns)] == docs.columns and (some or out.count() == 0)
            out.collect()


def test_no_pair_of_a_large_table_is_lost(spark):
    """All pairs of distinct texts at 0.8 or more, by all their shingles, on the whole of sf0.1: one of each pair goes."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = sorted({r.text for r in docs.select("text").collect()})
    number: dict[tuple, int] = {}
    sizes, owners, held = [], [], []
    for k, t in enumerate(texts):
        w = t.lower().split()
        grams = {number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(max(1, len(w) - 4))}
        sizes.append(len(grams))
        owners += [k] * len(grams)
        held += grams
    order = np.argsort(np.array(held), kind="stable")
    owner, gram = np.array(owners)[order], np.array(held)[order]
    pairs = []
    for run in np.split(owner, np.flatnonzero(np.diff(gram)) + 1):
        if len(run) > 1:
            a, b = np.triu_indices(len(run), 1)
            pairs.append(run[a] * len(texts) + run[b])
    codes, shared = np.unique(np.concatenate(pairs), return_counts=True)
    a, b, size = codes // len(texts), codes % len(texts), np.array(sizes)
    alike = shared / (size[a] + size[b] - shared) >= 0.8
    kept = {r.text for r in P.near_duplicates(spark, docs, "").select("text").collect()}
    lost = [(x, y) for x, y in zip(a[alike], b[alike]) if texts[x] in kept and texts[y] in kept]
    assert alike.sum() > 40 and not lost
