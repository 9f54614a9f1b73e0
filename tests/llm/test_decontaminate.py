from __future__ import annotations

import random

import pytest

from kantar.llm import decontaminate as D


def least_edits(item, text):
    """Plain semi-global edit distance."""
    row = [0] * (len(text) + 1)
    for c in item:
        here = [row[0] + 1]
        for j, d in enumerate(text):
            here.append(min(row[j + 1] + 1, here[-1] + 1, row[j] + (c != d)))
        row = here
    return min(row)


def _edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("abcé ")
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, rng.choice("abcé "))
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_find_equals_full_alignment(seed):
    rng = random.Random(seed)
    made = lambda n: D.normal("".join(rng.choice("abcdé ") for _ in range(n)))
    items = [made(n) for n in (10, 12, 20, 33, 64, 90, 140)]
    index = D.build(items)
    for _ in range(25):
        i = rng.randrange(len(items))
        k = D.budget(len(items[i]))
        body = _edited(rng, items[i], rng.randint(0, k + 2))
        text = D.normal(made(rng.randint(0, 60)) + body + made(rng.randint(0, 60)))
        want = {j: e for j, t in enumerate(items) if len(t) >= D.GRAM and (e := least_edits(t, text)) <= D.budget(len(t))}
        assert {j: e for j, e, _ in D.find(text, index)} == want


ITEM = "The quick brown fox jumps over the lazy dog, and then over the fence once more."


def test_edge_rows_and_parts(spark):
    items = [(1, ITEM), (1, ITEM), (2, ITEM.upper()), (3, None), (4, "tiny"), (None, "Another item with a good many characters in it"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"x {ITEM.upper()} y", 0), (2, None, 1), (3, "", 2), (None, "so: another  item\nwith a good many characters in it!", 3), (3, ITEM[:40], 4), (9, "tiny " * 9, 5), (1, f"x {ITEM.upper()} y", 0)],
        "doc_id long, text string, item_id int",
    )
    for part in (D.PART_CHARS, 50, 20):
        got = [(r.doc_id, sorted((str(h.item_id), h.edits) for h in r.hits)) for r in D.contaminated(docs, bench, part_chars=part).collect()]
        both = [("1", 0), ("2", 0)]
        assert sorted(got, key=str) == sorted([(1, both), (2, []), (3, []), (None, [("None", 0)]), (3, []), (9, [("4", 0)]), (1, both)], key=str)
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert [r.hits for r in D.contaminated(docs.limit(1), bench.limit(0)).collect()] == [[]]


def test_very_long_text():
    index = D.build([D.normal(ITEM)])
    assert D.find(D.normal("the quick b" * 30_000 + ITEM), index)[0][1] == 0


def test_query_against_brute_force_on_whole_table(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet").collect()
    items = spark.read.parquet(f"{where}/benchmark.parquet").collect()
    got = {r.doc_id: r["items"] for r in D.op8_decontaminate(spark, where).collect()}
    for r in docs:
        text = D.normal(r.text)
        assert got[r.doc_id] == ",".join(str(i.item_id) for i in sorted(items) if D.normal(i.text) in text)


def test_banded_alignment_equals_full_alignment():
    rng = random.Random(5)
    codes = lambda t: D.np.frombuffer(t.encode("utf-32-le"), D.np.uint32)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        told = D.align(codes(item), codes(text), -len(item), len(item) + len(text) + 1, len(item))
        assert told is not None and told[0] == least_edits(item, text)
        assert least_edits(item, text[max(0, told[1] - 2 * len(item)) : told[1]]) == told[0]


def test_long_items_are_aligned_in_their_band_alone():
    rng = random.Random(8)
    item = D.normal("".join(rng.choice("abcdefgh ") for _ in range(20_000)))
    edited = _edited(rng, item, 900)
    (hit,) = D.find(D.normal("x" * 500 + edited + "y" * 500), D.build([item]))
    assert hit[0] == 0 and 500 < hit[1] <= 900


def test_short_items_are_whole_words():
    index = D.build([D.normal(t) for t in ("ab", "a b", "Zürich", ITEM)])
    told = lambda t: [i for i, _, _ in D.find(D.normal(t), index)]
    assert told("xab abx") == [] and told("so a  b") == [1] and told("AB") == [0] and told("in zürich") == [2] and told("") == []


def test_clashing_names_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_PARTS", 1)
    docs = spark.createDataFrame([(1, f"{ITEM} and tiny", "h", "p", None)], "doc_id long, text string, hits string, _hits__0 string, item_id string")
    bench = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate([ITEM, "tiny", "absent words", "more absent words"])], "item_id string, text string")
    out = D.contaminated(docs, bench, part_chars=10)
    assert out.columns == [*docs.columns, "hits_"] and sorted(h.item_id for h in out.first()["hits_"]) == ["k0", "k1"]
