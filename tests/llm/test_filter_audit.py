from __future__ import annotations

import itertools
import random
import re
from collections import Counter

from kantar.llm import filter_audit as A


def fails(rows):
    """The letters each row fails, plainly."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        told = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, _ in rows),
        }
        out.append("".join(k for k, v in told.items() if v))
    return out


def brute(rows, labels):
    failed, told = fails(rows), {}
    parts = {s or "" for *_, s in rows}
    flag = lambda doc_id, k: any(d is not None and d == doc_id and x[k] == 1 for d, *x in labels)
    for part in parts:
        shapley, own = Counter(), [(i, f) for (i, _, s), f in zip(rows, failed) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [(i, f) for i, f in own if letter in f and not before & set(f)]
                shapley[letter] += len(here)
                told[part, order, step] = (
                    sum(not set(f) & (before | {letter}) for _, f in own), len(here), sum(letter in f and bool(before & set(f)) for _, f in own),
                    sum(f == letter for _, f in own), sum(flag(i, 0) for i, _ in here), sum(flag(i, 1) for i, _ in here),
                )
        for (p, order, step), x in list(told.items()):
            if p == part and len(x) == 6:
                told[p, order, step] = (*x, shapley[order[step - 1]])
    return told


def _rows():
    rng = random.Random(4)
    texts = ["", None, "short", "UPPER CASE TEXT", "a|b", " ".join(f"w{i}" for i in range(60)), "same word " * 40, "x\x0by\x1fz  ", "é ñ ü " * 30, " ".join(f"W{i}" for i in range(70)) + " $5", "w\xa0w " * 55]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(None, "short", "a"), (None, None, "c"), (3, rows[3][1], "a"), (2, "only here", "b"), (2, "only here", "b")]
    rows += [(100 + i, "very common " * 30, "hot") for i in range(200)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 220, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (6, None, None)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = _rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, part int").repartition(5)
    marks = spark.createDataFrame([(*x, "k") for x in labels], "doc_id long, quality int, toxic int, first string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in A.audit(A.masks(docs, marks)).collect()}
    assert got == brute(rows, labels)
    assert len(got) == 600 * 5
    assert A.audit(A.masks(docs.limit(0), marks)).count() == 0
    none = A.audit(A.masks(docs, marks.limit(0))).selectExpr("sum(good_lost + toxic_lost)").first()
    assert none[0] == 0


def test_removed_documents_add_up(spark):
    """Along an order, kept and removed make up the part; Shapley sums make up 120 times what all filters remove."""
    rows = A.op12_filter_audit(spark, "/root/testdata/sf0.001").collect()
    total = Counter(r.source or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    by = {}
    for r in rows:
        by.setdefault((r.part, r.filter_order), []).append(r)
    for (part, order), steps in by.items():
        steps.sort(key=lambda r: r.step)
        assert len(steps) == 5 and steps[-1].kept + sum(r.removed for r in steps) == total[part]
        assert sum(r.shapley for r in steps) == 120 * sum(r.removed for r in steps)
