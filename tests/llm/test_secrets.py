from __future__ import annotations

import hashlib
import re

from kantar.llm import secrets as S

WHERE = "/root/testdata/sf0.01"


def brute(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, kind number, kind, end), by plain regular expressions over the whole text."""
    out = []
    for k, rule in enumerate(S.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, rule.kind, m.end()))
    return sorted(out)


def told(spans, base: bool = False) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, k, kind, end in spans if not base or k < 3)


TEXTS = [
    None,
    "",
    "nothing here",
    "Password: hunter22, 𝄞 token=abc123 token=abc",
    "api_key = 'AKIA" + "A" * 30 + "' and APIKEY:\"x.y/z+==\"",
    "secret" * 3 + "=0123456789abcdef0123456789abcdef",
    "deadbeef" * 3 + " " + "deadbeef" * 2 + " " + "f" * 25,
    "-----BEGIN RSA PRIVATE KEY-----\npasswd:\t12345678",
    "é" * 1000 + "ghp_" + "a1B2" * 10,
    "word token: " * 50_000 + "secret = abcdefgh",
]


def test_spans_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, blob int, spans string")
    findings, book = S.scan_ledger(docs)
    got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in findings.collect())
    assert got == sorted((str(i), brute(t)) for i, t in rows)
    # The two empty texts and the three copies are one blob each.
    assert book.select("blob").distinct().count() == len(TEXTS) - 1


def test_only_unseen_blobs_and_rules_are_scanned(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    _, book = S.scan_ledger(docs.where("doc_id < 5"), rules=S.BASE)
    later, more = S.scan_ledger(docs, ledger=book)
    counts = more.groupBy("blob", "rule").count()
    assert counts.where("count > 1").count() == 0
    assert counts.count() == (len(TEXTS) - 1) * len(S.RULES)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in later.collect()} == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_a_new_version_of_a_rule_replaces_the_old_one(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    _, book = S.scan_ledger(docs, rules=(S.Rule("letter", "a"),))
    findings, _ = S.scan_ledger(docs, rules=(S.Rule("letter", "[bc]", version=2),), ledger=book)
    assert [tuple(s) for s in findings.first().spans] == [(1, 0, "letter", 2), (2, 0, "letter", 3)]


def test_empty_table(spark):
    findings, book = S.scan_ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert findings.count() == 0 and book.count() == 0


def test_query_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{WHERE}/documents.parquet").collect()}
    rows = S.op1_secret_scan(spark, WHERE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(told(want, base=True).encode()).hexdigest()
        assert r.spans == told(want)


def test_spans_of_many_shelves(spark):
    """More matches than are gathered at a time, at the edges of shelves too."""
    for n in (0, 1, S.SHELF - 1, S.SHELF, S.SHELF + 1, 3 * S.SHELF + 5):
        text = "é ".join([f"token={'x' * (i % 9)}{i}" for i in range(n)]) + " end"
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        spans = S.scan_ledger(df)[0].first().spans
        want = [(m.start(), m.end()) for m in re.finditer(r"token=([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
        assert [(x.start, x.stop) for x in spans if x.kind == "assign"] == want
