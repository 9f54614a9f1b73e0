from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from kantar.llm import fill_in_middle as M

PATTERNS = {
    "letters": r"[A-Za-z]+|[^A-Za-z]",
    "characters": r"[\s\S]",
    "words": r"\S+\s*|\s+",
    "lines": r"[^\n]*\n|[^\n]+",
}
TEXTS = ["", "a", "abc", "a b", "\n", "a\r\nb\n\n", "😀b  cD\n", "ž é", "  two  spaces ", "<P>", "x<S", "<M> y", "> <", "wo rd " * 3000, "A1b2", "<<P", "S>x"]


def plain(doc_id, text, rate, spm):
    """(n, form, prefix, middle, output)."""
    text = text or ""
    units = re.findall(PATTERNS["letters"], text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units(spark):
    texts = [t for t in TEXTS if t]
    df = spark.createDataFrame([(t,) for t in [*texts, ""]], "t string").repartition(1)
    for name, pattern in PATTERNS.items():
        got = {r.t: r.u for r in df.select("t", M.units(F.col("t"), M.GRAMMARS[name]).alias("u")).collect()}
        # The customary pattern of words has none for white space at the beginning, which Python's \s would match more widely.
        assert got == {t: re.findall(pattern, t, re.A if name == "words" else 0) for t in [*texts, ""]}, name


def test_against_plain_python(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], i, "k") for i in range(150)] + [(None, "null id here", 200, "k"), (7, None, 201, "k"), (3, "twice", 202, "k"), (3, "twice", 203, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_units int, whole string")
    for rate, spm in ((90, 20), (100, 100), (100, 0), (0, 0)):
        out = M.fill_in_middle(df, rate=rate, spm_rate=spm)
        assert out.columns == ["doc_id", "text", "n_units", "whole", "n_units_", "form", "prefix_chars", "middle_chars", "output"]
        told = out.withColumn("again", M.restore(F.col("output"), F.col("form"))).collect()
        assert {r.n_units for r in told} == {r[2] for r in rows} and len(told) == len(rows)
        for r in told:
            assert (r.n_units_, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, rate, spm)
            assert r.again == (r.text or "")
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_nothing_is_shuffled_and_no_python_runs(spark):
    plan = M.op13_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
