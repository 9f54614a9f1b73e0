"""Golden values of the scalar functions."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kantar.functions import similarity as M
from kantar.functions import text as T


def values(spark, rows, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_normalize(spark):
    got = values(
        spark,
        ["Čokoladno mleko 1 L", "Чоколадно млеко 1 л", "  MLEKO---ČOKOLADNO!!! 2×500g  ", "Đački džem, njoke i ljutenica", "Ђачки џем, њоке и љутеница", None, " ", "---", "йи и̮"],
        T.normalize_name,
    )
    assert got == ["cokoladno mleko 1 l"] * 2 + ["mleko cokoladno 2 x 500 g"] + ["djacki dzem njoke i ljutenica"] * 2 + ["", "", "", "i i"]


def test_quantities(spark):
    rows = {
        "Mleko 1 l": (1000, "ml"), "Млеко 1 л": (1000, "ml"), "Mleko 1000 ml": (1000, "ml"), "Mleko 1.000 ml": (1000, "ml"), "Jogurt 0,5 kg": (500, "g"),
        "Jogurt 0.5 kg": (500, "g"), "Keks 500 g": (500, "g"), "Voda 2 x 1,5 l": (3000, "ml"), "Jaja 10 kom": (10, "piece"), "Beli hleb": None, "Sok 0 l": None,
        "Sok -1 l": None, "sok -1,5 l": (5000, "ml"), "sok-1 l": None, "So 1.000 kg": (1000, "g"), None: None,
    }
    got = values(spark, list(rows), T.parse_quantity)
    assert [q and (q.value, q.unit) for q in got] == [w and (Decimal(w[0]), w[1]) for w in rows.values()]


def test_ean(spark):
    rows = ["96385074", "8601234567899", " 96385074 ", "96385075", "8601234567898", "1234567", "123456789012", "860123456789A", "00000000", "", None]
    assert values(spark, rows, T.is_ean) == [True] * 3 + [False] * 8


def test_barcode_and_key(spark):
    assert values(spark, [" 12345678\t", "1234567", "0" * 9, None, "123456789012345"], T.normalize_barcode) == ["12345678", None, None, None, None]


def test_decimals(spark):
    rows = {"1.299,90": "1299.90", "1,299.90": "1299.90", "1.299": "1.30", "1,5": "1.50", "1.234.567": "1234.57", "-": None, "null": None, "N/A": None, "": None, " 12 345,6 ": "12345.60", "abc": None, "1.005": "1.01", "-3": "-3.00"}
    assert values(spark, list(rows), T.parse_decimal) == [w and Decimal(w) for w in rows.values()]
    assert values(spark, ["abc", "1", "", "-"], T.decimal_is_wrong) == [True, False, False, False]


def test_dates(spark):
    rows = {"01-03-2026": "2026-03-01", "31-02-2026": "2026-02-28", "31-04-2026": "2026-04-30", "32-01-2026": None, "00-01-2026": None, "01-13-2026": None, "1-3-2026": None, "": None, None: None}
    assert [d and str(d) for d in values(spark, list(rows), T.parse_date)] == list(rows.values())


def test_small_parsers(spark):
    assert values(spark, ["da", "NE", "", None, "1", "maybe"], T.parse_active) == [True, False, True, True, True, None]
    assert values(spark, ["44,27", "91", "x", None], lambda c: T.parse_coordinate(c, 90)) == [44.27, None, None, None]
    assert values(spark, ["my format", "-x", "A_1", ""], T.format_code) == ["MY_FORMAT", None, "A_1", None]
    assert values(spark, ["", "t", "x" * 101], T.token_hash)[1] == "e3b98a4da31a127d4bde6e43033f66ba274cab0eb7eb1c70ec41402bf6273dd8"


@pytest.mark.parametrize(
    ("line", "name", "quantity"),
    [("2 x Mleko 1 l", "Mleko 1 l", "2"), ("3kom Hleb", "Hleb", "3"), ("Jogurt x4", "Jogurt", "4"), ("Jabuke - 1,5 kg", "Jabuke - 1,5 kg", "1"), ("Mleko 1 l", "Mleko 1 l", "1"), ("7 Days kroasan", "7 Days kroasan", "1"), ("Pelene 4 maxi", "Pelene 4 maxi", "1"), ("Jaja – 10 kom", "Jaja", "10")],
)
def test_pasted_line(spark, line, name, quantity):
    [lines] = values(spark, [line], T.paste_lines)
    assert [(x.name, x.quantity) for x in lines] == [(name, Decimal(quantity))]


def test_pasted_text(spark):
    [lines] = values(spark, ["  Mleko 1 l  \r\n\r\n  \r\nHleb\n"], T.paste_lines)
    assert [x.name for x in lines] == ["Mleko 1 l", None, None, "Hleb", None] and lines[0].line == "  Mleko 1 l  "


def test_similarity(spark):
    df = spark.createDataFrame([("word", "two words"), ("", ""), ("abc", "abc")], "a string, b string")
    got = [r[0] for r in df.select(M.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.363636, abs=1e-6), 0.0, 1.0]


def _score(spark, query, sim, brand, value, unit):
    df = spark.createDataFrame([(query, Decimal(sim), brand, value and Decimal(value), unit)], "q string, s decimal(5,4), b string, v decimal(14,4), u string")
    wanted = T.parse_quantity(F.col("q"))
    name, b, p = M.name_part(F.col("s")), M.brand_part(F.col("q"), F.col("b")), M.pack_part(wanted["value"], wanted["unit"], F.col("v"), F.col("u"))
    texts = M.explanations(F.col("s"), F.col("b"), b, wanted["value"], wanted["unit"], F.col("v"), F.col("u"), p)
    return df.select(M.score(name, b, p).alias("score"), M.decision(M.score(name, b, p)).alias("status"), texts.alias("why")).first()


def test_scores(spark):
    full = _score(spark, "imlek mleko 1 l", "1.0000", "Imlek", "1000", "ml")
    assert (full.score, full.status) == (Decimal("1.0000"), "AUTO_ACCEPTED")
    assert full.why == ["Naziv: sličnost 100.00%.", 'Brend: "Imlek" je pronađen u upitu.', "Pakovanje: tačno podudaranje (1000 ml)."]
    other = _score(spark, "imlek mleko 1 l", "0.9000", "Meggle", "1500", "ml")
    assert other.score == Decimal("0.3706") and other.why[2] == "Pakovanje: traženo 1000 ml, kandidat ima 1500 ml."
    assert _score(spark, "mleko", "0.8000", None, None, None).score == Decimal("0.3294")


def test_thresholds(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("0.9200", "0.9199", "0.7500", "0.7499")] + [(None,)], "s decimal(5,4)")
    assert [r[0] for r in df.select(M.decision(F.col("s"))).collect()] == ["AUTO_ACCEPTED", "NEEDS_CONFIRMATION", "NEEDS_CONFIRMATION", "UNMATCHED", "UNMATCHED"]
