import pytest
from pyspark.sql import functions as F

from lontar.functions import text, tokens


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()[0]


def test_display_and_key(spark):
    assert one(spark, text.display("a"), a=" ﬁn  Ａ\t ") == "fin A"
    assert one(spark, text.key("a"), a="STRAẞE  Σς") == "strasse σσ"
    assert one(spark, text.key("a"), a=None) == ""


@pytest.mark.parametrize(
    "term,definition,expected",
    [
        ("Izin", "Izin adalah surat.", ("surat.", True)),
        ("Izin", "izin, merupakan surat.", ("surat.", True)),
        ("Izin", "Izinkan surat.", ("Izinkan surat.", False)),
        ("Izin", "Izin", ("Izin", False)),
        ("a+b", "a+b - x", ("x", True)),
        ("", "surat", ("surat", False)),
    ],
)
def test_strip_prefix(spark, term, definition, expected):
    assert tuple(one(spark, text.strip_prefix(F.col("a"), F.col("b")), a=term, b=definition)) == expected


@pytest.mark.parametrize(
    "label,expected",
    [
        ("Undang-Undang Nomor 12 Tahun 2003", ("Undang-Undang", "12", "2003")),
        ("Peraturan Nomor 5/PMK.07/2010", ("Peraturan", "5/PMK.07/2010", "2010")),
        ("Rancangan 1999 atau 2001", ("Rancangan 1999 atau 2001", "", "2001")),
        ("", ("", "", "")),
    ],
)
def test_regulation(spark, label, expected):
    assert tuple(one(spark, text.regulation(F.col("a")), a=label))[1:] == expected


def test_keys_and_names(spark):
    assert one(spark, text.kind_key(F.col("a")), a="uu") == "undangundang"
    assert one(spark, text.number_key(F.col("a")), a="No. 0012/x") == "12"
    assert one(spark, text.host(F.col("a")), a="https://u:p@Host.ID:8/x") == "host.id"
    assert one(spark, text.host(F.col("a")), a="no address") == ""
    assert one(spark, text.regulation_key(F.col("a")), a="answer:x|1|2000") is None
    assert tuple(one(spark, text.regulation_key(F.col("a")), a="uu|1|2000")) == ("uu", "1", 2000)
    assert tuple(one(spark, text.asked_regulation(F.col("a")), a="menurut UU No. 7 tahun 2014")) == ("undang-undang", "7", 2014)
    assert one(spark, text.asked_article(F.col("a")), a="Pasal 5A ayat (2) huruf b") == "pasal 5A ayat(2) huruf b"
    assert one(spark, text.is_iso_time(F.col("a")), a="2024-01-01T00:00:00Z") is True
    assert one(spark, text.is_iso_time(F.col("a")), a="x") is False
    assert one(spark, text.article_name(F.col("a")), a="pasal 5 ayat (2 )") == "pasal 5 ayat(2)"
    assert one(spark, text.is_sha256(F.col("a")), a="0" * 64 + "\n") is False
    assert one(spark, text.clean_answer(F.col("a")), a="<think>x</think>\nassistant\n jawab <|im_end|>") == "jawab"
    assert one(spark, text.mark_count(F.col("a")), a="user\n<|im_end|>x<|im_end|>") == 3
    assert [r.role for r in one(spark, text.messages(F.col("a"), F.col("b")), a="p", b=None)] == ["user", "assistant"]


def test_metrics(spark):
    m = tokens.answer_metrics("a b b c", "a a b", "b c d")
    assert (m["precision"], m["recall"], m["f1"]) == (0.5, 2 / 3, 4 / 7)
    assert tokens.repeated_ngrams(["x"] * 12) == 6 / 7 and tokens.repeated_ngrams(["x"] * 11) == 0.0
    m = tokens.answer_metrics("menurut pasal 3 ayat (2) tahun 2014 izin", "pasal 3  ayat (2) dan 2015", "izin pasal")
    assert (m["marker_recall"], m["grounded"]) == (0.5, 0.5)
    assert tokens.answer_metrics("", "a")["f1"] == 0.0 and tokens.answer_metrics("a", "", "")["grounded"] is None and tokens.answer_metrics("a", "b")["grounded"] is None
    df = spark.createDataFrame([(["x"] * 12, [])], "a array<string>, b array<string>")
    row = df.select(tokens.coverage(F.col("b"), F.col("a")), tokens.anchor_recall(F.lit("x"), F.col("b"))).first()
    assert tuple(row) == (0.0, None)
    assert one(spark, tokens.matching_ratio("a", "b"), a="abcd", b="bcde") == 0.75
    assert one(spark, tokens.cites(F.col("a")), a="lihat S1.") and not one(spark, tokens.cites_exactly(F.col("a")), a="lihat S1.")
