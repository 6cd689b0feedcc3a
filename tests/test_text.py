"""Text rules by hand, and Unicode composition against Python's own."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from segmentlab.functions import numbers, text
from segmentlab.operators import normalize
from segmentlab.plans.corpus_text import RULES, hit_report, normalize_corpus, observe_hits

VI = {
    "0": "không", "10": "mười", "11": "mười một", "15": "mười lăm", "21": "hai mươi mốt", "24": "hai mươi tư",
    "25": "hai mươi lăm", "105": "một trăm lẻ năm", "1000": "một nghìn", "1005": "một nghìn không trăm lẻ năm",
    "1000000": "một triệu", "007": "không không bảy", "3.14": "ba phẩy một bốn", "1.234": "một nghìn hai trăm ba mươi tư",
    "1.234.567": "một triệu hai trăm ba mươi tư nghìn năm trăm sáu mươi bảy", "2,5": "hai phẩy năm",
    "12,3.4": "mười hai phẩy ba bốn", "1000010": "một triệu không trăm mười", "1.000.000.000": "một tỷ",
    "1000000000000": "một nghìn tỷ", "1234567890123456789": "một hai ba bốn năm sáu bảy tám chín không một hai ba bốn năm sáu bảy tám chín",
}
EN = {
    "0": "zero", "13": "thirteen", "21": "twenty-one", "105": "one hundred five", "1,234": "one thousand two hundred thirty-four",
    "3.05": "three point zero five", "007": "seven", "2000000": "two million", "1.2.3": None, "9" * 37: None,
}


@pytest.mark.parametrize("lang,golden", [("vi", VI), ("en", EN)])
def test_numbers(spark, lang, golden):
    df = spark.createDataFrame([(k,) for k in golden], "token string")
    said = F.element_at(numbers.number_words(F.array("token"), lang), 1)
    assert {r.token: r.said for r in df.select("token", said.alias("said")).collect()} == golden


def _one(spark, lang, line):
    df = spark.createDataFrame([(line, lang)], "text string, lang string")
    return normalize_corpus(df, "text", "lang").first()["text"]


@pytest.mark.parametrize("lang,line,expected", [
    ("vi", "Gọi 0912 345 678 ngay", "Gọi không chín một hai ba bốn năm sáu bảy tám ngay"),
    ("vi", "giá 100đ và 5%", "giá một trăm đồng và năm phần trăm"),
    ("vi", "20 vnd, $3 và 7$", "hai mươi đồng, ba đô la và bảy đô la"),
    ("vi", "10-20 và 1+1=2", "mười đến hai mươi và một cộng một bằng hai"),
    ("vi", "AI của NASA, x12B", "a i của nờ a ét a, x mười hai B"),
    ("vi", "ngày  ngày 15", "ngày mười lăm"),
    ("vi", "xin 你好 , chào", "xin, chào"),
    ("vi", "你好", ""),
    ("vi", "số 123456789 thôi", "số một trăm hai mươi ba triệu bốn trăm năm mươi sáu nghìn bảy trăm tám mươi chín thôi"),
    ("en", "5% of $3 & 10-20", "five percent of three dollars and ten to twenty"),
    ("en", "see www.a.b/c?d or me@x.org now", "see or now"),
    ("fr", "12B & 5%  ok", "12 B & 5%  ok"),
    ("en", "", ""), ("vi", None, None),
])
def test_normalize(spark, lang, line, expected):
    assert _one(spark, lang, line) == expected


def test_nfc_equals_python(spark):
    rng = random.Random(7)
    pool = [chr(c) for lo, hi in ((0x20, 0x250), (0x300, 0x370), (0x900, 0x980), (0x1100, 0x1200), (0x1E00, 0x1F00),
                                  (0x2000, 0x2030), (0x2120, 0x2130), (0xAC00, 0xAC20), (0xF900, 0xFA00), (0x1D160, 0x1D165))
            for c in range(lo, hi)]
    lines = ["".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    for r in df.select("i", text.nfc(F.col("t")).alias("n")).collect():
        assert r.n == unicodedata.normalize("NFC", lines[r.i])


def test_word_and_space_classes_equal_python(spark):
    import re

    chars = [chr(c) for c in [*range(1, 0x3100), 0xFF21, 0x1D7CE] if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select(
        "c", F.col("c").rlike(f"^{text.SPACE}$").alias("space"), F.col("c").rlike(f"(?s)^{text.NOT_SPACE}$").alias("other"))
    for r in df.collect():
        if r.c != "\n":
            assert r.space == bool(re.fullmatch(r"\s", r.c)), hex(ord(r.c))
            assert r.other == bool(re.fullmatch(r"\S", r.c)), hex(ord(r.c))


def test_ref_text_cap(spark):
    rows = [(0.0, 20.0, "a b c d e f"), (0.0, 10.0, " a b "), (0.0, 100.0, "a b"), (0.0, 16.0, "a b c d")]
    df = spark.createDataFrame(rows, "start_time double, end_time double, text string")
    assert [r.ref_text for r in normalize.ref_text_cap(df).collect()] == ["a b c", "a b", "a", "a b"]


def test_hits_are_the_replacements_made(spark):
    rows = [("vi", "gọi 0912345678 hoặc xem www.a.b, 5% và 7, ABC 漢字 12345678 9"), ("en", "5 % of 1.2.3 and 12, see x@y.zz NASA"), ("fr", "www.q.r 5% 7"), ("vi", None), ("vi", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    observed, hits = observe_hits(normalize_corpus(df, "text", "lang"))
    got = {r.lang: r for r in hit_report(observed, "lang").collect()}
    # A phone number is no number any more, a number with two dots is left as it is.
    assert [got["vi"][f"hit_{r}"] for r in RULES] == [1, 2, 1, 1, 4, 1]
    assert [got["en"][f"hit_{r}"] for r in RULES] == [1, 0, 0, 1, 2, 0]
    assert [got["fr"][f"hit_{r}"] for r in RULES] == [1, 0, 0, 0, 0, 0]
    assert got["vi"].texts == 3
    assert hits.get["texts"] == 5 and hits.get["hit_numbers"] == 6


def test_touching_pairs_of_time_words(spark):
    """As the reference's ``\\b(...)\\s+\\1\\b``: word edges take up no character, so pairs may touch."""
    import re

    said = ["năm năm năm năm chín", "năm năm năm", "Năm năm năm năm", "ngày ngày tháng tháng năm", "x năm năm năm năm năm y"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select(
        "i", text.dedupe_time_words(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == [re.sub(r"\b(ngày|tháng|năm|giờ)\s+\1\b", r"\1", t, flags=re.IGNORECASE) for t in said]


def test_amounts_and_ands_as_plainly_said(spark):
    """The rules that look back before they try give what the plain ones give."""
    plain = rf"({text.DIGIT}[{text.DIGIT}.,]*)"
    rng = random.Random(8)
    said = ["".join(rng.choices("15.,đ₫$&  \tVNDvndx", k=rng.randrange(30))) for _ in range(3000)] + ["& & &", "a  &&  b", "1.5.,đ₫ 5$"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").repartition(4)
    pairs = [(text.VI_EARLY[0], rf"{plain}{text.SPACE}*[đ₫](?![\p{{L}}\p{{N}}_À-ỹ])"), (text.VI_EARLY[1], rf"(?i){plain}{text.SPACE}*VND{text.EDGE}"),
             (text.VI_LATE[2], rf"{plain}{text.SPACE}*\$"), (text.VI_LATE[4], rf"{plain}{text.SPACE}*VND{text.EDGE}"), (text.VI_LATE[5], rf"{text.SPACE}*+&{text.SPACE}*")]
    same = [F.regexp_replace("t", new, said) .eqNullSafe(F.regexp_replace("t", old, said)) for (new, said), old in pairs]
    assert df.filter(~F.array_min(F.array(*same))).collect() == []


def test_long_runs_take_time_by_their_length(spark):
    """A text of digits or blanks alone is no square of its length."""
    import time

    df = spark.range(4).select(F.repeat(F.lit("7"), 60_000).alias("digits"), F.repeat(F.lit(" "), 60_000).alias("blanks"))
    started = time.time()
    row = df.select(*(text.vi_symbols_late(text.vi_symbols_early(F.col(c))).alias(c) for c in df.columns)).collect()[0]
    assert (row.digits, row.blanks) == ("7" * 60_000, " " * 60_000)
    assert time.time() - started < 20


def test_composition_asks_once(spark, monkeypatch):
    """The class of hundreds of ranges is tried only where a narrow look says it may match."""
    asked = []
    rlike = text.Column.rlike

    class Asked(str):
        def rlike(self, pattern):
            asked.append(pattern)
            return rlike(F.col(self), pattern)

    monkeypatch.setattr(text.F, "coalesce", lambda *columns: None)
    monkeypatch.setattr(text.F, "when", lambda condition, value: F.lit("x"))
    text.nfc(Asked("t"))
    rough, exact = text._unstable_classes()
    assert len(asked) == 1 and asked[0].endswith(f"(?={rough}){exact}")
