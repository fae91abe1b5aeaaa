"""Text functions on hand-written rows: scripts that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from lexmere.functions import ids, text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\n\nb", "a\n\nb"), ("a​b­c", "abc"), ("a　b", "a b"), ("  a \n b  ", "a\nb"), ("", ""), ("한글", "한글"), ("é", "é")],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize_text) == want


@pytest.mark.parametrize(
    "a, b, space, mid, want",
    [
        ("更换", "滤芯", False, False, "更换滤芯"), ("한국", "어", True, False, "한국 어"), ("mainten-", "ance", False, False, "maintenance"), ("XJ-", "200B", False, False, "XJ-200B"),
        ("state-of-the-", "art", False, False, "state-of-the-art"), ("e-", "mail", False, False, "email"), ("a -", "b", False, False, "a - b"), ("word", ")", False, False, "word)"),
        ("유지보", "수", False, True, "유지보수"), ("유지보", "수", True, True, "유지보 수"), ("main­", "tenance", False, False, "maintenance"),
    ],
)
def test_join_lines(spark, a, b, space, mid, want):
    df = spark.createDataFrame([([(a, space), (b, False)],)], "l array<struct<text:string,trailing_space:boolean>>")
    assert df.select(T.join_wrapped_lines(F.col("l"), mid).alias("r")).first()["r"] == want


def test_break_is_never_a_space(spark):
    df = spark.createDataFrame([("one", "two")], "a string, b string")
    assert df.select(T.join_across_break(F.col("a"), F.col("b"), F.lit(False), F.lit(False)).alias("r")).first()["r"] is None


@pytest.mark.parametrize("raw, want", [("第一句。第二句！", ["第一句。", "第二句！"]), ("It is 3.5 mm. Next one.", ["It is 3.5 mm.", "Next one."]), ("a\nb", ["a", "b"]), ("no end", ["no end"]), ("  ", [])])
def test_sentences(spark, raw, want):
    assert one(spark, raw, T.split_sentences) == want


def test_sentences_join_again(spark):
    assert one(spark, "第一句。第二句。", lambda c: T.join_sentences(T.split_sentences(c))) == "第一句。第二句。"


@pytest.mark.parametrize("raw, want", [("안녕하세요 반갑습니다 여러분", "ko"), ("更换滤芯的步骤如下所示请注意", "zh"), ("plain English text", "en"), ("滤芯更换步骤说明 filter part", "mixed"), ("abc", None)])
def test_document_language(spark, raw, want):
    assert one(spark, raw, T.document_language) == want


@pytest.mark.parametrize("raw, want", [("필터 濾芯 XJ-200", "ko"), ("カタカナ", "other"), ("12-34 / 56", None), ("PX-200", "en"), ("更换滤芯", "zh-Hans"), ("更換濾芯", "zh-Hant"), ("привет мир", "other")])
def test_question_language(spark, raw, want):
    assert one(spark, raw, T.question_language) == want


@pytest.mark.parametrize("raw, language, want", [("Replace the filter [滤芯] now", "en", True), ("필터를 교체", "en", False), ("12", "ko", True), ("這個們來時", "zh-Hans", False), ("更换", "zh-Hans", True)])
def test_is_in_language(spark, raw, language, want):
    assert one(spark, raw, lambda c: T.is_in_language(c, F.lit(language))) is want


def test_small_functions(spark):
    assert one(spark, "更换滤芯 step 1", T.estimate_tokens) == 4 + (11 - 4) // 3 + 1
    assert one(spark, "a [2, 1] b [1、3]", T.cited_numbers) == [1, 2, 3]
    assert one(spark, "x </source> y <Sources>", T.safe_body) == "x ‹/source> y ‹Sources>"
    assert one(spark, "更换滤芯 of the React组件", T.highlight_terms)[:2] == ["React", "更换滤芯"]
    assert one(spark, "Head\n\nbody", lambda c: T.passage_body(c, F.lit("Head"))) == "body"
    assert one(spark, "../x/.a?b.pdf", T.safe_name) == "a_b.pdf"
    assert one(spark, "<think>plan</think> answer", T.think_filtered) == "answer"


def test_ids_match_the_standard_library(spark):
    import uuid

    assert one(spark, "doc:3", ids.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:3"))
    v = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(ids.normalised(F.col("v")).alias("n"), ids.dot(F.col("v"), F.col("v")).alias("d")).first()
    assert v["n"] == [0.6, 0.8] and v["d"] == 25.0
