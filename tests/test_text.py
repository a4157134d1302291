"""Text rules: one case per branch."""

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import repeats, replies
from pagestrata.functions import text as t
from pagestrata.functions.styles import export_name, parse_color
from pagestrata.operators import recognition as rc

DS = t.FILTERED_PROVIDER


def judged(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, provider string")
    return [(r.clean_text, r.reason) for r in t.filter_ocr_text(df, F.col("text"), F.col("provider")).orderBy("i").collect()]


@pytest.mark.parametrize("text, reason", [
    ("  \r\n ", "empty_ocr_output"), ("a <TD>x", "structured_markup_non_text"), ('{"n": 1}', "structured_json_non_text"),
    ("[]", "structured_json_non_text"), ("42", "structured_json_non_text"), ("(1,2) (3,4) -- (5,6)", "coordinate_geometry_non_text"),
    ("1,2 3,4 5,6 7,8 9,1 2,3", "coordinate_geometry_non_text"), ("[]{}()<>" * 20, "structured_hallucination_non_text"),
    ("CategoryValue1234567890Blue", "table_like_non_text"), ("ab\nab\nab\nab\nab", "repeated_line_hallucination"),
    ("a" * 12, "repeated_character_hallucination"), ("go go go go go no", "repeated_token_hallucination"),
    ("xyzw" * 5, "repeated_pattern_hallucination"), ('{"text": "  "}', "empty_ocr_output"),
])
def test_rejections(spark, text, reason):
    assert judged(spark, (text, DS)) == [("", reason)]


def test_kept_texts(spark):
    assert judged(
        spark, ("a\r\nb", "other"), ("aaaaaaaaaaaa", "other"), ('{"ocr": "hi"}', DS), ('["a", " ", "b"]', DS), ('{"text": "{\\"text\\": \\"in\\"}"}', DS),
        ("good line\naaaaaaaaaaaaaaa", DS), ("aaaaaaaaaaa", DS), ("42 is it", DS), ("[1] and [2]", DS), ("1], [2", DS),
    ) == [("a\nb", ""), ("aaaaaaaaaaaa", ""), ("hi", ""), ("a\nb", ""), ("in", ""), ("good line", ""), ("aaaaaaaaaaa", ""), ("42 is it", ""), ("[1] and [2]", ""), ("1], [2", "")]


def test_json_nested_too_deep(spark):
    import json

    text = "end"
    for _ in range(4):
        text = json.dumps({"text": text})
    assert judged(spark, (text, DS)) == [("", "structured_json_non_text")]
    assert judged(spark, (json.loads(text)["text"], DS)) == [("end", "")]


@pytest.mark.parametrize("text, want", [
    ("1. one\n2. two\n3. three", "one two three"), ("- a\n- b", "a b"), ("say 1) this 2) that", "say this that"), ("① up", "up"), ("plain - 1", "plain 1"), ("x-y", "x-y"), ("", ""),
])
def test_list_markers(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(t.strip_list_markers(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ("```json\n{\"text\": \" hi \"}\n```", "hi"), ("OCR: hello   there", "hello there"), ('["a", 3, "b"]', "a\nb"), ("recognized text: x", "x"), ("a\n\n b ", "a\nb"), (None, ""),
])
def test_model_output(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert t.clean_model_output(df, F.col("x")).first().clean_text == want


@pytest.mark.parametrize("text, want", [("hello " + "ha" * 8, "hello"), ("no no no", None), ("x" * 12, ""), ("ab " * 6, ""), ("word", None), (None, None), ("so " + "😀 " * 12, "so"), ("a" * 50_000 + "b", None)])
def test_repeated_tail(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string").select(repeats.trim_repeated_suffix(F.col("x")).alias("t"))
    row = df.first().t
    assert (row.text if row.trimmed else None) == want


def longest_tail(dense):
    """Characters of the longest tail of a unit of up to twelve, by trying all of them."""
    best = 0
    for size in range(1, 13):
        for count in range(max(4, -(-12 // size)), len(dense) // size + 1):
            if dense.endswith(dense[len(dense) - size :] * count):
                best = max(best, size * count)
    return best


def test_repeated_tails_of_random_texts(spark):
    import random

    pick = random.Random(5)
    made = ["".join(pick.choice("ab c") for _ in range(pick.randint(0, 9))) + "".join(pick.choice("ab ") for _ in range(pick.randint(1, 5))) * pick.randint(0, 9) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(made)), "i int, x string").select("i", repeats.trim_repeated_suffix(F.col("x")).alias("t"))
    for row in df.collect():
        text = made[row.i].strip()
        at = [k for k, c in enumerate(text) if c != " "]
        tail = longest_tail("".join(text[k] for k in at))
        want = text if not tail else text[: at[len(at) - tail]].strip()
        assert (row.t.text, row.t.trimmed) == (want, tail > 0), made[row.i]


def test_attempts(spark):
    rows = [(1, 1, "ha" * 12), (1, 2, "clean words here"), (2, 1, "start of it " + "ha" * 8), (2, 2, ""), (3, 1, "a" * 13), (3, 2, "a" * 14), (4, 1, "")]
    df = spark.createDataFrame(rows, "crop int, attempt int, cleaned string")
    got = {r.crop: (r.text, r.status) for r in rc.best_attempt(df, ["crop"]).collect()}
    assert got == {1: ("clean words here", "OK"), 2: ("start of it", "LOOP_TRIMMED"), 3: ("a" * 14, "BEST_EFFORT"), 4: ("", "EMPTY")}


def test_markup_and_cjk(spark):
    df = spark.createDataFrame([("&lt;b&gt;tao&lt;/b&gt; <3 you<br/>now !", "半角ｶﾅ", "abc")], "a string, b string, c string")
    row = df.select(t.strip_markup(F.col("a")), t.contains_cjk(F.col("b")), t.contains_cjk(F.col("c")), t.fold_case(F.lit("Straße"))).first()
    assert tuple(row) == ("tao <3 you now!", True, False, "strasse")


def test_json_out_of_loose_reply(spark):
    rows = [("```json\n{\"a\": 1}\n```",), ("Sure: [1, 2] ok",), ("nothing",), ("{broken",), ("[1] [2]",)]
    out = replies.extract_json(spark.createDataFrame(rows, "x string"), F.col("x")).collect()
    assert [r.json_text for r in out] == ['{"a": 1}', "[1, 2]", None, None, None]


def test_colors_and_names(spark):
    df = spark.createDataFrame([("#0A0b0C",), ("1, 300,-2",), (" AUTO ",), ("red",)], "x string")
    color, error = parse_color(F.col("x"))
    assert [(r[0], r[1] is None) for r in df.select(color, error).collect()] == [([10, 11, 12], True), ([1, 255, 0], True), (None, True), (None, False)]
    f = {"index": F.lit(7), "page_number": F.lit(12), "stem": F.lit("a<b"), "source_stem": F.lit("s"), "project": F.lit("p"), "stage": F.lit("render")}
    names = [spark.range(1).select(export_name(p, f)).first()[0] for p in ("{page_number:03d}-{stem}", "{index}", "{oops}", "...", "")]
    assert names == ["012-a_b", "7", "0007_s", "0007_s", "0007_a_b"]


def test_references_of_html(spark):
    given = ["a&#8217;b", "caf&eacute;&hellip;", "&amp;lt;", "&#x41;&#66;", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    got = df.select("i", t.unescape_entities(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == ["a’b", "café…", "&lt;", "AB", None, ""]


def test_cjk_follows_character_names(spark):
    import unicodedata

    rows = spark.range(0x110000).where("id not between 55296 and 57343").select(
        "id", t.contains_cjk(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")).alias("hit")).where("hit").collect()
    want = {c for c in range(0x110000) if any(n in unicodedata.name(chr(c), "") for n in t.CJK_NAMES)}
    assert {r["id"] for r in rows} == want


def test_names_never_clash(spark):
    from pagestrata.operators.ranking import distinct_names

    given = ["a.png", "a.png", "a_1.png", "a_1.png", "a_3.png", "a.png", "a.png", "a_01.png", None, None, "b", "b"]
    df = spark.createDataFrame(list(enumerate(given)), "o int, n string")
    got = [r["unique_name"] for r in distinct_names(df, "n", "o").orderBy("o").collect()]
    assert got == ["a.png", "a_2.png", "a_1.png", "a_1_1.png", "a_3.png", "a_4.png", "a_5.png", "a_01.png", None, None, "b", "b_1"]
