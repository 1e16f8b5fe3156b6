"""Literal cases of the text expressions."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(column.alias("v")).first().v


def both(spark, f, s, t):
    return value(spark, f(F.col("s"), F.col("t")), s=s, t=t)


def one(spark, f, t):
    return value(spark, f(F.col("t")), t=t)


def test_copies(spark):
    assert both(spark, T.is_copy, "this is a whole plain sentence", "this is a whole plain sentence")
    assert not both(spark, T.is_copy, "Anna Maria Peter Paul", "Anna Maria Peter Paul")
    assert both(spark, T.identical, "<0>Same  text</0>", "same text")


@pytest.mark.parametrize("s,t,lost", [("see 4.2", "see section", True), ("3.14", "3,14", False), ("7 and 7", "7", True), ("no digits", "5", False)])
def test_numbers(spark, s, t, lost):
    assert both(spark, T.drops_numbers, s, t) is lost


@pytest.mark.parametrize("lang,t,found", [
    ("en", "two thousand three hundred five and one", [2305, 1]), ("en-GB", "the third of nineteen", [3, 19]), ("de", "zweitausend fünfhundert, dreizehn und siebenundvierzig", [2513, 47]),
    ("fr", "deux mille cinq cent vingt", [2520]), ("es", "cien, veintidós y tercero", [122, 3]), ("tr", "on iki", [12]), ("xx", "one two", []), ("en", "nothing", []), ("en", "zero", [0]), ("en", "hundred", [100]),
])
def test_spelled_numbers(spark, lang, t, found):
    assert value(spark, T.spelled_numbers(F.col("t"), F.col("l")), t=t, l=lang) == found


@pytest.mark.parametrize("lang,s,t,lost", [
    ("de", "page 12", "Seite zwölf", False), ("de", "page 12", "Seite elf", True), ("en", "2,500 items", "2500 items", False), ("en", "2.500", "two thousand five hundred", False), ("en", "1/2 cup", "½ cup", False),
    ("en", "5.2.1 and 5", "5.2.1", True), ("fr", "the 1st", "le premier", False), ("en", "3,657", "3.657", False),
])
def test_numbers_in_words(spark, lang, s, t, lost):
    assert value(spark, T.drops_numbers(F.col("s"), F.col("t"), F.col("l")), s=s, t=t, l=lang) is lost


def test_wrong_language(spark):
    own, other = "the end of the story is not that it was", "die Frau und der Mann mit dem Hund"
    judge = lambda t, lang: value(spark, T.wrong_language(F.col("t"), F.col("l")), t=t, l=lang)
    assert judge(other, "en") and not judge(own, "en") and judge(own, "de") and not judge(other, "xx") and not judge("die Frau", "en")


def test_thousands(spark):
    assert one(spark, T.joined_thousands, "1,234,567 and 12.345") == "1234567 and 12345"
    assert one(spark, T.joined_thousands, "3.14 and 1,23, 5.2.1, 12.500.") == "3.14 and 1,23, 5.2.1, 12500."


def test_garbled(spark):
    assert both(spark, T.garbled_words, "plain words", "plаin words") == ["plаin"]
    assert both(spark, T.garbled_words, "plain", "x² words") == []


def test_protect_round_trip(spark):
    t = "mail a.b@example.org, see https://x.org/y?z=1 on 2024-01-02, 5% of {n}"
    df = spark.createDataFrame([(t,)], ["t"]).select("t", T.literals(F.col("t")).alias("f"), T.protect(F.col("t")).alias("p"))
    r = df.select(T.restore(F.col("p"), F.col("f")).alias("back"), T.lost_tokens(F.lit(""), F.col("f")).alias("lost"), F.transform("f", lambda x: x["kind"]).alias("k")).first()
    assert r.back == t and r.lost == len(r.k) == 5 and r.k == ["email", "url", "date", "percent", "placeholder"]


def test_leaders_labels_pieces(spark):
    assert one(spark, lambda t: T.even_leaders(t, F.lit(20)), "Intro.....7") == "Intro" + "." * 14 + "7"
    assert both(spark, T.with_leading_label, "1) first thing", "the thing") == "1) the thing"
    assert one(spark, T.pieces, "One two. Three four! Five six?") == ["One two.", "Three four!", "Five six?"]
    assert one(spark, T.pieces, "One. Two three.") == []


def test_share_key(spark):
    assert one(spark, T.share_key, "  Two   Words ") is None
    assert one(spark, T.share_key, " Three  Short WORDS ") == "three short words"


def test_predicates(spark):
    assert one(spark, T.is_bibliography_heading, "7. References:")
    assert one(spark, T.is_citation, "Smith, J. (2004). A title. Journal of Things, vol. 3, pp. 5")
    assert one(spark, T.is_code_like, "x = foo_bar(y);") and not one(spark, T.is_code_like, "An ordinary sentence.")
    assert one(spark, T.is_formula_like, "a + b = c") and one(spark, T.is_data_only, "12.5 %") and not one(spark, T.is_data_only, "a1")
    assert one(spark, T.font_class, "ABCDEF+Courier-Bold") == "monospace" and one(spark, T.lang_code, "pt_BR") == "pt"
