"""The normaliser and the raw tokeniser, rule by rule."""

import pytest

from spanloom.functions import spoken_numbers as spoken
from spanloom.functions import text as t

SPOKEN = {
    # tens and units join; a bare one stays a word
    "forty six": "46", "sixty": "60", "one": "one", "ones": "ones", "seven": "7",
    # units after units are dictated, a unit after dictated tens fills their last place
    "four four two": "442", "eighteen sixty five": "1865", "twenty twenty four": "2024",
    # hundreds take what fits below them, thousands keep what they have
    "six hundred": "600", "three hundred and eleven": "311", "nine thousand eight hundred and five": "9805",
    "two million six thousand": "2006000", "and": "and", "salt and six": "salt and 6",
    # zeros, doubles, decimals
    "oh four": "04", "double five nine": "559", "triple zero": "000", "six point two five": "6.25", "point eight": ".8",
    "double trouble": "double trouble", "the point is": "the point is", "four and a half": "4.5", "day and a half": "day and a half",
    # endings
    "thirty second": "32nd", "fifth": "5th", "eighties": "80s", "4 th": "4th", "11th": "11th", "b12c": "b 12 c",
    # signs, money, percent
    "negative nine": "-9", "plus sign": "plus sign", "six euros": "€6", "eighty cents": "¢80", "dollar": "dollar",
    "nine pounds and five cents": "£9.05", "zero point four dollars": "¢4",
    "sixty percent": "60%", "six per cent": "6%", "per person": "per person", "$7 thousand": "$7000",
}

NORMALISED = {
    "We'll meet, they've said, at Dr Lee's!": "we will meet they have said at doctor lee is",
    "I can't; you won't; he'd gone.": "i can not you will not he had gone",
    "Hmm. (coughs) We paid [static] 1,250 pounds": "we paid £1250",
    "Über naïve cafés": "uber naive cafes",
    "sixty-four  per cent\tof 3.5": "64% of 3.5",
    "Cost: $5. Rate: 8%": "cost $5 rate 8%",
    "let's wanna ma'am": "let us want to madam",
    "the theatre": "the theatre",
    " ?! ": "",
}

RAW = {
    "Good-bye, Ann!": ["goodbye", "ann"],
    "It’s ‘fine’": ["it's", "'fine'"],
    "snake_case_word": ["snake", "case", "word"],
    "#5 @home £9\n(x)": ["5", "home", "£9", "x"],
    " \t ": [],
}


@pytest.mark.parametrize("said", SPOKEN)
def test_spoken_numbers(said):
    assert spoken.spoken_to_digits(said) == SPOKEN[said]


def test_long_numbers_are_whole():
    assert spoken.spoken_to_digits("two point five million") == "2500000"
    assert spoken.spoken_to_digits("six decillion") == "6" + "0" * 33
    assert spoken.spoken_to_digits("") == ""


def frame(spark, cases, kind):
    return spark.createDataFrame(list(cases.items()), f"text string, want {kind}")


def test_normalize(spark):
    got = t.normalized(frame(spark, NORMALISED, "string"), "text", "got")
    assert [tuple(r) for r in got.where("not (got <=> want)").collect()] == []


def test_tokenize_raw(spark):
    got = frame(spark, RAW, "array<string>").withColumn("got", t.tokenize_raw("text"))
    assert [tuple(r) for r in got.where("not (got <=> want)").collect()] == []


def test_tokens_are_normalised_words(spark):
    df = spark.createDataFrame([("Uh, she'll bring forty cents",), (None,)], "text string")
    assert t.with_norm_tokens(df, "text", "got").first().got == ["she", "will", "bring", "¢40"]


def test_language_neutral_normaliser(spark):
    df = spark.createDataFrame([("<b> Ñandú; (aside) 50%",)], "text string")
    row = df.select(t.basic_normalize("text").alias("a"), t.basic_normalize("text", True).alias("b")).first()
    assert (row.a.split(), row.b.split()) == (["ñandú", "50"], ["nandu", "50"])


def test_symbols_and_diacritics(spark):
    df = spark.createDataFrame([("cœur + 5% ~ straße",), ("a*b",)], "text string")
    assert [r[0].split() for r in df.select(t.remove_symbols_and_diacritics("text")).collect()] == [["coeur", "5%", "strasse"], ["a", "b"]]


def test_spellings_are_the_callers(spark):
    df = spark.createDataFrame([(1, "the harbour of x")], "id int, text string")
    assert t.normalized(df, "text", "got").first().got == "the harbour of x"
    assert t.normalized(df, "text", "got", {"harbour": "harbor"}).first().got == "the harbor of x"
    table = spark.createDataFrame([("harbour", "harbor")], "word string, respelled string")
    assert t.respell(df, "text", table, ["id"]).first().text == "the harbor of x"
    assert t.normaliser_version() != t.normaliser_version({"harbour": "harbor"})


def test_single_plain_words_take_no_rewrites(spark):
    """They read as before; a word that some step knows, or another sign, goes through all steps."""
    marks = ("", ".", ",", "!", "?", ";", ":")
    known = [w.upper() + m for w in t._NOT_PLAIN for m in marks]
    plain = ["Word" + m for m in marks] + ["a", "ZZ.", "umm,", "tens"]
    odd = ["word\n", "it's", "a.b", "Café.", "word..", "x1", "", " ", ".", "K"]
    df = spark.createDataFrame([(x,) for x in [*known, *plain, *odd]] + [(None,)], "text string")
    quick = t.normalized(df, "text", "norm")
    # With a spelling table every text goes through all steps; this one changes nothing.
    slow = t.normalized(df, "text", "norm", {"nosuchword": "nosuchword"})
    assert sorted(map(str, quick.collect())) == sorted(map(str, slow.collect()))
