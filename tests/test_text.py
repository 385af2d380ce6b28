import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as X

GOLDEN = [
    ("!!!", ""),
    ("Café, NEWS", "caf news"),
    ("• First “Item” – it’s", "first item its"),
    ("a € b", "a  b"),
    ("a$b+c", "a$b+c"),
    ("* * item", " item"),
    ("one\n\ntwo three-four", "one two three four"),
    ("\t tabbed \r\n", "tabbed"),
    ("rock &apos;n&APOS; roll", "rock n roll"),
    ("<b>x</b>", "<b>x<b>"),
    ("·  dot", "dot"),
    ("", ""),
]


def apply(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()
    return [row["o"] for row in out]


def clean_step_by_step(text):
    """The cleaning steps one after the other, in plain Python."""
    text = re.sub("[-–]", " ", text.lower()).strip()
    text = re.sub(" {2,}", " ", re.sub("[\n ]", " ", text)).strip()
    if text and text[0] in X.BULLETS:
        text = text[1:].strip()
    text = text.replace("&apos;", "'").encode("ascii", "ignore").decode()
    return "".join(c for c in text if not unicodedata.category(c).startswith("P"))


def test_clean_full_golden(spark):
    assert apply(spark, [g[0] for g in GOLDEN], X.clean_full) == [g[1] for g in GOLDEN]


def test_clean_full_equals_the_steps(spark):
    pick = random.Random(7)
    alphabet = "aB9 -–\n\t  •*·“”‘'\"!?.,;$+<>=é€\x1c&apos;_"
    texts = ["".join(pick.choices(alphabet, k=pick.randint(0, 30))) for _ in range(3000)]
    cleaned = apply(spark, texts, X.clean_full)
    for text, got in zip(texts, cleaned):
        assert got == clean_step_by_step(text), repr(text)
        assert got.isascii()
        assert not any(unicodedata.category(c).startswith("P") for c in got)


def test_null_stays_null_and_falls_back(spark):
    assert apply(spark, [None], X.clean_full) == [None]
    texts = [None, "", "!!!", "Ok."]
    assert apply(spark, texts, X.clean_text_or_na) == ["N/A", "N/A", "", "ok"]


def test_url_cleaning(spark):
    urls = ["<a>http://x/ 1</a>", "<b></b>", None, "", "  http://y/\n z ", "http://q?a=1"]
    expected = ["http://x/ 1", "N/A", "N/A", "N/A", "http://y/ z", "http://q?a=1"]
    assert apply(spark, urls, X.clean_url_or_na) == expected


def test_whitespace_of_every_kind(spark):
    spaces = [" ", "\t", "\n", "\x0b", "\x1c", "\x85", " ", " ", " ", " ", "　"]
    texts = [f"{s}a{s}{s}b{s}" for s in spaces]
    assert apply(spark, texts, X.collapse_space) == ["a b"] * len(spaces)
    assert apply(spark, texts, lambda c: F.size(X.words(c))) == [2] * len(spaces)
    assert apply(spark, [f"{s}a{s}" for s in spaces], X.strip_space) == ["a"] * len(spaces)


def test_small_steps(spark):
    assert apply(spark, ["a<br/>b<p x='1'>c"], X.strip_tags) == ["abc"]
    texts = ["“q” it’s &apos;", "naïve–x", "a.b,c«d»$", "&apos;• x", "a.&apos;b", "•&apos; x"]
    assert apply(spark, texts, X.clean_full) == ["q its ", "nave x", "abcd$", " x", "ab", " x"]


@pytest.mark.parametrize(
    "text, found",
    [("The cat", True), ("cat THE", True), ("theme cat", False), ("éthe cat", False),
     ("the-cat", True), ("cat", False), (None, False), ("the_ cat", False)],
)
def test_topic_words_are_whole_words(spark, text, found):
    assert apply(spark, [text], lambda c: X.mentions_all("the cat", c)) == [found]


def test_topic_words_may_be_in_different_columns(spark):
    rows = spark.createDataFrame([("the", "cat"), ("the", None)], "a string, b string")
    flags = rows.select(X.mentions_all("the cat", F.col("a"), F.col("b")).alias("f")).collect()
    assert [row["f"] for row in flags] == [True, False]
