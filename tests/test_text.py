"""Expressions against a plain Python reading of the same rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.config import TEXT_PRESETS, TextConfig
from quern.functions import text as T

STRIP = ".,!?;:\"'()[]{}<>"
EDGE = ["", "   ", "...!!", "a b", "É É don't (won't)", "x" * 50, "y" * 51, "tail word\n", "running foxes studies passes classes sing string need by eyed", "42 4th 007", "Running RUNS Easily", "\x0bvt\x0cff"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def size(s):
    return len(s.encode())


def tokens(text, c):
    ok = lambda t: bool(t) and c.min_length <= size(t) <= c.max_length and not (c.remove_numbers and re.fullmatch("[0-9]+", t))
    found = [t for t in (x.strip(STRIP) for x in re.split("[ \t\n\x0b\f\r]+", text)) if ok(t)]
    if not found and re.search("[^ \t\n\x0b\f\r]", text) and ok(text.strip(STRIP)):
        found = [text.strip(STRIP)]
    return [lower(t) if c.lowercase else t for t in found]


def stem(w):
    if size(w) < 3:
        return w
    w = lower(w)
    if w in T.STEMS:
        return T.STEMS[w]
    if size(w) >= 4:
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith("ies"):
            w = w[:-3] + "i"
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
    if size(w) >= 5 and w.endswith("ing"):
        w = w[:-3]
        w = w[:-1] if w.endswith("nn") else w
    elif size(w) >= 4 and w.endswith("ed"):
        w = w[:-2]
    if len(w) >= 2 and w[-1] == "y" and w[-2] not in "aeiou":
        w = w[:-1] + "i"
    return w


def process(text, c):
    t = [lower(x) for x in tokens(text, c)]
    if c.remove_stopwords:
        t = [x for x in t if x not in set(T.stopwords(c.language))]
    if c.stem:
        t = [stem(x) for x in t]
    return [x for x in t if c.min_length <= size(x) <= c.max_length]


def ask(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t")).alias("x")).collect()]


@pytest.mark.parametrize("name", sorted(TEXT_PRESETS))
def test_process(spark, name):
    c = TEXT_PRESETS[name]
    assert ask(spark, EDGE, lambda x: T.process(x, c)) == [process(t, c) for t in EDGE]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \n.,'abdegiinsyéÉ19", max_size=60), min_size=30, max_size=60))
def test_process_property(spark, texts):
    c = TextConfig(stem=True, min_length=1, remove_numbers=True)
    assert ask(spark, texts, lambda x: T.process(x, c)) == [process(t, c) for t in texts]


def test_null_and_table(spark):
    assert ask(spark, [None], lambda x: T.process(x, TEXT_PRESETS["retrieval"])) == [[]]
    assert ask(spark, ["running", "ran", "organization", "foxes"], T.stem) == ["run", "ran", "organ", "fox"]


def test_ngrams_snippet_count(spark):
    grams = lambda n: (lambda x: T.ngrams(F.split(x, " "), n))
    assert ask(spark, ["a b c", "a"], grams(2)) == [["a_b", "b_c"], []]
    assert ask(spark, ["a b"], grams(1)) == [[]]
    assert ask(spark, ["x" * 100, "x" * 101, "é"], T.token_count) == [25, 26, 1]
    assert ask(spark, ["x" * 100, "y" * 101], T.snippet) == ["x" * 100, "y" * 100 + "..."]


def test_language_without_stopwords():
    assert T.stopwords("klingon") == [] and len(T.stopwords("en")) == len(set(T.stopwords("en")))
