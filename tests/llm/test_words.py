"""Markup of any length is no word, and prose that only looks like it stays."""

import time

import pytest

from turnmill.llm.words import words
from turnmill.llm import leaks

P = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()


@pytest.mark.parametrize(
    "mark",
    [f'<img src="data:image/png;base64,{"Qk1 " * 200}" alt=x>', '<span\n  class="a b"\n  hidden\n>', "<a\nhref='x y'\n/>", "</span\n>", "&#x27;", "&#X2019;", "[", "](https://example.org/a_(b)?q=1)", '](docs/x.md "a title")'],
)
def test_markup_does_not_break_a_passage(mark):
    assert words(" ".join(P[:7]) + mark + " " + " ".join(P[7:])) == P


def test_prose_between_signs_stays():
    text = "if a <b then\n" + " ".join(P) + "\n> quoted = x"
    assert set(P) <= set(words(text))
    assert words("[see] (one two) [x](three four)") == ["see", "one", "two", "x", "three", "four"]


def test_markup_that_never_closes_is_quick():
    began = time.time()
    for bad in ('<a b="' * 20_000, "<a " + "b " * 100_000, "<a b=" + "c=" * 50_000, "](" + "x(" * 50_000, "](x" * 50_000, "<a b" + " " * 20_000):
        words(bad)
    assert time.time() - began < 20


def test_leak_across_a_long_tag(spark):
    docs = spark.createDataFrame([(1, " ".join(P[:7]) + f' <img src="{"x y " * 100}"> ' + " ".join(P[7:]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, " ".join(P))], "item_id bigint, passage string")
    assert [(r["item_id"], r["exact_words"]) for r in leaks.leaks(docs, items).collect()] == [(5, 14)]
