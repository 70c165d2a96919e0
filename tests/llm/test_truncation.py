"""The fit sees whole texts."""

import random

import numpy as np

from turnmill.llm import truncation


def test_training_examples_are_of_whole_texts(spark):
    # A fence opened at the start, closed at the end, and a limit of the source far behind the beginning.
    text = "Start of it.\n```\n" + "x = some code here\n" * 3000 + "```\nThat is all there is to say about it now."
    limit = 40_000
    known = truncation.Limits([("s", "chars", limit)])
    docs = spark.createDataFrame([(k, text, "s") for k in range(20)] + [(0, text, "s"), (99, None, "s"), (98, " ", "s")], "doc_id bigint, text string, source string")
    got = truncation.training_examples(docs, known)
    whole = truncation._row(text, known.near("s", len(text), len(text.encode())))
    negatives = [x for x, label, _ in got if not label]
    assert len(negatives) == 20 and all((x == whole).all() for x in negatives)
    at_limit = truncation._row(text[:limit], known.near("s", limit, limit))
    assert any(label and (x == at_limit).all() for x, label, _ in got)
    assert len([x for x, label, _ in truncation.training_examples(docs, known, sample=5) if not label]) == 5
    assert truncation.training_examples(docs.limit(0), known) == [] and not truncation.learn([]).any()


def test_fit_is_learning_from_its_examples():
    known, rows = truncation.Limits([]), [("A whole sentence here. And another one.", "a"), ("Then something else happened. It was good.", None)]
    rng = random.Random(7)
    assert np.array_equal(truncation.fit(rows, known), truncation.learn([e for t, s in rows for e in truncation.examples(t, s, known, rng)]))
