"""The tagger: held-out accuracy on the labelled table, exact likelihood on tiny chains, and odd inputs."""

import itertools
from collections import Counter

import numpy as np
import pytest

from turnmill.llm import pii, pii_table

LEXICON = tuple(sorted([("Anna", "given"), ("Will", "given"), ("Noor", "given"), ("Korvath", "family"), ("de Falvane", "family"), ("Ashgrove-Pell", "family")]))
ROWS = 1200


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.trained(LEXICON, ROWS))


def test_held_out_rows(tagger):
    rows = pii_table.rows(list(LEXICON), 300, seed=77)
    right, found, real = Counter(), Counter(), Counter()
    for (_, spans), got in zip(rows, tagger.spans([t for t, _ in rows]), strict=True):
        a, b = {(x, k) for x, _, k in spans}, {(x, k) for x, _, k in got}
        for k in pii.KINDS:
            right[k] += sum(y == k for _, y in a & b)
            real[k] += sum(y == k for _, y in a)
            found[k] += sum(y == k for _, y in b)
    for k in pii.KINDS:
        assert right[k] >= 0.93 * real[k] and right[k] >= 0.93 * found[k], (k, right[k], found[k], real[k])


def test_patterns_that_were_not_learnt():
    """A sixth of the item patterns is left out of training; items in them are found all the same."""
    kept, left = pii_table.folds(6)[2]
    tagger = pii.Tagger(pii.train(pii_table.rows(list(LEXICON), ROWS, items=kept), list(LEXICON), 4))
    right = found = real = 0
    for text, spans in pii_table.rows(list(LEXICON), 200, seed=91, items=left):
        a, b = {(x, k) for x, _, k in spans}, {(x, k) for x, _, k in tagger.spans([text])[0]}
        right, found, real = right + len(a & b), found + len(b), real + len(a)
    assert right >= 0.85 * real and right >= 0.85 * found, (right, found, real)


def test_lookalikes_are_left(tagger):
    texts = ["origin git@git.tavrik.example:core/lane-90.git", "installed @lanes/seal-kit@4.2.03 and tail-reader@0.03.1", "at 10.55.0.50:7050", "Mark Complete was pressed twice", '{"path":"a.rs","lines":"1401-1600"}', "--trace 8072aa84-41ce-4e1e-ae1e-fe8672385578"]
    assert tagger.spans(texts) == [[] for _ in texts]


def test_empty_long_and_repeated(tagger):
    long = "the parser kept the frame " * 4000 + "# ping Anna Korvath when done"
    got = tagger.spans(["", "\n\n", long, "contact: a.b@mail.example.com", "contact: a.b@mail.example.com"])
    assert got[:2] == [[], []] and got[3] == got[4] == [(9, 29, "email")]
    assert got[2] == [(long.index("Anna"), long.index(" when"), "name")]


def test_likelihood_and_viterbi_against_all_labelings():
    rng = np.random.default_rng(1)
    scores, lengths = rng.normal(size=(2, 3, pii.K)), np.array([3, 2])
    step, start = pii.allowed()
    step = step + rng.normal(size=(pii.K, pii.K))
    marginal, moves = pii.expectations(scores, lengths, step, start)
    total = np.zeros((pii.K, pii.K))
    for i, n in enumerate(lengths):
        ways = list(itertools.product(range(pii.K), repeat=int(n)))
        value = np.array([start[w[0]] + sum(scores[i, t, w[t]] for t in range(n)) + sum(step[w[t - 1], w[t]] for t in range(1, n)) for w in ways])
        p = np.exp(value - value.max())
        p /= p.sum()
        for t in range(n):
            assert np.allclose(marginal[i, t], np.bincount([w[t] for w in ways], p, pii.K), atol=1e-8)
        for w, x in zip(ways, p, strict=True):
            for t in range(1, n):
                total[w[t - 1], w[t]] += x
        assert tuple(pii.viterbi(scores, lengths, step, start)[i, :n]) == ways[int(value.argmax())]
    assert np.allclose(moves, total, atol=1e-8)


def test_found_and_masked(spark):
    rows = [("k1", "ping Anna Korvath at 1", None, "", "x"), ("k1", "ping Anna Korvath at 1", None, "", "x"), ("k2", None, None, None, "y"), (None, None, "mail a@b.example.org now", None, "z")]
    df = spark.createDataFrame(rows, "event_key string, input_text string, output_text string, error_text string, start_at string")
    lexicon = spark.createDataFrame(list(LEXICON) + [(None, "given"), ("x", None)], "name_part string, part_kind string")
    got = {tuple(r)[:4] for r in pii.found(df, lexicon, train_rows=ROWS).collect()}
    assert got == {("k1", "input_text", "name", 6), (None, "output_text", "email", 6)}
    masked = sorted((str(r) for r in pii.masked(df, lexicon, train_rows=ROWS).collect()))
    assert sum("ping <NAME> at 1" in m for m in masked) == 2 and sum("mail <EMAIL> now" in m for m in masked) == 1 and len(masked) == 4
    assert pii.found(df.limit(0), lexicon, train_rows=ROWS).collect() == []
