"""Extents of overlaps."""

from turnmill.llm import leaks
from turnmill.llm.words import word_hash

P = [f"p{i}" for i in range(60)]


def overlaps(text):
    import numpy as np

    return leaks.Passages([(1, " ".join(P))]).overlaps(np.array([word_hash(w) for w in text], np.uint64))


def test_longest_overlap_is_kept_apart_from_the_longest_exact_run():
    swapped = [*P[10:50]]
    swapped[12] = swapped[28] = "other"
    apart = [f"x{i}" for i in range(7)]
    for text in (P[:20] + apart + swapped, swapped + apart + P[:20]):
        assert overlaps(text) == [(1, 20, 40, 2)]


def test_two_neighbouring_words_may_be_replaced():
    text = [*P[:40]]
    text[15] = text[16] = "other"
    assert overlaps(text) == [(1, 23, 40, 2)]
    text[17] = "other"
    assert overlaps(text) == [(1, 22, 22, 0)]


def test_every_window_with_two_replaced_words_is_found(spark):
    """All pairs of places in a window, and texts end to end in a batch, against brute force."""
    import random
    from itertools import combinations

    r = random.Random(4)
    items = [(i, [f"w{r.randrange(40)}" for _ in range(r.randrange(8, 30))]) for i in range(12)]
    docs = []
    for n, (a, b) in enumerate(combinations(range(leaks.SPAN), 2)):
        w = [f"{x}" for x in P[5 : 5 + leaks.SPAN]]
        w[a], w[b] = "swapped", "changed"
        docs.append((n, w))
    for n in range(100, 220):
        w = []
        for _ in range(r.randrange(1, 4)):
            k = list(r.choice(items)[1])
            for _ in range(r.randrange(5)):
                k[r.randrange(len(k))] = "other"
            w += k[r.randrange(3) :]
        docs.append((n, w))
    items.append((99, P))
    near = lambda d, p: any(sum(x != y for x, y in zip(d[i : i + 12], p[j : j + 12], strict=True)) <= leaks.SWAPS for i in range(len(d) - 11) for j in range(len(p) - 11))
    want = {(n, i) for n, w in docs for i, p in items if near(w, p)}
    frame = lambda rows, names: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], names)
    for block in (leaks.BLOCK, 25):
        got = leaks.leaks(frame(docs, "doc_id bigint, text string"), frame(items, "item_id bigint, passage string"), block).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    assert {(n, 99) for n in range(66)} <= want and len(want) > 120


def test_masks_cover_all_pairs():
    from itertools import combinations

    assert all(any(m[a] == m[b] == "0" for m in leaks.MASKS) for a, b in combinations(range(leaks.SPAN), 2))
