"""Held-out passages inside training texts, by spaced-seed hashing.

A mask covers SPAN words and looks only at some of them; the words under its zeros are free. Every window of
SPAN words of the passages gives one hash a mask, and so does every window of every text. Hashes that meet are
hits; around each hit the two word sequences are aligned on its diagonal and compared word by word, with and
without substitutions. The masks are chosen so that any SWAPS positions of a window lie under the zeros of some mask:
so every window of SPAN words in which at most SWAPS were replaced is found, wherever they are, and equal ones by every mask.

The passages are the stated query set: they are processed in blocks of at most BLOCK words, each of which is
sent to the tasks; texts are never shuffled and never sent anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.words import word_hash, words

SPAN = 12
#: Words of a window that may be replaced, and zeros of a mask.
SWAPS, ZEROS = 2, 6
#: Neighbouring words that may be replaced within an overlap.
GAP = 2
#: Words of all passages of one block (8 bytes each and mask; 1 MB in all per 32,000).
BLOCK = 400_000


def covering(span: int, zeros: int, swaps: int) -> tuple[str, ...]:
    """Masks such that any `swaps` positions are zeros of one of them, chosen greedily: the most positions that no earlier one has, then the first such."""
    left, out = set(combinations(range(span), swaps)), []
    choices = list(combinations(range(span), zeros))
    while left:
        best = max(choices, key=lambda z: len(left & set(combinations(z, swaps))))
        left -= set(combinations(best, swaps))
        out.append("".join("0" if k in best else "1" for k in range(span)))
    return tuple(out)


#: Masks over SPAN words; 1 is compared, 0 is free.
MASKS = covering(SPAN, ZEROS, SWAPS)
_MULTIPLIERS = np.random.default_rng(12).integers(1, 2**63, SPAN, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window of SPAN words under a mask."""
    n = len(hashes) - SPAN + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k, bit in enumerate(mask):
            if bit == "1":
                out += hashes[k : k + n] * _MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    return out


class Passages:
    """The word hashes of a block of passages, end to end, and the sorted seeds of each mask."""

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = [(i, words(p)) for i, p in items]
        self.ids = np.array([i for i, _ in texts], np.int64)
        self.start = np.cumsum([0, *(len(w) for _, w in texts)])
        self.words = np.array([word_hash(x) for _, w in texts for x in w], np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.start))
        self.table = []
        for mask in MASKS:
            at = np.arange(max(0, len(self.words) - SPAN + 1))
            at = at[self.owner[at] == self.owner[at + SPAN - 1]] if len(at) else at
            s = seeds(self.words, mask)[at] if len(at) else np.zeros(0, np.uint64)
            order = np.argsort(s, kind="stable")
            self.table.append((s[order], at[order]))

    def hits(self, hashes: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the text, in the passages) of windows that meet under some mask, without repeats. ends: where texts end that lie end to end, windows over an end don't count."""
        found = []
        inside = np.ones(max(0, len(hashes) - SPAN + 1), bool)
        if ends is not None:
            for k in range(1, SPAN):
                at = ends - k
                inside[at[(at >= 0) & (at < len(inside))]] = False
        for mask, (s, at) in zip(MASKS, self.table, strict=True):
            own = seeds(hashes, mask)
            if not len(own) or not len(s):
                continue
            low = np.searchsorted(s, own, "left")
            met = np.flatnonzero((low < len(s)) & (s[np.minimum(low, len(s) - 1)] == own) & inside)
            if not len(met):
                continue
            low, high = low[met], np.searchsorted(s, own[met], "right")
            n = high - low
            here = np.repeat(met, n)
            there = at[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(here * np.int64(2**31) + there)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs >> 31, pairs & (2**31 - 1)

    def overlaps(self, hashes: np.ndarray, here: np.ndarray | None = None, there: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
        """(item id, longest exact run, longest run with substitutions, substitutions in it) of each item of which a window has at most SWAPS words replaced. here, there: the hits, if known."""
        if here is None:
            here, there = self.hits(hashes)
        best: dict[int, tuple[int, tuple[int, int]]] = {}  # the longest exact run and the longest joined one may lie on different diagonals
        for d, item in np.unique(np.stack([there - here, self.owner[there]]), axis=1).T if len(here) else ():
            low, high = max(0, self.start[item] - d), min(len(hashes), self.start[item + 1] - d)
            same = hashes[low:high] == self.words[low + d : high + d]
            total = np.concatenate(([0], np.cumsum(same)))
            if len(total) <= SPAN or (total[SPAN:] - total[:-SPAN]).max() < SPAN - SWAPS:
                continue  # they met under a mask, but too many words differ under its zeros
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            begin, end = edges[::2], edges[1::2]
            if not len(begin):
                continue
            length = end - begin
            # Equal stretches of 2 words or more join over a gap of at most GAP replaced words.
            stretch = length >= 2
            b, e = begin[stretch], end[stretch]
            joined, swaps = 0, 0
            if len(b):
                new = np.concatenate(([True], b[1:] - e[:-1] > GAP))
                group = np.cumsum(new) - 1
                first, last = b[new], np.concatenate((e[:-1][new[1:]], e[-1:]))
                replaced = (last - first) - np.bincount(group, (e - b)).astype(np.int64)
                k = int(np.lexsort((replaced, first - last))[0])
                joined, swaps = int(last[k] - first[k]), int(replaced[k])
            exact, run = best.get(item, (0, (0, 0)))
            best[item] = max(exact, int(length.max())), max(run, (joined, -swaps))
        return [(int(self.ids[i]), exact, n, -swaps) for i, (exact, (n, swaps)) in best.items()]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact_words", pa.int64()), ("overlap_words", pa.int64()), ("substitutions", pa.int64())])


def _scan(block: list[tuple[int, str | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, known = Passages(block), {}
        for batch in batches:
            out: list[tuple] = []
            ids, texts = batch["doc_id"].to_pylist(), [words(t) for t in batch["text"].to_pylist()]
            if len(known) > 500_000:
                known.clear()
            for w in texts:
                for x in w:
                    if x not in known:
                        known[x] = word_hash(x)
            ends = np.cumsum([len(w) for w in texts])
            hashes = np.fromiter((known[x] for w in texts for x in w), np.uint64, int(ends[-1]) if len(ends) else 0)
            here, there = passages.hits(hashes, ends)  # in order of here
            text = np.searchsorted(ends, here, "right")
            for k in np.unique(text):
                low, high = np.searchsorted(text, [k, k + 1])
                start = int(ends[k]) - len(texts[k])
                out.extend((ids[k], *o) for o in passages.overlaps(hashes[start : ends[k]], here[low:high] - start, there[low:high]))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in _SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _of_size(items: list[tuple[int, str | None]], block: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in lists of at most `block` words, or one item."""
    held, size = [], 0
    for item in items:
        n = len(words(item[1]))
        if held and size + n > block:
            yield held
            held, size = [], 0
        held.append(item)
        size += n
    if held:
        yield held


def leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, exact_words, overlap_words, substitutions) of every text that overlaps a passage.

    exact_words: the longest run of consecutive equal words; overlap_words: the longest run in which up to GAP neighbouring
    words may be replaced between equal ones, substitutions of them; the two may lie in different places of the text. A pair appears if, and only if,
    SPAN words in a row of the text are those of the passage but for at most SWAPS of them.
    Words are compared in lower case, without punctuation, markup and white space. Rows without id are dropped;
    null, empty or short texts and passages never match; repeated rows give one row.
    """
    rows = documents.where("doc_id is not null").select("doc_id", "text")
    sizes = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    total = sizes.agg(F.sum(F.size(F.split("passage", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(total * 1.3 / block))
    found = None
    for k in range(blocks):  # of bounded size each, and as many as the query set needs
        part = sizes.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else sizes
        for held in list(_of_size([tuple(r) for r in part.collect()], block)) or [[]]:
            hit = rows.mapInArrow(_scan(held), "doc_id bigint, item_id bigint, exact_words bigint, overlap_words bigint, substitutions bigint")
            found = hit if found is None else found.unionByName(hit)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("exact_words").alias("exact_words"), F.max("overlap_words").alias("overlap_words"), F.max_by("substitutions", "overlap_words").alias("substitutions")
    )
