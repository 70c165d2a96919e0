"""Texts cut off at a field limit or in transfer.

A hashed logistic regression over the way a text ends: its closing characters, punctuation and words, open code
blocks, marks of a cut, and its length against the limits of its source. Positives are made by cutting whole texts,
at a limit or at a random place, some with a mark behind; negatives are the same texts as they are. A few of
those are cut themselves: a first fit, which sees endings but no limits and no text that ends at one, tells which. Those it is
sure about are left out of the second fit, which sees all features; whole texts that happen to end at a limit stay in as negatives.

The fit uses a bounded sample (SAMPLE texts, by hash), each of them whole: its examples are made where the texts
lie, and only the numbers of their features come to the driver. Limits and scores cover all rows.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

#: Texts that the model is fitted on, at most: those of least hash.
SAMPLE = 6000
DIM = 1 << 18
THRESHOLD = 0.5
#: A length is a limit of a source if HAZARD of the distinct texts at least that long have just that length, SPIKE times as many as have any
#: length near it on average and STEEP times as many as have any one of these, and SPIKE_LEAST of them.
HAZARD, SPIKE, STEEP, SPIKE_LEAST = 0.03, 6.0, 3.0, 5
#: How far lengths are near: at most NEAR away. Lengths in bytes may stay below a limit by up to SLACK, which don't count as near there.
NEAR, SLACK = 12, 3
#: The features of a text that tell of limits; they are the last of features().
LIMIT_FEATURES = 3

#: Limits of all sources that may be held in memory.
LIMIT_ROWS = 1_000_000

# Marks that are put behind a cut.
MARKS = ["…", "...", "[truncated]", "(truncated)", "<truncated>", "[...]", "[…]", "[cut]", "<connection reset>", "[output truncated]", "--More--", "�", "-", "-", "—"]
_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|[\[(<]\s*(?:output |text |message )?(?:truncated|cut(?: off)?|clipped|snipped?|connection (?:reset|closed|lost)|stream (?:closed|reset)|\.\.\.|…)\s*[\])>]|--More--|�+))+\s*$", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_TERMINAL = ".!?。！？…"
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)


def _shape(word: str) -> str:
    if word.isdigit():
        return "9" * min(len(word), 4)
    if "一" <= word[0] <= "鿿":
        return "han"
    if word.isalpha():
        return ("A" if word.isupper() else "Aa" if word[0].isupper() else "a") + str(min(len(word), 6))
    return word


def _line_kind(line: str) -> str:
    s = line.lstrip()
    m = re.match(r"(?:[-*+] \[[ xX]\]|[-*+] |\d+[.)] |#{1,6} |>|\||-- |\w+(?:\([\w/-]+\))?!?: |[A-Z][\w-]*: |\S+:\d+[: ]|\{|\[|https?://)", s)
    return re.sub(r"\w+", "w", m[0])[:12] if m else ("code" if line[:4] == "    " else "prose")


def _last_tokens(line: str) -> list[str]:
    """The last three tokens of a line, however long they are: a fourth before them tells that they are whole."""
    size = 64
    while len(found := _TOKEN.findall(line[-size:])) < 4 and size < len(line):
        size *= 4
    return found[-3:]


def features(text: str, near: tuple[bool, bool, float]) -> list[str]:
    """The names of what the model sees. near: (at a limit in characters, in bytes, length by the nearest limit)."""
    mark = _MARK.search(text)
    body = text[: mark.start()] if mark else text
    blank = body[len(body.rstrip()) :]
    body = body.rstrip()
    fences = len(_FENCE.findall(body))
    line = body[body.rfind("\n") + 1 :]
    inside = fences % 2 == 1
    tokens = _last_tokens(line)
    last = tokens[-1] if tokens else ""
    end = body[-1:] or "none"
    kind = "code" if inside else _line_kind(line)
    since = re.split(r"[.!?。！？:]\s+|[。！？]", line[:-1] if line else "")[-1]
    earlier = any(c in line[:-1] for c in "。！？") or re.search(r"[.!?] ", line[:-1]) is not None
    n = len(since.split())
    t2, t3 = tokens[-2:-1], tokens[-3:-2]
    glued = len(line) >= 2 and len(last) < len(line) and not line[: len(line) - len(last)][-1:].isspace()
    word = re.search(r"\S*$", line)[0]
    ticks, opens = line.count("`") % 2, sum(line.count(c) for c in "([{“„") - sum(line.count(c) for c in ")]}”")
    out = [
        "bias", f"mark={mark is not None}", f"inside={inside}", f"kind={kind}", f"end={end if not end.isalnum() else _shape(end)}",
        f"end|kind={end if not end.isalnum() else 'w'}|{kind}", f"terminal={end in _TERMINAL}|{inside}", f"last={last.lower()}", f"last|kind={last.lower()}|{kind}",
        f"two={' '.join(x.lower() for x in (*t2, last))}", f"shape={_shape(last) if last else ''}|{kind}", f"shapes={' '.join(_shape(x) for x in (*t3, *t2, last))}",
        f"suffix={word[-3:].lower()}|{kind}", f"suffix4={word[-4:].lower()}", f"word={word.lower()}|{kind}", f"glued={glued}|{_shape(last) if last else ''}",
        f"earlier={earlier}|{end in _TERMINAL}|{kind}", f"n={min(n, 12)}|{kind}|{end in _TERMINAL}", f"first={since.split()[0].lower() if since.split() else ''}|{end in _TERMINAL}",
        f"open={max(-1, min(opens, 2))}|{ticks}|{end in _TERMINAL}", f"blank={blank[:1]!r}|{end in _TERMINAL}", f"dash={word.endswith('-') and len(word) > 1}",
        f"short={min(12, int(math.log2(len(body) + 1)))}|{end in _TERMINAL}", f"limit={near[0]}|{near[1]}", f"limit|end={near[0] or near[1]}|{end in _TERMINAL}", f"ratio={min(20, int(near[2] * 10))}",
    ]
    return out


def _row(text: str, near: tuple[bool, bool, float]) -> np.ndarray:
    return np.fromiter((zlib.crc32(f.encode()) % DIM for f in features(text, near)), np.int64)


class Limits:
    """Lengths at which texts of a source are cut: {source: {unit: lengths}}."""

    def __init__(self, rows: list[tuple]):
        self.by: dict[str | None, tuple[frozenset, frozenset]] = {}
        got: dict[tuple, set] = {}
        for source, unit, length in rows:
            got.setdefault((source, unit), set()).add(length)
        for source in {s for s, _ in got}:
            self.by[source] = (frozenset(got.get((source, "chars"), ())), frozenset(got.get((source, "bytes"), ())))

    def near(self, source: str | None, chars: int, size: int) -> tuple[bool, bool, float]:
        """(at a limit in characters, in bytes, length by the nearest limit). A character of several bytes may not fit, so a text with some may end up to SLACK bytes below."""
        c, b = self.by.get(source, (frozenset(), frozenset()))
        ratio = min((chars / x for x in c if x), key=lambda r: abs(r - 1), default=0.0)
        return chars in c, any(size + k in b for k in range(SLACK + 1 if size > chars else 1)), ratio


def lengths(documents: DataFrame) -> DataFrame:
    """(source, chars, bytes, n, rows): how many distinct texts of each source have these lengths, in how many rows. One scan; texts are told apart by their hash."""
    rows = documents.where("text is not null").select("source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    one = rows.groupBy("source", "h", "chars", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    return cut(one.groupBy("source", "chars", "bytes").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")))


def limits(documents: DataFrame) -> DataFrame:
    """(source, unit, n_long): the limits of each source, from the lengths of all texts, in characters and bytes."""
    return limits_of(lengths(documents))


def limits_of(counted: DataFrame) -> DataFrame:
    """The limits from lengths(). Windows are over the different lengths of a source, of which there are few beside its texts."""
    both = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("long")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("long")))
    by = counted.select("source", "n", F.explode(both).alias("x")).groupBy("source", "x.unit", "x.long").agg(F.sum("n").alias("n"))
    line = Window.partitionBy("source", "unit").orderBy("long")
    # just below a limit in bytes it is blurred
    below = lambda f: F.coalesce(F.when(F.col("unit") == "bytes", f(line.rangeBetween(-NEAR - SLACK, -SLACK - 1))).otherwise(f(line.rangeBetween(-NEAR, -1))), F.lit(0))
    above = lambda f: F.coalesce(f(line.rangeBetween(1, NEAR)), F.lit(0))
    total = below(lambda w: F.sum("n").over(w)) + above(lambda w: F.sum("n").over(w))
    most = F.greatest(below(lambda w: F.max("n").over(w)), above(lambda w: F.max("n").over(w)))
    longer = F.sum("n").over(line.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    seen = by.select("source", "unit", "long", "n", longer.alias("longer"), (total / (2 * NEAR)).alias("usual"), most.alias("most"))
    spike = (F.col("n") >= SPIKE_LEAST) & (F.col("n") >= HAZARD * F.col("longer")) & (F.col("n") >= SPIKE * F.col("usual")) & (F.col("n") >= STEEP * F.col("most")) & (F.col("long") >= 16)
    return seen.where(spike).select("source", "unit", F.col("long").alias("n_long"))


def cut_somewhere(text: str, rng: random.Random, bounds: list[int]) -> str | None:
    """A beginning of the text that ends within a word, sentence or code block; None if none is found."""
    for _ in range(6):
        at = rng.choice(bounds) if bounds and rng.random() < 0.4 else rng.randrange(1, max(2, len(text)))
        if not 0 < at < len(text):
            continue
        head, rest = text[:at], text[at:]
        open_block = len(_FENCE.findall(head)) % 2 == 1
        done = head.rstrip()
        if not done or (not open_block and (done[-1] in _TERMINAL + "`|)" or rest[0] in "\n\r" or head[-1] in "\n\r")):
            continue
        if open_block and head.endswith("```"):
            continue
        if rng.random() < 0.15:
            mark = rng.choice(MARKS)
            head = head + (rng.choice(["", " ", "\n"]) if len(mark) > 1 else "") + mark
        return head
    return None


def fit(sample: list[tuple], known: Limits, seed: int = 7, epochs: int = 6) -> np.ndarray:
    """Weights from (text, source) rows, by AdaGrad in two fits."""
    rng = random.Random(seed)
    return learn([e for text, source in sample for e in examples(text, source, known, rng)], seed, epochs)


def examples(text: str, source: str | None, known: Limits, rng: random.Random) -> list[tuple[np.ndarray, int, bool]]:
    """(features, label, whether it ends at a limit) of a whole text and of up to two artificial cuts of it."""
    near = known.near(source, len(text), len(text.encode()))
    out = [(_row(text, near), 0, near[0] or near[1])]
    chars = sorted(known.by.get(source, (frozenset(), frozenset()))[0])
    for _ in range(2):
        head = cut_somewhere(text, rng, chars)
        if head is not None:
            out.append((_row(head, known.near(source, len(head), len(head.encode()))), 1, False))
    return out


def learn(rows: list[tuple[np.ndarray, int, bool]], seed: int = 7, epochs: int = 6) -> np.ndarray:
    """Weights from examples, by AdaGrad in two fits."""
    if not rows:
        return np.zeros(DIM)
    x, y = np.stack([r for r, _, _ in rows]).astype(np.int64), np.array([label for _, label, _ in rows], float)
    at_limit = np.array([free for _, _, free in rows])

    def run(x: np.ndarray, use: np.ndarray) -> np.ndarray:
        w, g = np.zeros(DIM), np.full(DIM, 1e-2)
        gen = np.random.default_rng(seed)
        for _ in range(epochs):
            order = gen.permutation(use)
            for k in range(0, len(order), 64):
                at = order[k : k + 64]
                p = 1 / (1 + np.exp(-w[x[at]].sum(1)))
                cols, inverse = np.unique(x[at], return_inverse=True)
                step = np.bincount(inverse.ravel(), np.repeat((p - y[at]) / len(at), x.shape[1]), len(cols)) + 1e-6 * w[cols]
                g[cols] += step * step
                w[cols] -= 0.3 * step / np.sqrt(g[cols])
        return w

    endings = x[:, :-LIMIT_FEATURES]
    w = run(endings, np.flatnonzero(~at_limit))
    doubtful = (y == 0) & (1 / (1 + np.exp(-w[endings].sum(1))) > 0.5)
    return run(x, np.flatnonzero(~doubtful))


def _examples(known: Limits):
    schema = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("x", pa.binary()), ("label", pa.int32()), ("free", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, text, source in zip(*(batch[c].to_pylist() for c in ("h", "text", "source")), strict=True):
                out += [(h, n, x.astype(np.int32).tobytes(), label, free) for n, (x, label, free) in enumerate(examples(text, source, known, random.Random(h)))]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def training_examples(documents: DataFrame, known: Limits, sample: int = SAMPLE, seed: int = 7, texts: int | None = None) -> list[tuple[np.ndarray, int, bool]]:
    """The examples of at most `sample` texts, those of least hash, each made from the whole text; repeated rows count once. texts: how many rows have a text, if known."""
    rows = documents.where("text is not null and trim(text) != ''").select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), "text", "source")
    share = (1.2 * sample + 50) / max(1, rows.count() if texts is None else texts)  # hashes are even: this share of them has the least `sample`, and few more
    if share < 1:
        rows = rows.where(F.col("h") < int(2**64 * share) - 2**63)
    made = rows.mapInArrow(_examples(known), "h bigint, n int, x binary, label int, free boolean").groupBy("h", "n").agg(F.min(F.struct("x", "label", "free")).alias("e"))
    got = sorted(made.select("h", "n", "e.*").collect(), key=lambda r: (r["h"], r["n"]))
    held = set(sorted({r["h"] for r in got})[:sample])
    return [(np.frombuffer(bytes(r["x"]), np.int32), r["label"], r["free"]) for r in got if r["h"] in held]


def _score(weights: np.ndarray, known: Limits):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64())])
    held = np.flatnonzero(weights)
    packed = (held.astype(np.int32), weights[held].astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIM, np.float32)
        w[packed[0]] = packed[1]
        for batch in batches:
            ids, sources, texts = (batch[c].to_pylist() for c in ("doc_id", "source", "text"))
            score = [1 / (1 + math.exp(-float(w[_row(t, known.near(s, len(t), len(t.encode())))].sum()))) if t and t.strip() else 0.0 for s, t in zip(sources, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(score)], schema=schema)

    return run


def scored(documents: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(doc_id, source, score, is_cut) of every document.

    Null, empty and blank texts score 0. Rows without doc_id are scored like others. Repeated rows are scored each.
    A null source is a source of its own. Extra columns are ignored.
    """
    counted = lengths(documents)
    rows = [tuple(r) for r in limits_of(counted).limit(LIMIT_ROWS + 1).collect()]  # some tens in practice; the bound is checked
    if len(rows) > LIMIT_ROWS:
        raise ValueError(f"more than {LIMIT_ROWS} length limits: source isn't a field with few values")
    known = Limits(rows)
    texts = counted.agg(F.sum("rows")).first()[0] or 0
    weights = learn(training_examples(documents, known, sample, seed, texts), seed)
    out = documents.select("doc_id", "source", "text").mapInArrow(_score(weights, known), "doc_id bigint, source string, score double")
    return out.withColumn("is_cut", F.col("score") >= THRESHOLD)


def rates(scores: DataFrame) -> DataFrame:
    """(source, documents, cut_documents, cut_rate) per source, null sources together."""
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("is_cut").alias("cut_documents"), (F.count_if("is_cut") / F.count(F.lit(1))).alias("cut_rate")
    )
