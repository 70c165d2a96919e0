"""Personal information in free text: a linear-chain conditional random field over word-shape features.

Texts are cut into lines and lines into tokens (letter runs, Han characters, digit runs, single signs). A token's
features come from its own word and shape, the shapes of the piece between blanks and of the number it is in, the lexicon
of name parts, and its neighbours. Weights are trained on the labelled table of pii_table by AdaGrad on the
exact log-likelihood (forward-backward); texts are decoded by Viterbi over batches of lines of similar length.
Spans then pass a check of their form, which finds none of its own but drops a span that hasn't the form of its kind, and sets its edges: a mail address reaches
from the first sign of its local part to the end of its host, whatever part of it was tagged, a phone number takes a sign before it, others are trimmed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm import pii_table
from turnmill.llm.pii_table import KINDS

DIM = 1 << 17
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
K = len(LABELS)
#: Tokens of one sequence; longer lines are decoded in windows that overlap by twice MARGIN.
WINDOW, MARGIN = 384, 32
FIELDS = ("input_text", "output_text", "error_text")
#: Rows of the labelled table, passes over it, and name parts that may be held in memory.
TRAIN_ROWS, EPOCHS, LEXICON_LIMIT = 3200, 5, 1_000_000

_TOKEN = re.compile(r"\s*(?:[぀-ヿ一-鿿]|[^\W\d_぀-ヿ一-鿿]+|\d+|\S)")
_NUMBER = re.compile(r"[+(]?\d[\d ()./-]{4,}\d(?:[ ]?[A-Za-z]\b)?|\b[A-Z]{1,2} ?\d[\d ]{4,}\d ?[A-Z]\b")
_EDGE = "\"'()[]{}<>,;:.!?|（）。，、“”"


def _h(text: str) -> int:
    return zlib.crc32(text.encode())


def _squeeze(piece: str) -> str:
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", piece)
    return re.sub(r"\d+", "9", s)[:24]


def _word_shape(word: str) -> str:
    if word.isdigit():
        return "9" * min(len(word), 8)
    if word[0].isalpha():
        return ("A" if len(word) == 1 else "AA" if word.isupper() else "Aa" if word[1:].islower() else "AaA") if word[0].isupper() else "a"
    return word


class Attributes:
    """Hashed attributes of tokens, kept by their spelling (a bounded cache)."""

    #: columns: word, shape, suffix 2, suffix 3, prefix 3, lexicon, space before
    WIDTH = 7

    def __init__(self, lexicon: list[tuple[str, str]]):
        self.lexicon: dict[str, str] = {}
        for part, kind in lexicon:
            for piece in _TOKEN.findall(part):
                if piece.strip().isalpha():
                    word = piece.strip().lower()
                    old = self.lexicon.get(word, "")
                    self.lexicon[word] = old if kind[0] in old else "".join(sorted(old + kind[0]))
        self.seen: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, int] = {}

    def token(self, spelled: str) -> tuple[int, ...]:
        got = self.seen.get(spelled)
        if got is None:
            if len(self.seen) > 400_000:
                self.seen.clear()
            word = spelled.lstrip()
            shape, low = _word_shape(word), word.lower()
            if word.isdigit():
                low = shape
            got = self.seen[spelled] = (_h(low), _h(shape), _h(low[-2:] + shape), _h(low[-3:]), _h(low[:3]), _h("lex" + self.lexicon.get(low, "")), int(len(word) < len(spelled)))
        return got

    def piece(self, text: str) -> int:
        got = self.pieces.get(text)
        if got is None:
            if len(self.pieces) > 400_000:
                self.pieces.clear()
            body = text.strip(_EDGE)
            if "=" in body or ":" in body:
                body = re.split(r"[=:]['\"]?", body)[-1] if "@" not in body or "=" in body and body.index("=") < body.index("@") else body
            got = self.pieces[text] = _h(_squeeze(body))
        return got


def line_tokens(line: str, attributes: Attributes) -> tuple[np.ndarray, np.ndarray]:
    """(start of each token, attribute matrix): the columns of Attributes, then piece and number."""
    spelled = _TOKEN.findall(line)
    n = len(spelled)
    a = np.zeros((n, Attributes.WIDTH + 2), np.int64)
    if not n:
        return np.zeros(0, np.int64), a
    a[:, : Attributes.WIDTH] = [attributes.token(s) for s in spelled]
    ends = np.cumsum([len(s) for s in spelled])
    starts = ends - np.array([len(s.lstrip()) for s in spelled])
    blank = a[:, 6].copy()
    blank[0] = 0
    pieces = np.array([attributes.piece(p) for p in line.split()])
    a[:, 7] = pieces[np.minimum(np.cumsum(blank), len(pieces) - 1)]
    for m in _NUMBER.finditer(line):
        if sum(map(str.isdigit, m[0])) >= 7:
            a[(starts >= m.start()) & (starts < m.end()), 8] = _h("#" + re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", m[0])))
    return starts, a


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fold(number: int, *columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), number * 0x51ED27 + 1, np.uint64)
    for c in columns:
        h = (h ^ c) * _MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)) % np.uint64(DIM)


def feature_ids(a: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The hashed features of every token; a: attributes of sequences end to end, edges: where each sequence ends."""
    n = len(a)
    u = a.astype(np.uint64)
    position = np.arange(n)
    first = np.concatenate(([0], edges[:-1]))
    length = edges - first
    begin, end = np.repeat(first, length), np.repeat(edges, length)

    def at(column: int, shift: int) -> np.ndarray:
        j = position + shift
        ok = (j >= begin) & (j < end)
        return np.where(ok, u[np.where(ok, j, 0), column], np.uint64(7 if shift < 0 else 11))

    w = {s: at(0, s) for s in range(-3, 4)}
    s = {k: at(1, k) for k in range(-3, 4)}
    lex = {k: at(5, k) for k in range(-3, 4)}
    sp, piece, number = {k: at(6, k) for k in (0, 1, 2)}, {k: at(7, k) for k in (-1, 0, 1)}, at(8, 0)
    groups = [
        (w[0],), (s[0],), (at(2, 0),), (at(3, 0),), (at(4, 0),), (lex[0], s[0]), (piece[0],), (piece[0], w[0]), (number,), (number, s[0]), (w[-1],), (w[1],), (w[-2], w[-1]), (w[1], w[2]), (w[-1], s[0]), (s[0], w[1]),
        (s[-1], s[0], s[1]), (s[-2], s[-1], s[0]), (s[0], s[1], s[2]), (s[0], s[1], s[2], s[3]), (lex[0], lex[1], s[0], s[1], sp[1]), (lex[-1], lex[0], s[-1], s[0], sp[0]), (lex[0], lex[2], w[1], s[2]), (lex[-2], lex[0], w[-1], s[0]), (lex[0], lex[3], w[1], w[2]), (lex[-3], lex[0], w[-1], w[-2]),
        (w[-1], lex[0], s[0]), (w[-2], s[-1], s[0]), (w[-3], s[0]), (w[2], s[0], s[1]), (at(3, 1), s[0]), (at(3, -1), s[0]), (sp[0], s[0], sp[1]), (piece[-1], s[0]), (piece[1], s[0]), (w[-1], s[0], s[1], s[2]), (w[1], lex[0], lex[2]), (s[-3], s[-2], s[-1], s[0]),
    ]
    return np.stack([_fold(k, *g) for k, g in enumerate(groups)], axis=1).astype(np.int32)


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of transitions and of first labels: an item goes on only as what it began."""
    step, start = np.zeros((K, K)), np.zeros(K)
    for j, name in enumerate(LABELS):
        if name.startswith("I-"):
            start[j] = -1e4
            for i, before in enumerate(LABELS):
                if before[2:] != name[2:] or before == "O":
                    step[i, j] = -1e4
    return step, start


def viterbi(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best labels of padded sequences: scores (sequence, time, label)."""
    b, t, _ = scores.shape
    best = scores[:, 0] + start
    back = np.zeros((t, b, K), np.int8)
    last = np.where((lengths == 1)[:, None], best, 0)
    for k in range(1, t):
        way = best[:, :, None] + step
        back[k] = way.argmax(1)
        best = way.max(1) + scores[:, k]
        last = np.where((lengths == k + 1)[:, None], best, last)
    out = np.zeros((b, t), np.int8)
    now = last.argmax(1)
    rows = np.arange(b)
    for k in range(t - 1, -1, -1):
        here = k < lengths
        out[here, k] = now[here]
        if k:
            now = np.where(here, back[k, rows, now], now)
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


def expectations(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (sequence, time, label) and expected transition counts, by forward-backward."""
    b, t, _ = scores.shape
    alpha, beta = np.zeros((b, t, K)), np.zeros((b, t, K))
    alpha[:, 0] = scores[:, 0] + start
    for k in range(1, t):
        alpha[:, k] = _logsum(alpha[:, k - 1, :, None] + step, 1) + scores[:, k]
    for k in range(t - 2, -1, -1):
        on = _logsum(step + (scores[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where((k + 1 < lengths)[:, None], on, 0)
    z = _logsum(alpha[np.arange(b), lengths - 1], 1)
    inside = (np.arange(t) < lengths[:, None])[:, :, None]
    marginal = np.where(inside, np.exp(np.minimum(alpha + beta - z[:, None, None], 0)), 0)
    moves = np.zeros((K, K))
    for k in range(1, t):
        p = np.exp(np.minimum(alpha[:, k - 1, :, None] + step + (scores[:, k] + beta[:, k])[:, None, :] - z[:, None, None], 0))
        moves += (p * (k < lengths)[:, None, None]).sum(0)
    return marginal, moves


class Model:
    def __init__(self, weights: np.ndarray, step: np.ndarray, lexicon: list[tuple[str, str]]):
        self.weights, self.step, self.lexicon = weights, step, lexicon

    def __reduce__(self):
        held = np.flatnonzero(np.abs(self.weights).max(1) > 1e-3)
        return _unpack, (held.astype(np.int32), self.weights[held].astype(np.float16), self.step, self.lexicon)


def _unpack(held: np.ndarray, values: np.ndarray, step: np.ndarray, lexicon: list[tuple[str, str]]) -> Model:
    w = np.zeros((DIM, K), np.float32)
    w[held] = values
    return Model(w, step, lexicon)


def gold_labels(starts: np.ndarray, offset: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(starts), np.int64)
    for a, b, kind in spans:
        inside = np.flatnonzero((starts + offset >= a) & (starts + offset < b))
        y[inside] = 2 + 2 * KINDS.index(kind)
        y[inside[:1]] = 1 + 2 * KINDS.index(kind)
    return y


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], lexicon: list[tuple[str, str]], epochs: int = EPOCHS, batch: int = 48, seed: int = 5) -> Model:
    """The model of a labelled table: rows of (text, [(start, end, kind)])."""
    attributes = Attributes(lexicon)
    xs, ys = [], []
    for text, spans in rows:
        offset = 0
        for line in text.split("\n"):
            starts, a = line_tokens(line, attributes)
            if len(starts):
                xs.append(feature_ids(a, np.array([len(a)])))
                ys.append(gold_labels(starts, offset, spans))
            offset += len(line) + 1
    w, g = np.zeros((DIM, K)), np.full((DIM, K), 1e-4)
    forbidden, start = allowed()
    step, gs = np.zeros((K, K)), np.full((K, K), 1e-2)
    gen = np.random.default_rng(seed)
    for _ in range(epochs):
        # lines of similar length go together, so that short ones don't wait for long ones; the batches come in random order
        order = np.argsort(np.array([len(x) for x in xs]) * (1 + 0.2 * gen.random(len(xs))), kind="stable")
        for b in gen.permutation((len(order) + batch - 1) // batch):
            some = order[b * batch : (b + 1) * batch]
            lengths = np.array([len(xs[i]) for i in some])
            x = np.concatenate([xs[i] for i in some])
            y = np.concatenate([ys[i] for i in some])
            inside = np.arange(lengths.max()) < lengths[:, None]
            cols, at = np.unique(x, return_inverse=True)
            at = at.reshape(x.shape)
            scores = np.zeros((*inside.shape, K))
            scores[inside] = w[cols][at].sum(1)
            marginal, moves = expectations(scores, lengths, step + forbidden, start)
            error = marginal[inside]
            error[np.arange(len(y)), y] -= 1
            grad = np.stack([np.bincount(at.ravel(), np.repeat(error[:, j], x.shape[1]), len(cols)) for j in range(K)], axis=1) / len(some) + 2e-5 * w[cols]
            g[cols] += grad * grad
            w[cols] -= 0.25 * grad / np.sqrt(g[cols])
            follows = np.ones(len(y), bool)
            follows[np.cumsum(lengths)[:-1]] = False
            follows[0] = False
            np.subtract.at(moves, (y[:-1][follows[1:]], y[1:][follows[1:]]), 1)
            moves /= len(some)
            gs += moves * moves
            step -= 0.25 * moves / np.sqrt(gs)
    return Model(w.astype(np.float32), (step + forbidden).astype(np.float32), lexicon)


@lru_cache(maxsize=4)
def trained(lexicon: tuple[tuple[str, str], ...], n: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model:
    return train(pii_table.rows(list(lexicon), n), list(lexicon), epochs)


# The forms that a span must have, by kind; matched at its start.
_MAIL = re.compile(r"[\w.+%-]*\w\s?(?:@|%40|[\[({]\s?at\s?[\])}]|\bat\b)\s?\w[\w-]*(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)\w[\w-]*)+", re.I)
_FORM = {
    "email": _MAIL,
    "phone": re.compile(r"[+(]?\d[\d ()./–-]{5,}\d"),
    "id_number": re.compile(r"[A-Z]{0,2} ?\d[\d -]{4,}[\dA-Z]"),
    "address": re.compile(r"(?=.*\d)(?=.*[^\W\d_]).{5,}", re.S),
    "name": re.compile(r"[^\W\d_][\w'’.-]*,?\s(?:[^\W\d_][\w'’.-]*,?\s?)+"),
}


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The span with the edges of its form; None if it hasn't the form of its kind."""
    while start < end and (text[start].isspace() or text[start] in "\"'<[{,;:|=“（" or (kind != "phone" and text[start] in "(+")):
        start += 1
    if kind == "phone" and start and text[start : start + 1].isdigit() and text[start - 1] in "+(" :
        start -= 1
    if kind == "email":  # the local part from its first sign on
        while start and re.match(r"[A-Za-z0-9._+%-]", text[start - 1]):
            start -= 1
    m = _FORM[kind].match(text, start) if kind == "email" else _FORM[kind].match(text[start:end])
    if not m:
        return None
    if kind == "email":
        return None if text[m.end() : m.end() + 1] in ("/", ":") and re.match(r"[:/][\w~]", text[m.end() : m.end() + 2]) or "://" in text[max(0, start - 4) : start + 1] else (start, m.end())
    digits = sum(c.isdigit() for c in m[0])
    if kind == "phone" and not 7 <= digits <= 15 or kind == "id_number" and digits < 6:
        return None
    return start, start + m.end() if kind in ("phone", "id_number") else end


class Tagger:
    """Spans of texts by a model."""

    def __init__(self, model: Model):
        self.model = model
        self.attributes = Attributes(model.lexicon)
        self.start = allowed()[1].astype(np.float32)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        owners, offsets, starts, mats, takes = [], [], [], [], []
        for i, text in enumerate(texts):
            offset = 0
            for line in text.split("\n"):
                at, a = line_tokens(line, self.attributes)
                n = len(at)
                for k in range(0, max(1, n), WINDOW - 2 * MARGIN):
                    if n:
                        stop = min(n, k + WINDOW)
                        owners.append(i)
                        offsets.append(offset)
                        starts.append(at[k:stop])
                        mats.append(a[k:stop])
                        takes.append((MARGIN if k else 0, stop - k - (MARGIN if stop < n else 0)))
                    if k + WINDOW >= n:
                        break
                offset += len(line) + 1
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not mats:
            return out
        lengths = np.array([len(m) for m in mats])
        labels: list[np.ndarray] = [None] * len(mats)  # type: ignore[list-item]
        order = np.argsort(lengths, kind="stable")
        k = 0
        while k < len(order):  # batches of similar length, of bounded size
            longest = k
            while longest < len(order) and (longest - k + 1) * lengths[order[longest]] <= 24_000:
                longest += 1
            some = order[k : max(longest, k + 1)]
            k += len(some)
            n = lengths[some]
            ids = feature_ids(np.concatenate([mats[i] for i in some]), np.cumsum(n))
            scores = np.zeros((len(some), n.max(), K), np.float32)
            inside = np.arange(n.max()) < n[:, None]
            total = np.zeros((len(ids), K), np.float32)
            for column in ids.T:
                total += self.model.weights[column]
            scores[inside] = total
            best = viterbi(scores, n, self.model.step, self.start)
            for j, i in enumerate(some):
                labels[i] = best[j, : n[j]]
        open_span: list[tuple[int, int, int] | None] = [None] * len(texts)

        def close(i: int) -> None:
            if open_span[i] is not None:
                a, b, kind = open_span[i]
                span = checked(texts[i], a, b, KINDS[kind])
                if span and (not out[i] or span[0] >= out[i][-1][1]):
                    out[i].append((*span, KINDS[kind]))
                open_span[i] = None

        last = (-1, -1)
        for i, offset, at, lab, (low, high) in zip(owners, offsets, starts, labels, takes, strict=True):
            if (i, offset) != last:
                if last[0] >= 0:
                    close(last[0])
                last = (i, offset)
            if not lab[low:high].any():
                close(i)
                continue
            text = texts[i]
            for p in range(low, high):
                y = int(lab[p])
                if y % 2 == 1 or y == 0 or open_span[i] is None or open_span[i][2] != (y - 1) // 2:
                    close(i)
                if y:
                    a = offset + int(at[p])
                    m = _TOKEN.match(text, a)
                    open_span[i] = (open_span[i][0] if open_span[i] else a, m.end(), (y - 1) // 2)
        if last[0] >= 0:
            close(last[0])
        return out


_FOUND = pa.schema([("event_key", pa.string()), ("field_name", pa.string()), ("pii_kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64())])


def _find(model, key: str, fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for batch in batches:
            keys, out = batch[key].to_pylist(), []
            for field in fields:
                held = [(k, t) for k, t in zip(keys, batch[field].to_pylist(), strict=True) if t]
                for (k, _), spans in zip(held, tagger.spans([t for _, t in held]), strict=True):
                    out.extend((k, field, kind, a + 1, b) for a, b, kind in spans)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in _FOUND]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def _model(lexicon: DataFrame, train_rows: int = TRAIN_ROWS):
    """The trained model, sent once to every executor: at most DIM weights a label (3 MB packed), and the lexicon, whose size is checked."""
    parts = [tuple(r) for r in lexicon.where("name_part is not null and part_kind in ('given', 'family')").select("name_part", "part_kind").distinct().limit(LEXICON_LIMIT + 1).collect()]
    if len(parts) > LEXICON_LIMIT:
        raise ValueError(f"a lexicon of more than {LEXICON_LIMIT} name parts")
    return lexicon.sparkSession.sparkContext.broadcast(trained(tuple(sorted(parts)), train_rows))


def found(rows: DataFrame, lexicon: DataFrame, key: str = "event_key", fields: tuple[str, ...] = FIELDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Distinct (event_key, field_name, pii_kind, start_at, end_at): items with their first and last position, from 1, in code points.

    Null and empty texts have none; rows with a null key keep it; repeated rows give one. Lines of any length are read whole.
    """
    texts = rows.where(" or ".join(f"{f} is not null" for f in fields)).select(F.col(key).cast("string").alias(key), *fields)
    ddl = "event_key string, field_name string, pii_kind string, start_at bigint, end_at bigint"
    return texts.mapInArrow(_find(_model(lexicon, train_rows), key, fields), ddl).distinct()


def _mask(model, fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for field in fields:
                texts = columns[field].to_pylist()
                done = []
                for text, spans in zip(texts, tagger.spans([t or "" for t in texts]), strict=True):
                    for a, b, kind in reversed(spans):
                        text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
                    done.append(text)
                columns[field] = pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def masked(rows: DataFrame, lexicon: DataFrame, fields: tuple[str, ...] = FIELDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows with every item in the fields replaced by <KIND>; all other columns and characters stay. Null and empty texts stay as they are."""
    return rows.mapInArrow(_mask(_model(lexicon, train_rows), fields), rows.schema)
