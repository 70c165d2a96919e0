"""Leaks, mixing and truncation on small corpora with known answers."""

import os
import random

import numpy as np
import pytest

from turnmill.llm import leaks, mixing, truncation
from turnmill.llm.words import words

SF = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(400)]


def test_words():
    assert words("A <b>Big</b>&nbsp;dog_s **run**, 3.5!") == ["a", "big", "dog", "s", "run", "3", "5"]
    assert words(None) == words("") == []


def leaked(spark, docs, items, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, doc_id string")
    return {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in leaks.leaks(d, i, **k).collect()}


def test_leaks_against_all_windows(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(40))) for i in range(12)]
    docs, want = [], {}
    for n in range(80):
        i, p = r.choice(items)
        w = p.split()
        a, k = r.randrange(20), r.choice([5, 11, 12, 13, 20])
        dress = r.choice([str.upper, lambda t: t.replace(" ", ",  **"), lambda t: f"<p>{t}</p>"])
        docs.append((n, " ".join(r.choice(WORDS) for _ in range(30)) + " | " + dress(" ".join(w[a : a + k])) + " | " + " ".join(r.choice(WORDS) for _ in range(30)), "x"))
    for n, t, _ in docs:
        grams = {tuple(words(t)[k : k + 12]) for k in range(len(words(t)) - 11)}
        for i, p in items:
            if grams & {tuple(p.split()[k : k + 12]) for k in range(29)}:
                want[n, i] = True
    rows = [(i, p, "x") for i, p in items] * 2 + [(99, None, "x"), (98, "", "x"), (97, "too short", "x")]
    for block in (10_000, 150):
        got = leaked(spark, docs * 2 + [(500, None, "x"), (501, "", "x"), (None, docs[0][1], "x")], rows, block=block)
        assert {k for k, v in got.items() if v[0] >= 12} == set(want)


def test_substitutions_are_tolerated(spark):
    p = [f"p{i}" for i in range(30)]
    changed = list(p)
    changed[15] = "other"
    got = leaked(spark, [(1, " ".join(changed), "x")], [(1, " ".join(p), "x")])
    assert got[1, 1] == (15, 30, 1)


def test_empty_corpora(spark):
    assert leaked(spark, [], [(1, " ".join(WORDS[:20]), "x")]) == {} == leaked(spark, [(1, "a b", "x")], [])


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, bucket string")


def test_mix_meets_shares_and_caps(spark):
    r = random.Random(2)
    rows = [(i, "big" if i % 3 else r.choice(["mid", "small"]), r.randrange(0, 60), "x") for i in range(3000)]
    rows += rows[:50] + [(9000, None, 5, "x"), (None, "big", 5, "x"), (9001, "other", 5, "x"), (9002, "big", None, "x")]
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 3), ("small", 0.3, 2), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out, report = mixing.mix(sizes(spark, rows), targets)
    mix, rep = out.collect(), {x["source"]: x for x in report.collect()}
    assert [x["virtual_finish"] for x in mix] == sorted(x["virtual_finish"] for x in mix)
    assert len({(x["doc_id"], x["copy_no"]) for x in mix}) == len(mix)
    assert max(x["copy_no"] for x in mix if x["source"] == "mid") <= 3 and max(x["copy_no"] for x in mix if x["source"] == "small") <= 2
    assert rep["absent"]["actual_share"] == 0 and set(rep) == {"big", "mid", "small", "absent"}
    for s in ("big", "mid", "small"):
        assert abs(rep[s]["actual_share"] - 1 / 3) < 0.01
        assert rep[s]["tokens"] == sum(x["n_tokens"] for x in mix if x["source"] == s) and rep[s]["copies"] == sum(x["source"] == s for x in mix)
    whole = {s: sum({i: n or 0 for i, t, n, _ in rows if t == s and i is not None}.values()) for s in ("big", "mid", "small")}
    assert rep["small"]["available_tokens"] == whole["small"]
    assert min(whole["big"] - rep["big"]["tokens"], 3 * whole["mid"] - rep["mid"]["tokens"], 2 * whole["small"] - rep["small"]["tokens"]) < 60  # some source is used up
    half = len(mix) // 2  # fair at every prefix
    part = {s: sum(x["n_tokens"] for x in mix[:half] if x["source"] == s) for s in whole}
    assert max(part.values()) - min(part.values()) < 130
    small, _ = mixing.mix(sizes(spark, rows), targets, budget=600)
    assert sum(x["n_tokens"] for x in small.collect()) <= 600


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    out, report = mixing.mix(sizes(spark, []), targets)
    assert out.collect() == [] and [(r["source"], r["actual_share"]) for r in report.collect()] == [("a", 0.0)]
    out, report = mixing.mix(sizes(spark, [(1, "a", 3, "x")]), targets.limit(0))
    assert out.collect() == report.collect() == []


@pytest.mark.skipif(not os.path.isdir(mixing.TOKENIZERS), reason="no tokenizers")
def test_token_counts_are_of_whole_texts(spark):
    texts = [(1, "a", "Hello there, 你好\n\n  done"), (2, "a", ""), (3, None, None), (4, "a", "x " * 30_000)]
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.counted(spark.createDataFrame(texts, "doc_id bigint, source string, text string")).collect()}
    codec = mixing.encoding()
    assert got == {i: len(codec.encode_ordinary(t)) if t else 0 for i, _, t in texts}
    assert codec.decode(codec.encode_ordinary(texts[0][2])) == texts[0][2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_truncation_on_held_out_cuts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    known = truncation.Limits([tuple(r) for r in truncation.limits(docs).collect()])
    rows = [(r["text"], r["source"]) for r in docs.orderBy("doc_id").collect()]
    weights = truncation.fit(rows[::2], known)
    score = lambda t, s: weights[truncation._row(t, known.near(s, len(t), len(t.encode())))].sum() > 0
    rng = random.Random(5)
    whole = [(t, s) for t, s in rows[1::2] if t.rstrip()[-1:] in ".?!。？" and t.count("```") % 2 == 0]
    cut = [(h, s) for t, s in whole if (h := truncation.cut_somewhere(t, rng, []))]
    assert np.mean([score(t, s) for t, s in cut]) > 0.93 and np.mean([score(t, s) for t, s in whole]) < 0.03


def test_truncation_of_odd_rows(spark):
    rows = [(1, None, "a", 0.1), (2, "", "a", 0.1), (3, "  ", None, 0.1), (4, "A whole sentence. " * 9, None, 0.1), (None, "Another one here.", "a", 0.1), (4, "A whole sentence. " * 9, None, 0.1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    got = truncation.scored(df).collect()
    assert len(got) == 6 and not any(r["is_cut"] for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["source"]: r["documents"] for r in truncation.rates(truncation.scored(df)).collect()} == {"a": 3, None: 3}
    assert truncation.scored(df.limit(0)).collect() == []


def test_limits_are_found(spark):
    rows = [(i, f"{i} ".ljust(200 if i % 4 == 0 else 20 + (i * 37) % 400, "x"), "s", 1) for i in range(400)]
    got = {tuple(r) for r in truncation.limits(spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int")).collect()}
    assert {("s", "chars", 200), ("s", "bytes", 200)} == got


def test_copies_and_templates_are_no_limits(spark):
    long = [(i, f"{i} ".ljust(60 + (i * 37) % 400, "x"), "s") for i in range(400)]
    copies = [(1000 + i, "the same text over and over again", "s") for i in range(300)]
    heads = [(2000 + i, f"{k}({s}): {d}", "s") for i, (k, s, d) in enumerate((k, s, d) for k in ("fix", "feat", "docs", "test", "perf") for s in ("lane", "fold", "seal", "watch", "panel") for d in ("split the large import", "wait for the quiet period", "add a guard for null keys"))]
    df = spark.createDataFrame(long + copies + heads * 3, "doc_id bigint, text string, source string")
    assert truncation.limits(df).collect() == []


def test_byte_tolerance_is_for_texts_of_several_bytes_a_character():
    known = truncation.Limits([("s", "bytes", 100)])
    assert known.near("s", 100, 100)[1] and not known.near("s", 98, 98)[1] and known.near("s", 97, 98)[1] and not known.near("s", 99, 101)[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_complete_texts_without_punctuation_are_not_cut(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").where("text is not null")
    got = docs.join(truncation.scored(docs).select("doc_id", "is_cut"), "doc_id").collect()
    # Headlines of commits, links and finished list items end without punctuation.
    heads = [r for r in got if r["source"] == "commit-message" and "\n" not in r["text"] and len(r["text"]) < 60]
    links = [r for r in got if r["text"].splitlines()[-1].startswith(("See http", "Status: "))]
    assert len(heads) > 20 and len(links) > 5
    assert np.mean([r["is_cut"] for r in heads]) < 0.05 and np.mean([r["is_cut"] for r in links]) < 0.1


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.isdir(mixing.TOKENIZERS), reason="no test tables")
@pytest.mark.parametrize("rows_a_bucket", [16, 4096])
def test_mix_of_the_tables_is_the_queue_served_in_turn(spark, monkeypatch, rows_a_bucket):
    """Every copy, its place and the shares, against a plain simulation of the queues."""
    import math

    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_a_bucket)
    folder = SF.replace("0.001", "0.01")
    counted = mixing.counted(spark.read.parquet(f"{folder}/documents.parquet"))
    goal = {r["source"]: r for r in spark.read.parquet(f"{folder}/mixture_targets.parquet").collect()}
    out, report = mixing.mix(counted, spark.read.parquet(f"{folder}/mixture_targets.parquet"))
    rows = counted.where("n_tokens > 0").withColumn("place", F.xxhash64(F.lit(17), "doc_id")).withColumn("high", F.shiftrightunsigned("place", 40)).collect()
    rows = [r for r in rows if r["source"] in goal]
    buckets = math.ceil(len(rows) / rows_a_bucket)
    total = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in goal}
    held = {s for s in goal if total[s]}
    weight = {s: goal[s]["target_share"] / sum(goal[x]["target_share"] for x in held) for s in held}
    budget = min(goal[s]["max_repeats"] * total[s] / weight[s] for s in held)
    want = {}
    for s in held:
        at = 0
        for copy in range(1, goal[s]["max_repeats"] + 1):
            for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["high"] % buckets, r["place"], r["doc_id"])):
                at += r["n_tokens"]
                if at <= budget * weight[s] + 1e-6:
                    want[r["doc_id"], copy] = at / weight[s]
    got = {(r["doc_id"], r["copy_no"]): r["virtual_finish"] for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    for r in report.collect():
        assert abs(r["actual_share"] - weight.get(r["source"], 0)) < 0.01
