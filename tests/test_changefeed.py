"""The fold against brute force, on hand-written feeds and random ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnmill.operators import changefeed as cf

C = "session_key string, generation string, expected_generation string, delta_id string, delta_mode string, turn_keys array<string>, received_at timestamp, rank int"
U = "session_key string, delta_id string, upsert_no int, turn_key string, revision string, change string"
T0 = datetime(2026, 1, 1)


def brute(commits, upserts):
    out = set()
    for s in {c[0] for c in commits if c[0] is not None}:
        win = {}
        for c in sorted((c for c in commits if c[0] == s and c[1] and c[2] and c[1].strip().isdigit() and c[2].strip().isdigit() and c[3]), key=lambda c: (c[6] or datetime.max, c[3])):
            win.setdefault(int(c[2]), c)
        at, seen, done, turns = 0, set(), set(), {}
        while at in win and at not in seen:
            seen.add(at)
            c = win[at]
            if c[3] in done:
                break
            done.add(c[3])
            if c[4] == "replace-session":
                turns = {}
            for k in c[5] or []:
                turns.pop(k, None)
            for u in sorted({u for u in upserts if u[0] == s and u[1] == c[3] and u[3] is not None}, key=lambda u: (u[2], u[4] or "")):
                turns[u[3]] = (u[1], u[4])
            at = int(c[1])
        out |= {(s, k, *v) for k, v in turns.items()}
    return out


def held(spark, commits, upserts):
    return {tuple(r) for r in cf.held_turns(spark.createDataFrame(commits, C), spark.createDataFrame(upserts, U)).collect()}


def feed(seed, top):
    r = random.Random(seed)
    commits, upserts = [], []
    for s in "ab":
        at = 0
        for n in range(r.randrange(4, 12)):
            to = at + r.choice([1, 1, 1, 2, top])
            d = f"{s}{n}"
            row = (s, r.choice([str(to), f"00{to}", f" {to}"]), str(at), d, r.choice(["append"] * 5 + ["replace-session"]), r.choice([None, [], [f"t{r.randrange(5)}"]]), T0 + timedelta(minutes=r.randrange(99)), n)
            commits += [row] * r.choice([1, 1, 2])
            if r.random() < 0.3:  # a rival
                commits.append((s, str(to + 1), str(at), d + "x", "append", None, T0 + timedelta(minutes=r.randrange(99)), n))
            for k in range(r.randrange(3)):
                upserts += [(s, d, k, f"t{r.randrange(5)}", f"r{n}{k}", "x")] * r.choice([1, 2])
            if r.random() < 0.9:
                at = to
    r.shuffle(commits)
    return commits, upserts


@pytest.mark.parametrize("seed", range(3))
def test_random_feeds(spark, seed):
    commits, upserts = feed(seed, 3)
    assert held(spark, commits, upserts) == brute(commits, upserts)


def test_long_streams_are_walked_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(cf, "CHUNK", 3)
    commits, upserts = feed(11, 7)
    commits += [("a", "1", str(max(int(c[1]) for c in commits if c[0] == "a")), "back", "append", None, T0, 0)]  # a way back
    assert held(spark, commits, upserts) == brute(commits, upserts)


def test_nulls_bad_numbers_and_empty_tables(spark):
    commits = [("a", None, "0", "d0", "append", None, T0, 1), ("a", "x", "0", "d1", "append", None, T0, 1), (None, "1", "0", "d2", "append", None, T0, 1), ("a", "1", "0", "d3", "append", ["t"], None, 1), ("a", "1", "0", None, None, None, T0, 1)]
    upserts = [("a", "d3", 0, "t", None, ""), ("a", "d3", 0, None, "r", ""), ("a", "lost", 0, "t", "r", "")]
    assert held(spark, commits, upserts) == {("a", "t", "d3", None)}
    assert held(spark, [], []) == set()
    assert held(spark, commits, []) == set()


def test_fold_is_commutative_idempotent_and_keeps_tombstones(spark):
    rows = [("k", 1, cf.UPSERT, "a"), ("k", 3, cf.DELETE, None), ("k", 2, cf.UPSERT, "b"), ("j", None, cf.UPSERT, "n"), ("j", 1, cf.UPSERT, "m"), (None, 1, cf.UPSERT, "z")]
    df = spark.createDataFrame(rows, "k string, seq int, op int, v string")
    whole = cf.fold(df, ["k"], ["seq"], ["v"])
    parts = cf.fold(df.where("seq <> 3"), ["k"], ["seq"], ["v"], base=cf.fold(df.where("seq >= 2 or seq is null"), ["k"], ["seq"], ["v"]))
    parts = cf.fold(df, ["k"], ["seq"], ["v"], base=parts)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(whole) == key(parts)
    assert {tuple(r) for r in cf.current(whole, ["k"], ["v"]).collect()} == {("j", "m"), (None, "z")}
    late = spark.createDataFrame([("k", 2, cf.UPSERT, "late")], "k string, seq int, op int, v string")
    assert cf.current(cf.fold(late, ["k"], ["seq"], ["v"], base=whole), ["k"], ["v"]).where(F.col("k") == "k").isEmpty()


@pytest.mark.parametrize("chunk", [4096, 3, 1])
def test_a_chain_ends_where_a_delta_comes_again(spark, monkeypatch, chunk):
    monkeypatch.setattr(cf, "CHUNK", chunk)
    line = lambda s, at, d, mode="append", keys=None: (s, str(at + 1), str(at), d, mode, keys, T0, 0)
    commits = [line("a", 0, "d0"), line("a", 1, "d1"), line("a", 2, "d0"), line("a", 3, "d2", "replace-session"), line("a", 4, "d3")]
    commits += [line("b", 0, "e0"), line("b", 1, "e1", "replace-session"), *(line("b", k, f"e{k}") for k in range(2, 7)), line("b", 7, "e3"), line("b", 8, "e8", "replace-session"), line("b", 9, "e9", "append", ["t4"])]
    upserts = [("a", f"d{k}", 0, f"t{k}", f"r{k}", "x") for k in range(4)] + [("b", f"e{k}", 0, f"t{k}", f"r{k}", "x") for k in range(10)]
    want = brute(commits, upserts)
    assert {w[1] for w in want} == {"t0", "t1", "t2", "t3", "t4", "t5", "t6"} and held(spark, commits, upserts) == want


def repeating(seed):
    """Feeds in which deltas come again at other generations, before and behind replacements and in other chunks."""
    r = random.Random(seed)
    commits, upserts = [], []
    for s in (f"s{k}" for k in range(12)):
        at, ids = 0, []
        for n in range(r.randrange(2, 14)):
            to = at + r.choice([1, 1, 1, 3, 5])
            d = r.choice(ids) if ids and r.random() < 0.25 else f"{s}-{n}"
            ids.append(d)
            commits += [(s, str(to), str(at), d, r.choice(["append", "append", "replace-session"]), r.choice([None, [f"t{r.randrange(4)}"]]), T0 + timedelta(minutes=r.randrange(99)), n)] * r.choice([1, 2])
            upserts += [(s, d, k, f"t{r.randrange(4)}", f"r{n}{k}", "x") for k in range(r.randrange(3))]
            at = r.choice([at, to, to, to, to])
    return commits, list({(u[0], u[1], u[2]): u for u in upserts}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_every_chunk_size_and_the_sql_agree_on_repeated_deltas(spark, monkeypatch, tmp_path, seed):
    import duckdb

    from turnmill.plans import p1

    commits, upserts = repeating(seed)
    want = brute(commits, upserts)
    for chunk in (2, 4096):
        monkeypatch.setattr(cf, "CHUNK", chunk)
        assert held(spark, commits, upserts) == want
    db = duckdb.connect()
    for name, rows, ddl in (("session_commits", commits, C), ("turn_upserts", upserts, U)):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / name))
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    assert set(db.execute(p1.SQL["p1_found"]).fetchall()) == want
