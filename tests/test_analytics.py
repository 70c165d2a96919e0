"""Joins, windows, delivery edges, rollups, pages and lifecycle against brute force and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from turnmill.operators import analyses as an
from turnmill.operators import delivery, evidence, joins, lifecycle, query, rollups, search, usage, windows
from turnmill.operators.predicate import InvalidQuery
from turnmill.sources.versions import VersionedTable


def collected(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_numbers_and_runs_do_not_depend_on_stretches(spark, stretch):
    r = random.Random(stretch)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(40)]), i, r.choice(["x", "x", "y", None]), r.choice([None, 1, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "e string, n bigint, k int, v string, s int")
    want_numbers, want_runs = set(), {}
    for e in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == e), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        total, run = 0, -1
        for n, x in enumerate(own, 1):
            total += x[4] or 0
            want_numbers.add((e, x[2], n, len(own), total))
            run += n == 1 or own[n - 2][3] != x[3]
            want_runs[e, run, x[3]] = want_runs.get((e, run, x[3]), 0) + 1
    got = windows.numbered(df, ["e"], ["n", "k"], "s", stretch).select("e", "k", "row_no", "row_count", "end_size")
    assert set(collected(got)) == want_numbers and got.count() == len(rows)
    runs = windows.run_lengths(df, "e", ["n", "k"], "v", stretch).select("e", "run_no", "v", "length")
    assert {(e, n, v): k for e, n, v, k in collected(runs)} == want_runs
    assert windows.numbered(df.limit(0), ["e"], ["n", "k"]).collect() == [] == windows.run_lengths(df.limit(0), "e", ["n", "k"], "v").collect()


@pytest.mark.parametrize("bucket", [3, 50, 10**9])
def test_nearest_in_time(spark, bucket, monkeypatch):
    r = random.Random(bucket)
    left = [(f"l{i}", r.choice("ab"), a, a + r.randrange(12)) for i in range(60) for a in [r.randrange(100)]] + [("none", "c", 1, 2), ("open", "a", 1, None)]
    right = [(r.choice("ab"), r.choice([None, *range(120)]), f"r{i:02d}") for i in range(40)] * 2
    df = spark.createDataFrame(left, "l string, k string, start bigint, end bigint")
    pts = spark.createDataFrame(right, "k string, at bigint, id string")
    want = set()
    for name, k, a, b in left:
        own = [(0 if a <= t <= b else 1, abs(t - b), i) for kk, t, i in right if kk == k and t is not None] if b is not None else []
        if own:
            out, _, i = min(own)
            want.add((name, i, min(max(a - t, t - b, 0) for kk, t, j in right if kk == k and t is not None and j == i), 1 - out))
    real = joins.beside
    monkeypatch.setattr(joins, "beside", lambda *a: real(*a, bucket_us=bucket))
    got = joins.nearest_in_time(df, pts, ["k"], "at", "start", "end", "id").select("l", "id", "gap", "in_window")
    assert set(collected(got)) == want and got.count() == len(want)


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_unique_overlap(spark, hot):
    r = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    left = [(f"l{i}", w) for i in range(30) for w in r.sample(words, r.randrange(1, 6))] + [(None, "w1"), ("l1", None)]
    right = [(f"r{i}", w) for i in range(12) for w in r.sample(words, r.randrange(1, 7))]
    want = set()
    for a in {x for x, _ in left if x}:
        mine = {w for x, w in left if x == a and w}
        score = sorted(((len(mine & {w for y, w in right if y == b}), b) for b in {y for y, _ in right}), reverse=True)
        if score[0][0] >= 2 and (len(score) == 1 or score[1][0] < score[0][0]):
            want.add((a, score[0][1], score[0][0]))
    got = joins.unique_overlap(spark.createDataFrame(left * 2, "l string, t string"), spark.createDataFrame(right * 2, "r string, t string"), "l", "r", "t", hot=hot)
    assert set(collected(got)) == want and want


def rows_of(plan):
    """The most rows that an operator of a plan that has run gave."""
    name = plan.nodeName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
    return max([own, *map(rows_of, below)])


@pytest.mark.parametrize(("sets", "bitmaps"), [(131_072, 1 << 27), (90, 1 << 27), (400, 100)])
def test_overlap_of_common_words_makes_no_pairs(spark, monkeypatch, sets, bitmaps):
    """300 sets on each side of 4 to 9 of 12 words, some with words of their own: 90,000 pairs, which share more than one word each."""
    monkeypatch.setattr(joins, "RIGHT_SETS", sets)
    monkeypatch.setattr(joins, "BITMAPS", bitmaps)
    r = random.Random(11)
    some = lambda side, i: [*r.sample([f"w{k}" for k in range(12)], r.randrange(4, 10)), *([f"own{i}"] if i % 9 == 0 else []), f"{side}-only"]
    left, right = ({i: set(some(side, i)) for i in range(300)} for side in "ab")
    want = set()
    for i, mine in left.items():
        score = sorted(((len(mine & theirs), j) for j, theirs in right.items()), reverse=True)
        if score[0][0] >= 2 and score[1][0] < score[0][0]:
            want.add((i, score[0][1], score[0][0]))
    a, b = (spark.createDataFrame([(i, w) for i, ws in side.items() for w in ws], f"{n} bigint, t string") for n, side in (("l", left), ("r", right)))
    got = joins.unique_overlap(a, b, "l", "r", "t", hot=20)
    assert set(collected(got)) == want and len(want) > 10
    assert rows_of(got._jdf.queryExecution().executedPlan()) < 20_000


def test_edges_are_classified(spark):
    cases = [(1, 1, 1, 1, 3, 9), (0, 1, 1, 1, 3, 9), (0, 0, 1, 1, 3, 9), (0, 0, 0, 1, 3, 9), (0, 0, 0, 1, 3, 1), (0, 0, 0, 0, 3, 9), (0, 0, 1, 1, 0, 1), (None, None, None, None, None, None)]
    names = ["hash_observed", "prefix_unique", "in_window", "words_unique", "path_overlap", "word_overlap"]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"{n} int" for n in names))
    got = {r["i"]: (r["strength"], r["source"]) for r in delivery.classified(df).collect()}
    assert got == {
        0: ("direct", "observed-git-result"), 1: ("observed", "unique-hash-prefix"), 2: ("observed", "ordered-exact-path-overlap"), 3: ("candidate", "unique-text-overlap"), 4: ("contextual", "same-file-history"), 5: ("contextual", "same-file-history"),
    }


def edges(spark, mentions=(), paths=(), words=(), commits=(), files=(), summaries=()):
    f = spark.createDataFrame
    return delivery.session_commits(
        f(list(mentions), "repo string, session string, hash string"), f(list(paths), "repo string, session string, path string, first_at bigint, last_at bigint"), f(list(words), "repo string, session string, term string"), f(list(commits), "repo string, commit string"),
        f(list(files), "repo string, commit string, path string, at bigint"), f(list(summaries), "repo string, commit string, term string"),
    )


def test_edges_of_sessions_and_commits(spark):
    a, b, c = "a" * 40, "ab" * 20, "c" * 40
    got = edges(
        spark, mentions=[("r", "s1", a), ("r", "s2", "ababab1"), ("r", "s2", b[:8]), ("r", "s3", "a" * 7), ("q", "s1", b), ("r", None, None)] * 2, paths=[("r", "s4", "x.py", 10, 20), ("r", "s5", "x.py", 90, 95)],
        words=[("r", "s6", t) for t in ("lock", "quota", "seal")] + [("r", "s7", "lock"), ("q", "s6", "seal")], commits=[("r", a), ("r", b), ("r", c)] * 2, files=[("r", b, "x.py", 15), ("r", c, "x.py", 60), ("r", c, "x.py", None)], summaries=[("r", c, "lock"), ("r", c, "quota"), ("q", a, "seal")],
    )
    assert {(r["session"], r["commit"][0:2], r["strength"]) for r in got.collect()} == {("s1", "aa", "direct"), ("s2", "ab", "observed"), ("s3", "aa", "observed"), ("s4", "ab", "observed"), ("s5", "cc", "contextual"), ("s6", "cc", "candidate")}
    assert edges(spark).collect() == []
    turns = spark.createDataFrame([("t1", "s1", "p"), ("t4", "s4", None), ("t8", "s8", "p"), ("t9", None, "z")], "turnKey string, session string, project string")
    assert dict(collected(delivery.attribution(turns, got, spark.createDataFrame([("p",)], "project string")))) == {"t1": "direct", "t4": "observed", "t8": "none", "t9": "uncovered"}


def test_traces(spark):
    rows = [("session", "s", "commit", f"c{i}", "x", "direct" if i % 2 else "candidate", i) for i in range(6)] + [("turn", "t", "session", "s", "y", "direct", None)]
    e = spark.createDataFrame(rows, "from_kind string, from_key string, to_kind string, to_key string, relation string, strength string, observed_at bigint")
    roots = spark.createDataFrame([("session", "s"), ("session", "none"), ("session", None)], "root_kind string, root_key string")
    got = lambda **k: [(r["direction"], r["to_key"], r["more"]) for r in delivery.trace(e, roots, **k).orderBy("position").collect()]
    assert got(most=2) == [("out", "c5", 1), ("out", "c4", 1)] and got(direction="in") == [("in", "s", 0)]
    assert got(strengths=["direct"], window=(1, 5)) == [("out", "c3", 0), ("out", "c1", 0)]
    with pytest.raises(ValueError):
        delivery.trace(e, roots, "sideways")
    assert sorted(collected(delivery.replaced(roots, spark.createDataFrame([("session", "new")], roots.schema), "root_kind"))) == [("session", "new")] and delivery.replaced(None, roots, "root_kind") is roots


def test_rollups_equal_the_rows(spark):
    r = random.Random(1)
    day = rollups.DAY_US
    rows = [(r.choice(["a", None]), r.choice("xyz"), r.choice([None, r.randrange(9 * day)]), r.choice([None, 1, 2**62]), r.choice([None, "m", "n"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, j string, observedAt bigint, v bigint, m string")
    for keys in (["k", "j"], ["k"], []):
        got = rollups.merged(rollups.day_counts(df, ["k", "j"], "observedAt", ["v"]), {"m": rollups.day_members(df, ["k", "j"], "observedAt", "m")}, keys, ["v"], (2, 7))
        inside = df.where((F.col("observedAt") >= 2 * day) & (F.col("observedAt") < 7 * day))
        want = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v_sum"), F.count("v").alias("v_present"), F.count_distinct("m").alias("ms"))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    request = {"shape": {"kind": "aggregate", "groupBy": ["k"], "metrics": [{"name": "n", "op": "count"}]}, "where": {"field": "observedAt", "op": "between", "value": [day, 3 * day]}}
    assert rollups.serves(request, {"k": "k"}, {}) == (1, 3)
    for change in ({"where": {"field": "observedAt", "op": "between", "value": [day, 3 * day + 1]}}, {"where": None}, {"shape": request["shape"] | {"groupBy": ["z"]}}, {"shape": request["shape"] | {"metrics": [{"name": "d", "op": "distinct-count", "field": "k"}]}}):
        assert rollups.serves(request | change, {"k": "k"}, {}) is None


def test_pages_of_usage_go_on_behind_a_row(spark):
    r = random.Random(2)
    rows = [(f"c{i:02d}", r.randrange(3), r.randrange(3), r.randrange(2), r.choice([None, 5, 6]), r.randrange(-3, 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "capabilityKey string, invocations bigint, turns bigint, sessions bigint, lastUsedAt bigint, change bigint").withColumns({"failed": F.col("invocations"), "groups": F.col("turns")})
    for by in usage.ORDERS:
        order = usage.usage_order(by)
        whole = [x["capabilityKey"] for x in df.orderBy(*order).collect()]
        seen, where = [], F.lit(True)
        while True:
            page = usage.page(df.where(where).withColumn("metric", usage.ORDERS[by]()), order, 15).orderBy("position").collect()
            seen += [x["capabilityKey"] for x in page]
            assert {x["more"] for x in page} == {int(len(seen) < 40)}
            if len(seen) >= 40:
                break
            where = usage.behind(by, page[-1].asDict())
        assert seen == whole
    with pytest.raises(ValueError):
        usage.usage_order("luck")


def test_guards(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(20)] + [(None, "x")], "at bigint, k string")
    assert [r["at"] for r in query.newest(df, "at", ["k"], (5, 9)).collect()] == [8, 7, 6, 5]
    for window, most in (((5, 9), 3), ((9, 5), 99), ((0, 400 * 86_400_000_000), 99)):
        with pytest.raises(query.BudgetExceeded):
            query.newest(df, "at", ["k"], window, most)
    for bad in ({"providers": []}, {"providers": ["b", "a"]}, {"providers": ["a", "a"]}, {"window": [2, 1]}, {"nothing": ["a"]}, {"providers": [1]}):
        with pytest.raises(InvalidQuery):
            query.validate_filters(bad)
    with pytest.raises(InvalidQuery):
        query.validate_filters({"turnKeys": ["a"]}, allowed={"providers"})
    hidden = spark.createDataFrame([("s",)], "sessionKey string")
    rows = spark.createDataFrame([("s", "active"), ("t", "active"), ("t", "rolled-back"), (None, "active")], "sessionKey string, v string")
    assert sorted(map(str, collected(query.visible(rows, hidden, visibility="v")))) == ["('t', 'active')", "(None, 'active')"]


def test_head_and_tail_budgets(spark):
    r = random.Random(5)
    for _ in range(6):
        fields = {n: [f"{n}{i}" for i in range(r.randrange(7))] for n in ("p", "q", "z")}
        head, tail = r.randrange(1, 5), r.randrange(1, 5)
        left = {n: list(range(len(v))) for n, v in fields.items()}
        took = []
        for k, pop in ((head, 0), (tail, -1)):
            while k and any(left.values()):
                for n in fields:
                    if left[n] and k:
                        took.append((n, left[n].pop(pop)))
                        k -= 1
        df = spark.createDataFrame([tuple(fields.values())], "p array<string>, q array<string>, z array<string>")
        got = df.select(F.explode(search.head_tail({n: F.col(n) for n in fields}, head, tail)).alias("x")).select("x.field", F.col("x.place") - 1, "x.item")
        assert sorted(collected(got)) == sorted((n, i, fields[n][i]) for n, i in took)
    none = spark.createDataFrame([(None, ["a"])], "p array<string>, q array<string>").select(search.head_tail({"p": F.col("p"), "q": F.col("q")}, 2, 2).alias("x")).first()["x"]
    assert [(x["field"], x["item"]) for x in none] == [("q", "a")]


def test_search_of_turns(spark):
    turns = [(f"t{i}", i, "common words here") for i in range(20)] + [("a", 5, "Seal the lane.quota now"), ("b", 7, "seal the lane.quota now"), ("c", None, None), ("d", 1, "quota")]
    df = spark.createDataFrame(turns, "turnKey string, observedAt bigint, problem string")
    names = spark.createDataFrame([("d", "seal_tool"), ("d", "seal_tool"), (None, "x"), ("a", None)], "turnKey string, capabilityName string")
    got = [r["turnKey"] for r in search.search_turns(df, names, "seal lane.quota", "the lane").orderBy("position").collect()]
    assert got[:2] == ["a", "b"] or got[:2] == ["b", "a"]
    assert set(got) == {"a", "b", "d"} and "d" in {r["turnKey"] for r in search.search_turns(df, names, "seal_tool").collect()}
    assert search.search_turns(df, names, "absent").collect() == [] and search.search_turns(df.limit(0), names, "seal").collect() == []
    with pytest.raises(ValueError):
        search.search_turns(df, names, "?")


def test_recall_takes_each_document_once(spark):
    lists = [spark.createDataFrame([(d, i + 1) for i, d in enumerate(x)], "id string, rank int") for x in (["a", "b", "c"], ["x", "b", "y"])]
    got = search.recall([("p", lists[0]), ("q", lists[1])], "id", 4).orderBy("position").collect()
    assert [(r["id"], r["list"]) for r in got] == [("a", "p"), ("x", "q"), ("b", "p"), ("c", "p")]


def test_sources_come_and_go(spark):
    old = spark.createDataFrame([("same", 3, "h"), ("longer", 3, "h"), ("other", 3, "h"), ("gone", 3, "h"), ("out", 3, "h"), ("short", 3, "h")], "source string, size bigint, head string")
    new = spark.createDataFrame([("same", 3, "h", False), ("longer", 5, "h", None), ("other", 5, "x", False), ("fresh", 1, "z", False), ("out", 3, "h", True), ("short", 2, "h", False)], "source string, size bigint, head string, excluded boolean")
    assert dict(collected(lifecycle.classify_changes(old, new))) == {"same": "unchanged", "longer": "append", "other": "replace", "gone": "missing", "fresh": "new", "out": "excluded", "short": "replace"}
    commands = [("a", 1, "exclude"), ("a", 2, "include"), ("b", 3, "exclude"), ("b", 2, "include"), ("c", 1, "purge"), ("c", 9, "include"), (None, 1, "purge")]
    states = lifecycle.source_states(spark.createDataFrame(commands * 2, "sessionKey string, sequence int, command string"))
    assert dict(collected(states)) == {"a": "visible", "b": "hidden", "c": "purged"}


def test_purging_and_rebuilding(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["sessionKey"], 3)
    states = spark.createDataFrame([("a", "purged"), ("b", "hidden")], "sessionKey string, state string")
    assert lifecycle.purge(table, states, "sessionKey") is False
    table.write(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sessionKey string, n int"))
    assert lifecycle.purge(table, states, "sessionKey") is True and sorted(collected(table.read())) == [("b", 2), ("c", 3)]
    assert lifecycle.purge(table, states, "sessionKey") is False and len(list((tmp_path / "t").glob("v=*"))) == 1
    logs = [[("o", 1), ("p", 2)], [("o", 1), ("p", 2)], [("o", 1), ("p", 2), ("o", 3)]]  # the log grows while the projection is made
    log = lambda: spark.createDataFrame(logs[0] if len(logs) == 1 else logs.pop(0), "owner string, seq bigint")
    out = lifecycle.rebuilt(VersionedTable(spark, str(tmp_path / "p"), ["owner"], 2), log, lambda rows: rows.groupBy("owner").agg(F.count(F.lit(1)).alias("n")), "owner", "seq")
    assert sorted(collected(out)) == [("o", 2), ("p", 1)]


def test_documents_and_transcripts(spark):
    rows = [("s", 0, "message", "user", 'a "b"\n'), ("s", 1, "tool", None, None), ("s", 2, "tool", None, "x"), ("s", 3, "message", None, None), ("s", 4, "tool", None, None), (None, 0, "message", "user", "x")]
    df = spark.createDataFrame(rows, "s string, n int, kind string, role string, text string")
    docs = lifecycle.documents(df, "s", "n", ["role", "text"], 2)
    assert sorted(map(str, collected(lifecycle.imported(docs, "s", "n", ["role", "text"])))) == sorted(map(str, [(s, n, r, t) for s, n, _, r, t in rows]))
    assert lifecycle.imported(docs.withColumn("document", F.lit("no json")), "s", "n", ["role"]).collect() == []
    got = {(r["s"], r["page_no"]): r["body"] for r in lifecycle.transcript(df.where("s is not null"), "s", "n", "kind", "role", "text", 100).collect()}
    assert got == {("s", 0): 'user: a "b"\n\n[2 other entries]\n?: \n[1 other entries]'}


def test_heat_states_and_gaps(spark):
    ops = spark.createDataFrame([("a", "create", None), ("a", "update", None), ("b", "create", None), ("m", "merge", ["a", "b", "a", "none"]), ("e", "merge", None)], "scene string, op string, merged array<string>")
    assert dict(collected(lifecycle.heat(ops))) == {"a": 2, "b": 1, "m": 4, "e": 1}
    rows = spark.createDataFrame([("k", 0), ("k", 600), ("k", 5000), ("j", None)], "k string, s bigint").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(r["n"] for r in lifecycle.gap_sessions(rows, "k", "at", "20 minutes").collect()) == [1, 2]
    e = spark.createDataFrame([("s", 1, "x", "ok"), ("s", 2, "x", None), ("s", 3, "x", "bad"), ("s", 2, "y", None)], "s string, n int, tool string, st string")
    assert collected(evidence.state_as_of(e, "s", ["n", "tool"], "tool", F.col("st"), 3)) == [("s", "x", "ok")]
    kept = an.capped(e, "s", ["n", "tool"], F.col("st") == "bad", 1, 1).select("n", "tool", "part").collect()
    assert {(r["n"], r["tool"], r["part"]) for r in kept} == {(3, "x", "priority"), (1, "x", "head"), (2, "y", "tail")}
