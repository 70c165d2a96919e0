"""Forests against brute force, with every chunk size giving the same answer."""

import random

import numpy as np
import pytest

from turnmill.operators import gitgraph
from turnmill.operators import hierarchy as h

N = "repository_id string, object_id string, parent_object_ids_json string, committer_timestamp timestamp, chunk int"
R = "repository_id string, object_id string, top string"


def brute(rows, refs):
    import json

    parents = {}
    for ns, o, p, *_ in rows:
        if ns is None or o is None:
            continue
        try:
            ps = [x for x in json.loads((p or "[]").lower()) if x and x.strip()]
        except ValueError:
            ps = []
        parents[ns, o.lower()] = ps
    out, hit = set(), set()
    todo = [(a, b.lower()) for a, b, *_ in refs if a is not None and b is not None and (a, b.lower()) in parents]
    while todo:
        k = todo.pop()
        if k not in hit:
            hit.add(k)
            todo += [(k[0], p) for p in parents[k] if (k[0], p) in parents]
    for k in parents:
        path, seen = [k], {k: 0}
        while True:
            ps = parents[path[-1]]
            nxt = (k[0], ps[0]) if ps else None
            if nxt is None or nxt not in parents:
                root, depth = path[-1][1], len(path) - 1
                break
            if nxt in seen:
                root, depth = min(x[1] for x in path[seen[nxt] :]), -1
                break
            seen[nxt] = len(path)
            path.append(nxt)
        out.add((*k, root, depth, int(k in hit)))
    return out


def graph(seed):
    r = random.Random(seed)
    ids = [f"{i:03x}" for i in r.sample(range(900), 60)]
    rows = []
    for ns in "pq":
        for i, o in enumerate(ids):
            ps = [r.choice(ids[:i]) for _ in range(r.choice([1, 1, 1, 2]))] if i and r.random() < 0.9 else []
            if r.random() < 0.08:
                ps = [r.choice(ids)]
            text = r.choice(["", None, "[ ]", "[]"]) if not ps else str(ps).replace("'", '"').upper() if r.random() < 0.2 else str(ps).replace("'", '"')
            rows += [(ns, o, text, None, 1)] * r.choice([1, 1, 2])
    refs = [(ns, r.choice(ids).upper(), "x") for ns in "pq" for _ in range(2)] + [("p", "absent", "x"), (None, None, None)]
    return rows, refs


@pytest.mark.parametrize(("seed", "chunk"), [(1, 7), (1, 1000), (2, 10)])
def test_forest(spark, seed, chunk):
    rows, refs = graph(seed)
    got = gitgraph.commit_forest(spark.createDataFrame(rows, N), spark.createDataFrame(refs, R), chunk).collect()
    assert {tuple(r) for r in got} == brute(rows, refs)
    assert len(got) == len({(r[0], r[1]) for r in rows})


def test_empty_null_and_broken(spark):
    void = spark.createDataFrame([], N), spark.createDataFrame([], R)
    assert gitgraph.commit_forest(*void).collect() == []
    odd = [("p", "a", "{broken", None, 1), ("p", "b", '["a", null, " "]', None, 1), ("p", None, None, None, 1), (None, "c", None, None, 1), ("p", "d", '["D"]', None, 1)]
    got = {tuple(r) for r in gitgraph.commit_forest(spark.createDataFrame(odd, N), spark.createDataFrame([], R)).collect()}
    assert got == {("p", "a", "a", 0, 0), ("p", "b", "a", 1, 0), ("p", "d", "d", -1, 0)}


def test_local_forest_finds_cycles():
    top, off, _, cyclic = h.local_forest(np.array([-1, 0, 1, 4, 5, 3, 3]), np.arange(7))
    assert list(top) == [0, 0, 0, 3, 3, 3, 3] and list(off[:3]) == [0, 1, 2] and list(cyclic) == [False] * 3 + [True] * 4


def test_paths_and_descendants(spark):
    chain = [("p", f"{i:03d}", f'["{i - 1:03d}"]' if i else None, None, 1) for i in range(50)]
    local = h.forest(gitgraph.commit_nodes(spark.createDataFrame(chain, N)), 9)
    index = h.cut(h.path_index(local))
    asked = spark.createDataFrame([("p", "047"), ("p", "000")], "ns string, id string")
    assert {r["id"]: r["path"] for r in h.full_paths(index, asked).collect()} == {"047": [f"{i:03d}" for i in range(48)], "000": ["000"]}
    below = h.descendants_of(index, spark.createDataFrame([("p", "020")], "ns string, id string")).collect()
    assert {r["descendant"] for r in below} == {f"{i:03d}" for i in range(21, 50)}
    assert {r["id"]: r["descendants"] for r in index.collect()} == {f"{i:03d}": 49 - i for i in range(50)}
    assert max(len(r["segment"]) for r in index.collect()) < h.SEGMENT


def ways_up(rows):
    """The way up of each commit until there is no parent or one would come again, by brute force."""
    import json

    parents = {(ns, o.lower()): [x for x in json.loads((p or "[]").lower()) if x.strip()] for ns, o, p, *_ in rows}
    out = {}
    for ns, o in parents:
        way, at = [], o
        while at is not None and (ns, at) in parents and at not in way:
            way.append(at)
            at = (parents[ns, at] or [None])[0]
        out[ns, o] = way
    return out


# Cycles of three with a tail each: over 7, 10 and 2 rows a chunk they lie in one chunk or in several.
@pytest.mark.parametrize(("seed", "chunk"), [(1, 7), (1, 1000), (2, 10), (2, 2)])
def test_every_path_and_every_descendant(spark, seed, chunk):
    rows, _ = graph(seed)
    rows = [(ns, o, (t or "").replace("[ ]", "[]") or None, *x) for ns, o, t, *x in rows]
    rows += [("r", f"{i:02d}", f'["{(i + 7) % 21:02d}"]', None, 1) for i in range(21)] + [("r", f"{i}", f'["{i - 1}"]', None, 1) for i in range(101, 140)] + [("r", "100", '["05"]', None, 1)]
    want, commits = ways_up(rows), spark.createDataFrame(rows, N)
    got = gitgraph.commit_paths(commits, chunk).collect()
    assert {(r[0], r[1]): r["path"] for r in got} == {k: w[::-1] for k, w in want.items()} and len(got) == len(want)
    below = gitgraph.commit_descendants(commits, chunk).collect()
    pairs = {(ns, a, o) for (ns, o), w in want.items() for a in w[1:]}
    assert {tuple(r) for r in below} == pairs and len(below) == len(pairs)
    counts = {(r[0], r[1]): r["descendants"] for r in gitgraph.commit_hierarchy(commits, chunk).collect() if r["descendants"] is not None}
    assert counts and all(n == sum(p[:2] == k for p in pairs) for k, n in counts.items())


def test_all_paths_are_a_query(spark):
    import __spark_entry__ as e

    from tests.conftest import SF

    queries = e.queries()
    index = {(r[0], r[1]): r for r in queries["p4_hierarchy"](spark, SF).collect()}
    paths = queries["p4_paths"](spark, SF).collect()
    assert len(paths) == len(index)
    for r in paths:
        placed, path = index[r[0], r[1]], r["path"].split("/")
        assert path[-1] == r["object_id"] and (placed["tree_depth"] < 0 or (len(path) - 1, path[0]) == (placed["tree_depth"], placed["root_object_id"]))
    assert queries["p4_descendants"](spark, SF).count() == sum(r["path"].count("/") for r in paths)


def test_rounds_do_not_grow_with_the_length_of_a_history(spark, monkeypatch):
    """A line of 40 chunks with a branch off it, and one off that, takes as many rounds as there are turns."""
    rounds = []
    line = [f"{i:04d}" for i in range(400)]
    branch, twig = [f"b{i:03d}" for i in range(40)], [f"c{i:03d}" for i in range(40)]
    rows = [("p", o, f'["{line[i - 1]}"]' if i else None, None, 1) for i, o in enumerate(line)]
    rows[390] = ("p", line[390], f'["{line[389]}", "{branch[-1]}"]', None, 1)
    rows += [("p", o, f'["{branch[i - 1]}"]' if i else f'["{line[3]}", "{twig[-1]}"]', None, 1) for i, o in enumerate(branch)] + [("p", o, f'["{twig[i - 1]}"]' if i else None, None, 1) for i, o in enumerate(twig)]
    refs = [("p", line[-1], "x")]
    real_cut = h.cut
    monkeypatch.setattr(h, "cut", lambda df: rounds.append(1) or real_cut(df))
    local = h.forest(gitgraph.commit_nodes(spark.createDataFrame(rows, N)), 10)
    direct = h.top_links(local)
    before = len(rounds)
    starts = spark.createDataFrame(refs, R).selectExpr("repository_id as ns", "object_id as id")
    assert h.reachable(local, starts, direct).count() == 480
    assert len(rounds) - before <= 1 + 6 + 5  # doors, jumps over some 48 chunks, turns


def test_plans_grow_with_the_number_of_jumps_and_rings_make_none(spark, monkeypatch):
    """A line of 40 chunks and a ring over ten chunks: a plan has one join a jump, not one for each way of combining jumps, and jumps end with the line."""
    joins = []
    line, ring = [f"{i:04d}" for i in range(200)], [f"r{i:03d}" for i in range(50)]
    rows = [("p", o, f'["{line[i - 1]}"]' if i else None, None, 1) for i, o in enumerate(line)] + [("p", o, f'["{ring[i - 1]}"]', None, 1) for i, o in enumerate(ring)]
    commits, refs = spark.createDataFrame(rows, N), spark.createDataFrame([("p", line[-1], "x"), ("p", ring[17], "x")], R)
    real_cut = h.cut
    monkeypatch.setattr(h, "cut", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or real_cut(df))
    assert {tuple(r) for r in gitgraph.commit_forest(commits, refs, 5).collect()} == brute(rows, [("p", line[-1], "x"), ("p", ring[17], "x")])
    assert max(joins) <= 20
    only = h.top_links(h.forest(gitgraph.commit_nodes(spark.createDataFrame(rows[200:] + rows[:10], N)), 5))
    assert only.count() > 8 and len(h._jumps(only)) <= 4
