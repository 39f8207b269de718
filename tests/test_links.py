"""Parent links, hot keys and closures against sequential versions."""

import random
from collections import deque

import pytest
from loomstone.operators import closure, hotkeys, links
from loomstone.plans.registry import queries

SYMBOLS = "moniker string, enclosing string, name string, depth int"


def states(parent):
    out = {}
    for node in parent:
        seen, at = [], node
        while True:
            if at in seen:
                out[node] = ("cycle" if at == node else "hangs", None)
                break
            seen.append(at)
            if at not in parent:
                out[node] = ("orphan", seen[:-1])
                break
            if not parent[at]:
                out[node] = ("rooted", seen)
                break
            at = parent[at]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_random(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(400)]
    parent = {}
    for i, n in enumerate(names):
        r = rnd.random()
        parent[n] = None if r < 0.1 else "" if r < 0.15 else "missing" if r < 0.2 else rnd.choice(names) if r < 0.3 else names[max(0, i - rnd.randint(1, 9))]
    for i in range(350, 399):  # a long chain, then a long cycle
        parent[names[i]] = names[i + 1]
    parent[names[399]] = names[380] if seed == 2 else None
    rows = [(n, p, n.upper(), 7) for n, p in parent.items()] * 2 + [(None, "n1", None, None)]
    df = spark.createDataFrame(rows, SYMBOLS)
    want = states(parent)
    got = {r["node"]: r for r in links.hierarchy(df, label="name").collect()}
    assert set(got) == set(parent)
    for n, (state, path) in want.items():
        assert got[n]["state"] == state, n
        if path is None:
            assert got[n]["path"] is None and got[n]["depth"] is None
        else:
            assert got[n]["depth"] == len(path) - 1 and got[n]["root"] == path[-1]
            assert got[n]["path"] == "/".join(x.upper() for x in reversed(path))
    assert {(r["fault"], r["node"]) for r in links.faults(df).collect()} == {(s, n) for n, (s, _) in want.items() if s != "rooted"}
    pairs = {(r["node"], r["descendant"], r["distance"]) for r in links.descendants(df).collect()}
    assert pairs == {(a, n, k + 1) for n, (_, p) in want.items() if p for k, a in enumerate(p[1:])}
    spans = {r["node"]: (r["first"], r["last"]) for r in links.intervals(df).collect()}
    assert sorted(a for a, _ in spans.values()) == list(range(len(spans)))
    assert {(a, n) for a, (x, y) in spans.items() for n, (z, _) in spans.items() if x < z <= y} == {(a, n) for a, n, _ in pairs}


def test_hierarchy_small_cases(spark):
    assert links.faults(spark.createDataFrame([], SYMBOLS)).count() == 0
    self_loop = spark.createDataFrame([(f"s{i}", f"s{i}", None, 0) for i in range(40)] + [(f"t{i}", f"s{i}", None, 0) for i in range(40)], SYMBOLS)
    got = {(r["fault"], r["node"]) for r in links.faults(self_loop).collect()}
    assert got == {("cycle", f"s{i}") for i in range(40)} | {("hangs", f"t{i}") for i in range(40)}
    assert links.hierarchy(spark.createDataFrame([("a", None, None, None)], SYMBOLS), label="name").first()["path"] == "?"


def bfs(adj, start):
    depth, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in sorted(adj.get(x, ())):
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    return depth


EDGES = "src string, dst string, type string, layer string, cause string, occ struct<file_id:bigint,range:struct<start_line:int,start_col:int,end_line:int,end_col:int>,role:string>"


def edge(a, b, kind="EXTENDS"):
    return (a, b, kind, "hierarchy", None, (-1, (-1, -1, -1, -1), "NONE"))


@pytest.mark.parametrize("split", [1, 3, 8, 1000])
def test_least_depths_for_any_choice_of_splitters(spark, split):
    rnd = random.Random(split)
    pairs = {(f"t{rnd.randrange(50)}", f"t{rnd.randrange(50)}") for _ in range(110)} | {(f"u{i}", f"u{i + 1}") for i in range(30)} | {("u30", "u25")}
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
    starts = ["t1", "t2", "t3", "u0", "none"]
    got = {(r["start"], r["node"]): r["depth"] for r in links.least_depths(spark.createDataFrame(list(pairs), "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "start string"), split).collect()}
    assert got == {(s, n): d for s in starts for n, d in bfs(adj, s).items()}


def test_depth_faults(spark):
    rnd = random.Random(5)
    pairs = {(f"t{rnd.randrange(40)}", f"t{rnd.randrange(40)}") for _ in range(90)}
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
    asked, bad = [], set()
    for i in range(40):
        d = bfs(adj, f"t{i}")
        for j in range(0, 40, 3):
            true, said = d.get(f"t{j}"), rnd.choice([0, 1, 2, 3, None])
            asked.append((f"t{i}", f"t{j}", said))
            if said is None or said != true:
                bad.add((f"t{i}", f"t{j}"))
    nodes = spark.createDataFrame(asked * 2, "walk_start string, moniker string, depth int")
    edges = spark.createDataFrame([edge(a, b) for a, b in pairs] + [edge("t0", "t39", "CALLS")], EDGES)
    assert {tuple(r) for r in links.depth_faults(nodes, edges).collect()} == bad
    assert links.depth_faults(nodes.limit(0), edges).count() == 0


@pytest.mark.parametrize("cap", [500, 10, 17])
def test_closure_is_a_queue(spark, cap):
    rnd = random.Random(9)
    pairs = sorted({(f"t{rnd.randrange(60):02d}", f"t{rnd.randrange(60):02d}", rnd.choice(["EXTENDS", "IMPLEMENTS"])) for _ in range(130)})
    out = {}
    for a, b, k in pairs:
        if a != b:
            out.setdefault(a, []).append((b, 0 if k == "EXTENDS" else 1, k))
    got = {}
    for r in closure.closure(spark.createDataFrame([edge(a, b, k) for a, b, k in pairs], EDGES), cap=cap).collect():
        got.setdefault(r["start"], {})[r["node"]] = (r["depth"], r["via"], r["truncated"])
    for start in out:
        found, depth, queue, over = {}, {start: 0}, deque([start]), False
        while queue and not over:
            x = queue.popleft()
            for b, _, k in sorted(out.get(x, [])):
                if b not in depth:
                    if len(found) == cap:
                        over = True
                        break
                    depth[b] = depth[x] + 1
                    found[b] = (depth[b], k)
                    queue.append(b)
        assert {n: (d, v) for n, (d, v, _) in got.get(start, {}).items()} == found
        assert all(t == over for _, _, t in got.get(start, {}).values())


def test_first_parents_are_a_queue(spark, tmp_path):
    """At every depth the parent that a queue meets first gives via."""
    rnd = random.Random(11)
    pairs = sorted({(f"t{rnd.randrange(70):02d}", f"t{rnd.randrange(70):02d}", rnd.choice(["EXTENDS", "IMPLEMENTS"])) for _ in range(150)})
    spark.createDataFrame([edge(a, b, k) for a, b, k in pairs], EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    out, want, differ = {}, {}, 0
    for a, b, k in pairs:
        if a != b:
            out.setdefault(a, []).append((b, k))
    for start in out:
        depth, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for b, k in sorted(out.get(x, [])):
                if b not in depth:
                    depth[b] = depth[x] + 1
                    want[start, b] = (depth[b], k)
                    queue.append(b)
        differ += sum(len({k for x in depth if depth[x] == n - 1 for y, k in out.get(x, []) if y == b}) > 1 for b, n in depth.items() if n > 1)
    got = {(r["start"], r["node"]): (r["depth"], r["via"]) for r in queries()["bfs_first_parent"](spark, str(tmp_path)).collect()}
    assert got == want and differ > 20  # nodes whose parents disagree


def test_hierarchy_orders(spark, tmp_path):
    """Edges by type, dst and src; the nodes of each start by depth and moniker."""
    pairs = [("a", "z", "IMPLEMENTS"), ("a", "m", "EXTENDS"), ("z", "b", "EXTENDS"), ("m", "c", "EXTENDS"), ("m", "y", "OVERRIDES"), ("z", "y", "IMPLEMENTS")]
    spark.createDataFrame([edge(*p) for p in pairs * 2], EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    edges = sorted(tuple(r) for r in queries()["hierarchy_order_edges"](spark, str(tmp_path)).collect())
    assert edges == [(0, "z", "b", "EXTENDS"), (1, "m", "c", "EXTENDS"), (2, "a", "m", "EXTENDS"), (3, "z", "y", "IMPLEMENTS"), (4, "a", "z", "IMPLEMENTS"), (5, "m", "y", "OVERRIDES")]
    nodes = {(r["start"], r["pos"]): r["node"] for r in queries()["hierarchy_order"](spark, str(tmp_path)).collect()}
    assert [nodes["a", i] for i in range(5)] == ["m", "z", "b", "c", "y"] and nodes["z", 0] == "b" and nodes["m", 0] == "c" and len(nodes) == 8


def test_subtypes_of_hubs(spark, tmp_path):
    """A start with more subtypes than the cap keeps all of them."""
    rnd = random.Random(3)
    pairs = {(f"s{i:03d}", "hub") for i in range(520)} | {(f"t{i}", f"s{rnd.randrange(520):03d}") for i in range(90)} | {("hub", "top"), ("top", "t7")}
    spark.createDataFrame([edge(a, b) for a, b in pairs], EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    adj = {}
    for a, b in pairs:
        adj.setdefault(b, set()).add(a)
    got = {(r["start"], r["node"]): r["depth"] for r in queries()["subtypes_transitive"](spark, str(tmp_path)).collect()}
    assert got == {(x, y): n for x in adj for y, n in bfs(adj, x).items() if n}


def test_hot_keys(spark):
    rows = [("s%d" % (i % 50), "hot" if i % 3 == 0 else f"k{i}" if i % 3 == 1 else None, "CALLS", "value", None, (i, (i, 1, i, 2), "CALL")) for i in range(300)]
    df = hotkeys.edge_keys(spark.createDataFrame(rows * 2, EDGES))
    assert [tuple(r) for r in hotkeys.heavy_keys(df, 0.3).collect()] == [("hot", 100)]
    hot = hotkeys.per_key(df).where("key = 'hot'").first()
    assert (hot["uses"], hot["files"], hot["enclosing_symbols"]) == (100, 100, len({i % 50 for i in range(0, 300, 3)}))
    empty = hotkeys.edge_keys(spark.createDataFrame([], EDGES))
    assert hotkeys.heavy_keys(empty).count() == 0 and hotkeys.per_key(empty).count() == 0


def test_usage_keys_are_trimmed(spark):
    u = spark.createDataFrame([(1, "CALL", x, (1, i, 1, 2)) for i, x in enumerate(["a", " a", "a \t", "", " ", None, "b"])], "file_id bigint, kind string, target_name string, range struct<start_line:int,start_col:int,end_line:int,end_col:int>")
    assert {tuple(r) for r in hotkeys.heavy_keys(hotkeys.usage_keys(u), 3 / 7).collect()} == {("a", 3)}
