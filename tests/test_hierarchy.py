import datetime as dt
import random

from graphloom.operators import hierarchy as H

SCHEMA = "row_id bigint, class_uid string, repo string, name string, base_classes array<string>, indexed_at timestamp, node string"


def forest(seed, n):
    rng = random.Random(seed)
    parent = {f"n{i:04d}": (None if i == 0 or rng.random() < 0.05 else f"n{rng.choice([0, i - 1, i - 1, i - 1, rng.randrange(i)]):04d}") for i in range(n)}
    names = sorted(parent)
    for i in range(0, n - 40, max(20, n // 6)):  # cycles, one of them on itself
        parent[names[i]] = names[i + (i % 3)]
    return parent


def walk(parent, u):
    path, seen = [], set()
    while u is not None and u not in seen:
        path.append(u)
        seen.add(u)
        u = parent.get(u)
    return path[::-1], u


def test_against_walks(spark):
    parent = forest(3, 400)
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    separated = H.separate_cycles(df)
    heavy = H.cut(H.heavy_paths(separated))
    rows = {r.node: r for r in separated.collect()}
    paths = {r.node: r.path for r in H.node_paths(heavy).collect()}
    boxes = {r.node: r for r in heavy.collect()}
    below = {u: set() for u in parent}
    for u in parent:
        path, loop = walk(parent, u)
        if loop is None:
            assert rows[u].state == "rooted" and (boxes[u].root, boxes[u].depth) == (path[0], len(path) - 1)
            assert paths[u] == path
            for a in path[:-1]:
                below[a].add(u)
        else:
            assert rows[u].state == ("on_cycle" if loop == u else "below_cycle") and u not in boxes
    asked = [u for u in paths if below[u]][:5]
    found = {}
    for r in H.descendants_of(heavy, spark.createDataFrame([(u,) for u in asked], "node string")).collect():
        found.setdefault(r.node, set()).add(r.descendant)
    assert found == {u: below[u] for u in asked}
    assert all(boxes[u].size == len(below[u]) + 1 for u in boxes)
    for u in boxes:  # preorder: the descendants are an interval of their root
        assert {v for v in boxes if boxes[v].root == boxes[u].root and boxes[u].pos < boxes[v].pos < boxes[u].pos + boxes[u].size} == below[u]
    assert all(len(b.above) <= 10 for b in boxes.values())


def test_long_chain_and_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(H, "CHILDREN_AT_ONCE", 20)
    links = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(130)] + [(f"leaf{i}", "c064") for i in range(300)]
    heavy = H.cut(H.heavy_paths(H.separate_cycles(spark.createDataFrame(links, "node string, parent string"))))
    rows = {r.node: r for r in heavy.collect()}
    assert rows["c129"].depth == 129 and rows["c000"].size == 430 and sorted(r.pos for r in rows.values()) == list(range(430))
    assert all(r.root == "c000" for r in rows.values()) and rows["leaf7"].depth == 65


def test_classes(spark):
    t = dt.datetime(2024, 1, 1)
    later = t + dt.timedelta(days=1)
    rows = [
        (1, "a", "r", "A", None, t, "x"), (2, "b", "r", "B", ["abc.ABC", " pkg.mod.A[T] "], t, None), (3, "b", "r", "B", ["Nope"], t - dt.timedelta(days=9), None), (4, "c", "r", "C", ["C"], t, None),
        (5, "d", "r", "D", ["C"], t, None), (6, "e", "q", "E", ["A"], later, None), (6, "e", "q", "E", ["A"], later, None), (7, "f", "r", None, [], None, None), (8, "g", None, "G", [None, "A"], t, None),
    ]
    got = {r.class_uid: (r.root_uid, r.depth, r.state) for r in H.class_hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("a", 0, "rooted"), "b": ("a", 1, "rooted"), "c": ("", -1, "on_cycle"), "d": ("", -1, "below_cycle"), "e": ("e", 0, "rooted"), "f": ("f", 0, "rooted"), "g": ("g", 0, "rooted")}
    assert H.class_hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
