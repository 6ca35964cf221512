import random

from theoremill.operators.hierarchy import hierarchy, parent_edges


def brute(parents):
    """{node: (root, depth)} by walking up from every node."""
    out = {}
    for v in {*parents, *parents.values()}:
        path, at = [v], v
        while at in parents and (at := parents[at]) not in path:
            path.append(at)
        if at not in parents:
            out[v] = (at, len(path) - 1)
        else:
            ring = path[path.index(at) :]
            out[v] = (min(ring), -1 if v in ring else -2)
    return out


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()) or [], "node long, parent long")


def forest(seed, n, deep):
    r = random.Random(seed)
    ids = r.sample(range(10 * n), n)
    parents = {ids[i]: ids[max(0, i - r.randint(1, 3)) if deep else r.randrange(i)] for i in range(1, n) if r.random() < 0.97}
    for i in range(0, n, max(n // 3, 1)):  # some cycles
        parents[ids[i]] = ids[min(n - 1, i + r.randint(0, 9))]
    return {a: b for a, b in parents.items() if a != b}


def test_against_walks(spark):
    graphs = [forest(1, 150, True), forest(2, 150, False), {i: 0 for i in range(1, 60)}, {1: 2, 2: 1}, {i: i + 1 for i in range(40)}]
    parents = {10_000 * k + a: 10_000 * k + b for k, g in enumerate(graphs) for a, b in g.items()}
    found = hierarchy(frame(spark, parents), intervals=True, paths=True)
    found.nodes.persist()
    rows = {r.node: r for r in found.nodes.collect()}
    expected = brute(parents)
    assert {v: (r.root, r.depth) for v, r in rows.items()} == expected
    below = {v: set() for v in rows}
    for v, r in rows.items():
        if r.kind == "tree":
            path = [v]
            while path[-1] in parents:
                path.append(parents[path[-1]])
            assert r.path == path[::-1]
            for a in path[1:]:
                below[a].add(v)
    for v, r in rows.items():
        if r.kind == "tree":
            assert r.size == len(below[v]) + 1
            assert {u for u, s in rows.items() if s.root == r.root and s.kind == "tree" and r.lo < s.lo < r.hi} == below[v]
    pairs = {(r.ancestor, r.descendant) for r in found.descendants().collect()}
    assert pairs == {(a, v) for a, vs in below.items() for v in vs}


def test_empty_and_nulls(spark):
    assert hierarchy(frame(spark, {})).nodes.count() == 0
    rows = spark.createDataFrame([(1, None, "x"), (None, 2, "x"), (3, 3, "x"), (4, 5, "x"), (4, 6, "x")], "node long, parent long, size string")
    assert sorted((r.node, r.root, r.depth) for r in hierarchy(rows).nodes.collect()) == [(4, 5, 1), (5, 5, 0)]


def test_parent_edges(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 2, " Instance_Of\t", day(1)), (1, 3, "instance_of", day(2)), (1, 4, "uses", day(9)), (5, None, "instance_of", day(1)), (6, 6, "instance_of", day(1)), (7, 9, "instance_of", day(1)), (7, 8, "instance_of", day(1)), (7, 1, "instance_of", None)]
    found = parent_edges(spark.createDataFrame(rows, "src long, dst long, relation string, extracted_at timestamp"))
    assert sorted(map(tuple, found.collect())) == [(1, 3), (7, 8)]


def test_cycles(spark):
    found = hierarchy(frame(spark, {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 7: 8})).cycles().collect()
    assert [tuple(r) for r in found] == [(1, 3, 2)]
