import datetime as dt
import random
from collections import Counter, defaultdict

from theoremill.llm.splits import author_key, dataset_groups, dataset_splits, deal, file_key, related_groups, torn_groups

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "pair_id long, split string, source_file string, author string, theorem_name string, recorded_at timestamp, id int, value string"


def union_find(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, v in rows:
        parent[find(("id", i))] = find(("value", v))
    groups = defaultdict(set)
    for i, _ in rows:
        groups[find(("id", i))].add(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_groups_and_forest(spark):
    r = random.Random(5)
    rows = [(i, f"v{r.choice([0, r.randint(1, 150)])}" if i % 3 else f"s{i}") for i in range(200)] + [(i, f"v{r.randint(1, 150)}") for i in range(0, 200, 4)]
    rows += [(i, f"c{i // 2}") for i in range(300, 340)] + [(i, f"c{(i + 1) // 2}x") for i in range(300, 340)]
    values = spark.createDataFrame([*rows, (None, "v1"), (7, None)], "id long, value string")
    found = related_groups(values.select("id"), values)
    members = {r.id: r.group_id for r in found.members.collect()}
    assert members == union_find(rows)
    links = [tuple(r) for r in found.forest.collect()]
    assert len(links) == len(members) - len(set(members.values()))  # spans without a cycle
    assert all(members[a] == members[b] for a, b in links)


def test_keys(spark):
    rows = spark.createDataFrame([(" ./Src\\\\A/.//b.v ", " N/A"), ("/src/a/b.v", "X.Y\n"), (" ", None), (None, "-"), ("a./b", "unknown ")], "f string, a string")
    assert [tuple(r) for r in rows.select(file_key("f"), author_key("a")).collect()] == [("src/a/b.v", None), ("src/a/b.v", "x.y"), (None, None), (None, None), ("a./b", None)]


def test_torn_and_new_splits(spark):
    rows = [
        (1, "train", "a.v", None, None, DAY, 0, ""),
        (2, "val", "./A.V", None, "t", DAY, 0, ""),
        (3, "test", None, "n/a", "t", DAY, 0, ""),
        (4, "train", None, "n/a", None, DAY, 0, ""),
        (5, "train", "b.v", "me", None, DAY, 0, ""),
        (6, "train", "c.v", "ME ", None, DAY, 0, ""),
        (6, "test", "a.v", None, None, DAY - dt.timedelta(1), 0, ""),
        (None, "test", "b.v", None, None, DAY, 0, ""),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, torn_groups(table).collect())) == [(1, 1), (2, 1), (3, 1)]
    new = {r.pair_id: (r.group_id, r.split) for r in dataset_splits(table).collect()}
    assert {i: g for i, (g, _) in new.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert len({s for i, (g, s) in new.items() if g == 1}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert torn_groups(empty).count() == dataset_splits(empty).count() == 0
    assert dataset_groups(empty)[1].forest.count() == 0


def test_deal_proportions(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([1, 1, 1, 2, 3, 5, 9])) for i in range(40_000)] + [(50_000, 60_000)]
    share = Counter()
    for row in deal(spark.createDataFrame(sizes, "group_id long, size long")).collect():
        share[row.split] += row.size
    total = sum(share.values())
    assert abs(share["train"] / total - 0.8) < 0.01 and abs(share["val"] / total - 0.1) < 0.01
