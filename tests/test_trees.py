import random

from theoremill.functions.trees import Tree, cse, edit_distance, edit_similarity, flatten, parse, structural_match


def leaf(tag, payload=""):
    return (tag, payload, [])


def test_parse():
    tree = parse("forall n, n <= f n -> P n")
    assert tree.tags[:2] == ["Prod", "Sort"] and ("Const", "<=") in list(zip(tree.tags, tree.payloads)) and ("Rel", "1") in list(zip(tree.tags, tree.payloads))
    assert parse("a -> b -> Prop").tags == ["Prod", "Const", "Prod", "Const", "Sort"]
    assert parse("∀ (s : T), s ⊆ g s") is not None and parse("exists k, a k /\\ ~ b k") is not None
    assert parse(None) is parse("") is parse("(a") is parse("a )") is parse("forall") is None
    assert parse("(" * 50_000) is None


def test_edit_distance():
    a = flatten(("Prod", "", [leaf("Const", "x"), leaf("Const", "y")]))
    assert edit_distance(a, a) == 0 and edit_similarity(a, a) == 1
    assert edit_distance(a, flatten(("Prod", "", [leaf("Const", "x"), leaf("Ind", "y")]))) == 0.5
    assert edit_distance(a, flatten(("Prod", "", [leaf("Const", "x"), leaf("Rel", "1")]))) == 1
    assert edit_distance(flatten(("Case", "", [leaf("Ind", "a"), leaf("Ind", "b")])), flatten(leaf("Rel", "1"))) == 3
    assert edit_distance(a, flatten(leaf("Sort", "Type"))) == 2


def test_edit_distance_by_recursion():
    from functools import cache

    from theoremill.functions.trees import nested, rename_cost

    def freeze(t):
        return (t[0], t[1], tuple(map(freeze, t[2])))

    @cache
    def forest(a, b):
        if not a or not b:
            size = lambda f: sum(1 + size(t[2]) for t in f)
            return float(size(a or b))
        x, y = a[-1], b[-1]
        return min(forest(a[:-1] + x[2], b) + 1, forest(a, b[:-1] + y[2]) + 1, forest(a[:-1], b[:-1]) + forest(x[2], y[2]) + rename_cost(x[:2], y[:2]))

    r = random.Random(0)

    def grow(n):
        tag = r.choice(["App", "Prod", "Const", "Rel", "Sort", "Case"])
        out = (tag, r.choice("ab"), [])
        n -= 1
        while n > 0:
            k = r.randint(1, n)
            out[2].append(grow(k))
            n -= k
        return out

    for _ in range(60):
        a, b = flatten(grow(r.randint(1, 7))), flatten(grow(r.randint(1, 7)))
        assert edit_distance(a, b) == forest((freeze(nested(a)),), (freeze(nested(b)),))


def test_match_and_sharing():
    a = flatten(("Prod", "", [leaf("Sort", "Type"), leaf("Const", "y")]))
    b = flatten(("Prod", "", [("App", "", [leaf("Const", "f"), leaf("Const", "x")]), leaf("Ind", "y")]))
    assert structural_match(a, a) == 1 and structural_match(a, b) == (1 + 3 + 0.5) / 5
    assert structural_match(a, Tree()) == 0
    twice = ("App", "", [("Abs", "", [leaf("Rel", "1")]), ("Abs", "", [leaf("Rel", "1")])])
    assert cse(flatten(twice)).tags == ["App", "Abs", "Rel", "CseVar"]
    assert cse(flatten(("App", "", [leaf("Const", "c"), leaf("Const", "c")]))).tags == ["App", "Const", "Const"]
