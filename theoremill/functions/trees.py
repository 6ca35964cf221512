"""Expression trees: parsing of type expressions, normalisation, edit distance and structural match.

A tree is a list of nodes in pre-order, (tag, payload, children); children are indices. These algorithms need
the whole tree at once, so they run in Arrow UDFs, one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

# Categories that make a renaming cheaper.
CATEGORY = {
    "Abs": "Binder", "Prod": "Binder", "Let": "Binder", "App": "Application", "Const": "ConstantRef", "Ind": "ConstantRef", "Construct": "ConstantRef",
    "Rel": "Variable", "CseVar": "Variable", "Sort": "Sort", "Case": "Control", "Fix": "Control", "CoFix": "Control", "Proj": "Projection", "Primitive": "Primitive",
}
CONSTANTS = ("Const", "Ind", "Construct")

# Unicode signs and their plain forms; infix operators by how tightly they bind (and whether
# they group to the right); words that begin a term.
PLAIN = {"∀": "forall ", "∃": "exists ", "→": "->", "↔": "<->", "∧": "/\\", "∨": "\\/", "¬": "~", "≤": "<=", "≥": ">=", "≠": "<>", "λ": "fun ", "⇒": "=>", "×": "*"}
LEVELS = {
    "->": (99, True), "<->": (95, False), "\\/": (85, True), "/\\": (80, True), "=": (70, False), "<>": (70, False), "<": (70, False), ">": (70, False), "<=": (70, False),
    ">=": (70, False), "==": (70, False), "∈": (70, False), "⊆": (70, False), "=?": (70, False), "::": (60, True), "++": (60, True), "||": (50, False), "+": (50, False),
    "-": (50, False), "&&": (40, False), "*": (40, False), "/": (40, False), "∪": (50, False), "∩": (40, False), "^": (30, True), "∘": (40, False), "≡": (70, False),
}
SORTS = {"Prop": "Prop", "SProp": "Prop", "Set": "Set", "Type": "Type"}

_TOKEN = re.compile(r"\s*(?:(<->|->|=>|:=|<=|>=|<>|==|=\?|::|\+\+|\|\||&&|/\\|\\/|[=<>+\-*/^~(),:{}\[\]∈⊆∪∩∘≡])|([^\W\d][\w'.]*)|(\d+)|(_)|(\S))")


class ParseError(ValueError):
    """The text is no type expression."""


@dataclass
class Tree:
    """Nodes in pre-order: tag, payload, indices of children."""

    tags: list[str] = field(default_factory=list)
    payloads: list[str] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.tags)


class _Parser:
    """Operator-precedence parser to nested (tag, payload, children); bound names become de Bruijn indices."""

    def __init__(self, text: str) -> None:
        for sign, plain in PLAIN.items():
            text = text.replace(sign, plain)
        text = re.sub(r"%\w+", "", text)
        self.tokens = [next((k, g) for k, g in enumerate(m.groups()) if g) for m in _TOKEN.finditer(text)]
        if any(k == 4 for k, _ in self.tokens):
            raise ParseError(text)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, expected: str = "") -> tuple[int, str]:
        if self.at >= len(self.tokens) or (expected and self.tokens[self.at][1] != expected):
            raise ParseError(f"{expected or 'a term'} is missing")
        self.at += 1
        return self.tokens[self.at - 1]

    def binders(self, bound: list[str], end: str):
        """(name, type) of each binder up to ``end``; types are parsed under the binders in front."""
        out = []
        while self.peek() != end:
            close = {"(": ")", "{": "}", "[": "]"}.get(self.peek())
            if close:
                self.take()
            names = []
            while self.at < len(self.tokens) and self.tokens[self.at][0] in (1, 3):
                names.append(self.take()[1])
            if not names:
                raise ParseError("a binder is missing")
            kind = None
            if self.peek() == ":":
                self.take()
                kind = self.term(100, bound + [n for n, _ in out])
            if close:
                self.take(close)
            out += [(n, kind or ("Sort", "Type", [])) for n in names]
            if kind is not None and not close:
                break
        self.take(end)
        return out

    def term(self, level: int, bound: list[str]):
        left = self.application(bound)
        while (entry := LEVELS.get(self.peek())) and entry[0] <= level:
            sign = self.take()[1]
            binds, right_first = entry
            if sign == "->":
                left = ("Prod", "", [left, self.term(binds, bound + [""])])
                continue
            right = self.term(binds if right_first else binds - 1, bound)
            left = ("App", "", [("App", "", [("Const", sign, []), left]), right])
        return left

    def application(self, bound: list[str]):
        head = self.atom(bound)
        while self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if not (kind in (1, 2, 3) and text not in ("forall", "exists", "fun") or text == "("):
                break
            head = ("App", "", [head, self.atom(bound)])
        return head

    def atom(self, bound: list[str]):
        kind, text = self.take()
        if text == "(":
            inner = self.term(100, bound)
            if self.peek() == ",":
                while self.peek() == ",":
                    self.take()
                    inner = ("App", "", [("App", "", [("Construct", "pair", []), inner]), self.term(100, bound)])
            self.take(")")
            return inner
        if text in ("forall", "exists", "fun"):
            names = self.binders(bound, "=>" if text == "fun" else ",")
            body = self.term(100, bound + [n for n, _ in names])
            for _, typ in reversed(names):
                if text == "forall":
                    body = ("Prod", "", [typ, body])
                elif text == "fun":
                    body = ("Abs", "", [body])
                else:
                    body = ("App", "", [("Ind", "ex", []), ("Abs", "", [body])])
            return body
        if text == "~":
            return ("App", "", [("Const", "not", []), self.term(75, bound)])
        if kind == 2:
            return ("Primitive", text, [])
        if kind == 3:
            return ("Sort", "Type", [])
        if kind == 1:
            if text in SORTS:
                return ("Sort", SORTS[text], [])
            if text in bound:
                return ("Rel", str(bound[::-1].index(text) + 1), [])
            return ("Const", text.rstrip("."), [])
        raise ParseError(f"unexpected {text}")


# Words that are never names of variables.
WORDS = ("forall", "fun", "match", "let", "in", "if", "then", "else", "return", "as", "with", "end", "fix", "cofix", "Prop", "Set", "Type")


def parse_nested(text: str | None):
    """Nested (tag, payload, children) of a type expression; null for null, empty and unparsable texts."""
    try:
        parser = _Parser(text or "")
        root = parser.term(100, [])
        return root if parser.at == len(parser.tokens) else None
    except (ParseError, RecursionError):
        return None


def parse(text: str | None) -> Tree | None:
    """The normalised tree of a type expression; null for null, empty and unparsable texts."""
    root = parse_nested(text)
    return None if root is None else cse(flatten(root))


def free_names(root) -> list[str]:
    """Constants that may be meant as variables, in order of first appearance: names without a dot that begin
    with a small letter or an underscore and are no words of the language."""
    out, stack = {}, [root]
    while stack:
        tag, name, children = stack.pop()
        if tag == "Const" and "." not in name and name not in WORDS and (name[:1].islower() or name[:1] == "_"):
            out[name] = None
        stack += reversed(children)
    return list(out)


def bind(root, names: list[str]):
    """``root`` under one product over Type for each of ``names``, whose uses become indices. An expression
    that begins with a product is left alone."""
    if not names or root[0] == "Prod":
        return root

    def inside(node, depth: int):
        tag, name, children = node
        if tag == "Const" and name in names:
            return ("Rel", str(depth + len(names) - names.index(name)), [])
        below = [depth + (tag == "Abs" or tag == "Prod" and k == 1) for k in range(len(children))]
        return (tag, name, [inside(c, d) for c, d in zip(children, below)])

    out = inside(root, 0)
    for _ in names:
        out = ("Prod", "", [("Sort", "Type", []), out])
    return out


def peel(tree: Tree, most: int | None = None) -> Tree:
    """The tree without its leading products, of which at most ``most`` are taken off."""
    at = taken = 0
    while tree.tags[at : at + 1] == ["Prod"] and len(tree.children[at]) == 2 and (most is None or taken < most):
        at, taken = tree.children[at][1], taken + 1
    return flatten(nested(tree, at)) if taken else tree


def wl_labels(tags: list[str], depths: list[int], children: list[list[int]], rounds: int) -> Counter:
    """How often each label occurs in all rounds together; nodes come parents first."""
    of = lambda text: hashlib.md5(text.encode()).hexdigest()
    labels = [of(f"{t}_{d}_{len(c)}") for t, d, c in zip(tags, depths, children)]
    counts = Counter(labels)
    for _ in range(rounds):
        labels = [of(own + "".join(sorted(labels[c] for c in below))) for own, below in zip(labels, children)]
        counts.update(labels)
    return counts


def flatten(root) -> Tree:
    """Nested (tag, payload, children) to pre-order lists, without recursion."""
    tree, stack = Tree(), [(root, -1)]
    while stack:
        (tag, payload, children), parent = stack.pop()
        at = len(tree)
        tree.tags.append(tag)
        tree.payloads.append(payload)
        tree.children.append([])
        if parent >= 0:
            tree.children[parent].append(at)
        stack += [(c, at) for c in reversed(children)]
    return tree


def nested(tree: Tree, at: int = 0):
    return (tree.tags[at], tree.payloads[at], [nested(tree, c) for c in tree.children[at]])


def cse(tree: Tree) -> Tree:
    """Repeated subtrees other than constants, after their first occurrence, as shared variables.

    A repeated subtree that holds both constants and smaller repeated subtrees is kept; its parts change.
    """
    if len(tree) <= 1:
        return tree
    names, ids = [0] * len(tree), {}
    constant, inner = [False] * len(tree), [False] * len(tree)
    for i in range(len(tree) - 1, -1, -1):
        names[i] = ids.setdefault((tree.tags[i], tree.payloads[i], tuple(names[c] for c in tree.children[i])), len(ids))
        constant[i] = tree.tags[i] in CONSTANTS or any(constant[c] for c in tree.children[i])
    counts = Counter(names)
    shared = [counts[names[i]] > 1 and tree.tags[i] not in CONSTANTS for i in range(len(tree))]
    for i in range(len(tree) - 1, -1, -1):
        inner[i] = any(shared[c] or inner[c] for c in tree.children[i])
    whole = [shared[i] and not (constant[i] and inner[i]) for i in range(len(tree))]
    seen: dict[int, int] = {}
    out, stack = Tree(), [(0, -1)]
    while stack:
        i, parent = stack.pop()
        at, again = len(out), whole[i] and names[i] in seen
        if whole[i] and not again:
            seen[names[i]] = len(seen)
        out.tags.append("CseVar" if again else tree.tags[i])
        out.payloads.append(str(seen[names[i]]) if again else tree.payloads[i])
        out.children.append([])
        if parent >= 0:
            out.children[parent].append(at)
        if not again:
            stack += [(c, at) for c in reversed(tree.children[i])]
    return out


def rename_cost(a: tuple[str, str], b: tuple[str, str]) -> float:
    if a == b or "Sort" in (a[0], b[0]):
        return 0.0
    return 0.5 if CATEGORY[a[0]] == CATEGORY[b[0]] else 1.0


def _postorder(tree: Tree) -> tuple[list[int], list[int]]:
    """Nodes in post-order and, for each, the position of its leftmost leaf."""
    order, stack = [], [0] if len(tree) else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack += tree.children[i]
    order.reverse()
    place = {i: k for k, i in enumerate(order)}
    left = []
    for k, i in enumerate(order):
        left.append(left[place[tree.children[i][0]]] if tree.children[i] else k)
    return order, left


def edit_distance(a: Tree, b: Tree) -> float:
    """Ordered tree edit distance (Zhang and Shasha); insertions and deletions cost 1."""
    (ao, al), (bo, bl) = _postorder(a), _postorder(b)
    roots = lambda left: sorted({x: k for k, x in enumerate(left)}.values())
    cost = [[rename_cost((a.tags[i], a.payloads[i]), (b.tags[j], b.payloads[j])) for j in bo] for i in ao]
    dist = [[0.0] * len(bo) for _ in ao]
    for i in roots(al):
        for j in roots(bl):
            base_i, base_j = al[i], bl[j]
            rows = [[float(y) for y in range(j - base_j + 2)]]
            for x in range(base_i, i + 1):
                row, above = [float(x - base_i + 1)], rows[-1]
                for y in range(base_j, j + 1):
                    step = min(above[y - base_j + 1], row[-1]) + 1
                    if al[x] == base_i and bl[y] == base_j:
                        row.append(min(step, above[y - base_j] + cost[x][y]))
                        dist[x][y] = row[-1]
                    else:
                        row.append(min(step, rows[al[x] - base_i][bl[y] - base_j] + dist[x][y]))
                rows.append(row)
    return dist[-1][-1] if ao and bo else float(len(ao) + len(bo))


def edit_similarity(a: Tree, b: Tree) -> float:
    return max(0.0, 1 - edit_distance(a, b) / max(len(a), len(b), 1))


def _subtree_sizes(tree: Tree) -> list[int]:
    sizes = [1] * len(tree)
    for i in range(len(tree) - 1, -1, -1):
        sizes[i] += sum(sizes[c] for c in tree.children[i])
    return sizes


def structural_match(a: Tree, b: Tree) -> float:
    """Share of nodes that correspond from the roots down: equal kinds count 1, kinds of one category half,
    others nothing and end the descent. A sort without children matches any subtree whole; under two products
    it makes the types match whole."""
    sizes_a, sizes_b = _subtree_sizes(a), _subtree_sizes(b)
    is_any = lambda t, i: t.tags[i] == "Sort" and not t.children[i]
    total, stack = 0.0, [(0, 0)] if len(a) and len(b) else []
    while stack:
        i, j = stack.pop()
        x, y = a.children[i], b.children[j]
        if a.tags[i] == b.tags[j] == "Prod" and len(x) == len(y) == 2 and (is_any(a, x[0]) or is_any(b, y[0])):
            total += 1 + max(sizes_a[x[0]], sizes_b[y[0]])
            stack.append((x[1], y[1]))
        elif is_any(a, i) != is_any(b, j):
            total += sizes_b[j] if is_any(a, i) else sizes_a[i]
        elif CATEGORY[a.tags[i]] == CATEGORY[b.tags[j]]:
            total += 1.0 if a.tags[i] == b.tags[j] else 0.5
            stack += list(zip(x, y))
    return total / max(len(a), len(b), 1)
