"""Rooted trees: parsing, shaping and measuring small trees on the driver, and closures of large ones as edge tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import stage


class Node:
    __slots__ = ("name", "length", "children", "parent", "label", "id")

    def __init__(self, name: str = "", length: float = 0.0, children: Iterable[Node] = ()):
        self.name, self.length, self.children, self.parent, self.label, self.id = name, length, list(children), None, None, -1
        for c in self.children:
            c.parent = self

    # -- walks

    def preorder(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)

    def postorder(self) -> Iterator[Node]:
        return reversed(list(self._reverse_postorder()))

    def _reverse_postorder(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += node.children

    def inorder(self) -> Iterator[Node]:
        if not self.children:
            yield self
            return
        yield from self.children[0].inorder()
        yield self
        for c in self.children[1:]:
            yield from c.inorder()

    def leaves(self) -> list[Node]:
        return [n for n in self.preorder() if not n.children]

    def leaf_names(self) -> list[str]:
        return [n.name for n in self.leaves()]

    def find(self, name: str) -> Node | None:
        return next((n for n in self.preorder() if n.name == name), None)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    # -- measures

    def total_length(self) -> float:
        """Sum of all branches below this node."""
        return sum(n.length for n in self.preorder() if n is not self)

    def longest_branch(self) -> float:
        return max((n.length for n in self.preorder() if n is not self), default=0.0)

    def depth(self) -> float:
        """Distance to the root."""
        return self.length * (self.parent is not None) + sum(n.length for n in self.ancestors() if n.parent is not None)

    def distances(self) -> dict[tuple[str, str], float]:
        """Path length of each pair of leaves (named in the order of the walk)."""
        leaves = self.leaves()
        return {(a.name, b.name): path_length(a, b) for i, a in enumerate(leaves) for b in leaves[i + 1 :]}


def parse(text: str) -> Node:
    """A Newick tree; nodes with more than two children (but for the root's three) are made binary with branches of length 0."""
    tokens = re.findall(r"[(),;]|:[^(),;]+|[^(),:;\s]+", text.strip())
    at = 0

    def node() -> Node:
        nonlocal at
        children = []
        if tokens[at] == "(":
            while True:
                at += 1
                children.append(node())
                if tokens[at] != ",":
                    break
            if tokens[at] != ")":
                raise ValueError("a bracket is not closed")
            at += 1
        out = Node(children=children)
        if at < len(tokens) and tokens[at] not in "(),;" and tokens[at][0] != ":":
            out.name = tokens[at]
            at += 1
        if at < len(tokens) and tokens[at][0] == ":":
            length, _, label = tokens[at][1:].strip().partition("#")
            out.length, out.label = float(length), label.strip() or None
            at += 1
        return out

    root = node()
    for n in list(root.preorder()):
        while len(n.children) > 2:
            joined = Node("", 0.0, n.children[-2:])
            joined.parent = n
            n.children[-2:] = [joined]
    return number(root)


def number(root: Node) -> Node:
    for i, n in enumerate(root.preorder()):
        n.id = i
    return root


def newick(node: Node, digits: int = 6) -> str:
    def part(n: Node) -> str:
        inner = "(" + ",".join(map(part, n.children)) + ")" if n.children else ""
        return inner + n.name + ("" if n.parent is None else f":{n.length:.{digits}f}")

    return part(node) + ";"


def copy(node: Node) -> Node:
    out = Node(node.name, node.length, [copy(c) for c in node.children])
    out.label, out.id = node.label, node.id
    return out


def lca(nodes: Iterable[Node]) -> Node:
    """Lowest common ancestor."""
    nodes = list(nodes)
    common = [nodes[0], *nodes[0].ancestors()]
    for n in nodes[1:]:
        above = {id(n), *map(id, n.ancestors())}
        common = [c for c in common if id(c) in above]
    return common[0]


def path_length(a: Node, b: Node) -> float:
    top = lca([a, b])
    return a.depth() + b.depth() - 2 * (top.depth() if top.parent is not None else 0.0)


def scale(root: Node, factor: float) -> Node:
    for n in root.preorder():
        n.length *= factor
    return root


def scale_subtree(root: Node, name: str, factor: float, with_branch: bool = False) -> Node:
    top = root.find(name)
    for n in top.preorder():
        if n is not top or with_branch:
            n.length *= factor
    return root


def prune(root: Node, names: Iterable[str], keep: bool = False) -> tuple[Node | None, list[str]]:
    """The tree without (or with only) some leaves, nodes with one child merged into it; and the removed names."""
    names = set(names)
    removed: list[str] = []

    def part(n: Node) -> Node | None:
        if not n.children:
            if (n.name in names) == keep:
                return copy(n)
            removed.append(n.name)
            return None
        rest = [c for c in map(part, n.children) if c is not None]
        if not rest:
            return None
        if len(rest) == 1:
            rest[0].length += n.length
            return rest[0]
        out = Node(n.name, n.length, rest)
        out.label = n.label
        return out

    out = part(root)
    if out is not None:
        out.length = 0.0
        number(out)
    return out, removed


def subtree(root: Node, name: str) -> Node:
    """A copy of what lies below (and with) a node, as a tree of its own."""
    out = copy(root.find(name))
    out.parent, out.length = None, 0.0
    return number(out)


def supertree(root: Node, name: str) -> Node | None:
    """The tree without the leaves below a node."""
    return prune(root, subtree(root, name).leaf_names())[0]


def split_leaves(root: Node, name: str) -> tuple[list[str], list[str]]:
    """Leaf names inside and outside a subtree."""
    inside = set(root.find(name).leaf_names())
    return [x for x in root.leaf_names() if x in inside], [x for x in root.leaf_names() if x not in inside]


def name_ancestors(root: Node) -> Node:
    """Ancestors without a name get the first leaf on their left and the first on their right, joined by '-'."""
    for n in root.postorder():
        if n.children and not n.name:
            n.name = "-".join(c.leaves()[0].name for c in n.children[:2])
    return root


def label_subtree(root: Node, name: str, label: str, with_branch: bool = True) -> Node:
    top = root.find(name)
    for n in top.preorder():
        if n is not top or with_branch:
            n.label = label
    return root


def reroot(root: Node, name: str, at: float = 0.5) -> Node:
    """The tree with its root on the branch above a node, at a share of its length from the node; an old root left with one child goes."""
    target = root.find(name)
    if target.parent is None:
        return number(copy(root))
    links: dict[int, list[tuple[Node, float]]] = {}
    for n in root.preorder():
        if n.parent is not None and n is not target:
            links.setdefault(id(n), []).append((n.parent, n.length))
            links.setdefault(id(n.parent), []).append((n, n.length))

    def hang(n: Node, above: Node | None, length: float) -> Node:
        kids = [hang(m, n, x) for m, x in links.get(id(n), []) if m is not above]
        if len(kids) == 1 and n.children:
            kids[0].length += length
            return kids[0]
        out = Node(n.name, length, kids)
        out.label = n.label
        return out

    return number(Node("", 0.0, [hang(target, None, target.length * at), hang(target.parent, None, target.length * (1 - at))]))


def midpoint(root: Node) -> Node:
    """Rerooted in the middle of the longest path between two leaves."""
    leaves = root.leaves()
    a, b = max(((x, y) for i, x in enumerate(leaves) for y in leaves[i + 1 :]), key=lambda p: path_length(*p))
    half, top = path_length(a, b) / 2, lca([a, b])
    for n in (a, b):
        gone = 0.0
        while n is not top:
            if gone + n.length >= half:
                named = name_ancestors(copy(root)) if not n.name else root
                return reroot(named, named.find(n.name).name if n.name else next(x for x in named.preorder() if x.id == n.id).name, (half - gone) / n.length if n.length else 0.5)
            gone += n.length
            n = n.parent
    return number(copy(root))


def parsimony(root: Node, states: dict[str, str]) -> tuple[int, dict[int, set[str]]]:
    """Least number of changes for one column (gaps and missing ones are open), and the sets of states of the nodes, by id."""
    sets: dict[int, set[str]] = {}
    changes = 0
    for n in root.postorder():
        if not n.children:
            s = states.get(n.name, "*")
            sets[n.id] = set() if s in "-*N" else {s}
            continue
        known = [sets[c.id] for c in n.children if sets[c.id]]
        if not known:
            sets[n.id] = set()
            continue
        common = set.intersection(*known)
        if not common:
            changes += 1
            common = set.union(*known)
        sets[n.id] = common
    return changes, sets


def edges(root: Node) -> list[tuple[int, int | None, float, str, str | None]]:
    """node, parent, len, name and label of every node."""
    return [(n.id, None if n.parent is None else n.parent.id, n.length, n.name, n.label) for n in root.preorder()]


def from_edges(rows: Iterable[tuple[int, int | None, float, str]]) -> Node:
    rows = list(rows)
    nodes = {r[0]: Node(r[3] or "", r[2] or 0.0) for r in rows}
    root = None
    for r in rows:
        if r[1] is None:
            root = nodes[r[0]]
        else:
            nodes[r[1]].children.append(nodes[r[0]])
            nodes[r[0]].parent = nodes[r[1]]
    return number(root)


def topologies(names: list[str]) -> Iterator[Node]:
    """All rooted binary topologies over some leaves."""
    if len(names) == 1:
        yield Node(names[0], 1.0)
        return
    *rest, last = names
    for tree in topologies(rest):
        for i in range(len(list(tree.preorder()))):
            other = copy(tree)
            at = list(other.preorder())[i]
            joined = Node("", 1.0, [])
            parent = at.parent
            joined.children = [at, Node(last, 1.0)]
            for c in joined.children:
                c.parent = joined
            if parent is None:
                yield number(joined)
            else:
                parent.children = [joined if c is at else c for c in parent.children]
                joined.parent = parent
                yield number(other)


# -- large trees as edge tables ----------------------------------------------------------------------------------------


def closure(edge_rows: DataFrame) -> DataFrame:
    """node, ancestor, dist (edges) and length of every pair on a path to the root, the node itself included.

    Paths double in length each round, so a tree of depth d takes about log2(d) joins; each round is staged.
    Edges with a cycle are refused.
    """
    step = edge_rows.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("dist"), F.col("len").cast("double").alias("length")).filter(F.col("ancestor").isNotNull())
    self_ = edge_rows.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist"), F.lit(0.0).alias("length"))
    root = edge_rows.select(F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct().join(edge_rows.select("node"), "node", "left_anti")
    self_ = self_.unionByName(root.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist"), F.lit(0.0).alias("length")))
    paths, reach = stage(step, "paths"), 1
    while True:
        further = paths.filter(F.col("dist") == reach).alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.node"))
        more = further.select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.dist") + F.col("b.dist")).alias("dist"), (F.col("a.length") + F.col("b.length")).alias("length"))
        more = stage(more, "paths")
        if not more.limit(1).count():
            break
        if more.filter("node = ancestor").limit(1).count():
            raise ValueError("the edges have a cycle")
        paths, reach = paths.unionByName(more), 2 * reach
    return self_.unionByName(paths)


def subtree_aggregate(closure_rows: DataFrame, values: DataFrame, aggs: list) -> DataFrame:
    """ancestor and aggs over the values (node, ...) of everything below it."""
    return closure_rows.join(values, "node").groupBy("ancestor").agg(*aggs)


def lca_pairs(closure_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, lca and path (their distance) of pairs of nodes."""
    up = closure_rows.select("node", "ancestor", "dist", "length")
    a = pairs.join(up.select(F.col("node").alias("a"), F.col("ancestor").alias("lca"), F.col("dist").alias("da"), F.col("length").alias("la")), "a")
    both = a.join(up.select(F.col("node").alias("b"), F.col("ancestor").alias("lca"), F.col("length").alias("lb")), ["b", "lca"])
    best = both.groupBy("a", "b").agg(F.min_by(F.struct("lca", (F.col("la") + F.col("lb")).alias("path")), "da").alias("x"))
    return best.select("a", "b", F.col("x.lca").alias("lca"), F.col("x.path").alias("path"))


def apply_to_tree(text: str, function: Callable[[Node], Node]) -> str:
    return newick(function(parse(text)))
