"""Decision trees: growing on histograms, scoring as one expression, explaining, exporting.

A tree is a small list of nodes on the driver; rows never leave the cluster.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.operators import histogram, split
from timberline.operators.binning import Mapper
from timberline.operators.spec import valid
from timberline.session import materialize


@dataclass
class Node:
    """A leaf, or a split whose rows at or below the threshold (or in the set) go left."""

    feature: str | None = None
    threshold: float = 0.0
    bin: int = -1
    categories: list[int] = field(default_factory=list)
    default_left: bool = True
    zero_is_missing: bool = False
    left: int = -1
    right: int = -1
    value: float = 0.0
    weight: float = 0.0
    count: int = 0
    gain: float = 0.0
    linear: dict[str, float] = field(default_factory=dict)  # of a leaf: coefficients

    @property
    def is_leaf(self) -> bool:
        return self.feature is None


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node()])
    rate: float = 1.0

    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.is_leaf]

    def depth(self, at: int = 0) -> int:
        n = self.nodes[at]
        return 0 if n.is_leaf else 1 + max(self.depth(n.left), self.depth(n.right))

    def branch(self, leaf: int) -> list[str]:
        """Features on the way to a node."""
        parent = {c: i for i, n in enumerate(self.nodes) if not n.is_leaf for c in (n.left, n.right)}
        out = []
        while leaf in parent:
            leaf = parent[leaf]
            out.append(self.nodes[leaf].feature)
        return out[::-1]

    def expected_value(self) -> float:
        """Mean leaf value by rows."""
        total = sum(self.nodes[i].count for i in self.leaves())
        return self.rate * sum(self.nodes[i].value * self.nodes[i].count for i in self.leaves()) / max(total, 1)

    def bounds(self) -> tuple[float, float]:
        values = [self.rate * self.nodes[i].value for i in self.leaves()]
        return min(values), max(values)


def goes_left(n: Node) -> Column:
    """Routing of raw values: missing values follow the default side; categories outside the set go right."""
    v = valid(n.feature)
    if n.categories:
        return F.coalesce(F.when(v.between(-2e9, 2e9), v).cast("int").isin(n.categories), F.lit(False))
    missing = v.isNull() | (F.abs(v) <= 1e-35) if n.zero_is_missing else v.isNull()
    return F.when(missing, F.lit(n.default_left)).otherwise(v <= n.threshold)


def _walk(tree: Tree, at: int, leaf, test) -> Column:
    n = tree.nodes[at]
    if n.is_leaf:
        return leaf(at)
    return F.when(test(n), _walk(tree, n.left, leaf, test)).otherwise(_walk(tree, n.right, leaf, test))


def score_expression(tree: Tree) -> Column:
    """The tree as one nested CASE; leaves may be linear, falling back to their value where a used feature is missing."""

    def leaf(i: int) -> Column:
        n = tree.nodes[i]
        if not n.linear:
            return F.lit(float(tree.rate * n.value))
        total = sum((valid(f) * c for f, c in n.linear.items() if f), F.lit(n.linear.get("", 0.0)))
        return F.coalesce(total, F.lit(float(n.value))) * tree.rate

    return _walk(tree, 0, leaf, goes_left)


def leaf_expression(tree: Tree) -> Column:
    """The number of the leaf a row falls in."""
    return _walk(tree, 0, lambda i: F.lit(i), goes_left)


def bin_leaf_expression(tree: Tree, missing: dict[str, int], prefix: str = "bin_", categories: dict[str, dict[int, int]] | None = None) -> Column:
    """The same in bin space, while growing; ``categories`` maps the values of categorical features to bins."""

    def test(n: Node) -> Column:
        at = F.col(prefix + n.feature)
        if n.categories:
            return split.in_set(at, sorted({categories[n.feature][c] for c in n.categories}))
        return split.goes_left(at, n.bin, missing.get(n.feature), n.default_left)

    return _walk(tree, 0, lambda i: F.lit(i), test)


def grow(
    binned: DataFrame,
    mappers: list[Mapper],
    num_leaves: int = 7,
    l1: float = 0.0,
    l2: float = 0.0,
    min_data: int = 20,
    min_hessian: float = 1e-3,
    max_depth: int = 32,
    rate: float = 1.0,
    features: list[str] | None = None,
    monotone: dict[str, int] | None = None,
    constraints: list[set[str]] | None = None,
    forced: list[tuple] | None = None,
    smooth: float = 0.0,
    max_delta: float = 0.0,
    penalty: dict[str, float] | None = None,
    extra: int | None = None,
    category_smooth: float = 10.0,
    bundle: histogram.BundlePlan | None = None,
    monotone_rule: str = "middle",
    once: dict[str, float] | None = None,
    each: dict[str, float] | None = None,
    used: set[str] | None = None,
    count: str | None = None,
) -> Tree:
    """Grow a tree best leaf first on ``binned`` rows with ``bin_*``, ``g`` and ``h`` columns.

    One job sums the histograms of all leaves that the next rounds may ask for:
    the new leaves, and the children of every open leaf whose best split is
    known and may still be taken.  So passes over the rows grow with the depth
    of the tree, not with its leaves, and the tree is the one that splitting a
    leaf a job would give.  Of two children only the lighter one's rows are
    summed; the other's histogram is what that leaves of their parent's.
    Leaves are expressions, so no row is rewritten; the driver sees one
    candidate row a leaf.

    ``forced`` lists the first splits as ``(leaf, feature, bin)``: the leaf's
    number in the tree so far, 0 at first, each split adding a left and a right
    one after those there are; ``(feature, bin)`` stands for leaf 0.  A split
    that leaves too little on one side is an error.  With ``bundle`` the rows
    also hold its columns, and histograms are summed over those.

    With ``monotone_rule="neighbours"`` a leaf is bounded by the outputs of the
    leaves that lie beside it along a monotone feature, not by the middle of an
    old split: the bounds move as the tree grows, cuts are weighed with outputs
    within them, and a leaf whose bounds moved is searched anew from its kept
    histogram.  Leaves are then looked at one split at a time.

    ``once`` prices a feature's first use in the model (``used`` names those
    that earlier trees paid for, and is added to), ``each`` its first use for a
    row: the price counts for every row of the leaf whose bit in the column
    ``__paid`` is not set (bits by the order of the names) and whose path has
    not asked for the feature.  Once a feature is paid for, the open leaves are
    searched again from their histograms.

    ``smooth`` draws outputs towards the parent's, ``max_delta`` bounds them
    (0: not at all), ``penalty`` takes a feature's cost off its gains, ``extra``
    seeds random cuts, and ``monotone`` keeps outputs below a split of that
    feature on their side of the middle of its two outputs.  ``count`` names
    the column that says how many rows a row of ``binned`` stands for.
    """
    from timberline.operators.sampling import allowed_features

    stands = F.lit(1) if count is None else F.col(count)

    by_name = {m.feature: m for m in mappers}
    features = features or list(by_name)
    unordered = {f: by_name[f].default_bin for f in features if by_name[f].kind == "categorical"}
    categories = {f: by_name[f].categories for f in unordered}
    missing = {m.feature: m.default_bin for m in mappers if m.missing == "separate" and m.kind != "categorical"}
    limits = {"l1": l1, "l2": l2, "min_data": min_data, "min_hessian": min_hessian, "unordered": unordered, "category_smooth": category_smooth}
    root = binned.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.coalesce(F.sum(stands), F.lit(0)).alias("n"))
    first = root.select("n", "h", split.leaf_value(F.col("g"), F.col("h"), l1, l2).alias("value")).first()
    start = first["value"] or 0.0
    if max_delta > 0:
        start = max(-max_delta, min(max_delta, start))
    wide = Tree([Node(value=start, weight=first["h"] or 0.0, count=first["n"])])  # every split looked at
    candidates: dict[int, dict | None] = {}  # best split of each leaf looked at
    parent: dict[int, int] = {}
    frames: list[DataFrame] = []  # histograms, kept until the tree is grown
    light: list[DataFrame] = []  # those of them that were summed from rows
    held: dict[int, int] = {}  # which of them holds a leaf's
    widths = {f: by_name[f].n_bins + 2 for f in features}
    depth = {0: 0}
    near = monotone_rule == "neighbours"
    once, each, used = once or {}, each or {}, set() if used is None else used
    unpaid: dict[int, dict[str, int]] = {}  # a leaf's rows that never asked for a feature
    stepwise = bool(near and monotone) or bool(once) or bool(each)
    boxes: dict[int, dict[str, tuple[int, int]]] = {0: {}}  # bins that a leaf's numerical features may have
    bounds = {0: (-math.inf, math.inf)}

    def sums(leaves: list[int]) -> DataFrame:
        twins = {}  # the lighter child and the heavier, by parent
        for leaf in leaves:
            twins.setdefault(parent.get(leaf, -1), []).append(leaf)
        links = [(p, *sorted(pair, key=lambda i: (wide.nodes[i].count, i))) for p, pair in twins.items() if p in held and len(pair) == 2]
        heavy = {c for _, _, c in links}
        at = bin_leaf_expression(wide, missing, categories=categories)
        light_ones = [leaf for leaf in leaves if leaf not in heavy]
        if bundle is None:
            hist = histogram.leaf_histograms(binned, widths, at, light_ones, count=stands)
        else:
            hist = histogram.leaf_histograms(binned, {c: bundle.width(c) for c in bundle.columns}, at, light_ones, count=stands)
            hist = histogram.unbundled(hist, bundle).where(F.col("feature").isin(features))
        if links:
            whole = [frames[k].where(F.col("leaf").isin([p for p, _, _ in links if held[p] == k])) for k in sorted({held[p] for p, _, _ in links})]
            hist = hist.cache()
            light.append(hist)
            hist = hist.unionByName(histogram.siblings(reduce(DataFrame.unionByName, whole), hist, links))
        parts = min(len(leaves), binned.sparkSession.sparkContext.defaultParallelism)
        frames.append(hist.repartition(parts, "leaf").cache())  # all windows of the search are within a leaf
        held.update(dict.fromkeys(leaves, len(frames) - 1))
        return frames[-1]

    def look(leaves: list[int]) -> None:
        if each:
            at = bin_leaf_expression(wide, missing, categories=categories)
            free = [F.sum(F.when(F.col("__paid").bitwiseAND(F.lit(1 << k)) == 0, stands).otherwise(0)).alias(f"u{k}") for k in range(len(each))]
            for r in binned.select(at.alias("leaf"), "__paid", *([count] if count else [])).where(F.col("leaf").isin(leaves)).groupBy("leaf").agg(*free).collect():  # a row a leaf
                unpaid[r["leaf"]] = {f: r[f"u{k}"] for k, f in enumerate(sorted(each))}
        search(leaves, allowed_only(sums(leaves), leaves))

    def allowed_only(hist: DataFrame, leaves: list[int]) -> DataFrame:
        if not constraints:
            return hist
        allowed = F.lit(False)
        for leaf in leaves:
            allowed = allowed | ((F.col("leaf") == leaf) & F.col("feature").isin(allowed_features(features, set(wide.branch(leaf)), constraints)))
        return hist.where(allowed)

    def price(leaf: int) -> dict[tuple[int, str], float]:
        path = set(wide.branch(leaf))
        rows = {f: 0 if f in path else unpaid.get(leaf, {}).get(f, 0) for f in features}
        return {(leaf, f): (penalty or {}).get(f, 0.0) + (0.0 if f in used else once.get(f, 0.0)) + each.get(f, 0.0) * rows[f] for f in features}

    def search(leaves: list[int], hist: DataFrame) -> None:
        within = {leaf: bounds[leaf] for leaf in leaves} if near and monotone else None
        cost = {k: v for leaf in leaves for k, v in price(leaf).items()} if once or each else penalty
        best = split.with_values(split.best_splits(hist, monotone=monotone, penalty=cost, extra=extra, bounds=within, **limits), l1, l2)
        candidates.update(dict.fromkeys(leaves))
        candidates.update({r["leaf"]: r.asDict() for r in best.collect()})  # a row a leaf

    def output(value: float, weight: float, parent: int) -> float:
        if max_delta > 0:
            value = max(-max_delta, min(max_delta, value))
        if smooth > 0:
            share = smooth / (smooth + weight)
            value = (1 - share) * value + share * wide.nodes[parent].value
        low, high = bounds[parent]
        return max(low, min(high, value))

    def children(leaf: int, r: dict) -> list[int]:
        """Split a leaf of ``wide`` if it is not split yet; the numbers of its children."""
        old = wide.nodes[leaf]
        if not old.is_leaf:
            return [old.left, old.right]
        name, m = r["feature"], by_name[r["feature"]]
        left, right = len(wide.nodes), len(wide.nodes) + 1
        values = [output(r["left_value"], r["left_h"], leaf), output(r["right_value"], r["right_h"], leaf)]
        node = Node(name, left=left, right=right, value=old.value, weight=old.weight, count=old.count, gain=r["gain"])
        if name in unordered:
            node.categories = sorted(c for c, b in m.categories.items() if b in set(r["bins"]))
            node.default_left = False
        else:
            node.threshold = m.bounds[r["bin"]] if r["bin"] < len(m.bounds) - 1 else max(m.bounds[-1], m.highest)
            node.bin = r["bin"]
            node.default_left = False if name in missing else r["default_left"]
        wide.nodes[leaf] = node
        wide.nodes.append(Node(value=values[0], weight=r["left_h"], count=r["left_n"]))
        wide.nodes.append(Node(value=values[1], weight=r["right_h"], count=r["right_n"]))
        depth[left] = depth[right] = depth[leaf] + 1
        parent[left] = parent[right] = leaf
        bounds[left] = bounds[right] = bounds[leaf]
        sign = (monotone or {}).get(name, 0)
        boxes[left], boxes[right] = dict(boxes[leaf]), dict(boxes[leaf])
        if name not in unordered:
            low, high = boxes[leaf].get(name, (0, widths[name]))
            boxes[left][name], boxes[right][name] = (low, r["bin"]), (r["bin"] + 1, high)
        if sign and near:
            if sign * (values[1] - values[0]) < 0:  # smoothing turned them round
                for child in (left, right):
                    wide.nodes[child].value = sum(values) / 2
        elif sign:
            middle, (low, high) = sum(values) / 2, bounds[leaf]
            below, above = (left, right) if sign > 0 else (right, left)
            bounds[below], bounds[above] = (low, middle), (middle, high)
        return [left, right]

    def beside(leaf: int) -> tuple[float, float]:
        """What the outputs of the present leaves leave room for."""
        low, high = -math.inf, math.inf
        for other in place.values():
            apart = [f for f in {*boxes[leaf], *boxes[other]} if boxes[leaf].get(f, (0, widths[f]))[0] > boxes[other].get(f, (0, widths[f]))[1] or boxes[leaf].get(f, (0, widths[f]))[1] < boxes[other].get(f, (0, widths[f]))[0]]
            if other == leaf or len(apart) != 1 or not monotone.get(apart[0], 0):
                continue
            above = boxes[leaf].get(apart[0], (0, widths[apart[0]]))[0] > boxes[other].get(apart[0], (0, widths[apart[0]]))[1]
            if above == (monotone[apart[0]] > 0):
                low = max(low, wide.nodes[other].value)
            else:
                high = min(high, wide.nodes[other].value)
        return low, high

    def rebound() -> None:
        """Bounds of all open leaves; those that moved are searched again."""
        moved = []
        for at in place.values():
            new = beside(at)
            if new != bounds[at]:
                bounds[at] = new
                if at in candidates:
                    moved.append(at)
        search_again(moved)

    def search_again(moved: list[int]) -> None:
        if moved:
            kept = [frames[k].where(F.col("leaf").isin([at for at in moved if held[at] == k])) for k in sorted({held[at] for at in moved})]
            search(moved, allowed_only(reduce(DataFrame.unionByName, kept), moved))

    tree = Tree([replace(wide.nodes[0])], rate)
    place = {0: 0}  # leaves of the grown tree, and what they are in ``wide``

    def take(leaf: int) -> None:
        at = place.pop(leaf)
        pair = children(at, candidates[at])
        left, right = len(tree.nodes), len(tree.nodes) + 1
        tree.nodes[leaf] = replace(wide.nodes[at], left=left, right=right)
        for number, child in zip((left, right), pair, strict=True):
            node = wide.nodes[child]
            tree.nodes.append(Node(value=node.value, weight=node.weight, count=node.count))
            place[number] = child
        if near and monotone:
            rebound()
        name = tree.nodes[leaf].feature
        if name in once and name not in used:
            search_again([at for at in place.values() if at in candidates and not used.add(name)])
        used.add(name)

    for leaf, feature, cut in ((f if len(f) == 3 else (0, *f)) for f in forced or []):
        if leaf not in place or feature not in by_name:
            raise ValueError(f"forced split {(leaf, feature, cut)}: no such leaf or feature")
        at = place[leaf]
        if at not in held:
            sums([at])
        hist = frames[held[at]].where((F.col("leaf") == at) & (F.col("feature") == feature))
        hit = split.with_values(split.candidates(hist, **limits).where(F.col("bin") == cut), l1, l2).collect()
        if not hit:
            raise ValueError(f"forced split {(leaf, feature, cut)}: too little on one side")
        candidates[at] = hit[0].asDict()
        take(leaf)
    while len(place) < num_leaves:
        fresh = [at for at in place.values() if at not in candidates and depth[at] < max_depth]
        known = sorted((at for at in place.values() if candidates.get(at)), key=lambda at: -candidates[at]["gain"])
        if fresh:
            ahead = [] if stepwise else [c for at in known[: num_leaves - len(place)] for c in children(at, candidates[at])]
            look(fresh + [c for c in ahead if c not in candidates and depth[c] < max_depth])
        open_ = [leaf for leaf, at in place.items() if candidates.get(at)]
        if not open_:
            break
        take(min(open_, key=lambda leaf: (-candidates[place[leaf]]["gain"], leaf)))
    for frame in [*frames, *light]:
        frame.unpersist()
    return tree


def refit(df: DataFrame, tree: Tree, gradient: str = "g", hessian: str = "h", l1: float = 0.0, l2: float = 0.0, decay: float = 0.9) -> Tree:
    """The same splits with outputs drawn towards those of new rows: ``decay`` times the old plus the rest of the new.

    One aggregation by leaf; leaves without rows keep their output.
    """
    out = Tree([replace(n) for n in tree.nodes], tree.rate)
    sums = df.groupBy(leaf_expression(tree).alias("leaf")).agg(F.sum(gradient).alias("g"), F.sum(hessian).alias("h"), F.count("*").alias("n"))
    for r in sums.select("leaf", "n", "h", split.leaf_value(F.col("g"), F.col("h"), l1, l2).alias("value")).collect():  # a row a leaf
        n = out.nodes[r["leaf"]]
        n.value, n.weight, n.count = decay * n.value + (1 - decay) * (r["value"] or 0.0), r["h"] or 0.0, r["n"]
    return out


def refit_linear(df: DataFrame, tree: Tree, features: list[str], gradient: str = "g", hessian: str = "h", l2: float = 1.0) -> Tree:
    """Give each leaf a ridge regression on ``features``: sums of products per leaf, solved on the driver."""
    xs = [F.lit(1.0), *[valid(f) for f in features]]
    at = leaf_expression(tree)
    aggregates = [F.sum(xs[i] * xs[j] * F.col(hessian)).alias(f"a{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    aggregates += [F.sum(xs[i] * F.col(gradient)).alias(f"b{i}") for i in range(len(xs))]
    complete = df.where(~F.exists(F.array(*[valid(f) for f in features]), lambda x: x.isNull()))
    for r in complete.groupBy(at.alias("leaf")).agg(*aggregates).collect():  # a row a leaf
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(len(xs))] for i in range(len(xs))], dtype=float)
        b = np.array([r[f"b{i}"] for i in range(len(xs))], dtype=float)
        w = -np.linalg.solve(a + l2 * np.diag([1e-9] + [1.0] * len(features)), b)
        tree.nodes[r["leaf"]].linear = dict(zip(["", *features], w.tolist(), strict=True))
    return tree


def fit_linear(df: DataFrame, tree: Tree, l2: float = 1.0, gradient: str = "g", hessian: str = "h", skip: set[str] | None = None) -> Tree:
    """Give each leaf a ridge regression on the features of its own path, all leaves in one aggregation.

    A feature that is not on a leaf's path counts as 0 there, so the sums of
    products of all leaves stand side by side, whatever their paths.  Rows that
    miss a feature of their path do not count, and are scored by the leaf's
    plain output, as are leaves with fewer rows than coefficients.  ``skip``
    names features that are no numbers.
    """
    paths = {leaf: [f for f in dict.fromkeys(tree.branch(leaf)) if f not in (skip or set())] for leaf in tree.leaves()}
    names = sorted({f for path in paths.values() for f in path})
    if not names:
        return tree
    rows = df.withColumn("__leaf", leaf_expression(tree))
    on = {f: F.col("__leaf").isin([leaf for leaf, path in paths.items() if f in path]) for f in names}
    xs = [F.lit(1.0), *[F.when(on[f], valid(f)).otherwise(0.0) for f in names]]
    rows = rows.select("__leaf", F.col(gradient).alias("__g"), F.col(hessian).alias("__h"), *[x.alias(f"__x{i}") for i, x in enumerate(xs)]).where(reduce(lambda a, b: a & b, [F.col(f"__x{i}").isNotNull() for i in range(len(xs))]))
    x = [F.col(f"__x{i}") for i in range(len(xs))]
    sums = [F.sum(x[i] * x[j] * F.col("__h")).alias(f"a{i}_{j}") for i in range(len(x)) for j in range(i, len(x))] + [F.sum(x[i] * F.col("__g")).alias(f"b{i}") for i in range(len(x))]
    for r in rows.groupBy("__leaf").agg(F.count("*").alias("n"), *sums).collect():  # a row a leaf
        path = paths[r["__leaf"]]
        at = [0, *[names.index(f) + 1 for f in path]]
        if r["n"] <= len(at):
            continue
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in at] for i in at], dtype=float)
        b = np.array([r[f"b{i}"] for i in at], dtype=float)
        w = -np.linalg.solve(a + l2 * np.diag([0.0] + [1.0] * len(path)) + 1e-12 * np.eye(len(at)), b)
        tree.nodes[r["__leaf"]].linear = dict(zip(["", *path], w.tolist(), strict=True))
    return tree


def to_dict(tree: Tree) -> dict:
    return {"rate": tree.rate, "nodes": [asdict(n) for n in tree.nodes]}


def from_dict(d: dict) -> Tree:
    return Tree([Node(**n) for n in d["nodes"]], d["rate"])


def to_json(tree: Tree) -> str:
    return json.dumps(to_dict(tree))


def from_json(text: str) -> Tree:
    return from_dict(json.loads(text))


def to_text(tree: Tree) -> str:
    """Lines of ``key=value``, one list per field."""
    fields = list(asdict(Node()))
    lines = [f"num_leaves={len(tree.leaves())}", f"rate={tree.rate!r}"]
    return "\n".join(lines + [f"{f}={json.dumps([getattr(n, f) for n in tree.nodes])}" for f in fields]) + "\n"


def from_text(text: str) -> Tree:
    values = dict(line.split("=", 1) for line in text.strip().splitlines())
    columns = {f: json.loads(values[f]) for f in asdict(Node())}
    n = len(columns["feature"])
    return Tree([Node(**{f: c[i] for f, c in columns.items()}) for i in range(n)], float(values["rate"]))


def to_sql(tree: Tree, at: int = 0) -> str:
    """The tree as a SQL CASE expression that other engines can run."""
    n = tree.nodes[at]
    if n.is_leaf:
        return repr(float(tree.rate * n.value))
    if n.categories:
        test = f"coalesce({n.feature} IN ({', '.join(map(str, n.categories))}), false)"
    else:
        side = "true" if n.default_left else "false"
        test = f"coalesce({n.feature} <= CAST({n.threshold!r} AS DOUBLE), {side})"
    return f"CASE WHEN {test} THEN {to_sql(tree, n.left)} ELSE {to_sql(tree, n.right)} END"


def importance(trees: list[Tree], kind: str = "split") -> dict[str, float]:
    """Per feature: splits, total gain, or rows covered, over all trees; largest first."""
    worth = {"split": lambda n: 1.0, "gain": lambda n: n.gain, "cover": lambda n: float(n.count)}[kind]
    out: dict[str, float] = {}
    for t in trees:
        for n in t.nodes:
            if not n.is_leaf:
                out[n.feature] = out.get(n.feature, 0.0) + worth(n)
    return dict(sorted(out.items(), key=lambda kv: (-kv[1], kv[0])))


def over(trees: list[Tree], names: dict[str, str]) -> list[Tree]:
    """The same trees on other columns: ``names`` says which stand for which features."""
    return [Tree([replace(n, feature=names.get(n.feature, n.feature), linear={names.get(f, f): c for f, c in n.linear.items()}) for n in t.nodes], t.rate) for t in trees]


def permutation_importance(df: DataFrame, features: list[str], score: Callable[[dict[str, str]], Column], label: str, order: Column, seed: int = 0) -> dict[str, float]:
    """Rise of the mean squared error when a feature's values come from other rows.

    ``score`` gives the prediction when other columns stand for features, so
    ``lambda names: sum(map(score_expression, over(trees, names)))`` of trees.
    Rows are numbered once by ``order``, a number, best a hash (ties by the
    other columns); each row is joined to the one a seeded number of places
    on, and takes one feature at a time from it.  So all features are measured
    in one pass over one join.
    """
    from timberline.operators.sampling import numbered

    rows = materialize(numbered(df.select(*dict.fromkeys([*features, label]), order.alias("__at")), F.col("__at"), "__n"), "numbered")
    n = rows.count()
    if n < 2:
        return dict.fromkeys(features, 0.0)
    shift = 1 + seed * 2654435761 % (n - 1)
    other = rows.select(F.pmod(F.col("__n") - shift, F.lit(n)).alias("__n"), *[F.col(f).alias(f"__p{k}") for k, f in enumerate(features)])
    error = lambda names: F.avg((score(names) - F.col(label)) ** 2)
    row = rows.join(other, "__n").agg(error({}).alias("base"), *[error({f: f"__p{k}"}).alias(f"e{k}") for k, f in enumerate(features)]).first()
    return {f: row[f"e{k}"] - row["base"] for k, f in enumerate(features)}


def leaf_paths(t: Tree) -> Iterator[tuple[float, dict[str, list[tuple[Node, bool]]], dict[str, float]]]:
    """Of each leaf: its output, the tests on its path by feature, and the share of rows that each feature's tests let through."""

    def down(at: int, tests: list[tuple[Node, bool, float]]):
        n = t.nodes[at]
        if n.is_leaf:
            on: dict[str, list[tuple[Node, bool]]] = {}
            share: dict[str, float] = {}
            for node, left, part in tests:
                on.setdefault(node.feature, []).append((node, left))
                share[node.feature] = share.get(node.feature, 1.0) * part
            yield t.rate * n.value, on, share
            return
        for child, left in ((n.left, True), (n.right, False)):
            yield from down(child, [*tests, (n, left, t.nodes[child].count / max(n.count, 1))])

    yield from down(0, [])


def known_features(on: dict[str, list[tuple[Node, bool]]], x: dict[str, np.ndarray], sides: dict[int, np.ndarray]) -> dict[str, np.ndarray]:
    """1 where a row's value passes all of a feature's tests, by feature; ``sides`` keeps each node's answers."""

    def left_of(n: Node) -> np.ndarray:
        if id(n) not in sides:
            v = x[n.feature]
            gone = np.isnan(v) | (np.abs(v) <= 1e-35 if n.zero_is_missing else False)
            with np.errstate(invalid="ignore"):
                sides[id(n)] = np.isin(v, n.categories) if n.categories else np.where(gone, n.default_left, v <= n.threshold)
        return sides[id(n)]

    return {f: np.all([left_of(n) if left else ~left_of(n) for n, left in tests], axis=0).astype(float) for f, tests in on.items()}


def subset_sums(n: int, others: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
    """For each number of known features, the sum over subsets of ``others`` of that size of what lets a row through."""
    poly = [np.ones(n)]
    for one, share in others:
        poly = [(poly[k] * share if k < len(poly) else 0) + (poly[k - 1] * one if k else 0) for k in range(len(poly) + 1)]
    return poly


def with_vectors(df: DataFrame, features: list[str], work: Callable[[dict[str, np.ndarray], int], np.ndarray], name: str, width: int) -> DataFrame:
    """Append an array of ``width`` doubles that ``work`` makes of the features of an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {f: np.asarray(batch.column(batch.schema.get_field_index(f"__x_{f}")).to_numpy(zero_copy_only=False), dtype=float) for f in features}
            kept = [batch.column(i) for i in range(batch.num_columns - len(features))]
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(work(x, batch.num_rows).reshape(-1)), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept, vectors], [*batch.schema.names[: len(kept)], name])

    wide = df.select("*", *[valid(f).alias(f"__x_{f}") for f in features])
    return wide.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def shap_values(df: DataFrame, trees: list[Tree], features: list[str]) -> DataFrame:
    """Append ``shap array<double>``: a contribution per feature, then the expected value.

    Contributions of a leaf are sums over subsets of the features on its path,
    built as polynomials in one pass over the path; rows of an Arrow batch are
    worked on together.  Their sum is the ensemble's score.
    """
    base = sum(t.expected_value() for t in trees)
    flat = [p for t in trees for p in leaf_paths(t)]
    weights = [[math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)] for d in range(1, 1 + max((len(on) for _, on, _ in flat), default=0))]

    def explain(x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, len(features) + 1))
        out[:, -1] = base
        sides: dict[int, np.ndarray] = {}
        for value, on, share in flat:
            ones = known_features(on, x, sides)
            for f in on:
                poly = subset_sums(n, [(ones[o], share[o]) for o in on if o != f])
                total = sum(w * c for w, c in zip(weights[len(on) - 1], poly, strict=True))
                out[:, features.index(f)] += value * total * (ones[f] - share[f])
        return out

    return with_vectors(df, features, explain, "shap", len(features) + 1)


def shap_interactions(df: DataFrame, trees: list[Tree], features: list[str]) -> DataFrame:
    """Append ``interactions array<double>``: the matrix of interaction values, row by row.

    Off the diagonal stands half of what two features give together beyond what
    each gives alone, so the matrix is symmetric; the diagonal holds the rest
    of a feature's contribution, so each row sums to it.
    """
    m = len(features)
    flat = [p for t in trees for p in leaf_paths(t)]
    most = max((len(on) for _, on, _ in flat), default=0)
    alone = {d: [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)] for d in range(1, most + 1)}
    paired = {d: [math.factorial(s) * math.factorial(d - 2 - s) / (2 * math.factorial(d - 1)) for s in range(d - 1)] for d in range(2, most + 1)}

    def explain(x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, m, m))
        sides: dict[int, np.ndarray] = {}
        for value, on, share in flat:
            ones = known_features(on, x, sides)
            gap = {f: ones[f] - share[f] for f in on}
            for f in on:
                i = features.index(f)
                poly = subset_sums(n, [(ones[o], share[o]) for o in on if o != f])
                out[:, i, i] += value * gap[f] * sum(w * c for w, c in zip(alone[len(on)], poly, strict=True))
                for g in on:
                    if g != f:
                        poly = subset_sums(n, [(ones[o], share[o]) for o in on if o not in (f, g)])
                        both = value * gap[f] * gap[g] * sum(w * c for w, c in zip(paired[len(on)], poly, strict=True))
                        out[:, i, features.index(g)] += both
                        out[:, i, i] -= both
        return out

    return with_vectors(df, features, explain, "interactions", m * m)


def shap_summary(explained: DataFrame) -> DataFrame:
    """One row over all contributions of all rows: ``lowest, highest, mean, median, std, total_absolute``.

    Nulls where there are no rows.  The median comes from counts of values, in ranges.
    """
    from timberline.operators.profile import order_statistics

    cells = explained.select(F.explode("shap").alias("value"))
    x = F.col("value")
    sums = cells.agg(F.min(x).alias("lowest"), F.max(x).alias("highest"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sum(F.abs(x)).alias("total_absolute"))
    middle = order_statistics(cells, ["value"]).agg(F.first("median").alias("median"))
    return sums.crossJoin(F.broadcast(middle)).select("lowest", "highest", "mean", "median", "std", "total_absolute")  # one row each


def shap_importance(explained: DataFrame, features: list[str]) -> DataFrame:
    """``feature, importance``: the mean absolute contribution; 0 without rows."""
    one = explained.agg(*[F.coalesce(F.avg(F.abs(F.col("shap")[i])), F.lit(0.0)).alias(f) for i, f in enumerate(features)])
    return one.unpivot([], features, "feature", "importance")


def leaf_statistics(df: DataFrame, tree: Tree) -> DataFrame:
    """``leaf, n, share`` of the rows."""
    counted = df.groupBy(leaf_expression(tree).alias("leaf")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("t"))
    return counted.crossJoin(F.broadcast(total)).select("leaf", "n", (F.col("n") / F.col("t")).alias("share"))


def leaf_entropy(stats: DataFrame) -> DataFrame:
    return stats.agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy"))
