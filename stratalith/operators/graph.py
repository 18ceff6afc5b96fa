"""Edge tables, orientation of pairs, and what spreads along edges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


# ---- edges ----
def edges(rows: DataFrame, src: str, dst: str, sums: dict[str, Column], keep_self: bool = False) -> DataFrame:
    """src, dst, cnt and sums by directed pair; pairs with themselves go."""
    kept = rows if keep_self else rows.where(F.col(src) != F.col(dst))
    return kept.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])


def node_counts(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """node, cnt: how often it stands on either side, pairs with itself included."""
    return rows.select(F.explode(F.array(src, dst)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("cnt"))


def rolled_up(edges: DataFrame, of: DataFrame, measures: list[str]) -> DataFrame:
    """Edges between what the nodes belong to; ``of``: node, work. A node without a work stands for itself."""
    a, b = (of.select(F.col("node").alias(x), F.col("work").alias(f"w_{x}")) for x in ("src", "dst"))
    named = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("w_src", "src").alias("src"), F.coalesce("w_dst", "dst").alias("dst"), *measures)
    return named.where("src <> dst").groupBy("src", "dst").agg(*[F.sum(m).alias(m) for m in measures])


def undirected(edges: DataFrame, measures: list[str]) -> DataFrame:
    """a < b and summed measures of both directions."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(*[F.sum(m).alias(m) for m in measures])


def folded_pairs(edges: DataFrame, root_len: str, par_len: str, cnt: str = "cnt") -> DataFrame:
    """a < b, cnt, len_a, len_b: both directions of a pair in one pass; a's length comes from whichever side a is on."""
    a_is_root = F.col("src") < F.col("dst")
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum(cnt).alias("cnt"),
        F.sum(F.when(a_is_root, F.col(root_len)).otherwise(F.col(par_len))).alias("len_a"),
        F.sum(F.when(a_is_root, F.col(par_len)).otherwise(F.col(root_len))).alias("len_b"),
    )


def both_ways(pairs: DataFrame, *columns: str) -> DataFrame:
    """src, dst and columns of undirected pairs (a, b), each in both directions."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), *columns).union(pairs.select(F.col("b"), F.col("a"), *columns))


def breadth(pairs: DataFrame) -> DataFrame:
    """node, breadth: number of partners."""
    return both_ways(pairs).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("breadth"))


def weighted_degree(pairs: DataFrame, cnt: str = "cnt") -> DataFrame:
    """node, degree: sum of ln(1 + count)."""
    return both_ways(pairs, cnt).groupBy(F.col("src").alias("node")).agg(F.sum(F.log1p(cnt)).alias("degree"))


def nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def induced(pairs: DataFrame, membership: DataFrame, node: str = "node", group: str = "grp") -> DataFrame:
    """Pairs whose ends are of one group, with it."""
    a = membership.select(F.col(node).alias("a"), F.col(group).alias("grp"))
    b = membership.select(F.col(node).alias("b"), F.col(group).alias("grp"))
    return pairs.join(a, "a").join(b, ["b", "grp"])


def known_neighbours(pairs: DataFrame, dated: DataFrame) -> DataFrame:
    """node, n_known: partners with a date (dated: node, date)."""
    known = dated.where("date IS NOT NULL").select(F.col("node").alias("dst"))
    return both_ways(pairs).join(known, "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_known"))


def neighbour_dates(pairs: DataFrame, dated: DataFrame, quantiles=(0.1, 0.25, 0.5, 0.75, 0.9), cnt: str = "cnt") -> DataFrame:
    """Per node: weighted mean, min, max, sd and quantiles of its partners' dates, ln(1 + partners), and partners with a date.

    Weights are ln(1 + count) shared out to 1. A quantile is the first date whose cumulative weight reaches it (the last
    date where rounding keeps it from doing so). A node without dated partners has nulls.
    """
    all_ = both_ways(pairs, cnt).withColumn("w", F.log1p(cnt))
    degree = all_.groupBy(F.col("src").alias("node")).agg(F.log1p(F.count(F.lit(1))).alias("log_degree"))
    near = all_.join(dated.where("date IS NOT NULL").select(F.col("node").alias("dst"), "date"), "dst")
    by_date = near.groupBy("src", "date").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("src")
    upto = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    shares = by_date.withColumn("share", F.col("w") / F.sum("w").over(whole)).withColumn("cum", F.sum("w").over(upto) / F.sum("w").over(whole))
    mean = F.sum(F.col("share") * F.col("date"))
    out = shares.groupBy(F.col("src").alias("node")).agg(
        mean.alias("w_mean"),
        F.min("date").alias("w_min"),
        F.max("date").alias("w_max"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("share") * F.col("date") * F.col("date")) - mean * mean)).alias("w_sd"),
        *[F.coalesce(F.min(F.when(F.col("cum") >= q - 1e-12, F.col("date"))), F.max("date")).alias(f"q{round(100 * q)}") for q in quantiles],
        F.sum("n").alias("n_dated"),
    )
    return degree.join(out, "node", "left").withColumn("n_dated", F.coalesce("n_dated", F.lit(0)))


# ---- orientation ----
def orientation_score(len_a: Column, len_b: Column, breadth_a: Column, breadth_b: Column, weight: float = 1.5) -> Column:
    """Above 0: a is the later. The shorter and the broader is later."""
    return F.ln((len_b + 1) / (len_a + 1)) + weight * F.ln((breadth_a + 1) / (breadth_b + 1))


def oriented(pairs: DataFrame, threshold: float = 1.0, score: str = "score") -> DataFrame:
    """src (earlier), dst (later), of the pairs whose score is decided enough. The result may have cycles."""
    later_a = F.col(score) > 0
    return pairs.where(F.abs(score) >= threshold).select(F.when(later_a, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(later_a, F.col("a")).otherwise(F.col("b")).alias("dst"), score)


def rule_accuracy(rows: DataFrame, truth: str, rules: dict[str, Column]) -> DataFrame:
    """rule, decided, correct, accuracy: of rules that may abstain (null)."""
    stacked = rows.select(truth, F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("said")) for n, c in rules.items()])).alias("r")).select(truth, "r.*")
    out = stacked.groupBy("rule").agg(F.count("said").alias("decided"), F.sum(F.when(F.col("said") == F.col(truth), 1).otherwise(0)).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.nullif("decided", F.lit(0)))


def threshold_sweep(rows: DataFrame, score: str, later_a: str, thresholds=(0.0, 0.2, 0.5, 1.0, 1.5, 2.0, 3.0)) -> DataFrame:
    """thr, decided, coverage, accuracy (in %): of deciding by the sign of a score of at least thr; later_a: the truth."""
    each = rows.select(score, later_a, F.explode(F.array(*map(F.lit, thresholds))).alias("thr"))
    decided = F.abs(score) >= F.col("thr")
    out = each.groupBy("thr").agg(F.count(F.lit(1)).alias("n"), F.sum(decided.cast("long")).alias("decided"), F.sum((decided & ((F.col(score) > 0) == F.col(later_a))).cast("long")).alias("right"))
    return out.select("thr", "decided", (100 * F.col("decided") / F.col("n")).alias("coverage"), (100 * F.col("right") / F.greatest("decided", F.lit(1))).alias("accuracy"))


# ---- spreading ----
def harmonic(pairs: DataFrame, labels: DataFrame, lam: float = 0.02, prior: DataFrame | None = None, cnt: str = "cnt", tolerance: float = 1e-7, rounds: int = 500, shrink_isolated: bool = False) -> DataFrame:
    """node, x, labelled: labels spread along pairs, x = (mean of neighbours by ln(1 + count) + lam * prior) / (1 + lam).

    ``labels``: node, y. ``prior``: node, prior (else the mean label). The system is symmetric once each row is multiplied
    by the node's weight, so it is solved by conjugate gradients at every size: a step is a join and a sum, staged, and two
    sums over what was staged. It ends when no row is off by more than ``tolerance`` * lam, so no x by more than
    ``tolerance`` (lam counts as at least 0.001 there). A node without neighbours takes its prior (``shrink_isolated``:
    lam * prior / (1 + lam), as the unnormalised system would give). A labelled node keeps its label.
    """
    mean = labels.agg(F.avg("y").alias("__mean"))
    weights = staged(both_ways(pairs, cnt).groupBy("src", "dst").agg(F.sum(F.log1p(cnt)).alias("w")))
    all_ = nodes(pairs).union(labels.select("node")).distinct()
    base = all_.join(labels.select("node", F.col("y").cast("double").alias("y")), "node", "left").join(F.broadcast(mean))  # one row
    if prior is not None:
        base = base.join(prior.select("node", "prior"), "node", "left").withColumn("prior", F.coalesce("prior", "__mean"))
    else:
        base = base.withColumn("prior", F.col("__mean"))
    # Of each node its weight, and what its labelled neighbours say.
    near = weights.join(base.select(F.col("node").alias("dst"), F.col("y").alias("yn")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.coalesce("yn", F.lit(0.0))).alias("said"))
    base = staged(base.join(near, "node", "left").select("node", "y", F.col("prior").cast("double").alias("prior"), "d", "said"))
    free = base.where("y IS NULL AND d > 0").select("node", "d", "prior", "said")
    ends = free.select(F.col("node").alias("dst")), free.select(F.col("node").alias("src"))
    weights = staged(weights.join(ends[0], "dst", "left_semi").join(ends[1], "src", "left_semi"))

    def applied(rows: DataFrame, p: Column) -> DataFrame:
        """rows with p and ap, the system applied to p."""
        rows = rows.withColumn("p", p)
        heard = weights.join(rows.select(F.col("node").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("p")).alias("heard"))
        return staged(rows.join(heard, "node", "left").withColumn("ap", (1 + lam) * F.col("d") * F.col("p") - F.coalesce("heard", F.lit(0.0))).drop("heard"))

    first = applied(free.withColumn("x", F.col("prior")), F.col("prior"))
    now = first.select("node", "d", "x", (F.col("said") + lam * F.col("d") * F.col("prior") - F.col("ap")).alias("r"), F.lit(0.0).alias("p"))
    beta, size = 0.0, now.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]
    for _ in range(rounds if size else 0):
        step = applied(now, F.col("r") / F.col("d") + F.lit(beta) * F.col("p"))
        alpha = size / step.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        now = step.select("node", "d", (F.col("x") + F.lit(alpha) * F.col("p")).alias("x"), (F.col("r") - F.lit(alpha) * F.col("ap")).alias("r"), "p")
        after, off = now.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.max(F.abs(F.col("r") / F.col("d")))).first()
        beta, size = after / size, after
        if off <= tolerance * max(lam, 1e-3):
            break
    alone = lam * F.col("prior") / (1 + lam) if shrink_isolated else F.col("prior")
    return base.join(now.select("node", "x"), "node", "left").select("node", F.coalesce("y", "x", alone).alias("x"), F.col("y").isNotNull().alias("labelled"))


def harmonic_by_group(pairs: DataFrame, labels: DataFrame, lam: float = 0.05, cnt: str = "cnt", leave_one_out: bool = False, most: int = 256, most_pairs: int = 1 << 18, **how) -> DataFrame:
    """grp, node, x, labelled: harmonic() within each group, towards the group's median label.

    ``pairs``: grp, a, b, cnt; ``labels``: grp, node, y (null: none; a group's nodes that have no pair may stand there).
    A group without a label has null x. ``leave_one_out`` gives for each labelled node what its group would say without its
    label, towards the median of the other labels. A group of at most ``most`` nodes and ``most_pairs`` pairs is solved in a
    task, all its labels' systems from one factor; larger ones go through the joins of harmonic() together, their pairs
    once for each of their labels.
    """
    pairs, labels = staged(pairs.select("grp", "a", "b", F.col(cnt).alias("cnt"))), staged(labels.select("grp", "node", "y"))
    each = pairs.select("grp", F.explode(F.array("a", "b")).alias("node"), F.lit(1).alias("n")).unionByName(labels.select("grp", "node", F.lit(0).alias("n")))
    by_node = each.groupBy("grp", "node").agg(F.sum("n").alias("n"))
    sizes = staged(by_node.groupBy("grp").agg(((F.count(F.lit(1)) <= most) & (F.sum("n") <= 2 * most_pairs) & F.lit(lam > 0)).alias("small")))

    def of(rows: DataFrame, small: bool) -> DataFrame:
        those = sizes.where(F.col("small") == small).select(F.col("grp").alias("__g"))
        return rows.join(those, F.col("grp").eqNullSafe(F.col("__g")), "left_semi")

    shrink = how.get("shrink_isolated", False)
    cells = of(labels, True).select("grp", "node", F.col("y").cast("double").alias("y")).groupBy("grp")
    ties = of(pairs, True).select("grp", "a", "b", F.col("cnt").cast("double").alias("cnt")).groupBy("grp")
    kinds = dict(labels.dtypes)
    solved = ties.cogroup(cells).applyInArrow(lambda a, b: _solved(a, b, lam, leave_one_out, shrink), f"grp {kinds['grp']}, node {kinds['node']}, x double, labelled boolean")
    if leave_one_out:
        solved = solved.where("grp IS NOT NULL")
    if sizes.where("NOT small").isEmpty():
        return solved
    return solved.unionByName(_joined_by_group(of(pairs, False), of(labels, False), lam, leave_one_out, **how))


def _solved(pairs: pa.Table, labels: pa.Table, lam: float, leave_one_out: bool, shrink: bool) -> pa.Table:
    """harmonic_by_group() of one small group. Left out, a label's node joins the free ones: one more row and column to their factor."""
    both = pa.chunked_array([c for t, n in ((labels, "node"), (pairs, "a"), (pairs, "b")) for c in t[n].cast(labels["node"].type).chunks], labels["node"].type)
    nodes = both.unique()
    at = lambda c: pc.index_in(c.cast(nodes.type), value_set=nodes).to_numpy()
    y = np.full(len(nodes), np.nan)
    y[at(labels["node"])] = labels["y"].to_numpy()
    w, ends, each = np.zeros((len(nodes), len(nodes))), (at(pairs["a"]), at(pairs["b"])), np.nan_to_num(np.log1p(pairs["cnt"].to_numpy()))
    np.add.at(w, ends, each)
    np.add.at(w, ends[::-1], each)
    d, known = w.sum(1), ~np.isnan(y)
    free, own = np.flatnonzero(~known & (d > 0)), np.flatnonzero(known)
    k, yl = np.diag((1 + lam) * d) - w, y[own]
    alone = lam / (1 + lam) if shrink else 1.0
    x, out = np.where(known, y, np.nan), np.ones(len(nodes), bool)
    if len(own) and not leave_one_out:
        prior = np.median(yl)
        x[~known] = alone * prior
        x[free] = np.linalg.solve(k[np.ix_(free, free)], w[np.ix_(free, own)] @ yl + lam * d[free] * prior)
    elif leave_one_out:
        out = known & (known.sum() > 1)  # a single label leaves none
        if out.any():
            prior = np.array([np.median(np.delete(yl, i)) for i in range(len(yl))])
            heard = w[np.ix_(free, own)]
            a = np.linalg.solve(k[np.ix_(free, free)], np.column_stack([heard @ yl, d[free], heard]))
            said, drawn, pulled = a[:, :1], a[:, 1:2], a[:, 2:]
            among = w[np.ix_(own, own)]
            right = among @ yl - np.diag(among) * yl + lam * d[own] * prior + (heard * (said - pulled * yl + lam * prior * drawn)).sum(0)
            left = k[own, own] - (heard * pulled).sum(0)
            x[own] = np.where(d[own] > 0, right / np.where(d[own] > 0, left, 1.0), alone * prior)
    grp = (labels if labels.num_rows else pairs)["grp"][:1].combine_chunks().take(pa.array(np.zeros(out.sum(), int)))
    names = nodes.filter(pa.array(out))
    return pa.table({"grp": grp, "node": names, "x": pa.array(x[out], from_pandas=True), "labelled": pa.array(known[out])})


def _joined_by_group(pairs: DataFrame, labels: DataFrame, lam: float, leave_one_out: bool, cnt: str = "cnt", **how) -> DataFrame:
    """harmonic_by_group() of groups of any size."""
    kind = dict(pairs.dtypes)
    node = lambda c: F.struct("held", "grp", F.col(c).alias("node"))
    known = labels.where("y IS NOT NULL").select("grp", "node", F.col("y").cast("double").alias("y"))
    if leave_one_out:
        held = known.select("grp", F.col("node").alias("held"))
        pairs, each = pairs.join(held, "grp"), labels.join(held, "grp")
    else:
        none = F.lit(None).cast(kind["a"]).alias("held")
        pairs, each = pairs.select("*", none), labels.select("*", none)
    each = staged(each.select("held", "grp", "node", F.when(F.col("held").isNull() | (F.col("held") != F.col("node")), F.col("y").cast("double")).alias("y")))
    middle = each.groupBy("held", "grp").agg(F.median("y").alias("prior"))
    ends = pairs.select("held", "grp", F.explode(F.array("a", "b")).alias("node")).union(each.select("held", "grp", "node")).distinct()
    prior = ends.join(middle, ends["grp"].eqNullSafe(middle["grp"]) & ends["held"].eqNullSafe(middle["held"]), "left").where("prior IS NOT NULL").select(F.struct(ends["held"], ends["grp"], "node").alias("node"), "prior")
    prior = staged(prior)
    rows = pairs.select(node("a").alias("a"), node("b").alias("b"), F.col(cnt).cast("double").alias("cnt"))
    # A group that has no label takes no part; its nodes are given back without an x.
    rows = rows.join(prior.select(F.col("node").alias("a")), "a", "left_semi")
    own = each.where("y IS NOT NULL").select(node("node").alias("node"), "y")
    unlabelled = prior.join(own.select("node"), "node", "left_anti").select("node", F.lit(None).cast("double").alias("y"))
    out = harmonic(rows, own.unionByName(unlabelled), lam, prior, **how).select("node.held", "node.grp", "node.node", "x", "labelled")
    if leave_one_out:
        return out.where("held = node").select("grp", "node", "x", F.lit(True).alias("labelled"))
    out = out.select("grp", "node", "x", "labelled")
    got = out.select(F.col("grp").alias("__g"), F.col("node").alias("__n"))
    rest = ends.select("grp", "node").join(got, F.col("grp").eqNullSafe(F.col("__g")) & F.col("node").eqNullSafe(F.col("__n")), "left_anti")
    return out.unionByName(rest.select("grp", "node", F.lit(None).cast("double").alias("x"), F.lit(False).alias("labelled")))


def bounds(edges: DataFrame, known: DataFrame, low: float = -500.0, high: float = 1900.0, sweeps: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """node, lo, hi: intervals pushed along order edges src -> dst to a fixed point: lo rises to the sources' largest lo, hi falls to
    the targets' smallest hi, neither past the node's own other bound. ``known``: node, lo, hi."""
    e = staged(edges.select("src", "dst").distinct())
    all_ = e.select(F.col("src").alias("node")).union(e.select("dst")).union(known.select("node")).distinct()
    now = staged(all_.join(known.select("node", "lo", "hi"), "node", "left").select("node", F.coalesce("lo", F.lit(low)).cast("double").alias("lo"), F.coalesce("hi", F.lit(high)).cast("double").alias("hi")))
    for _ in range(sweeps):
        up = e.join(now.select(F.col("node").alias("src"), "lo"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("lo").alias("m"))
        raised = now.join(up, "node", "left").select("node", F.col("lo").alias("lo0"), "hi", F.when(F.col("m") > F.col("lo") + tolerance, F.least("m", "hi")).otherwise(F.col("lo")).alias("lo"))
        down = e.join(raised.select(F.col("node").alias("dst"), "hi"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("hi").alias("m"))
        after = staged(raised.join(down, "node", "left").select("node", "lo0", "lo", F.col("hi").alias("hi0"), F.when(F.col("m") < F.col("hi") - tolerance, F.greatest("m", "lo")).otherwise(F.col("hi")).alias("hi")))
        now = after.select("node", "lo", "hi")
        if after.where("lo <> lo0 OR hi <> hi0").isEmpty():
            break
    return now


def components(pairs: DataFrame, extra_nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the least node of each node's connected component. Least labels of neighbours, then of those labels."""
    e = staged(both_ways(pairs.select("a", "b")).distinct())
    all_ = nodes(pairs) if extra_nodes is None else nodes(pairs).union(extra_nodes.select("node")).distinct()
    now = staged(all_.select("node", F.col("node").alias("component")))
    while True:
        near = e.join(now.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("m"))
        low = now.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        far = now.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        after = staged(low.join(far, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("component")))
        now = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return now


def spanning_forest(pairs: DataFrame, cnt: str = "cnt") -> DataFrame:
    """a, b, cnt: the maximum spanning forest. Among equal counts the smaller (a, b) goes first, so it is unique.

    Boruvka rounds over a graph that contracts: each part takes its best edge and hooks onto the part beyond it; pointers
    jump to the roots of these hooks; then of all edges between two parts only the best is kept. Parts at least halve, so the
    rounds grow with the logarithm of the nodes. Nodes may be of any type that has an order; pairs of a node with itself go.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ordered = pairs.where("a <> b").groupBy(*ends).agg(F.max(cnt).alias("cnt"))
    order = F.desc("cnt"), "a", "b"
    # One sort gives every edge its place; from then on the best edge is a least number.
    ordered = staged(ordered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    left, chosen = ordered.select(F.col("a").alias("p"), F.col("b").alias("q"), "place"), []
    while True:
        each = left.select("p", "place").union(left.select("q", "place"))
        best = each.groupBy("p").agg(F.min("place").alias("place"))
        both = left.select(F.col("p").alias("x"), F.col("q").alias("y"), "place")
        # Each part hooks onto the part at the other end of its best edge.
        hooks = staged(best.join(both, "place").select("p", F.when(F.col("x") == F.col("p"), F.col("y")).otherwise(F.col("x")).alias("q"), "place"))
        if hooks.isEmpty():
            break
        chosen.append(hooks.select("place"))
        back = hooks.select(F.col("p").alias("q"), F.col("q").alias("back"))
        # Of two parts that chose each other the lesser is the root of its tree.
        root = hooks.join(back, "q").select("p", F.when((F.col("back") == F.col("p")) & (F.col("p") < F.col("q")), F.col("p")).otherwise(F.col("q")).alias("up"))
        while True:
            root = staged(_jumped(_jumped(root.select("p", "up"))).withColumn("far", F.col("up") != F.col("was")))
            if root.where("far").isEmpty():
                break
        to_p, to_q = root.select("p", F.col("up").alias("up_p")), root.select(F.col("p").alias("q"), F.col("up").alias("up_q"))
        moved = left.join(to_p, "p").join(to_q, "q").where("up_p <> up_q")
        left = staged(moved.groupBy(F.least("up_p", "up_q").alias("p"), F.greatest("up_p", "up_q").alias("q")).agg(F.min("place").alias("place")))
    if not chosen:
        return ordered.select("a", "b", "cnt")
    return ordered.join(reduce(DataFrame.union, chosen).distinct(), "place").select("a", "b", "cnt")


def _jumped(root: DataFrame) -> DataFrame:
    """p, up, was: each pointer moved on to where the one it points at points."""
    on = root.select(F.col("p").alias("up"), F.col("up").alias("next"))
    return root.select("p", "up").join(on, "up").select("p", F.col("next").alias("up"), F.col("up").alias("was"))


def nearest_graph(vectors: DataFrame, k: int = 15) -> DataFrame:
    """a, b, affinity: the k nearest by cosine distance of each vector (id, unit vector v), averaged with the reverse; exp(-d / mean d).

    Every vector is a query here.
    """
    from .neighbours import nearest

    near = nearest(vectors, vectors, k, "cosine").where("query <> id")
    pairs = near.groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg((F.sum("distance") / 2).alias("d"))
    mean = pairs.agg(F.avg("d").alias("mean"))
    return pairs.join(F.broadcast(mean)).select("a", "b", F.exp(-F.col("d") / F.col("mean")).alias("affinity"))
