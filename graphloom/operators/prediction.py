"""More link prediction: indices, candidates, thresholds, training samples, evaluation and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import meets
from graphloom.operators.distances import distances
from graphloom.operators.similarity import common_neighbours, predict
from graphloom.operators.structure import degrees
from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import materialize


#: Predictions that one task may sort.
FEW = 100_000


def _arcs(g: Graph) -> DataFrame:
    return materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")


def neighbours_measure(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, score): pairs of a neighbour x of u and y of v that are the same node or linked."""
    a, pairs = _arcs(g), materialize(pairs.select("u", "v"), "pairs")
    two = materialize(meets.shared_counts(a.withColumnRenamed("v", "x")), "two")
    same = common_neighbours(g, pairs).select("u", "v", F.col("common").alias("n")) if g.directed else two
    left = a.select(F.col("u").alias("node"), F.col("v").alias("x"), F.lit(0).alias("tag"))
    linked = meets.of_pairs(pairs, left, two.select(F.col("v").alias("node"), F.col("u").alias("x"), F.col("n").alias("tag")), "sum").select("u", "v", F.col("s").alias("k"))
    score = F.coalesce("n", F.lit(0)) + F.coalesce("k", F.lit(0.0))
    return pairs.join(same, ["u", "v"], "left").join(linked, ["u", "v"], "left").select("u", "v", score.cast("double").alias("score"))


def katz_index(g: Graph, pairs: DataFrame, length: int = 5, damping: float = 0.005) -> DataFrame:
    """(u, v, score): damping^l for every round l in which v is in the front grown from u, each front being the different neighbours of the one before."""
    a = _arcs(g)
    front = materialize(pairs.select("u").distinct().select("u", F.col("u").alias("x")), "front")
    out = None
    for r in range(1, length + 1):
        front = materialize(front.join(a.select(F.col("u").alias("x"), F.col("v").alias("y")), "x").select("u", F.col("y").alias("x")).distinct(), "front")
        hits = front.select("u", F.col("x").alias("v"), F.lit(damping**r).alias("s"))
        hits = pairs.select("u", "v").join(hits, ["u", "v"])
        out = hits if out is None else out.union(hits)
    s = out.groupBy("u", "v").agg(F.sum("s").alias("s"))
    return pairs.select("u", "v").join(s, ["u", "v"], "left").select("u", "v", F.coalesce("s", F.lit(0.0)).alias("score"))


def adjusted_rand_index(g: Graph, pairs: DataFrame, corrected: bool = False) -> DataFrame:
    """(u, v, score): 2 (ad - bc) / ((a + b)(b + d) + (a + c)(c + d)) with a common, d neither. b and c are the size of the union, as the usual implementation has it, or the differences if corrected."""
    n = g.vertices.count()
    p = predict(g, pairs)
    d = lambda c, x: degrees(g).select(F.col("node").alias(c), F.col("degree").alias(x))
    p = p.join(d("u", "du"), "u").join(d("v", "dv"), "v")
    a, union = F.col("common"), F.col("total_neighbours")
    b, c = (F.col("du") - a, F.col("dv") - a) if corrected else (union, union)
    rest = F.lit(n) - (a + b + c)
    below = (a + b) * (b + rest) + (a + c) * (c + rest)
    return p.select("u", "v", F.when(below != 0, 2.0 * (a * rest - b * c) / below).otherwise(0.0).alias("score"))


def algebraic_index(g: Graph, pairs: DataFrame, systems: int = 10, rounds: int = 30, omega: float = 0.5, norm: int = 2, seed: int = 1) -> DataFrame:
    from graphloom.operators.paths import algebraic_distance

    return algebraic_distance(g, pairs, systems, rounds, omega, norm, seed).withColumnRenamed("distance", "score")


def same_community(g: Graph, pairs: DataFrame, p: DataFrame | None = None) -> DataFrame:
    """1 for pairs of one community (by Louvain, unless given), else 0."""
    from graphloom.operators.community import louvain
    from graphloom.operators.partitions import in_same_community

    return in_same_community(louvain(g) if p is None else p, pairs).select("u", "v", F.col("same").cast("double").alias("score"))


def end_degree(g: Graph, pairs: DataFrame, end: str = "u") -> DataFrame:
    d = degrees(g).select(F.col("node").alias(end), F.col("degree").cast("double").alias("score"))
    return pairs.select("u", "v").join(d, end).select("u", "v", "score")


def missing_links(g: Graph, distance: int, sources: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v: pairs exactly so many hops apart, at least 2, so not linked."""
    if distance == 2 and sources is None:
        a = _arcs(g)
        two = a.select(F.col("v").alias("x"), F.col("u").alias("m")).join(a.select(F.col("u").alias("m"), F.col("v").alias("y")), "m").where("x < y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        return two.join(a, ["u", "v"], "left_anti")
    d = distances(g, sources).where(F.col("distance") == distance)
    return d.select(F.least("source", "node").alias("u"), F.greatest("source", "node").alias("v")).distinct()


def sorted_predictions(scores: DataFrame, by_pair: bool = False) -> DataFrame:
    return scores.orderBy("u", "v") if by_pair else scores.orderBy(F.desc("score"), "u", "v")


def links_by_score(scores: DataFrame, least: float) -> DataFrame:
    return scores.where(F.col("score") >= least).select("u", "v")


def links_by_count(scores: DataFrame, k: int) -> DataFrame:
    """The k pairs of the largest score; more than there are is an error."""
    if k > scores.count():
        raise ValueError("there are fewer predictions")
    if k <= FEW:
        return scores.orderBy(F.desc("score"), "u", "v").limit(k).select("u", "v")
    return numbered(scores.select("u", "v", "score"), F.desc("score"), "u", "v").where(F.col("number") < k).select("u", "v")


def links_by_percentage(scores: DataFrame, percentage: float) -> DataFrame:
    return links_by_count(scores, int(scores.count() * percentage))


def training_graph(g: Graph, percentage: float | None = None, count: int | None = None, seed: int = 1) -> Graph:
    """All nodes, and a share or number of edges, taken by a hash."""
    if percentage is not None:
        limit = F.lit(int(percentage * (1 << 52)))
        return Graph(g.vertices, g.edges.where(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 52)) < limit), g.directed)
    return Graph(g.vertices, g.edges.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(count), g.directed)


def _judged(test: Graph, scores: DataFrame) -> DataFrame:
    """scores in order with n (rank from 1) and hits (links of test so far)."""
    real = test.arcs().select("u", "v", F.lit(1).alias("real")).distinct()
    s = scores.join(real, ["u", "v"], "left").select("u", "v", "score", F.coalesce("real", F.lit(0)).alias("real"))
    r = materialize(numbered(s, F.desc("score"), "u", "v", name="n", first=1), "judged")
    # hits so far, by counts of blocks of ranks and a window within each
    block = F.floor((F.col("n") - 1) / 100_000)
    sums = r.groupBy(block.alias("b")).agg(F.sum("real").alias("k"))
    base = sums.select("b", F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    r = r.withColumn("b", block)
    within = F.sum("real").over(Window.partitionBy("b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("in", within).join(F.broadcast(base), "b").select("n", "score", (F.col("base") + F.col("in")).alias("hits"))


def _thresholds(r: DataFrame, total: int, points: int) -> DataFrame:
    ranks = sorted({-(-total * i // (points - 1)) for i in range(points)})
    return r.join(F.broadcast(r.sparkSession.createDataFrame([(x,) for x in ranks], "n long")), "n")


def roc_curve(test: Graph, scores: DataFrame, points: int = 1000) -> DataFrame:
    """(fpr, tpr) at so many ranks, 0 and all included; of points of one fpr the highest."""
    r = materialize(_judged(test, scores), "judged")
    total = r.count()
    hits = r.agg(F.max("hits")).first()[0] or 0
    if not hits or hits == total:
        raise ValueError("predictions must hold links and others")
    p = _thresholds(r, total, points).select(((F.col("n") - F.col("hits")) / (total - hits)).alias("fpr"), (F.col("hits") / hits).alias("tpr"))
    zero = r.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double")
    return zero.union(p).groupBy("fpr").agg(F.max("tpr").alias("tpr")).orderBy("fpr")


def precision_recall_curve(test: Graph, scores: DataFrame, points: int = 1000) -> DataFrame:
    """(recall, precision) at so many ranks; of points of one recall the highest."""
    r = materialize(_judged(test, scores), "judged")
    total = r.count()
    hits = r.agg(F.max("hits")).first()[0] or 0
    if not hits:
        raise ValueError("predictions hold no link")
    p = _thresholds(r, total, points).select((F.col("hits") / hits).alias("recall"), (F.col("hits") / F.col("n")).alias("precision"))
    first = r.sparkSession.createDataFrame([(0.0, 1.0)], "recall double, precision double")
    return first.union(p).groupBy("recall").agg(F.max("precision").alias("precision")).orderBy("recall")


def area(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the area below a curve of bounded many points, by trapezoids."""
    w = Window.orderBy(x)
    t = curve.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lag(x).over(w).alias("px"), F.lag(y).over(w).alias("py"))
    return t.agg(F.coalesce(F.sum((F.col("x") - F.col("px")) * (F.col("y") + F.col("py")) / 2), F.lit(0.0)).alias("area"))


def pair_features(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, features, label): the indices of predict as a vector, and whether the pair is linked."""
    from pyspark.ml.functions import array_to_vector

    names = ["common", "jaccard", "total_neighbours", "preferential_attachment", "adamic_adar", "resource_allocation", "neighbourhood_distance"]
    real = g.arcs().select("u", "v", F.lit(1.0).alias("label")).distinct()
    p = predict(g, pairs).join(real, ["u", "v"], "left")
    return p.select("u", "v", array_to_vector(F.array(*(F.col(c).cast("double") for c in names))).alias("features"), F.coalesce("label", F.lit(0.0)).alias("label"))


def trained_classifier(train: Graph, known: Graph, pairs: DataFrame):
    """A logistic regression on features of train whose labels are the links of known."""
    from pyspark.ml.classification import LogisticRegression

    rows = pair_features(train, pairs).drop("label")
    real = known.arcs().select("u", "v", F.lit(1.0).alias("label")).distinct()
    return LogisticRegression().fit(rows.join(real, ["u", "v"], "left").fillna(0.0, ["label"]))
