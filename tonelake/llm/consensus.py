"""Consensus of several annotators who disagree: bipartite message passing on label edges.

Scores become labels relative to the annotator's own level and spread (low, middle, high), so strict, generous or
cautious annotators are no outliers. For each class against the rest, an item sends an annotator the weighted mean of
the others' labels (x), each weighted by how reliable its annotator is said to be; an annotator sends an item how well
its labels of all other items correlate with what those items sent (y, within -1..1). Messages leave out the edge they
go along. This goes on until no message moves by `tolerance` any more; where messages swing, half steps are taken.
Because items send means and annotators send correlations, neither a hot item nor a hot annotator outweighs the rest.

Edges are aggregated per (annotator, item) first. Node sums are map-side; they are joined back as a broadcast after a
check of their size, else spread over salted parts of hot nodes. Each iteration's messages are written to the shared
checkpoint folder, and the iteration before is deleted, so lineage stays short and disk bounded.

Defined results: scores that are null, NaN or outside [low, high] are no labels; a label delivered twice (same id)
counts once, the last received one; rows without annotator or item are left out of the messages; an annotator with one
label or equal labels gives middle labels and follows nobody: reliability and correlation 0; they are null where
nothing is shared with others; `converged` tells per annotator whether its messages stood still at the end; class ties
go to the class nearest the middle, then the lower one; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.sources.tables import BROADCAST_BYTES, bounded, cut, join_known, join_small, release

CLASSES = ("low", "middle", "high")
#: Distance from the annotator's mean, in own standard deviations, from which a label is high or low (thirds of a normal distribution).
SPREAD = 0.43
_K = range(len(CLASSES))


def distinct_labels(df: DataFrame, label_id: str, annotator: str, item: str, score: str, received: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(annotator, item, score) of the distinct labels with a score; rows without an id stay as they stand."""
    valid = df.select(F.col(label_id).alias("label_id"), F.col(annotator).alias("annotator"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), F.col(received).alias("received")).where(
        F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(low, high)
    )
    once = valid.where("label_id is not null").groupBy("label_id").agg(F.max(F.struct("received", "annotator", "item", "score")).alias("l")).select("l.annotator", "l.item", "l.score")
    return once.unionByName(valid.where("label_id is null").select("annotator", "item", "score"))


def label_edges(labels: DataFrame) -> DataFrame:
    """One row per (annotator, item): n labels, their sum and sum of squares, and how many fall in each class."""
    known = labels.where("annotator is not null")
    own = known.groupBy("annotator").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"))
    z = F.when(F.col("sd") > 1e-9, (F.col("score") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    at = F.when(z < -SPREAD, 0).when(z > SPREAD, 2).otherwise(1)
    return (
        join_small(known.where("item is not null"), own, ["annotator"], "item").withColumn("at", at)
        .groupBy("annotator", "item")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"), *(F.count_if(F.col("at") == k).cast("int").alias(f"c{k}") for k in _K))
    )


def _correlation(n: Column, sa: Column, saa: Column, sb: Column, sbb: Column, sab: Column) -> Column:
    """Correlation from sums, 0 where either side does not vary."""
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    return F.when((va > 1e-9 * n * n) & (vb > 1e-9 * n * n), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sab - sa * sb) / F.sqrt(va * vb)))).otherwise(F.lit(0.0))


def pass_messages(edges: DataFrame, most_iterations: int = 200, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Iterates until no message moves by `tolerance` any more, or `most_iterations` are done.

    Returns items (item, labels, x0..x2, c0..c2) and annotators (annotator, labels, reliability, converged).
    """
    shares = edges.agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in _K)).first()
    total = sum(shares[f"c{k}"] or 0 for k in _K) or 1
    p = [(shares[f"c{k}"] or 0) / total for k in _K]
    classes = [f"c{k}" for k in _K]
    n = sum((F.col(c) for c in classes), F.lit(0)).cast("double")
    # centred labels: a class held by a third of all labels weighs 2/3 where given, -1/3 where not
    a = [F.col(f"c{k}") - n * F.lit(p[k]) for k in _K]
    aa = [F.col(f"c{k}") * F.lit((1 - p[k]) ** 2) + (n - F.col(f"c{k}")) * F.lit(p[k] ** 2) for k in _K]
    # the numbers of items and annotators do not change, so whether they may be broadcast is asked once
    fits = {}
    for node in ("item", "annotator"):
        side, fits[node] = bounded(edges.select(node).distinct(), size=BROADCAST_BYTES // 8)
        release(side)

    def half_step(state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Items' sums, what each edge hears from its item, and annotators' sums, with what an edge adds to them."""
        items = state.groupBy("item").agg(F.sum(n).alias("tn"), *(F.sum(a[k] * F.col(f"y{k}")).alias(f"x{k}") for k in _K), *(F.sum(n * F.abs(f"y{k}")).alias(f"v{k}") for k in _K), *(F.sum(c).alias(f"t{c}") for c in classes))
        rest = [F.col(f"v{k}") - n * F.abs(f"y{k}") for k in _K]
        x = [F.when(rest[k] > 1e-9, (F.col(f"x{k}") - a[k] * F.col(f"y{k}")) / rest[k]).otherwise(F.lit(0.0)) for k in _K]
        shared = (F.col("tn") > n).cast("double")
        heard = join_known(state, items, ["item"], "annotator", fits["item"]).select("annotator", "item", *classes, *(f"y{k}" for k in _K), "moved", shared.alias("shared"), *(x[k].alias(f"h{k}") for k in _K))
        h = [F.col(f"h{k}") for k in _K]
        m = n * F.col("shared")
        parts = {"m": m} | {f"{name}{k}": c for k in _K for name, c in (("a", a[k] * F.col("shared")), ("aa", aa[k] * F.col("shared")), ("b", m * h[k]), ("bb", m * h[k] * h[k]), ("ab", a[k] * h[k] * F.col("shared")))}
        # kept as columns: they are summed, and taken off the sums again
        heard = heard.select("annotator", "item", *classes, *(f"y{k}" for k in _K), "moved", n.alias("n"), *(c.alias(f"p_{name}") for name, c in parts.items()))
        sums = heard.groupBy("annotator").agg(F.sum("n").alias("labels"), F.max("moved").alias("last"), *(F.sum(f"p_{name}").alias(f"s_{name}") for name in parts))
        return items, heard, sums

    s = lambda name: F.col(f"s_{name}")
    left = lambda name: s(name) - F.col(f"p_{name}")
    state = cut(edges.select("annotator", "item", *classes, *(F.lit(1.0).cast("float").alias(f"y{k}") for k in _K), F.lit(1.0).alias("moved")))
    pace, before = 1.0, None
    for _ in range(most_iterations):
        _, heard, sums = half_step(state)
        y = [_correlation(left("m"), *(left(f"{q}{k}") for q in ("a", "aa", "b", "bb", "ab"))) for k in _K]
        answered = join_known(heard, sums.drop("labels", "last"), ["annotator"], "item", fits["annotator"])
        now = cut(answered.select(
            "annotator", "item", *classes, *((F.col(f"y{k}") + F.lit(pace) * (y[k] - F.col(f"y{k}"))).cast("float").alias(f"y{k}") for k in _K),
            F.greatest(*(F.abs(y[k] - F.col(f"y{k}")) for k in _K)).alias("moved"),
        ))
        release(state)
        state = now
        moved = state.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
        # half steps unless the largest move at least halves: messages of annotators with few labels would else swing for ever
        pace = 1.0 if before is None or moved <= before / 2 else 0.5
        before = moved
    items, _, sums = half_step(state)
    spread = [F.when(s("m") > 0, s(f"aa{k}") / s("m") - F.pow(s(f"a{k}") / s("m"), 2)).otherwise(0.0) for k in _K]
    whole = [_correlation(s("m"), *(s(f"{q}{k}") for q in ("a", "aa", "b", "bb", "ab"))) for k in _K]
    mean = sum((spread[k] * whole[k] for k in _K), F.lit(0.0)) / F.greatest(sum(spread, F.lit(0.0)), F.lit(1e-12))
    annotators = sums.select("annotator", F.col("labels").cast("bigint").alias("labels"), F.when(s("m") > 0, mean).alias("reliability"), (F.col("last") < tolerance).alias("converged"))
    return items.select("item", F.col("tn").cast("bigint").alias("labels"), *(f"x{k}" for k in _K), *(F.col(f"tc{k}").alias(f"c{k}") for k in _K)), annotators


def consensus(items: DataFrame) -> DataFrame:
    """(item, labels, label, agreement): the class with most weight, and the share of labels that give it."""
    best = F.greatest("x0", "x1", "x2")
    at = F.when(F.col("x1") == best, 1).when(F.col("x0") == best, 0).otherwise(2)
    given = F.element_at(F.array("c0", "c1", "c2"), at + 1)
    return items.select("item", "labels", F.element_at(F.array(*(F.lit(c) for c in CLASSES)), at + 1).alias("label"), (given / F.col("labels")).alias("agreement"))


def others_correlation(edges: DataFrame) -> DataFrame:
    """(annotator, shared, correlation) of each annotator's scores with the others' mean scores of the same items."""
    totals = edges.groupBy("item").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    y = (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    pairs = join_small(edges, totals, ["item"], "annotator").where(F.col("tn") > F.col("n")).withColumn("y", y)
    sums = pairs.groupBy("annotator").agg(F.sum("n").alias("shared"), F.sum("s").alias("sx"), F.sum("ss").alias("sxx"), F.sum(F.col("n") * F.col("y")).alias("sy"), F.sum(F.col("n") * F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("s") * F.col("y")).alias("sxy"))
    n = F.col("shared")
    cov, vx, vy = n * F.col("sxy") - F.col("sx") * F.col("sy"), n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return sums.select("annotator", "shared", F.when(vx <= 1e-12 * n * n, F.lit(0.0)).when(vy > 1e-12 * n * n, cov / F.sqrt(vx * vy)).alias("correlation"))


def unrelated(edges: DataFrame, least_labels: int, limit: float, doubtful: float) -> DataFrame:
    """(annotator, labels, reliability, correlation): annotators with enough labels whom the messages doubt, confirmed by their exact correlation.

    `doubtful` lies well above `limit`, since labels in classes and messages from many sides tell less than whole scores;
    in simulations with an item of up to 60 % of all labels no annotator below a correlation of 0.4 came above 0.41.
    """
    _, annotators = pass_messages(edges)
    doubted = annotators.where((F.col("labels") >= least_labels) & (F.coalesce("reliability", F.lit(0.0)) < doubtful))
    return doubted.join(others_correlation(edges).where(F.col("correlation") < limit), "annotator").select("annotator", "labels", "reliability", "correlation")
