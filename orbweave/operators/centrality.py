"""Betweenness and closeness by searches from many sources at once, communities by modularity.

Searches from all vertices run in tasks that hold the edges (``allpairs``); from chosen sources, or where edges are more than a task
may hold, every level of a search is an aggregation and a join over rows. Levels and rounds of moves are written to the shared
folder; only emptiness tests and single numbers come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from orbweave.operators import allpairs
from orbweave.operators.graph import undirected
from orbweave.sources.io import materialized


def searches(edges: DataFrame, sources: DataFrame | None = None) -> list[DataFrame]:
    """Level by level: source, id, paths (how many shortest paths lead there); edges are undirected, sources (id) all vertices if None.

    Levels hold a row for each source and vertex that it reaches: choose sources for graphs where all would be too many.
    """
    both = materialized(undirected(edges))
    start = (sources.select("id").distinct() if sources is not None else both.select(F.col("src").alias("id")).distinct())
    levels = [materialized(start.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("source", "id")
    while True:
        step = levels[-1].join(both, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = materialized(step.join(seen, ["source", "id"], "left_anti"))
        if front.isEmpty():
            return levels
        levels.append(front)
        seen = seen.unionAll(front.select("source", "id"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """(id, betweenness): the share of shortest paths between other vertices that pass through each.

    Dependencies go back level by level. With chosen sources the sum is scaled up to all vertices. Normalized, a vertex on
    all paths has 1; otherwise pairs count once. Graphs of fewer than three vertices have 0.
    """
    both = materialized(undirected(edges))
    if sources is None and 0 < both.count() <= allpairs.EDGES:
        return _betweenness_of_all(both, normalized)
    levels = searches(edges, sources)
    vertices = materialized(both.select(F.col("src").alias("id")).distinct())
    n, k = vertices.count(), levels[0].count()
    later, parts = None, []
    for level in reversed(levels[1:]):
        gain = F.lit(1.0) + (F.coalesce("_d", F.lit(0.0)) if later is not None else F.lit(0.0))
        held = level.join(later.select("source", "id", F.col("dependency").alias("_d")), ["source", "id"], "left") if later is not None else level
        share = held.select("source", F.col("id").alias("_w"), (gain / F.col("paths")).alias("_g"))
        above = levels[levels.index(level) - 1]
        back = share.join(both, F.col("_w") == F.col("src")).select("source", F.col("dst").alias("id"), "_g")
        later = materialized(back.join(above, ["source", "id"]).groupBy("source", "id").agg((F.sum("_g") * F.any_value("paths")).alias("dependency")))
        parts.append(later.where("source <> id").select("id", "dependency"))
    if not parts:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    scale = (n / k) * (1 / ((n - 1) * (n - 2)) if normalized and n > 2 else 0.0 if normalized else 0.5)
    total = every.groupBy("id").agg((F.sum("dependency") * scale).alias("betweenness"))
    return vertices.join(total, "id", "left").na.fill(0.0, ["betweenness"])


#: Leaves are hung on their neighbours in so many rounds at most; those that stay are vertices like any other.
ROUNDS = 12


def _hung(both: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Edges without leaves, the vertices left (id, w, squares), and the leaves round by round (id, up, w, squares), each gone from the next round.

    w counts a vertex and all that hang on it, squares adds up the squared w of what hangs on it directly. A last pair keeps its smaller vertex.
    """
    held = materialized(both.select(F.col("src").alias("id")).distinct().select("id", F.lit(1.0).alias("w"), F.lit(0.0).alias("squares")))
    left, rounds = held.count(), []
    while len(rounds) < ROUNDS:
        ends = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_n"), F.min("dst").alias("up")).where("_n = 1").select("id", "up")
        pairs = ends.select(F.col("id").alias("up"), F.lit(True).alias("_pair"))
        leaves = materialized(ends.join(pairs, "up", "left").where("_pair IS NULL OR id > up").join(held, "id").select("id", "up", "w", "squares"))
        n = leaves.count()
        if 50 * n < left or not n:
            break
        gone = leaves.select("id")
        more = leaves.groupBy(F.col("up").alias("id")).agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("w")).alias("_s"))
        held = held.join(gone, "id", "left_anti").join(more, "id", "left")
        held = materialized(held.select("id", (F.col("w") + F.coalesce("_w", F.lit(0.0))).alias("w"), (F.col("squares") + F.coalesce("_s", F.lit(0.0))).alias("squares")))
        both = materialized(both.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        left -= n
        rounds.append(leaves)
    return both, held, rounds


def _betweenness_of_all(both: DataFrame, normalized: bool) -> DataFrame:
    """Betweenness from all sources: the searches leave out what hangs on the rest as trees, where every pair's path is known."""
    n = both.select("src").distinct().count()
    core, held, rounds = _hung(both)
    found = allpairs.passing(core.join(held.select(F.col("id").alias("src"), "w"), "src"), held.count())
    w, size = F.col("w"), F.coalesce("size", "w")
    inside = (w - 1) * (w - 1) - F.col("squares") + 2 * (w - 1) * (size - w)
    got = materialized(held.join(found, "id", "left").select("id", size.alias("size"), (F.coalesce("passed", F.lit(0.0)) + inside).alias("pairs")))
    for leaves in reversed(rounds):
        size = F.col("size")
        own = leaves.join(got.select(F.col("id").alias("up"), "size"), "up")
        own = own.select("id", "size", ((size - 1) * (size - 1) - F.col("squares") - (size - w) * (size - w)).alias("pairs"))
        got = materialized(got.unionAll(own))
    scale = 1 / ((n - 1) * (n - 2)) if normalized and n > 2 else 0.0 if normalized else 0.5
    return got.select("id", (F.col("pairs") * scale).alias("betweenness"))


def closeness(edges: DataFrame) -> DataFrame:
    """(id, closeness): how many vertices each reaches over their mean distance, times the share of all vertices that it reaches."""
    both = materialized(undirected(edges))
    if 0 < both.count() <= allpairs.EDGES:
        n = both.select("src").distinct().count()
        reached = (F.col("reached") - 1).cast("double")
        return allpairs.distances(both, n).select("id", F.coalesce(F.try_divide(reached * reached, F.col("far") * F.lit(max(n - 1, 1))), F.lit(0.0)).alias("closeness"))
    levels = searches(edges)
    n = levels[0].count()
    far = levels[0].select("id", F.lit(0).alias("hop"))
    for hop, level in enumerate(levels[1:], 1):
        far = far.unionAll(level.select("id", F.lit(hop).alias("hop")))
    reached = (F.count("*") - 1).cast("double")
    return far.groupBy("id").agg(F.coalesce(F.try_divide(reached * reached, F.sum("hop") * F.lit(max(n - 1, 1))), F.lit(0.0)).alias("closeness"))


def _weighted(edges: DataFrame) -> DataFrame:
    """src, dst, w in both directions; loops and repeated edges fall away unless a column ``weight`` adds them up."""
    if "weight" not in edges.columns:
        return undirected(edges).withColumn("w", F.lit(1.0))
    e = edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("w"))
    return e.unionAll(e.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of labels (id, community) over the undirected edges; 0 without edges."""
    e = _weighted(edges)
    own = labels.select(F.col("id").alias("src"), F.col("community").alias("_a"))
    to = labels.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    sums = e.join(own, "src").join(to, "dst").groupBy("_a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")).otherwise(0.0)).alias("inner"))
    return _score(sums)


def _score(sums: DataFrame) -> float:
    row = sums.agg(F.sum("inner").alias("i"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("q")).first()
    return 0.0 if not row["m"] else row["i"] / row["m"] - row["q"] / row["m"] ** 2


def modular_communities(edges: DataFrame, levels: int = 10, rounds: int = 30) -> tuple[DataFrame, list[float]]:
    """(id, community by its least id) and the modularity after each level, which never falls.

    In a round every vertex names the neighbouring community that its move would gain most from (ties to the smaller), and a move
    is made if it is the best one (ties to the smaller vertex) for the community left and for the one joined. So a community
    takes part in one move a round, gains add up as computed, and modularity rises with every round. When no move gains,
    or after ``rounds``, communities become the vertices of a smaller graph, level by level.
    """
    e = materialized(_weighted(edges))
    members = materialized(e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    inner = e.select(F.col("src").alias("id"), F.lit(0.0).alias("loop")).distinct()
    m2 = e.agg(F.sum("w")).first()[0]
    history: list[float] = []
    if not m2:
        return members, history
    for _ in range(levels):
        k = materialized(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).join(inner, "id", "full").select("id", (F.coalesce("k", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0))).alias("k")))
        lab, moved = k.select("id", F.col("id").alias("c"), "k"), False
        for _ in range(rounds):
            # Vertices carry their degree and their community's, so that links meet them twice and nothing else.
            held = lab.join(lab.groupBy("c").agg(F.sum("k").alias("total")), "c")
            links = e.join(held.select(F.col("id").alias("dst"), F.col("c").alias("to"), F.col("total").alias("_to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("link"), F.any_value("_to").alias("_to"))
            stay = F.max(F.when(F.col("to") == F.col("c"), F.col("link"))).over(Window.partitionBy("id"))
            tried = links.join(held, "id").withColumn("_stay", stay).where("to <> c")
            gain = 2 * (F.col("link") - F.coalesce("_stay", F.lit(0.0))) / m2 - 2 * F.col("k") * (F.col("_to") - F.col("total") + F.col("k")) / (m2 * m2)
            wish = tried.withColumn("gain", gain).where("gain > 1e-12")
            best = wish.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("to").alias("to"), F.col("c").alias("c"))).alias("b")).select("id", "b.g", "b.to", "b.c")
            n = Observation()
            best = materialized(best.observe(n, F.count("*").alias("n")))
            if not n.get["n"]:
                break
            chosen = best.select(F.explode(F.array("c", "to")).alias("end"), F.struct("g", "id").alias("r")).groupBy("end").agg(F.min("r").alias("r"))
            made = best.join(chosen.select(F.col("end").alias("c"), F.col("r.id").alias("_x")), "c").join(chosen.select(F.col("end").alias("to"), F.col("r.id").alias("_y")), "to").where("id = _x AND id = _y")
            lab, moved = materialized(lab.join(made.select("id", F.col("to").alias("_n")), "id", "left").select("id", F.coalesce("_n", "c").alias("c"), "k")), True
        if not moved:
            break
        least = lab.groupBy("c").agg(F.min("id").alias("name"))
        lab = materialized(lab.join(least, "c").select("id", F.col("name").alias("c")))
        members = materialized(members.join(lab.select(F.col("id").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        a, b = (lab.select(F.col("id").alias(x), F.col("c").alias(y)) for x, y in (("src", "_a"), ("dst", "_b")))
        merged = materialized(e.join(a, "src").join(b, "dst").groupBy("_a", "_b").agg(F.sum("w").alias("w")))
        loops = merged.where("_a = _b").select(F.col("_a").alias("id"), F.col("w").alias("loop")).unionAll(inner.join(lab, "id").select(F.col("c").alias("id"), "loop"))
        inner = materialized(loops.groupBy("id").agg(F.sum("loop").alias("loop")))
        e = materialized(merged.where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "w"))
        sums = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("w")).join(inner, "id", "full").select((F.coalesce("w", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0))).alias("k"), F.coalesce("loop", F.lit(0.0)).alias("inner"))
        history.append(_score(sums))
    return members, history
