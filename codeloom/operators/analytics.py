"""Whole-graph analytics: weights, communities, centrality, coupling, matrices."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each edge kind, and of others; kinds that count as coupling.
WEIGHTS = {"CALLS": 1.0, "EXTENDS": 0.8, "IMPLEMENTS": 0.8, "INSTANTIATES": 0.7, "IMPORTS": 0.6, "OWNS": 0.4, "PROVIDES_CONTEXT": 0.2, "CONSUMES_CONTEXT": 0.2}
OTHER_WEIGHT = 0.5
#: Sizes above which betweenness is sampled (and from how many sources), and the matrix aggregated.
EXACT_NODES, SAMPLED_SOURCES, MATRIX_NODES = 5000, 600, 1500
_SEED = 20260618


def weight(kind: Column) -> Column:
    table = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[kind], F.lit(OTHER_WEIGHT))


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """src, dst, weight, coupling_weight (all kinds but OWNS), kinds: one row an ordered pair; blanks and self loops go."""
    rows = edges.where((F.trim("src") != "") & (F.trim("dst") != "") & (F.col("src") != F.col("dst")))
    w = weight(F.col("kind"))
    return rows.groupBy("src", "dst").agg(F.sum(w).alias("weight"), F.sum(F.when(F.col("kind") != "OWNS", w).otherwise(0.0)).alias("coupling_weight"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def scoped(edges: DataFrame, path: str = "") -> DataFrame:
    """Edges (src, dst) with an end in a file below a path."""
    inside = lambda c: F.substring_index(c, "::", 1).startswith(path)
    return edges.where(inside("src") | inside("dst")) if path else edges


def coupled_core(pairs: DataFrame) -> DataFrame:
    """Nodes with at least one coupling edge; only these take part in the communities that spans are counted over."""
    return coupling(pairs)[0].select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def analyze(edges: DataFrame, owns: DataFrame, path: str = "", min_size: int = 1, splits: bool = False) -> dict[str, DataFrame]:
    """Scope, communities (with size and cohesion), modularity, owners that span coupled communities, and splits."""
    pairs = aggregate_edges(scoped(edges, path))
    und = undirected(pairs)
    membership = communities(und, pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    coupled = undirected(coupling(pairs)[0], "coupling_weight")
    spans = communities(coupled, coupled_core(pairs), refine=False)
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    central = betweenness(pairs, nodes).join(degrees(pairs), "node", "left")
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).where(F.col("size") >= min_size)
    out = {"communities": sizes.join(cohesion(und, membership), "community"), "modularity": modularity(und, membership), "god_objects": god_objects(owns, spans, central)}
    if splits:
        out["splits"] = split_suggestions(owns.join(out["god_objects"].select("owner"), "owner", "left_semi"), spans)
    return out


def undirected(pairs: DataFrame, column: str = "weight") -> DataFrame:
    return pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col(column).alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def coupling(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with coupling, and all nodes."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return pairs.where("coupling_weight > 0"), nodes


def degrees(pairs: DataFrame) -> DataFrame:
    """fan_in and fan_out over ordered pairs."""
    ends = pairs.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(pairs.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def cohesion(und: DataFrame, membership: DataFrame) -> DataFrame:
    """Internal over incident weight of each community; without edges 0."""
    m = membership.select("node", "community")
    both = und.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = both.where("ca = cb").select(F.col("ca").alias("community"), F.col("w").alias("i"), F.col("w").alias("t"))
    cross = both.where("ca <> cb")
    out = inside.unionByName(cross.select(F.col("ca").alias("community"), F.lit(0.0).alias("i"), F.col("w").alias("t"))).unionByName(cross.select(F.col("cb").alias("community"), F.lit(0.0).alias("i"), F.col("w").alias("t")))
    sums = out.groupBy("community").agg(F.sum("i").alias("i"), F.sum("t").alias("t"))
    return m.select("community").distinct().join(sums, "community", "left").select("community", F.coalesce(F.col("i") / F.when(F.col("t") > 0, F.col("t")), F.lit(0.0)).alias("cohesion"))


def modularity(und: DataFrame, membership: DataFrame) -> DataFrame:
    """Newman's weighted modularity, one row: the sum over communities of L/m - (d/2m)^2."""
    m = membership.select("node", "community")
    both = und.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    total = und.agg(F.sum("w").alias("m"))
    inside = both.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("l"))
    ends = both.select(F.col("ca").alias("community"), "w").unionByName(both.select(F.col("cb").alias("community"), "w")).groupBy("community").agg(F.sum("w").alias("d"))
    one = ends.join(inside, "community", "left").join(F.broadcast(total))  # one row
    return one.agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def louvain_local(links: list[tuple[str, str, float]], nodes: list[str], seed: int = _SEED) -> dict[str, int]:
    """Louvain on one machine: local moves by gain of modularity, then the same on communities, until nothing gains."""
    names = sorted(nodes)
    index = {n: i for i, n in enumerate(names)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, w in links:
        if a != b:
            near[index[a]][index[b]] += w
            near[index[b]][index[a]] += w
    loops, label = [0.0] * len(names), list(range(len(names)))
    total = sum(sum(x.values()) for x in near) / 2
    rng = np.random.default_rng(seed)
    while total > 0:
        n = len(near)
        own, strength = list(range(n)), [sum(near[i].values()) + 2 * loops[i] for i in range(n)]
        mass, moved_any = strength[:], False
        for _ in range(100):
            moved = False
            for i in rng.permutation(n).tolist():
                to: dict[int, float] = defaultdict(float)
                for j, w in near[i].items():
                    to[own[j]] += w
                here = own[i]
                mass[here] -= strength[i]
                gain = lambda c: to.get(c, 0.0) - strength[i] * mass[c] / (2 * total)  # noqa: B023, E731
                best = max(sorted(to), key=gain, default=here)
                if gain(best) <= gain(here) + 1e-12:
                    best = here
                mass[best] += strength[i]
                moved |= best != here
                own[i] = best
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            break
        ids = {c: k for k, c in enumerate(sorted(set(own)))}
        label = [ids[own[x]] for x in label]
        folded: list[dict[int, float]] = [defaultdict(float) for _ in ids]
        inner = [0.0] * len(ids)
        for i in range(n):
            inner[ids[own[i]]] += loops[i]
            for j, w in near[i].items():
                a, b = ids[own[i]], ids[own[j]]
                if a == b:
                    inner[a] += w / 2
                else:
                    folded[a][b] += w
        near, loops = folded, inner
    groups: dict[int, list[str]] = defaultdict(list)
    for n, c in zip(names, label):
        groups[c].append(n)
    ranked = sorted(groups.values(), key=lambda g: (-len(g), g[0]))
    return {n: k for k, g in enumerate(ranked) for n in g}


def refine_local(links, membership: dict[str, int], rounds: int = 5, sparse: float = 0.01, attached: float = 0.5) -> dict[str, int]:
    """In communities of low density, nodes with under half of their weight inside go to the community that
    they are most attached to, or stand alone; up to five rounds."""
    own = dict(membership)
    near: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in links:
        if a != b:
            near[a][b] += w
            near[b][a] += w
    for _ in range(rounds):
        members: dict[int, list[str]] = defaultdict(list)
        for n, c in own.items():
            members[c].append(n)
        moved, fresh = False, max(own.values(), default=-1) + 1
        for c, group in sorted(members.items()):
            if len(group) < 2:
                continue
            inside = set(group)
            edges = sum(1 for n in group for x in near[n] if x in inside) / 2
            if 2 * edges / (len(group) * (len(group) - 1)) >= sparse:
                continue
            for n in sorted(group):
                total = sum(near[n].values())
                to: dict[int, float] = defaultdict(float)
                for x, w in near[n].items():
                    to[own[x]] += w
                if not total or to.get(c, 0.0) / total >= attached:
                    continue
                best = max(sorted(k for k in to if k != c), key=lambda k: to[k], default=None)
                if best is None:
                    best, fresh = fresh, fresh + 1
                own[n], moved = best, True
        if not moved:
            break
    return own


def communities(und: DataFrame, nodes: DataFrame, refine: bool = True, seed: int = _SEED) -> DataFrame:
    """node, component, community. Louvain never joins what no path joins, so each connected component is one
    task; components come from an iterative minimum of labels."""
    found = connected(und, nodes)
    rows = und.join(found.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b", F.col("w").cast("double").alias("w"))
    alone = found.join(und.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti").select("component", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = sorted(pdf[["a", "b", "w"]].itertuples(index=False, name=None))
        own = louvain_local(links, sorted(set(pdf.a) | set(pdf.b)), seed)
        if refine:
            own = refine_local(links, own)
        return pd.DataFrame([(n, pdf.component.iloc[0], c) for n, c in own.items()], columns=["node", "component", "local"])

    local = rows.unionByName(alone).groupBy("component").applyInPandas(run, "node string, component string, local long")
    return local.select("node", "component", F.concat_ws("#", "component", "local").alias("community"))


def connected(und: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """node and the smallest node that it is connected to; labels jump along their own labels each round."""
    labels = nodes.select("node", F.col("node").alias("component"))
    both = und.select("a", "b").unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    spark = und.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not shared:
            import tempfile

            shared = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(shared)
    for _ in range(rounds):
        least = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(least, labels["node"] == least["a"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.alias("x").join(step.select(F.col("node").alias("via"), F.col("component").alias("far")).alias("y"), F.col("component") == F.col("via"), "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component")).checkpoint()
        changed = jump.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before").isEmpty()
        labels = jump
        if changed:
            return labels
    raise RuntimeError(f"components aren't done after {rounds} rounds")


def betweenness(pairs: DataFrame, nodes: DataFrame, sources: int | None = None) -> DataFrame:
    """Unweighted directed betweenness, normalised by (n-1)(n-2). Each task runs Brandes' accumulation from its
    sources over a broadcast adjacency (bounded: above EXACT_NODES sources are sampled by hash and scaled)."""
    spark = pairs.sparkSession
    names = sorted(r[0] for r in nodes.select("node").distinct().collect())
    index = {n: i for i, n in enumerate(names)}
    n = len(names)
    out: list[list[int]] = [[] for _ in names]
    for a, b in sorted((index[r[0]], index[r[1]]) for r in pairs.select("src", "dst").distinct().collect()):
        out[a].append(b)
    take = list(range(n))
    if n > EXACT_NODES or sources:
        take = np.random.default_rng(_SEED).permutation(n)[: sources or SAMPLED_SOURCES].tolist()
    scale = (n / len(take) if take else 0.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    graph = spark.sparkContext.broadcast(out)

    def run(batches):
        for pdf in batches:
            total = np.zeros(n)
            for s in pdf.i:
                total += _brandes(graph.value, int(s), n)
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"i": hit, "part": total[hit]})

    parts = spark.createDataFrame([(i,) for i in take], "i long").repartition(min(max(1, len(take)), 32)).mapInPandas(run, "i long, part double") if take else spark.createDataFrame([], "i long, part double")
    named = spark.createDataFrame(list(enumerate(names)), "i long, node string")
    return named.join(parts.groupBy("i").agg((F.sum("part") * scale).alias("b")), "i", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _brandes(out: list[list[int]], s: int, n: int) -> np.ndarray:
    sigma, dist, order = np.zeros(n), np.full(n, -1), [s]
    before: list[list[int]] = [[] for _ in range(n)]
    sigma[s], dist[s] = 1, 0
    for v in order:
        for w in out[v]:
            if dist[w] < 0:
                dist[w] = dist[v] + 1
                order.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
                before[w].append(v)
    delta = np.zeros(n)
    for w in reversed(order):
        for v in before[w]:
            delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
    delta[s] = 0
    return delta


def god_objects(owns: DataFrame, membership: DataFrame, centrality: DataFrame, spread: int = 3) -> DataFrame:
    """Owners whose members lie in ``spread`` or more coupling communities; score .5 betweenness, .3 fan-in
    (both of the largest) and .2 of the share of communities."""
    m = owns.select("owner", "member").distinct().join(membership.select(F.col("node").alias("member"), "community"), "member")
    span = m.groupBy("owner").agg(F.count_distinct("community").alias("span"), F.count("*").alias("n_members")).where(F.col("span") >= spread)
    n = membership.agg(F.count_distinct("community").alias("n_communities"))
    top = centrality.agg(F.max("betweenness").alias("top_b"), F.max("fan_in").alias("top_f"))
    rows = span.join(centrality, span["owner"] == centrality["node"], "left").join(F.broadcast(n)).join(F.broadcast(top))  # one row each
    part = lambda x, most: F.when(F.col(most) > 0, F.coalesce(x, F.lit(0.0)) / F.col(most)).otherwise(0.0)
    score = 0.5 * part("betweenness", "top_b") + 0.3 * part("fan_in", "top_f") + 0.2 * F.col("span") / F.col("n_communities")
    return rows.select("owner", "span", "n_members", score.alias("score"))


def split_suggestions(owns: DataFrame, membership: DataFrame) -> DataFrame:
    """For owners whose members form two or more groups of two or more: owner, part name, members."""
    m = owns.select("owner", "member").distinct().join(membership.select(F.col("node").alias("member"), "community"), "member")
    groups = m.groupBy("owner", "community").agg(F.array_sort(F.collect_list("member")).alias("members")).where(F.size("members") >= 2)
    w = Window.partitionBy("owner")
    rows = groups.withColumn("n_groups", F.count("*").over(w)).where("n_groups >= 2")
    i = F.row_number().over(w.orderBy(F.desc(F.size("members")), F.col("members")[0]))
    base = F.substring_index(F.substring_index("owner", "::", -1), ".", -1)
    return rows.select("owner", F.concat(base, F.lit("_part"), i.cast("string")).alias("part"), "members")


def community_labels(membership: DataFrame, symbols: DataFrame, centrality: DataFrame) -> DataFrame:
    """Dominant module (and how many others) and the most central symbol of each community."""
    rows = membership.join(symbols.select(F.col("fqn").alias("node"), "path"), "node", "left").join(centrality, "node", "left")
    votes = rows.groupBy("community", "path").agg(F.count("*").alias("n"))
    best = votes.groupBy("community").agg(F.max_by("path", F.struct("n", F.col("path"))).alias("module"), (F.count("*") - 1).alias("others"))
    centre = rows.groupBy("community").agg(F.max_by("node", F.struct(F.coalesce("betweenness", F.lit(0.0)), "node")).alias("centre"), F.count("*").alias("size"))
    label = F.concat(F.coalesce("module", F.lit("?")), F.when(F.col("others") > 0, F.concat(F.lit(" (+"), F.col("others").cast("string"), F.lit(" modules)"))).otherwise(""), F.lit(" — "), "centre")
    return best.join(centre, "community").select("community", "size", label.alias("label"))


def matrix(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Dependency cells (row, col, weight, kinds); ``order`` has node and its sort keys g and k (community or file, name)."""
    places = order.select("node", (F.row_number().over(Window.orderBy("g", "k", "node")) - 1).alias("place"))
    cells = pairs.join(places.select(F.col("node").alias("src"), F.col("place").alias("row")), "src").join(places.select(F.col("node").alias("dst"), F.col("place").alias("col")), "dst")
    return cells.select("row", "col", "weight", "kinds")


def matrix_by_community(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Summed weight between communities, for graphs of more than MATRIX_NODES nodes."""
    m = membership.select("node", "community")
    both = pairs.join(m.select(F.col("node").alias("src"), F.col("community").alias("row")), "src").join(m.select(F.col("node").alias("dst"), F.col("community").alias("col")), "dst")
    return both.groupBy("row", "col").agg(F.sum("weight").alias("weight"))
