"""The memory graph: edges, personalised PageRank (by DataFrame or by push), communities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(mentions: DataFrame | None = None, relations: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """(u, v, weight), u < v, parallel edges summed, of mentions (u, v), relations (u, v, evidence) and similar (u, v, score)."""
    parts = []
    if mentions is not None:
        parts.append(mentions.select("u", "v", F.lit(1.0).alias("w")))
    if relations is not None:
        parts.append(relations.select("u", "v", F.greatest(F.log1p(F.col("evidence").cast("double")), F.lit(0.5)).alias("w")))
    if similar is not None:
        parts.append(similar.select("u", "v", F.col("score").cast("double").alias("w")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kept = out.where("u <> v AND w > 0").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    return kept.groupBy("u", "v").agg(F.sum("w").alias("weight"))


def both_ways(graph: DataFrame) -> DataFrame:
    """(u, v, share): each edge in both directions, with the share of u's weight that it takes."""
    directed = graph.select("u", "v", "weight").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    degree = directed.groupBy("u").agg(F.sum("weight").alias("degree"))
    return directed.join(degree, "u").select("u", "v", (F.col("weight") / F.col("degree")).alias("share"))


def ppr_power(graph: DataFrame, seeds: DataFrame, alpha: float, steps: int) -> DataFrame:
    """(query_id, node, score) after so many steps of p = alpha s + (1 - alpha) p W from seeds (query_id, node, mass); every query at once.

    Masses are normalised a query. A node without edges keeps what reaches it. Each step is one join and one
    partial aggregation by (query, node); for many steps, write the result in between to cut the lineage.
    """
    walk = both_ways(graph)
    total = seeds.groupBy("query_id").agg(F.sum("mass").alias("total"))
    start = seeds.groupBy("query_id", "node").agg(F.sum("mass").alias("mass")).join(total, "query_id").select("query_id", "node", (F.col("mass") / F.col("total")).alias("s"))
    lonely = start.join(walk.select(F.col("u").alias("node")).distinct(), "node", "left_anti").select("query_id", "node", (F.col("s") * (1 - alpha)).alias("score"))
    base = start.select("query_id", "node", (F.col("s") * alpha).alias("score"))
    p = start.select("query_id", "node", F.col("s").alias("score"))
    for _ in range(steps):
        moved = p.join(walk, p.node == walk.u).select("query_id", F.col("v").alias("node"), ((1 - alpha) * F.col("score") * F.col("share")).alias("score"))
        p = base.unionByName(moved).unionByName(lonely).groupBy("query_id", "node").agg(F.sum("score").alias("score"))
    return p


class Snapshot:
    """A graph in compressed rows, for one query at a time on the driver or in a task."""

    def __init__(self, rows: Iterable[tuple[int, int, float]]):
        rows = [(u, v, w) for u, v, w in rows if u != v and w > 0]
        self.ids = np.unique([x for u, v, _ in rows for x in (u, v)]).astype(np.int64)
        u, v = (np.searchsorted(self.ids, [r[k] for r in rows]) for k in (0, 1))
        w = np.array([r[2] for r in rows], float)
        a, b, w = np.concatenate([u, v]).astype(int), np.concatenate([v, u]).astype(int), np.concatenate([w, w])
        order = np.lexsort((b, a))
        self.to, self.w = b[order], w[order]
        self.at = np.searchsorted(a[order], np.arange(len(self.ids) + 1))
        self.degree = np.bincount(a, w, len(self.ids))

    def push(self, seeds: Mapping[int, float], alpha: float = 0.5, eps: float = 1e-5, most: int = 200_000) -> dict[int, float]:
        """Personalised PageRank by pushing residuals (Andersen, Chung and Lang 2006), in waves.

        Each wave pushes all nodes whose residual is eps of their degree or more; a seed that the graph
        does not have keeps its mass.
        """
        seeds = {n: m for n, m in seeds.items() if m > 0}
        total = sum(seeds.values())
        if not total:
            return {}
        known = {int(n): k for k, n in enumerate(self.ids)} if len(self.ids) else {}
        alone = {n: m / total for n, m in seeds.items() if n not in known}
        rest, score = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for n, m in seeds.items():
            if n in known:
                rest[known[n]] += m / total
        pushes = 0
        while pushes < most:
            hot = np.flatnonzero((rest > 0) & (rest >= eps * self.degree))[: most - pushes]
            if not len(hot):
                break
            pushes += len(hot)
            mass = rest[hot]
            rest[hot] = 0
            score[hot] += alpha * mass
            sizes = self.at[hot + 1] - self.at[hot]
            owner = np.repeat(np.arange(len(hot)), sizes)
            k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.at[hot][owner]
            np.add.at(rest, self.to[k], ((1 - alpha) * mass / self.degree[hot])[owner] * self.w[k])
        return alone | {int(self.ids[k]): float(score[k]) for k in np.flatnonzero(score)}

    def power(self, seeds: Mapping[int, float], alpha: float = 0.5, steps: int = 100) -> dict[int, float]:
        """The same fixed point by iteration."""
        known = {int(n): k for k, n in enumerate(self.ids)}
        total = sum(m for m in seeds.values() if m > 0)
        s = np.zeros(len(self.ids))
        for n, m in seeds.items():
            if n in known and m > 0:
                s[known[n]] += m / total
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        p = s.copy()
        for _ in range(steps):
            p = alpha * s + (1 - alpha) * np.bincount(self.to, p[owner] * self.w / self.degree[owner], len(self.ids))
        return {int(self.ids[k]): float(p[k]) for k in np.flatnonzero(p)}


def louvain(rows: Iterable[tuple[int, int, float]], resolution: float = 1.0, passes: int = 20) -> dict[int, int]:
    """node -> community by greedy modularity (Blondel et al. 2008); a community is called by its smallest node."""
    near: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for u, v, w in rows:
        if u != v and w > 0:
            near[u][v] += w
            near[v][u] += w
    member = {n: n for n in near}
    loops: dict[int, float] = defaultdict(float)
    for _ in range(passes):
        two_m = sum(sum(x.values()) for x in near.values()) + sum(loops.values())
        if not two_m:
            break
        degree = {n: sum(x.values()) + loops[n] for n, x in near.items()}
        home, total, moved = {n: n for n in near}, dict(degree), False
        for _ in range(passes):
            changed = False
            for n in sorted(near):
                links: dict[int, float] = defaultdict(float)
                for m, w in near[n].items():
                    links[home[m]] += w
                old = home[n]
                total[old] -= degree[n]
                gain = lambda c: links[c] - resolution * degree[n] * total[c] / two_m  # noqa: B023, E731
                best = max(sorted({*links, old}), key=lambda c: (round(gain(c), 12), c == old))
                total[best] += degree[n]
                if best != old:
                    home[n], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        smallest: dict[int, int] = {}
        for n in sorted(near):
            smallest.setdefault(home[n], n)
        name = {n: smallest[home[n]] for n in near}
        member = {n: name[c] for n, c in member.items()}
        new: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        inner: dict[int, float] = defaultdict(float)
        for n, x in near.items():
            inner[name[n]] += loops[n]
            for m, w in x.items():
                if name[m] == name[n]:
                    inner[name[n]] += w
                else:
                    new[name[n]][name[m]] += w
            new.setdefault(name[n], defaultdict(float))
        near, loops = new, inner
    least: dict[int, int] = {}
    for n, c in sorted(member.items()):
        least.setdefault(c, n)
    return {n: least[c] for n, c in member.items()}
