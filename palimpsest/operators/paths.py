"""Walks over relations: following, aggregating, and searching for chains that answer a query."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X

# Search widths and weights.
BEAM, EDGES_AN_ENTITY, HITS, DEPTH = 24, 12, 12, 3
REVERSE, LAST_STEP = 0.75, 3.0
# Words that name an answer, negate a query, or stand for one another.
ANSWER_WORDS = frozenset("address city count country date email kind language list name names number phone place town type value".split())
NEGATION_WORDS = frozenset("arent cannot cant didnt doesnt dont except hadnt hasnt havent isnt neither never no nobody none nor not nothing wasnt werent without wont".split())
SYNONYMS = {
    "home": ("live",), "lives": ("home",), "live": ("home",), "job": ("work",), "employer": ("work",), "company": ("work",),
    "work": ("company",), "works": ("company",), "boss": ("manager",), "supervisor": ("manager",), "sister": ("sibling",),
    "brother": ("sibling",), "sibling": ("brother", "sister"), "language": ("use",), "stack": ("use",), "prefer": ("like",),
    "prefers": ("like",), "like": ("prefer",), "likes": ("prefer",),
}


def negated(text: str) -> bool:
    folded = X.fold_text(text)
    return "no longer" in folded or not NEGATION_WORDS.isdisjoint(folded.split())


def forms(word: str) -> set[str]:
    """Surface forms of a word that match one another."""
    lemma = X.norm_predicate(word)
    return {w for w in (word, X.singularize(word), lemma) if len(w) > 1 and " " not in w}


def text_forms(text: str) -> list[str]:
    return sorted(set().union(*map(forms, X.fold_text(text).split()))) if text else []


def query_terms(query: str, anchors: str = "") -> list[list[str]]:
    """The words of a query that can match a relation, each as its forms; 16 at most, none that names an anchor or the answer."""
    taken = set(text_forms(anchors))
    out = []
    for word in X.fold_text(query or "").split():
        if len(word) < 2 or word in X.STOPWORDS or word in ANSWER_WORDS:
            continue
        found = forms(word) | set(SYNONYMS.get(word, ()))
        if found.isdisjoint(taken):
            taken |= found
            out.append(sorted(found))
    # a term that shares a form with an earlier one adds nothing
    return out[:16]


def incident(relations: DataFrame) -> DataFrame:
    """(entity, other, reverse, relation columns): each relation from both its ends, as a union of two scans instead of a join on either end."""
    out = relations.where("src <> dst")
    forward = out.select(F.col("src").alias("entity"), F.col("dst").alias("other"), F.lit(False).alias("reverse"), *out.columns)
    return forward.unionByName(out.select(F.col("dst").alias("entity"), F.col("src").alias("other"), F.lit(True).alias("reverse"), *out.columns))


def follow(relations: DataFrame, starts: DataFrame, depth: int, k: int | None = None) -> DataFrame:
    """(query_id, id, hops, direction) of the relations (id, src, dst) within depth hops of starts (query_id, entity), each from the side reached first; k a query."""
    sides = incident(relations.select("id", "src", "dst"))
    frontier = starts.select("query_id", "entity").distinct()
    reached, found, seen = frontier, [], None
    for hop in range(1, depth + 1):
        step = frontier.join(sides, "entity")
        if seen is not None:
            step = step.join(seen, ["query_id", "id"], "left_anti")
        # a relation between two entities of the same frontier is met from the smaller one
        step = step.groupBy("query_id", "id").agg(F.min(F.struct("entity", "reverse", "other")).alias("x"))
        found.append(step.select("query_id", "id", F.lit(hop).alias("hops"), F.when(F.col("x.reverse"), "in").otherwise("out").alias("direction")))
        ids = step.select("query_id", "id")
        seen = ids if seen is None else seen.unionByName(ids)
        frontier = step.select("query_id", F.col("x.other").alias("entity")).distinct().join(reached, ["query_id", "entity"], "left_anti")
        reached = reached.unionByName(frontier)
    out = reduce(DataFrame.unionByName, found)
    if k is None:
        return out
    order = W.partitionBy("query_id").orderBy("hops", F.col("direction").desc(), "id")
    return out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def aggregate(relations: DataFrame, key: str, other: str) -> DataFrame:
    """For each value of key: how many distinct ends its positive relations have, how many facts, and how many negative ones apart."""
    positive = F.col("polarity") == 1
    return relations.groupBy(key).agg(F.count_distinct(F.when(positive, F.col(other))).alias("ends"), F.count_if(positive).alias("facts"), F.count_if(~positive).alias("negatives"))


def lexical_beam(relations: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, position, coverage, score, steps, end) of the best chains for queries (query_id, entity, terms array<array<string>>).

    relations (id, src, dst, words): words are the forms of predicate and fact. A hop must match a query
    term that the chain has not matched yet. Each round is a join with the incident edges and two ranked cuts.
    """
    sides = incident(relations.select("id", "src", "dst", "words"))
    terms = queries.select("query_id", "terms").dropDuplicates(["query_id"]).where(F.size("terms") > 0)
    state = queries.select("query_id", "entity").distinct().join(terms, "query_id")
    state = state.select("query_id", "entity", "terms", F.lit(0).cast("long").alias("covered"), F.lit(1.0).alias("score"), F.array().cast("array<bigint>").alias("steps"))
    bits = lambda c: F.bit_count(c)
    hits = []
    for _ in range(depth):
        step = state.join(sides, "entity")
        mask = F.aggregate(F.sequence(F.lit(0), F.size("terms") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(F.arrays_overlap(F.element_at("terms", i + 1), F.col("words")), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        step = step.withColumn("mask", mask).where("mask <> 0")
        quality = (0.4 + 0.6 * bits(F.col("mask")) / F.size("terms")) * F.when(F.col("reverse"), REVERSE).otherwise(1.0)
        step = step.withColumn("quality", quality)
        edge = W.partitionBy("query_id", "entity", "covered", "steps").orderBy(bits(F.col("mask")).desc(), F.col("quality").desc(), "id")
        step = step.withColumn("n", F.row_number().over(edge)).where(F.col("n") <= EDGES_AN_ENTITY)
        step = step.withColumn("now", F.col("covered").bitwiseOR(F.col("mask"))).where("now <> covered")
        step = step.select("query_id", F.col("other").alias("entity"), "terms", F.col("now").alias("covered"), (F.col("score") * F.col("quality")).alias("score"), F.concat("steps", F.array("id")).alias("steps"))
        same = W.partitionBy("query_id", "entity", "covered").orderBy(F.col("score").desc(), "steps")
        step = step.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
        hits.append(step.where(bits(F.col("covered")) >= F.when(F.size("terms") >= 2, 2).otherwise(1)))
        beam = W.partitionBy("query_id").orderBy(bits(F.col("covered")).desc(), F.col("score").desc(), "entity")
        state = step.withColumn("n", F.row_number().over(beam)).where(F.col("n") <= BEAM).drop("n")
    out = reduce(DataFrame.unionByName, hits).select("query_id", bits(F.col("covered")).alias("coverage"), "score", "steps", F.col("entity").alias("end"))
    ends = W.partitionBy("query_id", "end", "coverage").orderBy(F.col("score").desc(), F.size("steps"), "steps")
    out = out.withColumn("n", F.row_number().over(ends)).where("n = 1").drop("n")
    best = W.partitionBy("query_id").orderBy(F.col("coverage").desc(), F.col("score").desc(), F.size("steps"), "end")
    return out.withColumn("position", F.row_number().over(best)).where(F.col("position") <= HITS)


def evidence(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, memory_id, weight): what the chains of hits say for the memories of links (relation_id, memory_id); a chain's last step counts LAST_STEP times."""
    step = hits.select("query_id", (F.col("score") * F.pow(1.0 + F.col("coverage"), F.lit(2))).alias("base"), F.size("steps").alias("n"), F.posexplode("steps").alias("p", "relation_id"))
    weight = F.col("base") * F.when(F.col("p") == F.col("n") - 1, LAST_STEP).otherwise(1.0)
    return step.join(links, "relation_id").groupBy("query_id", "memory_id").agg(F.max(weight).alias("weight"))


def residual_after(query: np.ndarray, fact: np.ndarray) -> np.ndarray:
    """What is left of a query vector beside a fact's direction, of length 1."""
    size = np.linalg.norm(fact)
    left = query - (query @ fact / size**2) * fact if size else query
    return left / n if (n := np.linalg.norm(left)) else left


def semantic_beam(query: np.ndarray, facts: list[tuple[int, int, int, np.ndarray]], seeds: list[int], depth: int = DEPTH, beam: int = BEAM, edges: int = 6) -> list[tuple[float, list[int], int]]:
    """(score, relation ids, end) of chains of two hops or more over facts (id, src, dst, vector) near a query.

    A hop scores the cosine of its fact with what of the query earlier hops have left; chains never come
    back to an entity or to a seed. facts are one query's nearest: a bounded number.
    """
    sides: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, s, d, v in facts:
        if s != d:
            sides.setdefault(s, []).append((i, d, v))
            sides.setdefault(d, []).append((i, s, v))
    cosine = lambda a, b: float(a @ b / n) if (n := np.linalg.norm(a) * np.linalg.norm(b)) else 0.0
    states = [(0.0, [], s, {s}, query / (np.linalg.norm(query) or 1)) for s in dict.fromkeys(seeds)]
    out: dict[int, tuple[float, list[int], int]] = {}
    for _ in range(depth):
        new = []
        for score, steps, at, seen, left in states:
            near = sorted(((cosine(left, v), i, o, v) for i, o, v in sides.get(at, []) if o not in seen and o not in seeds), key=lambda x: (-x[0], x[1]))[:edges]
            new += [(score + c, [*steps, i], o, seen | {o}, residual_after(left, v)) for c, i, o, v in near if c > 0]
        states = sorted(new, key=lambda x: (-x[0], x[1]))[:beam]
        for score, steps, at, *_ in states:
            if len(steps) >= 2 and (at not in out or out[at][0] < score):
                out[at] = (score, steps, at)
    return sorted(out.values(), key=lambda x: (-x[0], x[1]))[:HITS]
