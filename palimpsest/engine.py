"""The engine: memories in, memories and facts out, over a store on Spark."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.functions import temporal as T
from palimpsest.functions import text as X
from palimpsest.functions.embed import HashEmbedder, embedded
from palimpsest.ledger import Ledger, Rejected, identifier, prepare
from palimpsest.operators import graph, maintenance, paths, ranking, resolve, retrieval, validity
from palimpsest.sources import exchange
from palimpsest.sources.store import Store

BATCH = 256
KEYS = {"memories": ["id"], "memories_vec": ["id"], "entities": ["id"], "entity_aliases": ["entity_id", "alias_norm"], "predicates": ["id"], "relations": ["id"], "mentions": ["memory_id", "entity_id"], "relation_evidence": ["relation_id", "memory_id"]}


class Engine:
    """One store. clock: unix seconds, the time of day if not given."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] | None = None, embedder: HashEmbedder | None = None, config: schema.Config = schema.Config(), offset: int = 0):
        self.spark, self.config, self.offset = spark, config, offset
        self.embedder = embedder or HashEmbedder()
        self.store = Store(spark, path, self.embedder.name)
        self.clock = clock or (lambda: int(time.time()))

    def now(self) -> T.Clock:
        return T.Clock(self.clock(), self.offset)

    # writing

    def remember(self, item: dict) -> dict:
        out = self.remember_batch([item])[0]
        if "error" in out:
            raise Rejected(out["error"])
        return out

    def remember_batch(self, items: Sequence[dict], infer_relations: bool = False) -> list[dict]:
        """Write memories in order, BATCH at a time; one that breaks a rule is reported and leaves the others alone."""
        out: list[dict] = []
        for k in range(0, len(items), BATCH):
            out += self._write(items[k : k + BATCH], infer_relations)
        return out

    def _write(self, items: Sequence[dict], infer_relations: bool) -> list[dict]:
        clock = self.now()
        prepared = []
        for item in items:
            try:
                prepared.append(prepare(item, clock, infer_relations))
            except Rejected as e:
                prepared.append(e)
        good = [p for p in prepared if not isinstance(p, Rejected)]
        ledger = self._touched(good)
        out = []
        for p in prepared:
            try:
                if isinstance(p, Rejected):
                    raise p
                out.append(ledger.remember(p, clock.now))
            except Rejected as e:
                out.append({"error": str(e)})
        self._save(ledger)
        return out

    def _touched(self, good: list) -> Ledger:
        """The rows that these inputs can touch, by key: a bounded part of the store."""
        t = self.store.table
        names = {X.norm_name(n) for p in good for n in [*(e["name"] for e in p.entities), *(a for e in p.entities for a in e.get("aliases") or ()), *(str(v) for r in p.relations for k, v in r.items() if k in ("source", "target", "src", "dst", "subject", "object"))]}
        heads = sorted({n[:3] for n in names if n})
        keys = self.spark.createDataFrame([(h,) for h in heads], "head string")
        aliases = t("entity_aliases").withColumn("head", F.substring("alias_norm", 1, 3)).join(F.broadcast(keys), "head", "left_semi")  # heads of one batch
        initial = t("entities").where(F.col("name").isin(*sorted({n.upper() for n in names if 3 <= len(n) <= 6})) if names else F.lit(False)).select(F.col("id").alias("entity_id"))
        ids = aliases.select("entity_id").unionByName(initial).distinct()
        entities = t("entities").join(F.broadcast(ids), F.col("id") == F.col("entity_id"), "left_semi")
        ledger = Ledger(next_id={n: (t(n).agg(F.max("id")).first()[0] or 0) + 1 for n in ("memories", "entities", "predicates", "relations")})
        rows = lambda df: [r.asDict() for r in df.collect()]
        ledger.entities = {r["id"]: r for r in rows(entities)}
        for r in rows(t("entity_aliases").join(F.broadcast(ids), "entity_id", "left_semi")):
            ledger.aliases.setdefault(r["alias_norm"], set()).add(r["entity_id"])
        ledger.predicates = {r["id"]: r for r in rows(t("predicates"))}
        known = list(ledger.entities)
        # rivals share the subject, equal and denied triples both ends: what else a much-named entity takes part in stays in the store
        near = t("relations").where(F.col("subj").isin(*known) | (F.col("src").isin(*known) & F.col("dst").isin(*known))) if known else t("relations").limit(0)
        replaced = sorted({i for p in good for i in p.supersedes})
        evidence = t("relation_evidence")
        for_old = evidence.where(F.col("memory_id").isin(*replaced)).select(F.col("relation_id").alias("id")) if replaced else evidence.limit(0).select(F.col("relation_id").alias("id"))
        near = near.unionByName(t("relations").join(for_old.distinct(), "id", "left_semi")).dropDuplicates(["id"])
        ledger.relations = {r["id"]: r for r in rows(near)}
        links = evidence.where(F.col("relation_id").isin(*ledger.relations)) if ledger.relations else evidence.limit(0)
        links = links.unionByName(evidence.join(links.select("memory_id").distinct(), "memory_id", "left_semi")).distinct()
        ledger.evidence = {(r["relation_id"], r["memory_id"]) for r in rows(links)}
        missing = {r for r, _ in ledger.evidence} - set(ledger.relations)
        if missing:
            ledger.relations |= {r["id"]: r for r in rows(t("relations").where(F.col("id").isin(*missing)))}
        wanted = sorted({*replaced, *(m for _, m in ledger.evidence)})
        hashes = sorted({p.hash for p in good})
        memory = t("memories").where((F.col("id").isin(*wanted) if wanted else F.lit(False)) | (F.col("content_hash").isin(*hashes) & F.col("expired_at").isNull() if hashes else F.lit(False)))
        ledger.memories = {r["id"]: r for r in rows(memory)}
        if known and wanted:
            ledger.mentions = {(r["memory_id"], r["entity_id"]) for r in rows(t("mentions").where(F.col("memory_id").isin(*wanted)))}
        return ledger

    def _save(self, ledger: Ledger) -> None:
        columns = lambda name: [c.split()[0] for c in schema.TABLES[name].split(", ")]
        changed = {name: [tuple(getattr(ledger, name)[i][c] for c in columns(name)) for i in sorted(ledger.changed[name])] for name in ("memories", "entities", "predicates", "relations")}
        changed["entity_aliases"] = [(i, alias, norm, "agent") for i, alias, norm in sorted(ledger.changed["entity_aliases"])]
        changed["mentions"] = sorted(ledger.changed["mentions"])
        changed["relation_evidence"] = sorted(ledger.changed["relation_evidence"])
        new = [ledger.memories[i] for i in sorted(ledger.changed["memories"])]
        vectors = self.embedder.embed([m["content"] for m in new])
        changed["memories_vec"] = [(m["id"], [float(x) for x in v], m["expired_at"] is None) for m, v in zip(new, vectors, strict=True)]
        self.store.upsert(changed, KEYS)

    def invalidate(self, which: str, at: str | int | None = None) -> None:
        """End a memory (m12) or a relation (r12)."""
        name = {"m": "memories", "r": "relations"}.get(which[:1])
        if name is None:
            raise Rejected(f"not an id: {which}")
        clock = self.now()
        when = at if isinstance(at, int) else clock.now if at is None else T.parse_instant(at, clock)
        ids = self.spark.createDataFrame([(identifier(which, which[0]), when)], "id long, at long")
        self.store.commit({name: maintenance.invalidate(self.store.table(name), ids)})

    def forget(self, which: str, hard: bool = False) -> None:
        t = self.store.table
        ids = self.spark.createDataFrame([(identifier(which, "m"),)], "id long")
        memories, relations = maintenance.forget(t("memories"), t("relations"), t("relation_evidence"), ids, self.clock(), hard)
        out = {"memories": memories, "relations": relations}
        if hard:
            out |= maintenance.erased({n: t(n) for n in ("memories_vec", "mentions", "relation_evidence")}, ids)
        self.store.commit(out)

    def merge(self, keep: str, other: str) -> None:
        """Two names are one entity: the other's rows become keep's."""
        t = self.store.table
        a, b = self.resolve(keep), self.resolve(other)
        if a == b:
            raise Rejected("the same entity")
        relations, mentions, evidence = maintenance.merge(t("relations"), t("mentions"), a, b, self.clock(), t("relation_evidence"))
        moved = t("entity_aliases").withColumn("entity_id", F.when(F.col("entity_id") == b, F.lit(a)).otherwise(F.col("entity_id")).cast("long")).dropDuplicates(["entity_id", "alias_norm"])
        n = t("entities").where(F.col("id") == b).select("mention_count").first()[0]
        entities = t("entities").where(F.col("id") != b).withColumn("mention_count", F.when(F.col("id") == a, F.col("mention_count") + n).otherwise(F.col("mention_count")))
        self.store.commit({"relations": relations, "mentions": mentions, "relation_evidence": evidence, "entity_aliases": moved, "entities": entities})

    def alias(self, entity: str, alias: str) -> None:
        """Another name of an entity; refused if it names another one."""
        i, norm = self.resolve(entity), X.norm_name(alias)
        taken = self.store.table("entity_aliases").where((F.col("alias_norm") == norm) & (F.col("entity_id") != i)).head(1)
        if taken:
            raise Rejected(f"{alias} names another entity")
        self.store.upsert({"entity_aliases": [(i, alias, norm, "manual")]}, KEYS)

    # reading

    def resolve(self, name: str) -> int:
        """The entity of a name: exact, else the only one that begins so."""
        norm = X.norm_name(name)
        found = self.store.table("entity_aliases").where((F.col("alias_norm") == norm) | F.startswith("alias_norm", F.lit(norm))).select("entity_id", (F.col("alias_norm") != norm).alias("far")).distinct().orderBy("far", "entity_id").limit(2).collect()
        if not found:
            raise Rejected(f"no such entity: {name}")
        return found[0].entity_id

    def recall(self, query: str, **options) -> list[dict]:
        rows = self.recall_batch([query], **options).orderBy("position").collect()
        return [r.asDict() for r in rows]

    def recall_batch(self, queries: Sequence[str] | DataFrame, k: int = 8, budget: int = 1200, as_of: str | int | None = None, history: bool = False, **filters) -> DataFrame:
        """(query_id, position, id, content, score, cost): memories for many queries at once, through words, vectors, time, graph and relation paths."""
        clock = self.now()
        cut = as_of if isinstance(as_of, int) or as_of is None else T.parse_instant(as_of, clock)
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")
        k = min(50, max(1, k))
        depth = max(5 * k, 50)
        fits = validity.eligible(cut, history, **filters)
        memories = self.store.table("memories").where(fits)
        asked = queries.select("query_id", "q", X.search_terms(F.col("q")).alias("terms"), embedded(F.col("q"), self.embedder).alias("embedding"))
        posted = retrieval.postings(memories.select("id", X.tokens(F.col("content")).alias("words"), "tags"), {"words": 1.0, "tags": 2.0})
        words = retrieval.bm25(posted, asked, depth, self.config.fts_prefix_min).select("query_id", "id", "rank", F.lit("bm25").alias("channel"))
        vectors = self.store.table("memories_vec").join(memories.select("id"), "id", "left_semi").select("id", "embedding")
        near = retrieval.knn(vectors, asked.select(F.col("query_id"), "embedding").withColumn("query_id", -F.col("query_id") - 1), depth).withColumn("query_id", -F.col("query_id") - 1)
        spans = self._spans(queries, clock)
        channels = [words, near.select("query_id", "id", "rank", F.lit("vector").alias("channel")), self._timed(memories, near, spans, depth), *self._linked(memories, asked, near, clock, cut, history, depth)]
        weights = {"bm25": self.config.w_bm25, "vector": self.config.w_vector, "time": self.config.w_temporal, "graph": self.config.w_graph, "path": self.config.w_path}
        fused = ranking.rrf(reduce(DataFrame.unionByName, channels), weights, self.config)
        # nothing is found for a query that only far vectors speak for
        near_enough = near.where(F.col("cosine") >= self.config.abstain_cosine).select("query_id")
        supported = reduce(DataFrame.unionByName, [c.select("query_id") for c in (channels[0], channels[2], channels[4])], near_enough).distinct()
        fused = fused.join(supported, "query_id", "left_semi")
        rows = fused.join(memories, "id")
        # a query about what is not so is answered by memories that say so, or that evidence a denial
        denies = X.vectorised(paths.negated, "boolean")
        asks = queries.select("query_id", denies(F.col("q")).alias("asks"))
        denied = self.store.table("relations").where("polarity = 0").select(F.col("id").alias("relation_id")).join(self.store.table("relation_evidence"), "relation_id").select(F.col("memory_id").alias("id")).distinct().withColumn("denied", F.lit(True))
        rows = rows.join(asks, "query_id").join(denied, "id", "left").where(~F.col("asks") | F.coalesce("denied", F.lit(False)) | denies(F.col("content"))).drop("asks", "denied")
        rows = rows.join(spans, "query_id", "left")
        inside = F.coalesce(F.col("valid_from").between(F.col("a"), F.col("z") - 1), F.lit(False))
        score = ranking.modified(F.col("score"), validity.ended(clock.now if cut is None else cut), inside, F.lit(clock.now) - F.col("valid_from"), F.col("importance"), history, cut is not None, self.config)
        rows = rows.withColumn("score", score).join(self.store.table("memories_vec").select("id", "embedding"), "id")
        best = retrieval.top(rows, 3 * k)
        chosen = ranking.diversified(best, k, self.config).withColumnRenamed("position", "rank")
        kept = chosen.join(best.select("query_id", "id", "content", "score"), ["query_id", "id"]).withColumn("cost", X.cost(F.col("content")))
        packed = ranking.packed(kept, budget)
        return packed.select("query_id", "id").join(kept, ["query_id", "id"]).select("query_id", F.col("rank").alias("position"), "id", "content", "score", "cost")

    def _spans(self, queries: DataFrame, clock: T.Clock) -> DataFrame:
        """(query_id, a, z): the time, from a to before z, that a query names."""

        def window(q: str) -> str | None:
            w = T.find_window(q, clock)
            return f"{w.start},{w.end}" if w else None

        return queries.select("query_id", F.split(X.vectorised(window)(F.col("q")), ",").alias("w")).where("w IS NOT NULL").select("query_id", F.element_at("w", 1).cast("long").alias("a"), F.element_at("w", 2).cast("long").alias("z"))

    def _timed(self, memories: DataFrame, near: DataFrame, spans: DataFrame, depth: int) -> DataFrame:
        """Memories that start inside the time which a query names, by cosine."""
        inside = memories.select("id", "valid_from").join(spans, F.col("valid_from").between(F.col("a"), F.col("z") - 1))
        scored = inside.join(near.select("query_id", "id", "cosine"), ["query_id", "id"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
        return retrieval.top(scored, depth, "cosine").select("query_id", "id", "rank", F.lit("time").alias("channel"))

    def _linked(self, memories: DataFrame, asked: DataFrame, near: DataFrame, clock: T.Clock, cut: int | None, history: bool, depth: int) -> list[DataFrame]:
        """Memories by PageRank from the entities that a query names, and by chains of relations that answer it."""
        t = self.store.table
        relations = t("relations").where(validity.visible(clock.now, cut, history))
        aliases = t("entity_aliases").select(F.col("alias_norm").alias("alias"), "entity_id").distinct()
        grams = asked.select("query_id", X.tokens(F.col("q")).alias("words")).select("query_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: F.array_join(F.slice("words", i + 1, n), " "))))).alias("alias")).distinct()
        anchors = grams.where(F.length("alias") >= 3).join(aliases, "alias").select("query_id", "entity_id").distinct()
        node = lambda c: (-F.col(c)).alias(c)  # noqa: E731  entities are negative nodes, memories positive ones
        edges = graph.edges(
            t("mentions").join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select(F.col("memory_id").alias("u"), (-F.col("entity_id")).alias("v")),
            relations.select((-F.col("src")).alias("u"), (-F.col("dst")).alias("v"), F.col("evidence_count").alias("evidence")),
        )
        rare = t("mentions").groupBy("entity_id").agg(F.count("*").alias("n"))
        seeds = anchors.join(rare, "entity_id").select("query_id", node("entity_id").alias("node"), (0.4 / F.col("n")).alias("mass"))
        seeds = seeds.unionByName(near.where(F.col("rank") <= self.config.mem_seed_top).select("query_id", F.col("id").alias("node"), (F.greatest("cosine", F.lit(0.0)) * self.config.mem_seed_share / self.config.mem_seed_top).alias("mass")))
        mass = graph.ppr_power(edges, seeds.where("mass > 0"), self.config.alpha, 3).where("node > 0").withColumnRenamed("node", "id")
        walked = retrieval.top(mass.join(memories.select("id"), "id", "left_semi"), depth).select("query_id", "id", "rank", F.lit("graph").alias("channel"))
        spoken = F.udf(paths.query_terms, "array<array<string>>")
        words = X.vectorised(lambda s: paths.text_forms(s), "array<string>")
        told = relations.where("src <> dst").join(t("predicates").select(F.col("id").alias("predicate_id"), "canonical"), "predicate_id")
        told = told.join(t("entities").select(F.col("id").alias("src"), F.col("name").alias("sn")), "src").join(t("entities").select(F.col("id").alias("dst"), F.col("name").alias("dn")), "dst")
        told = told.select("id", "src", "dst", words(F.concat_ws(" ", "canonical", "sn", "text", "dn")).alias("words"))
        named = anchors.join(t("entities").select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("query_id").agg(F.array_join(F.collect_list("name"), " ").alias("names"))
        # a query that denies something, or asks how things were, is not answered by chains
        plain = F.udf(lambda q: not paths.negated(q) and not T.history_intent(q), "boolean")
        starts = anchors.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("entity_id"))).where("n <= 4").join(named, "query_id").join(asked.select("query_id", "q"), "query_id").where(plain("q"))
        starts = starts.select("query_id", F.col("entity_id").alias("entity"), spoken("q", "names").alias("terms"))
        hits = paths.lexical_beam(told, starts)
        proof = paths.evidence(hits, t("relation_evidence")).withColumnRenamed("memory_id", "id").join(memories.select("id"), "id", "left_semi")
        return [walked, retrieval.top(proof, depth, "weight").select("query_id", "id", "rank", F.lit("path").alias("channel"))]

    def follow(self, name: str, depth: int = 2, k: int = 20, as_of: int | None = None, history: bool = False) -> DataFrame:
        """Relations within depth hops of an entity, nearest first."""
        shown = self.store.table("relations").where(validity.visible(self.clock(), as_of, history))
        start = self.spark.createDataFrame([(0, self.resolve(name))], "query_id long, entity long")
        return paths.follow(shown, start, min(3, max(1, depth)), min(100, max(1, k))).join(self._named(shown), "id").drop("query_id").orderBy("hops", F.col("direction").desc(), "id")

    def _named(self, relations: DataFrame) -> DataFrame:
        """(id, source, predicate, target, polarity, valid_from, valid_to)."""
        t = self.store.table
        name = lambda c, to: t("entities").select(F.col("id").alias(c), F.col("name").alias(to))
        return relations.join(name("src", "source"), "src").join(name("dst", "target"), "dst").join(t("predicates").select(F.col("id").alias("predicate_id"), F.col("canonical").alias("predicate")), "predicate_id").select("id", "source", "predicate", "target", "polarity", "valid_from", "valid_to")

    def aggregate(self, predicate: str, source: str | None = None, target: str | None = None, limit: int = 50, history: bool = False) -> DataFrame:
        """Distinct ends of a predicate's relations, with how many facts say so and how many deny it."""
        if source is None and target is None:
            raise Rejected("source or target is needed")
        shown = self._named(self.store.table("relations").where(validity.visible(self.clock(), None, history))).where(F.col("predicate") == X.norm_predicate(predicate))
        for column, name in (("source", source), ("target", target)):
            if name is not None:
                shown = shown.where(F.col(column) == self.store.table("entities").where(F.col("id") == self.resolve(name)).first().name)
        key = "target" if source is not None else "source"
        return paths.aggregate(shown, key, "source" if key == "target" else "target").orderBy(key).limit(min(200, limit))

    def entity(self, name: str, limit: int = 20) -> dict:
        """A card: the entity, its names, its relations and its newest memories."""
        t, i = self.store.table, self.resolve(name)
        row = t("entities").where(F.col("id") == i).first().asDict()
        facts = self._named(t("relations").where((F.col("src") == i) | (F.col("dst") == i)).where(validity.visible(self.clock()))).orderBy(F.col("valid_from").desc(), "id").limit(limit)
        timeline = t("memories").join(t("mentions").where(F.col("entity_id") == i).select(F.col("memory_id").alias("id")), "id").where(~validity.forgotten()).orderBy(F.col("valid_from").desc(), "id").limit(limit)
        return row | {"aliases": sorted(r.alias for r in t("entity_aliases").where(F.col("entity_id") == i).collect()), "facts": [r.asDict() for r in facts.collect()], "timeline": [r.asDict() for r in timeline.select("id", "content", "valid_from", "valid_to").collect()]}

    def overview(self, k: int = 5, most: int = 200_000) -> list[dict]:
        """The k communities that are mentioned most, each with its chief entities and a memory that stands for it.

        Communities are found over relations between entities, the `most` with the most evidence at most (what a driver can hold), and kept until the next write.
        """
        if getattr(self, "_communities", (None,))[0] != self.store.generation:
            pairs = self.store.table("relations").where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("evidence_count").alias("w"))
            home = graph.louvain((r.u, r.v, float(r.w)) for r in pairs.orderBy(F.col("w").desc(), "u", "v").limit(most).collect())
            self._communities = (self.store.generation, home)
        home = self._communities[1]
        if not home:
            return []
        t = self.store.table
        member = self.spark.createDataFrame(sorted(home.items()), "entity_id long, community long")
        named = member.join(t("entities"), F.col("entity_id") == F.col("id"))
        cards = named.groupBy("community").agg(F.sum("mention_count").alias("score"), F.slice(F.sort_array(F.collect_list(F.struct("mention_count", "name")), asc=False), 1, 3).alias("chief"), F.count("*").alias("size"))
        best = cards.orderBy(F.col("score").desc(), "community").limit(k)
        about = t("mentions").join(member, "entity_id").select("community", F.col("memory_id").alias("id"), "entity_id")
        stands = resolve.representative(about, t("memories").where(validity.live()), "community").join(t("memories").select("id", "content"), "id")
        out = best.join(stands.select("community", "id", "content"), "community", "left").orderBy(F.col("score").desc(), "community").collect()
        return [{"community": r.community, "size": r["size"], "score": r.score, "entities": [c["name"] for c in r.chief], "memory": r.content} for r in out]

    def stats(self) -> dict[str, int]:
        return {r.metric: r.n for r in maintenance.counts({n: self.store.table(n) for n in schema.TABLES}).collect()}

    def validate(self) -> dict[str, int]:
        t = self.store.table
        checks = {
            "mention without memory": (t("mentions"), "memory_id", t("memories"), "id"), "mention without entity": (t("mentions"), "entity_id", t("entities"), "id"),
            "evidence without relation": (t("relation_evidence"), "relation_id", t("relations"), "id"), "evidence without memory": (t("relation_evidence"), "memory_id", t("memories"), "id"),
            "memory without vector": (t("memories"), "id", t("memories_vec"), "id"), "relation without source": (t("relations"), "src", t("entities"), "id"), "relation without target": (t("relations"), "dst", t("entities"), "id"),
        }
        return {r.check: r.n for r in maintenance.dangling(checks).collect()}

    def sql(self, query: str) -> DataFrame:
        """A read-only query over the views nodes and edges."""
        t = self.store.table
        t("entities").select("id", "name", "type").createOrReplaceTempView("nodes")
        self._named(t("relations")).createOrReplaceTempView("edges")
        return self.spark.sql(maintenance.guarded(query))

    def export(self, path: str, forgotten: bool = False) -> None:
        exchange.write_jsonl({n: self.store.table(n) for n in schema.TABLES}, path, forgotten)

    def load(self, rows: Sequence[dict]) -> int:
        """Replay export records in order; ids of replaced memories are translated. The number written."""
        ids: dict[str, str] = {}
        held: list[tuple[str | None, dict]] = []

        def flush() -> None:
            for (old, _), out in zip(held, self.remember_batch([i for _, i in held]), strict=True):
                if old and "id" in out:
                    ids[old] = out["id"]
            held.clear()

        n = 0
        for row in rows:
            if any(s not in ids for s in row.get("supersedes") or []):
                flush()
            item = {k: v for k, v in row.items() if k not in ("id", "expired")} | {"supersedes": [ids[s] for s in row.get("supersedes") or [] if s in ids]}
            for r in item.get("relations") or []:
                for key in ("valid_from", "valid_to"):
                    r[key] = T.parse_instant(r[key], self.now()) if isinstance(r.get(key), str) else r.get(key)
            held.append((row.get("id"), item))
            n += 1
        flush()
        return n
