"""Tables of the memory model, kinds, the predicate ontology and tunable values."""

from __future__ import annotations

from dataclasses import dataclass

# Kinds of memories, the first being the default.
KINDS = ("note", "fact", "event", "preference", "decision", "task", "insight", "profile")

TABLES = {
    "memories": "id long, content string, kind string, tags array<string>, importance double, scope string, source string, session string, created_at long, expired_at long, valid_from long, valid_to long, superseded_by long, content_hash string",
    "memories_vec": "id long, embedding array<float>, live boolean",
    "entities": "id long, name string, norm string, type string, homonym int, description string, mention_count long",
    "entity_aliases": "entity_id long, alias string, alias_norm string, origin string",
    "predicates": "id long, canonical string, display string, exclusive boolean, symmetric boolean, seeded boolean, group_id long, inverse_of long",
    "relations": "id long, subj long, src long, predicate_id long, dst long, text string, polarity int, valid_from long, valid_to long, created_at long, expired_at long, evidence_count long, ended_by long",
    "mentions": "memory_id long, entity_id long",
    "relation_evidence": "relation_id long, memory_id long",
    "similar": "a long, b long, score double",
}

# Predicates known from the start: (canonical, display, exclusive, symmetric, group, inverse).
ONTOLOGY = (
    ("live in", "lives in", True, False, "live in", None),
    ("reside in", "resides in", True, False, "live in", None),
    ("base in", "based in", True, False, "live in", None),
    ("work at", "works at", True, False, "work at", None),
    ("work for", "works for", True, False, "work at", None),
    ("employ by", "employed by", True, False, "work at", None),
    ("married to", "married to", True, True, "married to", None),
    ("manage", "manages", False, False, "manage", "report to"),
    ("report to", "reports to", True, False, "manage", "manage"),
    ("parent of", "parent of", False, False, "parent of", "child of"),
    ("child of", "child of", False, False, "parent of", "parent of"),
    ("friend with", "friends with", False, True, "friend with", None),
    ("sibling of", "sibling of", False, True, "sibling of", None),
    ("born in", "born in", False, False, "born in", None),
    ("born on", "born on", False, False, "born on", None),
    ("headquartered in", "headquartered in", True, False, "headquartered in", None),
)


def seed_predicates() -> list[tuple]:
    """Rows of `predicates` for ONTOLOGY, ids from 1 in its order."""
    ids = {row[0]: k for k, row in enumerate(ONTOLOGY, 1)}
    return [(ids[c], c, d, e, s, True, ids[g], ids.get(i)) for c, d, e, s, g, i in ONTOLOGY]


@dataclass(frozen=True)
class Config:
    """Tunable values and their defaults."""

    near_dup: float = 0.97
    sim_edge: float = 0.75
    entity_seed: float = 0.55
    pred_alias: float = 0.80
    entity_conflict: float = 0.73
    w_bm25: float = 1.0
    w_vector: float = 2.0
    w_graph: float = 1.5
    w_temporal: float = 1.0
    w_path: float = 2.5
    w_sempath: float = 0.25
    rrf_k: int = 5
    alpha: float = 0.5
    eps: float = 1e-5
    expired_penalty: float = 0.35
    history_boost: float = 1.5
    mmr_lambda: float = 0.9
    half_life_days: float = 90.0
    bm25_rel: float = 0.0
    fts_prefix_min: int = 4
    mem_seed_share: float = 0.6
    mem_seed_top: int = 20
    fact_entity_boost: float = 1.0
    fact_memory_seed: float = 0.0
    update_candidate: float = 0.75
    window_boost: float = 1.25
    agreement: float = 0.05
    abstain_cosine: float = 0.18
