"""Fixed tables: entity types, edge types, declared fields. They are small and never grow with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The data model's names.
NAMESPACES = ("doi", "arxiv", "s2", "url", "openalex")
EXEMPT_GLOBS = ("foundations/**", "outputs/**", "reflections/**", "*://*")
EDGE_CONFIDENCE = ("high", "medium", "low")
ENTITY_TYPES = {
    "core": ("sources", "concepts", "people", "summary", "outputs", "graph", "readings"),
    "research": ("foundations", "topics"),
    "reading": ("chapters", "characters", "themes", "plot"),
    "learning": ("reflections",),
}

# Pairs of edge types that are each other's reverse: (from, to, pack, name, reverse).
TWO_WAY = (
    ("sources", "sources", "core", "cites", "cited_by"),
    ("sources", "sources", "core", "builds_on", "built_upon_by"),
    ("sources", "sources", "core", "improves_on", "improved_by"),
    ("sources", "sources", "core", "challenges", "challenged_by"),
    ("sources", "sources", "core", "surveys", "surveyed_by"),
    ("sources", "concepts", "core", "introduces_concept", "introduced_in"),
    ("sources", "concepts", "core", "uses_concept", "used_in"),
    ("sources", "concepts", "core", "extends_concept", "extended_in"),
    ("sources", "concepts", "core", "critiques_concept", "critiqued_in"),
    ("sources", "people", "core", "authored_by", "authored"),
    ("readings", "sources", "core", "annotates", "annotated_by"),
    ("concepts", "concepts", "core", "part_of", "has_part"),
    ("topics", "sources", "research", "includes_source", "included_in_topic"),
    ("topics", "concepts", "research", "covers_concept", "covered_by_topic"),
    ("themes", "characters", "reading", "associated_with", "expresses_theme"),
)
# Edge types stored once with sorted ends: (both ends, pack, name).
SYMMETRIC = (
    ("sources", "core", "same_problem_as"), ("sources", "core", "similar_method_to"), ("sources", "core", "complementary_to"),
    ("sources", "core", "compares_against"), ("concepts", "core", "related_to"), ("characters", "reading", "appears_with"),
)
# Others: (from, to, pack, name, reverse, terminal).
ONE_WAY = (
    ("*", "foundations", "research", "grounded_in", None, True),
    ("*", "outputs", "core", "produced", None, True),
    ("*", "*", "core", "see_also_url", None, True),
    ("chapters", "characters", "reading", "features", "appears_in", False),
    ("*", "chapters", "reading", "appears_in", None, False),
    ("chapters", "themes", "reading", "tagged_with", "appears_in", False),
)

# Declared fields, first those that every type has: (key, type, required, allowed values of an enum).
BASE_FIELDS = (
    ("id", "string", True, None),
    ("title", "string", True, None),
    ("type", "string", True, None),
    ("created", "iso-date", True, None),
    ("updated", "iso-date", True, None),
)
FIELDS = {
    "sources": (
        ("authors", "array", True, None),
        ("year", "number", True, None),
        ("importance", "enum", True, ("1", "2", "3", "4", "5")),
        ("urls", "array", False, None),
        ("raw_paths", "array", False, None),
        ("provenance", "enum", True, ("replayable", "partial", "missing")),
        ("confidence", "enum", False, ("high", "medium", "low", "unverified")),
        ("ingest_status", "enum", False, ("drafted", "linted", "verified", "finalized")),
        ("verify_status", "enum", False, ("passed", "findings_pending", "drift_detected", "skipped", "not_applicable")),
        ("findings", "array", False, None),
        ("external_ids", "object", False, None),
        ("sources", "array", False, None),
        ("ranking", "object", False, None),
    ),
    "concepts": (
        ("key_sources", "array", True, None),
        ("related_concepts", "array", True, None),
        ("confidence", "enum", False, ("high", "medium", "low", "unverified")),
    ),
    "people": (
        ("key_sources", "array", True, None),
        ("affiliations", "array", False, None),
    ),
    "summary": (
        ("covers", "array", True, None),
    ),
    "readings": (
        ("source", "string", True, None),
        ("part", "number", True, None),
        ("pages", "string", False, None),
    ),
    "foundations": (
        ("aliases", "array", False, None),
    ),
    "topics": (
        ("key_sources", "array", True, None),
    ),
    "chapters": (
        ("book", "string", True, None),
        ("number", "number", True, None),
    ),
    "characters": (
        ("book", "string", True, None),
        ("first_seen", "string", False, None),
    ),
    "themes": (
        ("book", "string", True, None),
    ),
    "plot": (
        ("book", "string", True, None),
        ("up_to_chapter", "number", True, None),
    ),
    "reflections": (
        ("related_concepts", "array", True, None),
        ("related_sources", "array", True, None),
        ("evolution_count", "number", True, None),
    ),
}
ENUM_DEFAULTS = (("sources", "provenance", "missing"), ("sources", "confidence", "unverified"), ("concepts", "confidence", "unverified"))
LEGACY_KEYS = (("slug", "id"), ("date_added", "created"), ("url", "urls"))


def edge_type_rows() -> list[tuple]:
    """(name, from_type, to_type, reverse, symmetric, terminal, pack)."""
    out = []
    for a, b, pack, name, reverse in TWO_WAY:
        out += [(name, a, b, reverse, False, False, pack), (reverse, b, a, name, False, False, pack)]
    out += [(name, end, end, name, True, False, pack) for end, pack, name in SYMMETRIC]
    out += [(name, a, b, reverse, False, terminal, pack) for a, b, pack, name, reverse, terminal in ONE_WAY]
    return out


def field_rows() -> list[tuple]:
    """(entity_type, key, field_type, required, allowed)."""
    return [(kind, key, of, required, list(allowed) if allowed else None) for kind, own in FIELDS.items() for key, of, required, allowed in (*BASE_FIELDS, *own)]


def edge_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_type_rows(), "name string, from_type string, to_type string, reverse string, symmetric boolean, terminal boolean, pack string")


def field_defs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(field_rows(), "entity_type string, key string, field_type string, required boolean, allowed array<string>")


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, t + "/", pack) for pack, types in ENTITY_TYPES.items() for t in types], "entity_type string, dir string, pack string")


def enum_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENUM_DEFAULTS), "entity_type string, key string, value string")


def sql_values(rows: list[tuple]) -> str:
    """Rows as the text of a VALUES list, for the comparison SQL."""

    def one(v) -> str:
        if v is None:
            return "null"
        return str(v).lower() if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
