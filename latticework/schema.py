"""Logical schemas and controlled vocabularies of the node store."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


S, STRINGS = StringType(), ArrayType(StringType())

NODES = _struct(
    node_type=S, slug=S, display_label=S, aliases=STRINGS, description=S, note=S, categories=STRINGS,
    anchor_id=S, created_at=S, merged_from=STRINGS, redirect_to=S, user_notes=S,
)
MENTIONS = _struct(node_type=S, node_slug=S, ord=IntegerType(), paper_slug=S, paper_title=S, concept_slug=S)
RELATIONS = _struct(from_type=S, from_slug=S, rel_type=S, to_type=S, to_slug=S, rationale=S, sources=STRINGS)
PAPERS = _struct(slug=S, title=S, authors=S, tags=STRINGS, body=S, text_hash=S)
FOLDERS = _struct(id=S, name=S, paper_slugs=STRINGS, brain_id=S, created_at=S)
BRAINS = _struct(id=S, name=S, paper_slugs=STRINGS, created_at=S)
CANDIDATES = _struct(type=S, slug_a=S, slug_b=S, via_alias=S, detected_in_paper=S, detected_at=S, status=S, rejected_at=S, merged_at=S)
RELATION_TYPES = _struct(rel_type=S, symmetric=BooleanType(), description=S)
VECTORS = _struct(node_type=S, node_slug=S, embedding=ArrayType(FloatType()))

_CONCEPT = _struct(id=S, label=S, categories=STRINGS, aliases=STRINGS, description=S, note=S)
_ENTITY = _struct(id=S, label=S, concept_id=S, aliases=STRINGS, description=S, note=S)
_RELATION = _struct(from_id=S, from_type=S, to_id=S, to_type=S, type=S, rationale=S)
EXTRACTION = _struct(
    paper_slug=S, title=S, authors=S, tags=STRINGS, concepts=ArrayType(_CONCEPT), entities=ArrayType(_ENTITY), relationships=ArrayType(_RELATION)
)

# Relation types with their symmetry, concept categories, image extensions.
RELATION_TYPE_SYMMETRY = {
    "PART_OF": False,
    "IS_A": False,
    "USES": False,
    "EXTENDS": False,
    "IMPROVES_ON": False,
    "OUTPERFORMS": False,
    "SOLVES": False,
    "EVALUATED_ON": False,
    "LIMITED_BY": False,
    "COMPARED_TO": True,
    "CONTRADICTS": True,
    "RELATED": True,
}
CONCEPT_CATEGORIES = (
    "problem", "proposed_method", "architecture", "algorithm", "theory", "optimization", "training_strategy",
    "evaluation_setup", "finding", "input_representation", "limitation", "other",
)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp")
