"""The property graph as tables: node keys, relation types and their groups."""

from __future__ import annotations

# Node labels with their key columns.
NODE_KEYS = {
    "Repository": "id", "Module": "id", "Package": "id", "JavaFile": "path", "Type": "qualified_name", "Method": "id", "Field": "id", "Commit": "hash",
}
# Relation type -> (label of src, label of dst).
RELATIONS = {
    "CONTAINS_MODULE": ("Repository", "Module"), "CONTAINS_PACKAGE": ("Module", "Package"), "CONTAINS_SUB": ("Package", "Package"),
    "CONTAINS_FILE": ("Package", "JavaFile"), "IMPORTS": ("JavaFile", "Type"), "DEFINES_TYPE": ("JavaFile", "Type"), "INNER_CLASS_OF": ("Type", "Type"),
    "EXTENDS": ("Type", "Type"), "IMPLEMENTS": ("Type", "Type"), "HAS_FIELD": ("Type", "Field"), "DEPENDS_ON": ("Type", "Type"), "HAS_METHOD": ("Type", "Method"),
    "CALLS": ("Method", "Method"), "READS_FIELD": ("Method", "Field"), "WRITES_FIELD": ("Method", "Field"), "CHANGED_IN": ("Type", "Commit"),
}
# Query facets -> relation types.
GROUPS = {
    "CALL_CHAIN": ("CALLS",), "TYPE_HIERARCHY": ("EXTENDS", "IMPLEMENTS"), "FIELD_ACCESS": ("READS_FIELD", "WRITES_FIELD"), "TYPE_DEPENDS": ("DEPENDS_ON",),
    "IMPORTS": ("IMPORTS",), "STRUCTURE": ("CONTAINS_FILE", "DEFINES_TYPE", "HAS_METHOD", "HAS_FIELD"),
}
DEFAULT_GROUPS = ("CALL_CHAIN", "TYPE_HIERARCHY", "FIELD_ACCESS", "TYPE_DEPENDS")


def relation_types(groups: tuple[str, ...] | None) -> tuple[str, ...]:
    """Relation types of the groups, in order and without repeats; no groups means the default ones."""
    return tuple(dict.fromkeys(t for g in groups or DEFAULT_GROUPS for t in GROUPS[g]))


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def effective_depth(asked: int | None, most: int = 30) -> int:
    """Propagation depth: nothing or nothing positive means the most."""
    return most if asked is None or asked <= 0 else min(asked, most)
