"""Deterministic identifiers as Spark SQL expressions."""

from __future__ import annotations


def content_hash(x: str) -> str:
    return f"sha2({x}, 256)"


def short_hash(x: str) -> str:
    return f"substring(sha2({x}, 256), 1, 16)"


def query_hash(x: str) -> str:
    return f"substring(md5({x}), 1, 16)"


def chunk_id(doc: str, clause: str) -> str:
    return f"concat({doc}, ':', {clause})"


def document_uid(doc: str) -> str:
    return f"concat('document:', {doc})"


def clause_uid(doc: str, clause: str) -> str:
    return f"concat('clause:', {doc}, ':', {clause})"


def requirement_uid(doc: str, clause: str, text: str) -> str:
    return f"concat('requirement:', {doc}, ':', {clause}, ':', substring(md5({text}), 1, 8))"


def requirement_uid_by_index(doc: str, clause: str, idx: str) -> str:
    return f"concat('requirement:', {doc}, ':', {clause}, ':', {idx})"


def table_uid(doc: str, clause: str, number: str) -> str:
    return f"concat('table:', {doc}, ':', {clause}, ':', {number})"


def figure_uid(doc: str, clause: str, number: str) -> str:
    return f"concat('figure:', {doc}, ':', {clause}, ':', {number})"


def normalized_standard(name: str) -> str:
    return f"translate(upper({name}), ' -', '')"


def standard_uid(name: str) -> str:
    return f"concat('standard:', replace({normalized_standard(name)}, '/', '_'))"


def clause_of_chunk(chunk: str) -> str:
    """The text after the first colon, or all of it when there is none."""
    return f"CASE WHEN contains({chunk}, ':') THEN substring({chunk}, instr({chunk}, ':') + 1) ELSE {chunk} END"
