"""Hashes and keys of queries, tokens and cached results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.patterns import BLANK


def strip_blanks(text: Column) -> Column:
    """Text without blanks at either end."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def canonical_query(query: Column) -> Column:
    """Query with outer blanks removed and blank runs collapsed; letter case is kept."""
    return F.regexp_replace(strip_blanks(query), rf"(?U){BLANK}+", " ")


def query_hash(query: Column) -> Column:
    """Hash of the canonical query, as stored in the token ledger."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_query(query), 256))


def cache_key(version: Column, user_id: Column, agent_id: Column, query: Column) -> Column:
    """Key of a cached result, scoped by policy version and identity.

    The query is only stripped of outer blanks, unlike in the token hash.
    """
    identity = F.concat_ws(":", user_id, agent_id)
    return F.concat_ws(
        ":", F.lit("governed"), F.substring(version, 1, 16),
        F.substring(F.sha2(identity, 256), 1, 16),
        F.substring(F.sha2(strip_blanks(query), 256), 1, 24))
