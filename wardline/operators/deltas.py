"""Changes of policy as deltas: only what a change can touch is decided again.

Two states of the policy tables are compared key by key; decisions that rest on a key that
was added, removed or altered are made again, all others are kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import access
from wardline.operators.skew import salted_join


class Policy(NamedTuple):
    """A state of the policy tables, one row per key; `consent` is the consent in force."""

    users: DataFrame
    agents: DataFrame
    assets: DataFrame
    consent: DataFrame


class Changes(NamedTuple):
    """Keys that differ between two states: ids, and pairs of user and asset."""

    users: DataFrame
    agents: DataFrame
    assets: DataFrame
    consent: DataFrame


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """Keys whose rows were added, removed or altered in `columns`; null keys decide nothing."""
    def side(table: DataFrame, name: str) -> DataFrame:
        return table.dropna(subset=list(keys)).select(
            *keys, F.struct(F.lit(True).alias("_there"), *columns).alias(name))

    both = side(old, "_old").join(side(new, "_new"), list(keys), "full")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys).distinct()


def changes(old: Policy, new: Policy) -> Changes:
    """What differs between two states in a column that decisions read."""
    def of(table: str, key: str, columns: Sequence[str]) -> DataFrame:
        return changed_keys(getattr(old, table), getattr(new, table), [key],
                            [c for c in columns if c != key])

    def granted(consent: DataFrame) -> DataFrame:
        return consent.where("granted").select(F.col("subject_id").alias("user_id"), "asset_id")

    return Changes(of("users", "user_id", access.USER_COLUMNS),
                   of("agents", "agent_id", access.AGENT_COLUMNS),
                   of("assets", "asset_id", access.ASSET_COLUMNS),
                   changed_keys(granted(old.consent), granted(new.consent),
                                ["user_id", "asset_id"], []))


def mark_touched(rows: DataFrame, found: Changes, spread: Sequence[str]) -> DataFrame:
    """Add `touched`: whether a row names a user, agent, asset or consent that changed."""
    marked = rows
    for flag, side, keys in (("_user", found.users, ["user_id"]),
                             ("_agent", found.agents, ["agent_id"]),
                             ("_asset", found.assets, ["asset_id"]),
                             ("_consent", found.consent, ["user_id", "asset_id"])):
        marked = salted_join(marked, side.withColumn(flag, F.lit(True)), keys, spread, base=rows)
    flags = [F.col(f).isNotNull() for f in ("_user", "_agent", "_asset", "_consent")]
    return marked.select(*[F.col(c) for c in rows.columns],
                         (flags[0] | flags[1] | flags[2] | flags[3]).alias("touched"))


def refresh(decisions: DataFrame, old: Policy, new: Policy,
            spread: Sequence[str] = ("request_id",)) -> DataFrame:
    """Decisions of `access.resolve_access` under `old`, brought to what they are under `new`.

    Requests that a change touches are decided again, the rest is kept unread by the policy
    joins. `decisions` is read twice, so pass a stored table.
    """
    marked = mark_touched(decisions, changes(old, new), spread)
    requests = [c for c in decisions.columns if c not in access.DECISION_COLUMNS]
    again = access.resolve_access(marked.where("touched").select(*requests), *new, spread=spread)
    return marked.where("NOT touched").drop("touched").unionByName(again)
