"""Eligibility of agents for a session and a list of assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.operators.access import decide, join_assets, join_principals

_AGENT_PART = ("agent_known", "ceiling_rank", "allowed_rights", "allowed_sources")


def decide_assets(requests: DataFrame, assets: DataFrame, consent: DataFrame, wanted: str,
                  spread: Sequence[str], base: DataFrame) -> DataFrame:
    """One decided row per request and asset of the array `wanted`, with its position.

    A request with an empty array keeps one row without an asset. `base` holds user_id and asset_ids of the
    requests.
    """
    exploded = requests.select("*", F.posexplode_outer(wanted).alias("pos", "asset_id"))
    named = base.select("user_id", F.explode("asset_ids").alias("asset_id"))
    return decide(join_assets(exploded, assets, consent, [*spread, "pos"], named))


def _summarise(decided: DataFrame, columns: Sequence[str]) -> DataFrame:
    item = F.struct("pos", "asset_id", "reason_code", "row_filter", "allowed")
    items = F.collect_list(F.when(F.col("pos").isNotNull(), item))
    grouped = (decided.groupBy(*columns, "early_code")
               .agg(F.array_sort(items).alias("items")))
    allowed = F.filter("items", lambda i: i["allowed"])
    denied = F.filter("items", lambda i: ~i["allowed"])
    filtered = F.array_distinct(F.transform(
        F.filter(allowed, lambda i: i["row_filter"].isNotNull()),
        lambda i: F.struct(i["asset_id"], i["row_filter"])))
    outcome = (F.when(F.col("early_code").isNotNull(), F.col("early_code"))
               .when((F.size(denied) > 0) & (F.size(allowed) == 0), "ALL_DENIED")
               .when(F.size(denied) > 0, "PARTIAL").otherwise("ALL_PASSED"))
    status = (F.when(F.col("outcome") == "AGENT_NOT_REGISTERED", "blocked")
              .when(F.col("outcome").isin("ALL_PASSED", "PARTIAL"), "eligible")
              .otherwise("ineligible"))
    return (grouped.withColumn("outcome", outcome).withColumn("status", status)
            .select(*columns, "status", "outcome",
                    F.transform(denied, lambda i: F.concat_ws(
                        ":", i["asset_id"], i["reason_code"])).alias("reason_codes"),
                    F.transform(allowed, lambda i: i["asset_id"]).alias("allowed_asset_ids"),
                    F.map_from_entries(filtered).alias("applied_filters")))


def check_eligibility(requests: DataFrame, users: DataFrame, agents: DataFrame,
                      assets: DataFrame, consent: DataFrame,
                      request_id: str = "request_id") -> DataFrame:
    """Decide each request of a user, an agent, `asset_ids` and `access_right`.

    No asset is looked at when the agent is unknown or ranks above its user. The arrays
    are rebuilt per request, so a group holds no more than one request's own list.
    """
    early = (F.when(~F.col("agent_known"), "AGENT_NOT_REGISTERED")
             .when(~F.col("user_known"), "USER_UNKNOWN")
             .when(~F.coalesce(F.col("clearance_rank") >= F.col("ceiling_rank"), F.lit(False)),
                   "USER_BELOW_AGENT"))
    joined = (join_principals(requests, users, agents, [request_id])
              .withColumn("early_code", early)
              .withColumn("_wanted", F.when(F.col("early_code").isNull(), F.col("asset_ids"))))
    decided = decide_assets(joined, assets, consent, "_wanted", [request_id], requests)
    return _summarise(decided, [request_id, "user_id", "agent_id"])


def gate(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split decisions into those that may run and those that may not."""
    return decisions.where("status = 'eligible'"), decisions.where("status <> 'eligible'")


def eligible_agents(sessions: DataFrame, users: DataFrame, agents: DataFrame, assets: DataFrame,
                    consent: DataFrame, session_id: str = "session_id") -> DataFrame:
    """Eligible agents of each session, out of all registered ones.

    Each session names the levels up to its user's clearance, at most one per level, and
    meets the agents with such a ceiling, so sessions never meet agents they cannot use.
    """
    none = agents.limit(0)
    joined = join_principals(sessions.withColumn("agent_id", F.lit(None).cast("string")),
                             users, none, [session_id], sessions).drop("agent_id", *_AGENT_PART)
    levels = F.sequence(F.lit(0), F.least("clearance_rank", F.lit(L.SECRET)))
    reached = joined.withColumn("_level", F.explode(F.when(F.col("clearance_rank") >= 0, levels)))
    rows = (reached.join(agents.select("agent_id", *_AGENT_PART[1:]),
                         F.col("_level") == F.col("ceiling_rank"))
            .withColumn("agent_known", F.lit(True)).drop("_level")
            .withColumn("early_code", F.lit(None).cast("string")))
    decided = decide_assets(rows, assets, consent, "asset_ids", [session_id, "agent_id"],
                            sessions)
    return _summarise(decided, [session_id, "user_id", "agent_id"]).where("status = 'eligible'")
