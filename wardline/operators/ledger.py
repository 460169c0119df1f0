"""Token ledger: issue, verification, single use and staleness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.tokens import query_hash
from wardline.operators.access import join_principals
from wardline.operators.eligibility import decide_assets
from wardline.operators.policy import version_as_of
from wardline.operators.skew import salted_join

# Fixed values.
DEFAULT_TTL_SECONDS = 120
PREVIEW_LENGTH = 120

PASSED = "ALLOWED"


def token_id(secret: Column) -> Column:
    """Id of the token of a request, which can't be computed without the secret."""
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat_ws(
        "|", secret, F.col("request_id").cast("string"), "session_id", "user_id", "agent_id"),
        256), 1, 32))


def issue_tokens(requests: DataFrame, users: DataFrame, agents: DataFrame, assets: DataFrame,
                 consent: DataFrame, timeline: DataFrame, secret: Column,
                 ttl_seconds: int = DEFAULT_TTL_SECONDS, **options: int) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of requests whose assets are all allowed, and the rejected requests.

    Requests hold request_id, ts, session_id, user_id, agent_id, asset_ids, access_right
    and query. Filters and masks are kept per asset. Token ids derive from the request and
    from `secret`, so a rerun issues the same tokens and nobody else can name them; take a column
    joined from a table of secrets rather than a literal of the plan.
    """
    stamped = version_as_of(requests, timeline, ["request_id"], name="policy_version", **options)
    joined = join_principals(stamped, users, agents, ["request_id"], requests)
    decided = decide_assets(joined, assets, consent, "asset_ids", ["request_id"], requests)
    item = F.struct("pos", "asset_id", "reason_code", "row_filter", "masked_columns")
    keys = ["request_id", "ts", "session_id", "user_id", "agent_id", "query", "policy_version"]
    grouped = (decided.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("items"))
        .withColumn("denied", F.filter("items", lambda i: i["reason_code"] != PASSED)))

    def per_asset(field: str, keep: Callable[[Column], Column]) -> Column:
        return F.map_from_entries(F.array_distinct(F.transform(
            F.filter("items", lambda i: keep(i[field])),
            lambda i: F.struct(i["asset_id"], i[field]))))

    ledger = grouped.where(F.size("denied") == 0).select(
        "request_id", token_id(secret).alias("token_id"), query_hash(F.col("query")).alias("query_hash"),
        F.substring("query", 1, PREVIEW_LENGTH).alias("query_preview"),
        "user_id", "agent_id", "session_id", "policy_version", F.col("ts").alias("issued_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
        per_asset("row_filter", lambda f: f.isNotNull()).alias("row_filters"),
        per_asset("masked_columns", lambda m: F.size(m) > 0).alias("masked_columns"),
        F.transform("items", lambda i: i["asset_id"]).alias("asset_ids"))
    rejected = grouped.where(F.size("denied") > 0).select(
        "request_id", "user_id", "agent_id",
        F.col("denied")[0]["asset_id"].alias("asset_id"),
        F.col("denied")[0]["reason_code"].alias("reason_code"))
    return ledger, rejected


def with_revocations(ledger: DataFrame, revocations: DataFrame) -> DataFrame:
    """Add when each token and its session were first revoked."""
    first = revocations.groupBy("kind", "id").agg(F.min("ts").alias("at"))
    tokens = first.where("kind = 'token'").select(
        F.col("id").alias("token_id"), F.col("at").alias("token_revoked_at"))
    sessions = first.where("kind = 'session'").select(
        F.col("id").alias("session_id"), F.col("at").alias("session_revoked_at"))
    return salted_join(ledger.join(tokens, "token_id", "left"), sessions, ["session_id"],
                       ["token_id"], base=ledger)


def check_code(require_token: bool = True) -> Column:
    """Verdict on a call joined to its ledger row, before the test for single use."""
    ungoverned = "UNGOVERNED" if require_token else "ALLOWED_UNGOVERNED"
    ts = F.col("ts")
    return (
        F.when(F.coalesce(F.col("token_id"), F.lit("")) == "", ungoverned)
        .when(F.col("query_hash").isNull() | F.col("expires_at").isNull()
              | F.col("issued_at").isNull(), "TOKEN_UNKNOWN")
        .when(ts >= F.col("expires_at"), "TOKEN_EXPIRED")
        .when(ts < F.col("issued_at"), "TOKEN_NOT_YET_VALID")
        .when(F.col("token_revoked_at") <= ts, "TOKEN_REVOKED")
        .when(F.col("session_revoked_at") <= ts, "SESSION_REVOKED")
        .when(F.coalesce(F.col("agent_id") != F.col("token_agent_id"), F.lit(True)),
              "WRONG_AGENT")
        .when(F.coalesce(F.col("call_hash") != F.col("query_hash"), F.lit(True)),
              "QUERY_MISMATCH")
        .when(ts.isNotNull(), PASSED).otherwise("TOKEN_UNKNOWN"))


def check_calls(calls: DataFrame, ledger: DataFrame, revocations: DataFrame,
                require_token: bool = True) -> DataFrame:
    """Verify calls against the ledger; adds `check`, the ledger version and its filters."""
    side = with_revocations(ledger, revocations).select(
        "token_id", "query_hash", F.col("agent_id").alias("token_agent_id"), "issued_at",
        "expires_at", "policy_version", "row_filters", "masked_columns", "token_revoked_at",
        "session_revoked_at")
    joined = salted_join(calls.withColumn("call_hash", query_hash(F.col("query"))), side,
                         ["token_id"], ["call_id"], base=calls)
    return joined.select(*calls.columns, check_code(require_token).alias("check"),
                         "policy_version", "row_filters", "masked_columns")


def bucketed(table: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """The table stored in buckets of its token ids, so that tables so stored meet unshuffled."""
    spread = table.repartition(buckets, "token_id")
    (spread.write.mode("overwrite").option("path", path).bucketBy(buckets, "token_id")
     .sortBy("token_id").saveAsTable(name))
    return table.sparkSession.table(name)


def check_bucketed(calls: DataFrame, ledger: DataFrame, require_token: bool = True) -> DataFrame:
    """`check` for calls and a ledger `with_revocations`, both `bucketed` alike.

    Neither side is shuffled or broadcast. Calls of one token share a bucket: where a token
    holds a large part of all calls, use `check_calls`.
    """
    side = ledger.select(
        F.col("token_id").alias("ledger_token"), "query_hash",
        F.col("agent_id").alias("token_agent_id"), "issued_at", "expires_at",
        "token_revoked_at", "session_revoked_at").hint("merge")
    joined = calls.withColumn("call_hash", query_hash(F.col("query"))).join(
        side, F.col("token_id") == F.col("ledger_token"), "left")
    return joined.select(*calls.columns, check_code(require_token).alias("check"))


def first_uses(checked: DataFrame) -> DataFrame:
    """The call that uses up each token: the first that passes, by time and id.

    One combined row per token and task is shuffled, however often a token is called.
    """
    return (checked.where(F.col("check") == PASSED).groupBy("token_id")
            .agg(F.min(F.struct("ts", "call_id")).alias("first"))
            .select("token_id", F.col("first.call_id").alias("call_id"),
                    F.col("first.ts").alias("ts")))


def judge_calls(checked: DataFrame) -> DataFrame:
    """Add `verdict`: a passing call after the first on its token is a replay.

    First uses are joined back on the call id, which is unique and so never skewed.
    """
    first = first_uses(checked).select("call_id", F.lit(True).alias("_first"))
    verdict = F.when((F.col("check") == PASSED) & F.col("_first").isNull(), "REPLAYED"
                     ).otherwise(F.col("check"))
    return (checked.join(first, "call_id", "left").withColumn("verdict", verdict)
            .drop("_first", "check"))


def call_results(judged: DataFrame) -> DataFrame:
    """Result record of each call: success, error code, filters applied, governed flag."""
    passed = F.col("verdict") == PASSED
    governed = ~F.col("verdict").isin("UNGOVERNED", "ALLOWED_UNGOVERNED")
    return judged.select(
        "call_id", (passed | (F.col("verdict") == "ALLOWED_UNGOVERNED")).alias("success"),
        F.when(~passed & (F.col("verdict") != "ALLOWED_UNGOVERNED"), F.col("verdict"))
        .alias("error"),
        F.when(passed, F.col("row_filters")).alias("filters_applied"),
        F.when(passed, F.col("masked_columns")).alias("masked_columns"),
        F.when(passed, F.col("token_id")).alias("token_id"), governed.alias("governed"))


def mark_stale(checked: DataFrame, timeline: DataFrame, calls: DataFrame,
               **options: int) -> DataFrame:
    """Add `policy_stale` to calls with a ledger row: the policy changed since the issue.

    `calls` is the table that was checked; the sizes of its time buckets are read from it.
    """
    now = version_as_of(checked, timeline, ["call_id"], base=calls, **options)
    return now.withColumn("policy_stale", F.when(
        F.col("policy_version").isNotNull(),
        F.col("policy_version") != F.col("version_in_force")))
