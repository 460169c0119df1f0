"""Identity claims to users, service principals, entitlements and sessions.

Claims come from an upstream that has verified their signature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.functions.patterns import BLANK
from wardline.operators.access import empty_if_null
from wardline.operators.skew import salted_join

# Levels of the usual application roles.
ROLE_LEVELS = {
    "DataReader": "internal",
    "DataAnalyst": "confidential",
    "DataSteward": "confidential",
    "DataAdmin": "restricted",
}


def claim_view(claims: DataFrame) -> DataFrame:
    """Claims with their defaults: alternative names, empty lists and split scopes."""
    def text(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names], F.lit(""))

    scopes = F.filter(F.split(text("scp"), rf"(?U){BLANK}+"), lambda s: s != "")
    oid_absent = F.col("oid").isNull()
    return (claims
            .withColumn("is_app_only", oid_absent | F.coalesce(F.col("idtyp") == "app",
                                                               F.lit(False)))
            .withColumn("upn", text("upn", "preferred_username"))
            .withColumn("app_id", text("azp", "appid"))
            .withColumn("scopes", scopes)
            .withColumn("groups", empty_if_null(F.col("groups")))
            .withColumn("roles", empty_if_null(F.col("roles")))
            .withColumn("overage", F.coalesce("overage", F.lit(False)))
            .withColumn("user_id", F.coalesce(F.nullif("oid", F.lit("")),
                                              F.nullif("sub", F.lit("")))))


def claim_reason(now: Column, audience: str, tenant: str | None = None,
                 issuer: str | None = None, skew_seconds: int = 0) -> Column:
    """Reason to refuse a claim record, null when it is sound.

    Required claims, tenant and issuer are only checked where a tenant is given.
    """
    checks = [(F.coalesce(F.col("exp") <= now - skew_seconds, F.lit(False)), "CLAIM_EXPIRED")]
    if tenant is not None:
        missing = (F.col("exp").isNull() | F.col("iat").isNull() | F.col("iss").isNull()
                   | F.col("aud").isNull())
        checks.insert(0, (missing, "CLAIM_MISSING"))
    checks.append((F.coalesce(F.col("iat") > now + skew_seconds, F.lit(False)),
                   "CLAIM_NOT_YET_VALID"))
    checks.append((F.coalesce(F.col("aud") != audience, F.lit(True)), "AUDIENCE_MISMATCH"))
    if issuer is not None:
        checks.append((F.coalesce(F.col("iss") != issuer, F.lit(True)), "ISSUER_MISMATCH"))
    if tenant is not None:
        checks.append((F.coalesce(F.col("tid") != tenant, F.lit(True)), "TENANT_MISMATCH"))
    reason = F.lit(None).cast("string")
    for bad, code in reversed(checks):
        reason = F.when(bad, code).otherwise(reason)
    return reason


def check_claims(viewed: DataFrame, now: Column, audience: str, tenant: str | None = None,
                 issuer: str | None = None, skew_seconds: int = 0) -> DataFrame:
    """Add `reason_code`: why no user context can be made, or USER."""
    return viewed.withColumn("reason_code", F.coalesce(
        claim_reason(now, audience, tenant, issuer, skew_seconds),
        F.when(F.col("is_app_only"), "APP_ONLY").when(F.col("user_id").isNull(), "NO_IDENTITY")
        .when(~L.is_safe_identifier(F.col("user_id")), "UNSAFE_IDENTIFIER").otherwise("USER")))


def _literal_map(mapping: Mapping[str, Column]) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), v)])


def brand_scope(groups: Column, overage: Column, group_brands: Mapping[str, Sequence[str]],
                override: Column | None = None) -> Column:
    """Brands of the user's groups, sorted; none when the group list is incomplete.

    An override can narrow the scope but never widen it.
    """
    if group_brands:
        table = _literal_map({g: F.array(*[F.lit(b) for b in bs]).cast("array<string>")
                              for g, bs in group_brands.items()})
        brands = F.flatten(F.transform(groups, lambda g: empty_if_null(F.element_at(table, g))))
    else:
        brands = F.array().cast("array<string>")
    scope = F.when(overage, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(brands)))
    if override is None:
        return scope
    return F.when(override.isNull(), scope).otherwise(F.array_intersect(scope, override))


def clearance(roles: Column, role_levels: Mapping[str, str] = ROLE_LEVELS) -> Column:
    """Highest rank over the user's roles, at least INTERNAL; unknown levels do not count."""
    ranks = {r: F.lit(L.SENSITIVITY_LEVELS.index(v)) for r, v in role_levels.items()
             if v in L.SENSITIVITY_LEVELS}
    floor = F.lit(L.INTERNAL)
    if not ranks:
        return floor
    table = _literal_map(ranks)
    best = F.array_max(F.transform(roles, lambda r: F.element_at(table, r)))
    return F.greatest(floor, best)


def user_contexts(checked: DataFrame, group_brands: Mapping[str, Sequence[str]],
                  role_levels: Mapping[str, str] = ROLE_LEVELS,
                  override: Column | None = None) -> DataFrame:
    """User rows with entitlements. The maps are configuration, so nothing is shuffled."""
    return checked.where("reason_code = 'USER'").select(
        "claim_id", "user_id", "roles",
        brand_scope(F.col("groups"), F.col("overage"), group_brands, override)
        .alias("brand_scope"),
        clearance(F.col("roles"), role_levels).alias("clearance_rank"),
        F.create_map(
            F.lit("upn"), F.col("upn"), F.lit("name"), F.coalesce("name", F.lit("")),
            F.lit("tenant_id"), F.coalesce("tid", F.lit("")), F.lit("app_id"), F.col("app_id"),
            F.lit("groups"), F.array_join("groups", ","), F.lit("source"), F.lit("entra_id"))
        .alias("metadata"))


def user_contexts_from_tables(checked: DataFrame, group_brands: DataFrame, role_levels: DataFrame,
                              override: Column | None = None) -> DataFrame:
    """`user_contexts` with groups and roles as tables of any size, joined instead of looked up.

    `group_brands` has group_name and brand, `role_levels` role and level, each a row per pair.
    Names of all claims meet the tables at once; `claim_id` tells the claims apart.
    """
    rank = F.array_position(F.array(*[F.lit(v) for v in L.SENSITIVITY_LEVELS]), F.col("level"))
    names = group_brands.select(F.concat(F.lit("g:"), "group_name").alias("name"), "brand",
                                F.lit(None).cast("int").alias("rank")).unionByName(
        role_levels.where(rank > 0).select(F.concat(F.lit("r:"), "role").alias("name"),
                                           F.lit(None).cast("string").alias("brand"),
                                           (rank - 1).cast("int").alias("rank")))
    users = checked.where("reason_code = 'USER'")

    def tagged(names: Column, tag: str) -> Column:
        return F.transform(names, lambda n: F.concat(F.lit(tag), n))

    # An incomplete list of groups gives no brands, so its names need not travel.
    groups = F.when(F.col("overage"), F.array().cast("array<string>")).otherwise(F.col("groups"))
    held = users.select("claim_id", F.explode(F.array_distinct(F.concat(
        tagged(groups, "g:"), tagged(F.col("roles"), "r:")))).alias("name"))
    found = salted_join(held, names, ["name"], ["claim_id"], "inner").groupBy("claim_id").agg(
        F.array_sort(F.collect_set("brand")).alias("brand_scope"), F.max("rank").alias("_rank"))
    none = F.array().cast("array<string>")
    scope = F.coalesce("brand_scope", none)
    if override is not None:
        scope = F.when(override.isNull(), scope).otherwise(F.array_intersect(scope, override))
    plain = user_contexts(checked, {}, {}).drop("brand_scope", "clearance_rank")
    return plain.join(found, "claim_id", "left").select(
        "claim_id", "user_id", "roles", scope.alias("brand_scope"),
        F.greatest(F.lit(L.INTERNAL), F.col("_rank")).alias("clearance_rank"), "metadata")


def agent_principals(checked: DataFrame) -> DataFrame:
    """Service principals from the claims that carry no user."""
    return checked.where("reason_code = 'APP_ONLY'").select(
        "claim_id", F.coalesce("oid", F.lit("")).alias("service_principal_oid"), "app_id",
        F.coalesce("tid", F.lit("")).alias("tenant_id"), "roles",
        F.lit("entra_id_managed_identity").alias("source"))


def degrade_on_behalf_of(users: DataFrame) -> DataFrame:
    """Users as a delegated call sees them: no roles, no scope, lowest clearance.

    What was lost is kept in the metadata, as it was before the delegation.
    """
    nothing = F.array().cast("array<string>")
    lost = F.create_map(
        F.lit("obo_degraded"), F.lit("true"),
        F.lit("original_clearance"), L.rank_to_name(F.col("clearance_rank")),
        F.lit("original_brand_scope"), F.array_join("brand_scope", ","))
    return (users.withColumn("metadata", F.map_concat("metadata", lost))
            .withColumn("roles", nothing).withColumn("brand_scope", nothing)
            .withColumn("clearance_rank", F.lit(L.INTERNAL)))


def _session_id() -> Column:
    return F.concat(F.lit("ses_"), F.substring(F.sha2(F.concat_ws(
        "|", F.col("request_id").cast("string"), F.col("claim_id").cast("string")), 256), 1, 32))


def sessions(requests: DataFrame, users: DataFrame) -> DataFrame:
    """One session per authenticated request of a known claim record.

    `requests` has request_id, claim_id, ts and request_intent; a request is made with
    one claim record.
    """
    joined = salted_join(requests, users, ["claim_id"], ["request_id"], "inner")
    return joined.select(
        _session_id().alias("session_id"), "request_id", "user_id", "brand_scope",
        "clearance_rank", "request_intent", F.col("ts").alias("created_at"),
        F.create_map(F.lit("auth_source"), F.lit("entra_id"),
                     F.lit("upn"), F.element_at("metadata", F.lit("upn")),
                     F.lit("app_id"), F.element_at("metadata", F.lit("app_id")))
        .alias("metadata"))


def on_behalf_sessions(requests: DataFrame, users: DataFrame, originals: DataFrame) -> DataFrame:
    """Sessions of delegated calls: degraded, with what the original session had.

    `requests` has request_id, claim_id, ts, request_intent and original_session_id, which
    may be null or unknown. What was lost is taken from the original session, since the
    delegated claims no longer hold it.
    """
    before = originals.select(
        F.col("session_id").alias("original_session_id"),
        F.col("user_id").alias("original_user_id"), F.col("brand_scope").alias("original_scope"),
        F.col("clearance_rank").alias("original_rank"))
    known = salted_join(requests, users.select("claim_id", "user_id"), ["claim_id"],
                        ["request_id"], "inner")
    joined = salted_join(known, before, ["original_session_id"], ["request_id"], base=requests)
    return joined.select(
        _session_id().alias("session_id"), "request_id", "user_id",
        F.array().cast("array<string>").alias("brand_scope"),
        F.lit(L.INTERNAL).alias("clearance_rank"), "request_intent",
        F.col("ts").alias("created_at"),
        F.map_filter(F.create_map(
            F.lit("auth_source"), F.lit("entra_id_obo"), F.lit("obo_degraded"), F.lit("true"),
            F.lit("original_session_id"), F.when(
                F.col("original_user_id").isNotNull(), F.col("original_session_id")),
            F.lit("original_user_id"), F.col("original_user_id"),
            F.lit("original_clearance"), L.rank_to_name(F.col("original_rank")),
            F.lit("original_brand_scope"), F.array_join("original_scope", ",")),
            lambda k, v: v.isNotNull()).alias("metadata"))
