"""Access decisions, row filters and column masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.operators.skew import find_hot, salted_join, split_join

ALLOWED = "ALLOWED"

USER_COLUMNS = ("user_id", "clearance_rank", "brand_scope")
AGENT_COLUMNS = ("agent_id", "ceiling_rank", "allowed_rights", "allowed_sources")
ASSET_COLUMNS = ("asset_id", "source", "sensitivity_rank", "brand_tags", "brand_column",
                 "row_filter_template", "pii_columns", "consent_required")


def empty_if_null(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def at_most(rank: str, limit: str) -> Column:
    """Rank comparison that fails on a null."""
    return F.coalesce(F.col(rank) <= F.col(limit), F.lit(False))


def reason_code() -> Column:
    """Reason of the first failing check, over a request joined to its policy rows.

    Ends in a denial: a comparison with a null never allows.
    """
    tags, scope = empty_if_null(F.col("brand_tags")), empty_if_null(F.col("brand_scope"))
    sources = empty_if_null(F.col("allowed_sources"))
    open_source = (F.size(sources) == 0) | F.array_contains(sources, F.col("asset_source"))
    consent = ~F.col("consent_required") | F.coalesce(F.col("consented"), F.lit(False))
    return (
        F.when(~F.col("asset_known"), "ASSET_NOT_FOUND")
        .when(~F.col("agent_known"), "AGENT_UNKNOWN")
        .when(~F.col("user_known"), "USER_UNKNOWN")
        .when(~at_most("sensitivity_rank", "ceiling_rank"), "AGENT_CEILING")
        .when(~at_most("sensitivity_rank", "clearance_rank"), "USER_CLEARANCE")
        .when(~F.coalesce(F.array_contains(F.col("allowed_rights"), F.col("access_right")),
                          F.lit(False)), "RIGHT_NOT_ALLOWED")
        .when((F.size(tags) > 0) & (F.size(scope) == 0), "BRAND_SCOPE_EMPTY")
        .when((F.size(tags) > 0) & ~F.arrays_overlap(tags, scope), "BRAND_SCOPE_MISMATCH")
        .when(~open_source, "SOURCE_NOT_ALLOWED")
        .when(~consent, "CONSENT_BLOCKED")
        .when(open_source & consent, ALLOWED)
        .otherwise("POLICY_INCOMPLETE"))


def join_principals(requests: DataFrame, users: DataFrame, agents: DataFrame,
                    spread: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """Join requests to user and agent; `base` is the stored table behind the requests.

    Agents are a short configured list that Spark broadcasts by its size. Users may be
    many, and one user may make a large share of the requests.
    """
    user_side = users.select(*USER_COLUMNS).withColumn("user_known", F.lit(True))
    agent_side = agents.select(*AGENT_COLUMNS).withColumn("agent_known", F.lit(True))
    joined = requests.join(agent_side, "agent_id", "left")
    return (salted_join(joined, user_side, ["user_id"], spread,
                        base=requests if base is None else base)
            .fillna(False, ["user_known", "agent_known"]))


def join_assets(requests: DataFrame, assets: DataFrame, consent: DataFrame,
                spread: Sequence[str], base: DataFrame) -> DataFrame:
    """Join requests to their asset and to the consent in force of the user."""
    asset_side = assets.select(*ASSET_COLUMNS).withColumnRenamed(
        "source", "asset_source").withColumn("asset_known", F.lit(True))
    granted = consent.where("granted").select(
        F.col("subject_id").alias("user_id"), "asset_id", F.lit(True).alias("consented"))
    hot = find_hot(base, ["asset_id"])
    joined = split_join(requests, asset_side, ["asset_id"], spread, "left", hot)
    # A pair can only be hot where its asset is.
    hot_pairs = None if hot is None else find_hot(base, ["user_id", "asset_id"])
    joined = split_join(joined, granted, ["user_id", "asset_id"], spread, "left", hot_pairs)
    return joined.fillna(False, ["asset_known", "consented"])


def resolve_access(requests: DataFrame, users: DataFrame, agents: DataFrame, assets: DataFrame,
                   consent: DataFrame, spread: Sequence[str] = ("request_id",)) -> DataFrame:
    """Requests with `reason_code`, `allowed`, row filters and masked columns."""
    columns = requests.columns
    joined = join_assets(join_principals(requests, users, agents, spread), assets, consent,
                         spread, requests)
    return decide(joined).select(*columns, *DECISION_COLUMNS)


DECISION_COLUMNS = ("reason_code", "allowed", "row_filter", "filter_error", "masked_columns")


def decide(joined: DataFrame) -> DataFrame:
    """Add the decision columns to requests joined to their policy rows.

    Access whose row filter cannot be built, or would hold unsafe text, is denied with the
    reason code of the filter, and no filter text is given.
    """
    error = filter_error()
    code = reason_code()
    return (joined.withColumn("filter_error", error)
            .withColumn("reason_code", F.when(
                (code == ALLOWED) & error.isNotNull(), error).otherwise(code))
            .withColumn("allowed", F.col("reason_code") == ALLOWED)
            .withColumn("row_filter", F.when(F.col("filter_error").isNull(), row_filter()))
            .withColumn("masked_columns", masked_columns()))


def allowed_brands() -> Column:
    """Brands of the asset that the user may see, in asset order; empty when unrestricted."""
    return F.array_intersect(empty_if_null(F.col("brand_tags")),
                             empty_if_null(F.col("brand_scope")))


def brand_predicate() -> Column:
    """SQL text of the brand filter, for the audit record; null when there is none."""
    brands = allowed_brands()
    return F.when(F.size(brands) > 0, F.concat(
        F.col("brand_column"), F.lit(" IN ('"),
        F.array_join(brands, "', '"), F.lit("')")))


def brand_filter_status() -> Column:
    """NONE, RESTRICTED, or MISSING_BRAND_COLUMN, which callers must deny."""
    return (F.when(F.size(allowed_brands()) == 0, "NONE")
            .when(F.col("brand_column").isNull(), "MISSING_BRAND_COLUMN")
            .otherwise("RESTRICTED"))


def template_error() -> Column:
    """Reason code of a template with a placeholder other than user_id and brand_scope."""
    rest = F.regexp_replace(F.col("row_filter_template"), r"\{(user_id|brand_scope)\}", "")
    return F.when(rest.rlike(r"[{}]"), F.lit("TEMPLATE_UNKNOWN_PLACEHOLDER"))


def resolve_template() -> Column:
    """Row filter template with its placeholders filled in; null when it cannot be."""
    scope = empty_if_null(F.col("brand_scope"))
    quoted = F.when(F.size(scope) > 0, F.concat(
        F.lit("'"), F.array_join(scope, "','"), F.lit("'"))).otherwise(F.lit(""))
    filled = F.replace(F.replace(F.col("row_filter_template"), F.lit("{user_id}"),
                                 F.col("user_id")), F.lit("{brand_scope}"), quoted)
    return F.when(template_error().isNull(), filled)


def row_filter() -> Column:
    """SQL text of all row filters of a request, joined by AND; null when there is none."""
    parts = F.array_compact(F.array(brand_predicate(), resolve_template()))
    return F.when(F.size(parts) > 0, F.concat(F.lit("("), F.array_join(parts, ") AND ("),
                                              F.lit(")")))


def unsafe_names() -> Column:
    """Whether a name that filters are made of holds other than safe characters."""
    return (F.col("user_id").isNotNull() & ~L.is_safe_identifier(F.col("user_id"))
            | ~L.are_safe_identifiers(F.col("brand_scope"))
            | ~L.are_safe_identifiers(F.col("brand_tags"))
            | (F.col("brand_column").isNotNull() & ~L.is_safe_identifier(F.col("brand_column"))))


def filter_error() -> Column:
    """Reason code of row filters that cannot be applied, so that access must be denied."""
    return F.coalesce(
        template_error(),
        F.when(brand_filter_status() == "MISSING_BRAND_COLUMN", F.lit("MISSING_BRAND_COLUMN")),
        F.when(unsafe_names(), F.lit("UNSAFE_IDENTIFIER")))


def masked_columns() -> Column:
    """Personal data columns of the asset, unless the user is cleared for restricted data."""
    return F.when(F.col("clearance_rank") >= L.RESTRICTED, F.array().cast("array<string>")
                  ).otherwise(empty_if_null(F.col("pii_columns")))


def decision_counts(users: DataFrame, agents: DataFrame, assets: DataFrame, consent: DataFrame,
                    rights: Sequence[str] = L.ACCESS_RIGHTS) -> DataFrame:
    """Number of decisions per agent, right and reason over all users and assets.

    Gives what deciding every user x agent x asset x right would, by counting: users are
    reduced to profiles of clearance and scope, assets to sums per level and source, and an
    agent meets these sums on levels and on the sources it may use.
    """
    rooms = _asset_sums(users, assets, consent)
    by_source = rooms.groupBy("sensitivity_rank", "source").agg(
        *[F.sum(c).alias(c) for c in _SUMS])
    by_level = by_source.groupBy("sensitivity_rank").agg(*[F.sum(c).alias(c) for c in _SUMS])

    ranks = F.array(*[F.lit(r) for r in range(len(L.SENSITIVITY_LEVELS))],
                    F.lit(None).cast("int"))
    sides = agents.select("agent_id", "ceiling_rank", "allowed_rights",
                          F.array_distinct(empty_if_null(F.col("allowed_sources")))
                          .alias("sources"), F.explode(ranks).alias("level"))
    # Sums over the sources that an agent may use; all of them where none are listed.
    open_sums = [c for c in _SUMS if c not in ("n_assets", "cleared", "no_scope")]
    listed = (sides.select("agent_id", "level", F.explode("sources").alias("source"))
              .join(by_source.withColumnRenamed("source", "asset_source"),
                    F.col("level").eqNullSafe(F.col("sensitivity_rank"))
                    & (F.col("source") == F.col("asset_source")))
              .groupBy("agent_id", "level").agg(*[F.sum(c).alias(f"o_{c}") for c in open_sums]))
    listed = listed.select(F.col("agent_id").alias("l_agent"), F.col("level").alias("l_level"),
                           *[f"o_{c}" for c in open_sums])
    cells = (sides.join(by_level, F.col("level").eqNullSafe(F.col("sensitivity_rank")))
             .join(listed, (F.col("agent_id") == F.col("l_agent"))
                   & F.col("level").eqNullSafe(F.col("l_level")), "left")
             .withColumns({f"o_{c}": F.when(F.size("sources") == 0, F.col(c)).otherwise(
                 F.coalesce(f"o_{c}", F.lit(0))) for c in open_sums})
             .withColumn("access_right", F.explode(F.array(*[F.lit(r) for r in rights]))))

    def part(code: str, n: Column) -> Column:
        return F.struct(F.lit(code).alias("reason_code"), n.cast("long").alias("n"))

    c = F.col
    passed = [part("SOURCE_NOT_ALLOWED", c("in_scope") - c("o_in_scope")),
              part("CONSENT_BLOCKED", c("o_in_scope") - c("o_consented")),
              *[part(code, c(f"o_{name}")) for name, code in _PASSED.items()]]
    after_right = F.when(
        ~F.coalesce(F.array_contains("allowed_rights", c("access_right")), F.lit(False)),
        F.array(part("RIGHT_NOT_ALLOWED", c("cleared")))).otherwise(F.array(
            part("BRAND_SCOPE_EMPTY", c("no_scope")),
            part("BRAND_SCOPE_MISMATCH", c("cleared") - c("no_scope") - c("in_scope")), *passed))
    parts = F.when(~at_most("level", "ceiling_rank"),
                   F.array(part("AGENT_CEILING", c("n_pairs")))).otherwise(F.concat(
                       F.array(part("USER_CLEARANCE", c("n_pairs") - c("cleared"))), after_right))
    return (cells.withColumn("n_pairs", c("n_assets") * F.lit(users.count()))
            .select("agent_id", "access_right", F.inline(parts))
            .groupBy("agent_id", "access_right", "reason_code").agg(F.sum("n").alias("n"))
            .where("n > 0"))


# What becomes of users who pass every check, by the filter of the asset.
_PASSED = {"passed": ALLOWED, "bad_template": "TEMPLATE_UNKNOWN_PLACEHOLDER",
           "no_column": "MISSING_BRAND_COLUMN", "unsafe": "UNSAFE_IDENTIFIER"}
_SUMS = ("n_assets", "cleared", "no_scope", "in_scope", "consented", *_PASSED)


def _asset_sums(users: DataFrame, assets: DataFrame, consent: DataFrame) -> DataFrame:
    """Per asset, how many users are cleared, in scope, consent, and end with each code."""
    scope = F.array_sort(F.array_distinct(empty_if_null(F.col("brand_scope"))))
    unsafe = ~(L.is_safe_identifier(F.col("user_id")) & L.are_safe_identifiers(
        F.col("brand_scope")))
    profiles = (users.select("clearance_rank", scope.alias("scope"), unsafe.alias("unsafe"))
                .groupBy("clearance_rank", "scope", "unsafe").agg(F.count(F.lit(1)).alias("n")))
    # A null stays one: such users are cleared for nothing.
    level = F.when(F.col("clearance_rank") > L.SECRET, L.SECRET).otherwise(F.col("clearance_rank"))
    ranks = profiles.groupBy(level.alias("clearance_rank")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.size("scope") == 0, F.col("n")).otherwise(0)).alias("unscoped"),
        F.sum(F.when(F.col("unsafe"), F.col("n")).otherwise(0)).alias("unsafe")).collect()

    def cleared(field: str) -> Column:
        """Users with a field who are cleared for the asset, a list of one number per level."""
        by_level = [sum(r[field] for r in ranks if r["clearance_rank"] is not None
                        and r["clearance_rank"] >= x) for x in range(len(L.SENSITIVITY_LEVELS))]
        return F.coalesce(F.get(F.array(*map(F.lit, by_level)), F.col("sensitivity_rank")),
                          F.lit(0))

    assets = assets.withColumn("tag_set", F.array_sort(F.array_distinct(
        empty_if_null(F.col("brand_tags")))))
    tagged = (assets.where(F.size("tag_set") > 0).select("sensitivity_rank", "tag_set").distinct()
              .select("*", F.explode("tag_set").alias("brand")))
    by_brand = profiles.select("clearance_rank", "scope", "unsafe", "n",
                               F.explode("scope").alias("brand"))
    overlap = (by_brand.join(tagged, "brand")
               .where(F.col("clearance_rank") >= F.col("sensitivity_rank"))
               .groupBy("sensitivity_rank", "tag_set", "clearance_rank", "scope", "unsafe")
               .agg(F.max("n").alias("n"))
               .groupBy("sensitivity_rank", "tag_set").agg(
                   F.sum("n").alias("n_overlap"),
                   F.sum(F.when(F.col("unsafe"), F.col("n")).otherwise(0)).alias("u_overlap")))

    granted = (consent.where("granted").select(F.col("subject_id").alias("user_id"), "asset_id"))
    need = assets.where("consent_required").select("asset_id", "sensitivity_rank", "brand_tags")
    holders = salted_join(salted_join(granted, need, ["asset_id"], ["user_id"], "inner"),
                          users.select(*USER_COLUMNS), ["user_id"], ["asset_id"], "inner",
                          base=granted)
    tags = empty_if_null(F.col("brand_tags"))
    consents = (holders.where((F.col("clearance_rank") >= F.col("sensitivity_rank")) & (
        (F.size(tags) == 0) | F.arrays_overlap(tags, empty_if_null(F.col("brand_scope")))))
        .groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_consent"),
                                 F.count_if(unsafe).alias("u_consent")))

    is_tagged = F.size(tags) > 0
    zero = F.lit(0)
    joined = (assets.join(overlap, ["sensitivity_rank", "tag_set"], "left")
              .join(consents, "asset_id", "left"))

    def with_consent(in_scope: Column, holders: str) -> Column:
        return F.when(F.col("consent_required"), F.coalesce(holders, zero)).otherwise(in_scope)

    scoped = joined.select(
        "source", "sensitivity_rank", F.lit(1).alias("n_assets"), cleared("n").alias("cleared"),
        F.when(is_tagged, cleared("unscoped")).otherwise(zero).alias("no_scope"),
        F.when(is_tagged, F.coalesce("n_overlap", zero)).otherwise(cleared("n")).alias("in_scope"),
        with_consent(F.when(is_tagged, F.coalesce("n_overlap", zero)).otherwise(cleared("n")),
                     "n_consent").alias("consented"),
        with_consent(F.when(is_tagged, F.coalesce("u_overlap", zero)).otherwise(
            cleared("unsafe")), "u_consent").alias("n_unsafe"),
        F.when(template_error().isNotNull(), "bad_template")
        .when(is_tagged & F.col("brand_column").isNull(), "no_column")
        .when(~L.are_safe_identifiers(F.col("brand_tags")) | (
            F.col("brand_column").isNotNull() & ~L.is_safe_identifier(F.col("brand_column"))),
            "unsafe").alias("fault"))
    whole = {name: F.when(F.col("fault") == name, F.col("consented")).otherwise(zero)
             for name in ("bad_template", "no_column")}
    return scoped.withColumns(whole).withColumns({
        "unsafe": F.when(F.col("fault") == "unsafe", F.col("consented"))
        .when(F.col("fault").isNull(), F.col("n_unsafe")).otherwise(zero),
        "passed": F.when(F.col("fault").isNull(), F.col("consented") - F.col("n_unsafe"))
        .otherwise(zero)})


def decision_report(counts: DataFrame) -> DataFrame:
    """Roll up of decision counts by agent and reason."""
    return counts.rollup("agent_id", "reason_code").agg(F.sum("n").alias("n_decisions"))
