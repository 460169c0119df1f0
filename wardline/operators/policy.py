"""Policy tables: latest state of logs, lookups, consent, versions and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.operators.asof import asof_join
from wardline.operators.skew import salted_join


def latest_by(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in `order`; combined map-side, so a hot key costs one row per task."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return (log.groupBy(*keys).agg(newest)
            .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
            .select(*log.columns))


def latest_assets(registrations: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Catalog in force: the last registration of each asset wins."""
    return latest_by(registrations, ["asset_id"], order)


def latest_agents(registrations: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Agents in force: the last registration of each agent wins."""
    return latest_by(registrations, ["agent_id"], order)


def find_by_source(assets: DataFrame, source: str) -> DataFrame:
    return assets.where(F.col("source") == source)


def find_by_table(assets: DataFrame, table: str) -> DataFrame:
    return assets.where(F.col("table") == table)


def lookup_assets(requests: DataFrame, assets: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Join requests to their asset; `asset_status` tells those that name none."""
    marked = assets.withColumn("_found", F.lit(True))
    return (salted_join(requests, marked, ["asset_id"], spread)
            .withColumn("asset_status", F.when(F.col("_found"), F.lit("FOUND"))
                        .otherwise(F.lit("ASSET_NOT_FOUND"))).drop("_found"))


def latest_consent(consent_events: DataFrame) -> DataFrame:
    """Consent in force per subject and asset; the last event wins."""
    return (consent_events.groupBy("subject_id", "asset_id")
            .agg(F.max_by("granted", F.struct("ts", "seq")).alias("granted")))


def consent_as_of(requests: DataFrame, consent_events: DataFrame, spread: Sequence[str],
                  ts: str = "ts", **options: int) -> DataFrame:
    """Add `consented`, the consent of subject and asset in force when each request was made."""
    joined = asof_join(requests, consent_events, ["subject_id", "asset_id"], ts=ts,
                       change_ts="ts", seq="seq", payload=["granted"], spread=spread, **options)
    return (joined.withColumn("consented", F.coalesce("granted", F.lit(False))).drop("granted"))


def consented_rows(rows: DataFrame, consent_events: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Rows whose own subject consents to the use of their asset.

    For jobs of our own: a view under a user's query takes a literal filter instead.
    """
    granted = latest_consent(consent_events).where("granted").select("subject_id", "asset_id")
    return salted_join(rows, granted, ["subject_id", "asset_id"], spread, "left_semi")


LANES = 4


def lanes_of(line: Column) -> list[Column]:
    """Four numbers of a line's hash; sums of them over the lines of a state identify it."""
    digest = F.sha2(line, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
            for i in range(LANES)]


def _json(**fields: Column) -> Column:
    """One text of all fields, nulls kept, so that different records never read alike."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]),
                     {"ignoreNullFields": "false"})


def asset_line() -> Column:
    """Canonical text of an asset for the version digest: the whole record."""
    names = ("asset_id", "name", "source", "table", "columns", "sensitivity_rank",
             "required_rights", "brand_tags", "brand_column", "row_filter_template",
             "pii_columns", "consent_required", "owner", "tags")
    return _json(kind=F.lit("asset"), **{n: F.col(n) for n in names})


def consent_line() -> Column:
    """Canonical text of a consent for the version digest."""
    return _json(kind=F.lit("consent"), subject_id=F.col("subject_id"),
                 asset_id=F.col("asset_id"), granted=F.col("granted"))


def version_id(n_lines: Column, lanes: Sequence[Column]) -> Column:
    digest = F.sha2(F.concat_ws("|", n_lines.cast("string"), *[
        F.coalesce(x.cast("string"), F.lit("0")) for x in lanes]), 256)
    return F.concat(F.lit("v:"), F.substring(digest, 1, 16))


def _state_sums(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), *[
        F.sum(x).alias(f"lane{i}") for i, x in enumerate(lanes_of(F.col("line")))])


def policy_version(assets: DataFrame, consent: DataFrame) -> DataFrame:
    """One row with the version of the policy state.

    Lines are hashed one by one and the hashes are added up, so the version does not
    depend on row order and no task holds the state: any change to any line changes it.
    """
    lines = assets.select(asset_line().alias("line")).unionByName(
        consent.select(consent_line().alias("line")))
    lanes = [F.col(f"lane{i}") for i in range(LANES)]
    return _state_sums(lines).select(version_id(F.col("n_lines"), lanes).alias("version_id"),
                                     "n_lines")


def consent_changes(consent_events: DataFrame) -> DataFrame:
    """Consent events as changes of the policy state: key, line, ts, seq."""
    return consent_events.select(F.array("subject_id", "asset_id").alias("key"),
                                 consent_line().alias("line"), "ts", "seq")


def policy_timeline(changes: DataFrame, assets: DataFrame) -> DataFrame:
    """The version of the policy state after each change: ts, seq, version_id.

    `changes` replace the line of their key; `assets` are lines that stay. A change takes
    the hash of the line before it off the sums and puts its own on, so that a change that
    changes nothing keeps the version and one taken back restores it. Sums run by day and
    then over days, so no task holds the whole history.
    """
    start = _state_sums(assets.select(asset_line().alias("line"))).first()
    names = ["n_lines", *[f"lane{i}" for i in range(LANES)]]
    before = F.lag("line").over(Window.partitionBy("key").orderBy("ts", "seq"))
    steps = changes.select("key", "line", "ts", "seq").withColumn("before", before)
    steps = steps.select("ts", "seq", F.to_date("ts").alias("day"),
                         F.when(F.col("before").isNull(), 1).otherwise(0).alias("n_lines"), *[
        (new - F.coalesce(old, F.lit(0).cast("decimal(20,0)"))).alias(f"lane{i}")
        for i, (new, old) in enumerate(zip(lanes_of(F.col("line")), lanes_of(F.col("before"))))])
    inside = Window.partitionBy("day").orderBy("ts", "seq").rowsBetween(
        Window.unboundedPreceding, 0)
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    by_day = steps.groupBy("day").agg(*[F.sum(n).alias(n) for n in names]).select(
        "day", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in names])
    total = [F.col(n) + F.col(f"_{n}") + F.lit(start[n] or 0) for n in names]
    return (steps.select("ts", "seq", "day", *[F.sum(n).over(inside).alias(n) for n in names])
            .join(by_day, "day").select("ts", "seq", version_id(
                total[0].cast("long"), [x.cast("decimal(38,0)") for x in total[1:]])
                .alias("version_id")))


def version_as_of(rows: DataFrame, timeline: DataFrame, spread: Sequence[str],
                  ts: str = "ts", name: str = "version_in_force",
                  base: DataFrame | None = None, **options: int) -> DataFrame:
    """Add the policy version in force at the time of each row; `v:0` before any change."""
    joined = asof_join(rows, timeline, [], ts=ts, change_ts="ts", seq="seq",
                       payload=["version_id"], spread=spread, base=base, **options)
    return joined.withColumn(name, F.coalesce("version_id", F.lit("v:0"))).drop("version_id")


def split_identifiers(df: DataFrame, scalars: Sequence[str],
                      arrays: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with safe identifiers, and the others with `reason_code`."""
    safe = F.lit(True)
    for c in scalars:
        safe = safe & L.is_safe_identifier(F.col(c))
    for c in arrays:
        safe = safe & L.are_safe_identifiers(F.col(c))
    return (df.where(safe),
            df.where(~safe).withColumn("reason_code", F.lit("UNSAFE_IDENTIFIER")))
