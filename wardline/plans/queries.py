"""Registered queries: each runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions import spans
from wardline.functions import text as X
from wardline.functions.tokens import canonical_query, query_hash
from wardline.operators import (
    access, deltas, eligibility, free_rows, identity, ledger, policy, results, screening, state,
    transfer, views)
from wardline.operators.skew import salted_join
from wardline.plans import roles
from wardline.session import shared_path, stored
from wardline.sources.tables import spread_few_files
from wardline.streaming.calls import (
    check_streams, check_with, judge_batches, name_late, run_in_slices)
from wardline.streaming.denials import denial_sessions, denial_windows
from wardline.streaming.text import govern_and_screen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A user who may see three brands.
ANALYST_BRANDS = ("Brand#3", "Brand#7", "Brand#12")


def query(run: Query) -> Query:
    """Register a query under its own name; one that ends in an underscore loses it."""
    QUERIES[run.__name__.rstrip("_")] = run
    return run


def _list(column: str | Column, by: str = ",") -> Column:
    """Array as text; an empty or null array is an empty string."""
    return F.coalesce(F.array_join(column, by), F.lit(""))


def _pairs(column: str) -> Column:
    """String map as text, sorted by key."""
    entries = F.array_sort(F.map_entries(column))
    return F.coalesce(F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit(""))


def _map_of_lists(column: str) -> Column:
    entries = F.array_sort(F.map_entries(column))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(e["value"], ","))), ";"), F.lit(""))


def _ntz(ts: str) -> Column:
    return F.col(ts).cast("timestamp_ntz")


# --- Governed reads ---------------------------------------------------------------------


def _analyst_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.governed_view(roles.table(spark, sf_dir, "part"), brand_column="p_brand",
                               brands=ANALYST_BRANDS, masked=["p_retailprice"])


@query
def governed_brand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_analyst_view(spark, sf_dir).groupBy("p_brand")
            .agg(F.count(F.lit(1)).alias("n_parts"), F.sum("p_size").alias("sum_size")))


@query
def governed_or_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT p_partkey, p_brand, p_size FROM parts WHERE p_size > 45 OR 1 = 1 -- all"
    return views.run_governed_sql(spark, text, {"parts": lambda s: _analyst_view(s, sf_dir)})


@query
def masked_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.governed_view(roles.table(spark, sf_dir, "customer"),
                               masked=["c_name", "c_acctbal"])


def _items_and_auditors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items by brand, and one auditor per nation."""
    parts = roles.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"))
    items = roles.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = salted_join(items, parts, ["l_partkey"], ["l_orderkey", "l_linenumber"], "inner"
                       ).drop("l_partkey")
    key = F.col("n_nationkey")
    auditors = roles.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("auditor_"), key.cast("string")).alias("user_id"),
        (key % 5).alias("clearance_rank"),
        F.array(F.concat(F.lit("Brand_"), (1 + key).cast("string")),
                F.concat(F.lit("Brand_"), (1 + (key + 9) % 25).cast("string")))
        .alias("brand_scope"))
    return rows, auditors


@query
def multi_user_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by brand for one auditor per nation, with prices masked by clearance."""
    rows, auditors = _items_and_auditors(spark, sf_dir)
    return views.multi_user_extract(rows, auditors, "brand", ["l_extendedprice"],
                                    ["l_orderkey", "l_linenumber"])


@query
def laid_out_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`multi_user_extract` from line items stored by brand, whose scan entitlements prune."""
    rows, auditors = _items_and_auditors(spark, sf_dir)
    stored_rows = views.lay_out(rows, "brand", shared_path(spark, "by-brand"),
                                ["l_orderkey", "l_linenumber"])
    return views.laid_out_extract(stored_rows, auditors, "brand", ["l_extendedprice"])


# --- Policy tables ----------------------------------------------------------------------


@query
def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.lookup_assets(
        roles.access_requests(spark, sf_dir),
        roles.assets(spark, sf_dir).select("asset_id", "source", "table"), ["request_id"])
    return found.select("request_id", "asset_id", "source", "table", "asset_status")


@query
def assets_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.find_by_source(roles.assets(spark, sf_dir), "snowflake").select(
        "asset_id", "table", "sensitivity_rank")


@query
def assets_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.find_by_table(roles.assets(spark, sf_dir), "parts.b7").select(
        "asset_id", "source")


@query
def asset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.assets(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_assets"), F.max("sensitivity_rank").alias("max_rank"))


@query
def asset_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.latest_assets(roles.registrations(spark, sf_dir))


@query
def agent_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.latest_agents(roles.agent_registrations(spark, sf_dir))


@query
def consent_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.latest_consent(roles.consent_events(spark, sf_dir))


@query
def consent_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent in force when each line item was shipped."""
    out = policy.consent_as_of(
        roles.shipped_rows(spark, sf_dir), roles.consent_events(spark, sf_dir),
        ["l_orderkey", "l_linenumber"], ts="l_shipdate")
    return out.groupBy("subject_id", "consented").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("long").alias("quantity"))


@query
def consented_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.consented_rows(
        roles.shipped_rows(spark, sf_dir), roles.consent_events(spark, sf_dir),
        ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "subject_id", "asset_id", "l_quantity")


@query
def policy_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.policy_version(
        roles.assets(spark, sf_dir),
        policy.latest_consent(roles.consent_events(spark, sf_dir)))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.policy_timeline(policy.consent_changes(roles.policy_changes(spark, sf_dir)),
                                  roles.assets(spark, sf_dir))


@query
def policy_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query
def unsafe_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw brand names hold a character that no identifier may."""
    raw = roles.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"),
                                                    F.array("p_type").alias("scope"))
    return policy.split_identifiers(raw, ["brand"], ["scope"])[1].select(
        "p_partkey", "brand", "reason_code")


# --- Access decisions -------------------------------------------------------------------


def _policy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return (roles.users(spark, sf_dir), roles.agents(spark), roles.assets(spark, sf_dir),
            policy.latest_consent(roles.consent_events(spark, sf_dir)))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.resolve_access(roles.access_requests(spark, sf_dir), *_policy(spark, sf_dir))


@query
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(
        "request_id", "user_id", "agent_id", "asset_id", "access_right", "reason_code", "allowed")


@query
def access_decisions_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`access_decisions` from those of an older policy: only what changes touch is decided again.

    Of the older policy the later half of the consents and some clearances were different.
    """
    users, agents, assets, consent = _policy(spark, sf_dir)
    events = roles.consent_events(spark, sf_dir)
    middle = events.select(F.percentile_approx("ts", 0.5).alias("middle"))
    before = events.join(F.broadcast(middle), F.col("ts") <= F.col("middle")).drop("middle")
    lower = F.when(F.crc32("user_id") % 7 == 0, F.col("clearance_rank") - 1).otherwise(
        F.col("clearance_rank"))
    old = deltas.Policy(users.withColumn("clearance_rank", lower), agents, assets,
                        policy.latest_consent(before))
    decisions = stored(access.resolve_access(roles.access_requests(spark, sf_dir), *old))
    return deltas.refresh(decisions, old, deltas.Policy(users, agents, assets, consent)).select(
        "request_id", "user_id", "agent_id", "asset_id", "access_right", "reason_code", "allowed")


@query
def decision_matrix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.decision_report(access.decision_counts(*_policy(spark, sf_dir)))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, agents, assets, consent = _policy(spark, sf_dir)
    requests = roles.access_requests(spark, sf_dir)
    both = access.join_principals(requests, users, agents, ["request_id"])
    return access.join_assets(both, assets, consent, ["request_id"], requests).where(
        "asset_known AND user_known")


@query
def row_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select(
        "request_id", "user_id", "asset_id", access.brand_predicate().alias("brand_filter"),
        access.brand_filter_status().alias("status"))


@query
def row_filter_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).where("row_filter_template IS NOT NULL").select(
        "request_id", "asset_id", access.resolve_template().alias("template_filter"),
        access.template_error().alias("reason_code"))


@query
def column_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select(
        "request_id", "user_id", "asset_id", _list(access.masked_columns()).alias("masked"))


# --- Eligibility ------------------------------------------------------------------------


def _eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.check_eligibility(
        roles.eligibility_requests(spark, sf_dir), *_policy(spark, sf_dir))


@query
def eligibility_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligibility(spark, sf_dir).select(
        "request_id", "user_id", "agent_id", "status", "outcome",
        _list("reason_codes").alias("reason_codes"),
        _list("allowed_asset_ids").alias("allowed_asset_ids"),
        _pairs("applied_filters").alias("applied_filters"))


@query
def gate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, stopped = eligibility.gate(_eligibility(spark, sf_dir))
    counted = [part.groupBy("agent_id", "status", "outcome").agg(
        F.count(F.lit(1)).alias("n_requests")).withColumn("side", F.lit(side))
        for part, side in ((passed, "run"), (stopped, "stop"))]
    return counted[0].unionByName(counted[1])


@query
def eligible_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.eligible_agents(
        roles.user_sessions(spark, sf_dir), *_policy(spark, sf_dir)).select(
        "session_id", "agent_id", "outcome", _list("allowed_asset_ids").alias("allowed_asset_ids"))


# --- Tokens and calls -------------------------------------------------------------------


@query
def query_hash_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.tool_calls(spark, sf_dir).select(
        "call_id", canonical_query(F.col("query")).alias("canonical"),
        query_hash(F.col("query")).alias("query_hash"))


def _issued(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    timeline = _timeline(spark, sf_dir)
    return ledger.issue_tokens(roles.token_requests(spark, sf_dir), *_policy(spark, sf_dir),
                               timeline, F.lit(roles.SECRET), roles.TTL_SECONDS)


def _checked(spark: SparkSession, sf_dir: str, require_token: bool = True) -> DataFrame:
    return ledger.check_calls(
        roles.tool_calls(spark, sf_dir), stored(_issued(spark, sf_dir)[0]),
        roles.revocations(spark, sf_dir), require_token)


@query
def token_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = _issued(spark, sf_dir)[0]
    return issued.select(
        "token_id", "query_hash", "query_preview", "user_id", "agent_id", "session_id",
        "policy_version", "issued_at", "expires_at", _pairs("row_filters").alias("row_filters"),
        _map_of_lists("masked_columns").alias("masked_columns"),
        _list("asset_ids").alias("asset_ids"))


@query
def token_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issued(spark, sf_dir)[1]


@query
def token_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.judge_calls(_checked(spark, sf_dir)).select(
        "call_id", "agent_id", "token_id", "verdict")


def _call_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = stored(_issued(spark, sf_dir)[0])
    return views.call_reads(ledger.judge_calls(ledger.check_calls(
        roles.tool_calls(spark, sf_dir), issued, roles.revocations(spark, sf_dir))), issued)


@query
def governed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every allowed call with what it reads; the rows of a read are in `governed_read_rows`.

    Parts have neither owner nor scope, so a filter that names them leaves no row.
    """
    return _call_reads(spark, sf_dir).select(
        "call_id", "asset_id", "read_id",
        (F.col("row_filter").isNull() | views.brands_of_filter("p_brand").isNotNull())
        .alias("readable"))


@query
def governed_read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of parts for each different read of the allowed calls."""
    parts = roles.table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("p_brand"),
        "p_size", "p_retailprice")
    return views.governed_reads(_call_reads(spark, sf_dir), parts, "p_brand")


@query
def governed_call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From requests to rows: the rows of parts that each allowed call reads.

    Calls whose filters name brands alone; what calls without a filter read is all parts, and
    parts have neither owner nor scope. Rows are made once per different read.
    """
    reads = stored(_call_reads(spark, sf_dir).where(
        views.brands_of_filter("p_brand").isNotNull()))
    parts = roles.table(spark, sf_dir, "part").select(
        "p_partkey", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("p_brand"), "p_size")
    rows = stored(views.governed_reads(reads, parts, "p_brand"))
    return views.rows_of_calls(reads, rows, "p_partkey").drop("read_id")


@query
def token_verdicts_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`token_verdicts` from calls and ledger stored in buckets of tokens: neither is shuffled."""
    path = shared_path(spark, "buckets")
    known = ledger.with_revocations(_issued(spark, sf_dir)[0], roles.revocations(spark, sf_dir))
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    checked = ledger.check_bucketed(
        ledger.bucketed(roles.tool_calls(spark, sf_dir), f"{name}_calls", f"{path}/calls", 8),
        ledger.bucketed(known.select(
            "token_id", "query_hash", "agent_id", "issued_at", "expires_at", "token_revoked_at",
            "session_revoked_at"), f"{name}_ledger", f"{path}/ledger", 8))
    return ledger.judge_calls(checked).select("call_id", "agent_id", "token_id", "verdict")


#: Later than anything in a log.
END_OF_TIME = "2200-01-01 00:00:00"
#: Sessions are those of a day, of 25 hours at most where clocks change. Revocations count until
#: tokens expire that were issued in the session.
SESSION_LIFE = f"{25 * 3600 + roles.TTL_SECONDS} seconds"


@query
def live_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`token_verdicts` from a stream of files that stops and starts again."""
    path = shared_path(spark, "live")
    book = stored(_issued(spark, sf_dir)[0])
    revoked = roles.revocations(spark, sf_dir)
    calls = stored(roles.tool_calls(spark, sf_dir))
    judge = judge_batches(f"{path}/used", f"{path}/out", check_with(lambda _: book,
                                                                    lambda _: revoked))
    spark.createDataFrame([], "token_id string, expires_on date, bucket int, batch long"
                          ).write.parquet(f"{path}/used")
    run_in_slices(path, {"calls": ("ts", calls)}, lambda streams: (
        streams["calls"].writeStream.foreachBatch(judge).trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").start()), "calls")
    return spark.read.parquet(f"{path}/out").select("call_id", "agent_id", "token_id", "verdict")


@query
def live_revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`token_verdicts` from streams of calls, tokens and revocations that stop and start again."""
    path = shared_path(spark, "revoked")
    book = _issued(spark, sf_dir)[0].select(
        "token_id", "session_id", "agent_id", "query_hash",
        F.col("issued_at").cast("timestamp"), F.col("expires_at").cast("timestamp"))
    logs = {"calls": ("ts", roles.tool_calls(spark, sf_dir)), "tokens": ("issued_at", book),
            "revocations": ("ts", roles.revocations(spark, sf_dir))}
    logs = {name: (ts, stored(log.withColumn(ts, F.col(ts).cast("timestamp"))))
            for name, (ts, log) in logs.items()}
    spark.createDataFrame([], "token_id string, expires_on date, bucket int, batch long"
                          ).write.parquet(f"{path}/used")
    judge = judge_batches(f"{path}/used", f"{path}/out")

    def judge_once(batch: DataFrame, batch_id: int) -> None:
        # Written first: each reading of the batch would run the joins of the streams again.
        batch.write.mode("overwrite").parquet(f"{path}/batches/{batch_id}")
        issued = spark.read.schema(logs["tokens"][1].schema).parquet(f"{path}/tokens")
        judge(name_late(spark.read.parquet(f"{path}/batches/{batch_id}"), issued), batch_id)

    def start(streams: dict[str, DataFrame]) -> StreamingQuery:
        checked = check_streams(streams["calls"], streams["tokens"], streams["revocations"],
                                roles.TTL_SECONDS, session_life=SESSION_LIFE, every="6 hours")
        return (checked.writeStream.foreachBatch(judge_once).trigger(availableNow=True)
                .option("checkpointLocation", f"{path}/checkpoint").start())

    run_in_slices(path, logs, start, "calls", F.lit(END_OF_TIME).cast("timestamp"))
    return spark.read.parquet(f"{path}/out").select("call_id", "agent_id", "token_id", "verdict")


@query
def replay_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_uses(_checked(spark, sf_dir))


@query
def ungoverned_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger.judge_calls(_checked(spark, sf_dir, require_token=False))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_calls"))


@query
def call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.call_results(ledger.judge_calls(_checked(spark, sf_dir))).select(
        "call_id", "success", "error", _pairs("filters_applied").alias("filters_applied"),
        _map_of_lists("masked_columns").alias("masked_columns"), "token_id", "governed")


@query
def stale_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline = _timeline(spark, sf_dir)
    calls = roles.tool_calls(spark, sf_dir)
    return ledger.mark_stale(_checked(spark, sf_dir), timeline, calls).select(
        "call_id", "policy_version", "version_in_force", "policy_stale")


# --- Text -------------------------------------------------------------------------------


@query
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(X.split_chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (roles.documents(spark, sf_dir)
            .select("doc_id", "source", X.classify(F.col("text")).alias("c"))
            .select("doc_id", "source", F.col("c.rank").alias("sensitivity_rank"),
                    (F.size("c.kinds") > 0).alias("pii_detected")))


@query
def pii_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (roles.documents(spark, sf_dir)
            .select("lang", "source", F.explode(X.pii_kinds(F.col("text"))).alias("kind"))
            .groupBy("lang", "source", "kind").agg(F.count(F.lit(1)).alias("n_docs")))


@query
def brand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands in chat turns that end with the name of a brand."""
    named = F.concat_ws(" ", "text", F.get(F.array(*[F.lit(b) for b in (
        "Brand_A", "brand_c and BRAND_b", "CORP_BRAND")]), (F.col("turn") % 5).cast("int")))
    return roles.conversations(spark, sf_dir).select(
        "conv_id", "turn", _list(X.brand_tags(named)).alias("brands"))


@query
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.documents(spark, sf_dir).select(
        "doc_id", X.redact_pii(F.col("text")).alias("redacted"))


@query
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows: each place that redaction replaces in a document."""
    found = F.explode(spans.pii_spans(F.col("text"))).alias("s")
    return roles.documents(spark, sf_dir).select("doc_id", found).select(
        "doc_id", "s.kind", F.col("s.start").alias("starts_at"), F.col("s.end").alias("ends_at"))


@query
def free_row_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of rows with any keys as their receivers see them, by path."""
    governed = free_rows.govern_free_rows(
        roles.free_rows(spark, sf_dir), "content", "ceiling_rank", ["turn.no"], ["role"])
    return governed.select("conv_id", "turn", F.inline("fields"))


@query
def free_row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected instructions in fields of rows with any keys, by path."""
    a = F.col("assessment")
    return free_rows.screen_free_rows(
        roles.free_rows(spark, sf_dir), "content", ["conv_id", "turn"]).select(
        "conv_id", "turn", "path", a["risk"].alias("risk"),
        _list(a["triggered"]).alias("triggered"))


def _govern(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return transfer.govern(roles.transfers(spark, sf_dir), "text", "ceiling_rank", mode)


@query
def govern_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _govern(spark, sf_dir, "REDACT").select(
        "conv_id", "turn", "redaction_count", F.size("chunks").alias("n_chunks"),
        "max_rank_seen", "safe_text")


@query
def govern_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents passed to an agent cleared for internal data only."""
    docs = roles.documents(spark, sf_dir).withColumn("ceiling_rank", F.lit(1))
    return transfer.govern(docs, "text", "ceiling_rank").select(
        "doc_id", "redaction_count", F.size("chunks").alias("n_chunks"), "max_rank_seen",
        F.sha2("safe_text", 256).alias("safe_hash"))


@query
def govern_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, stopped = transfer.split_blocked(_govern(spark, sf_dir, "BLOCK"))
    return passed.select("conv_id", "turn", F.lit(False).alias("blocked"), "safe_text").unionByName(
        stopped.select("conv_id", "turn", F.lit(True).alias("blocked"), "safe_text"))


@query
def govern_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.violations(_govern(spark, sf_dir, "AUDIT"), "ceiling_rank",
                               ["conv_id", "turn"])


@query
def govern_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured event content as text, then governed."""
    content = F.struct("event_type", "user_id", "props")
    rows = spread_few_files(roles.table(spark, sf_dir, "events"), "event_id").select(
        "event_id", X.as_text(content, True).alias("text"), F.lit(1).alias("ceiling_rank"))
    return transfer.govern(rows, "text", "ceiling_rank").select(
        "event_id", "redaction_count", "max_rank_seen", "safe_text")


@query
def govern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers for a receiver cleared for confidential data."""
    customers = roles.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    orders = roles.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered_on"))
    rows = salted_join(spread_few_files(orders, "o_orderkey"), customers, ["o_custkey"],
                       ["o_orderkey"], "inner", base=orders)
    return transfer.govern_rows(rows, 2, masked=["c_name"], keep=["o_orderkey"])


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.documents(spark, sf_dir).select(
        "doc_id", "text", "lang", "source")
    return transfer.column_profile(rows)


# --- Injection --------------------------------------------------------------------------


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(roles.documents(spark, sf_dir), "text")


@query
def injection_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("assessment")
    return _screened(spark, sf_dir).select(
        "doc_id", a["risk"].alias("risk"), a["confidence"].alias("confidence"),
        _list(a["triggered"]).alias("triggered"), a["explanation"].alias("explanation"),
        a["should_block"].alias("should_block"))


@query
def injection_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, stopped = screening.split_screened(
        screening.screen(roles.conversations(spark, sf_dir), "text"))
    columns = ["conv_id", "turn", "role"]
    return clean.select(*columns, F.lit("clean").alias("side")).unionByName(
        stopped.select(*columns, F.lit("quarantine").alias("side")))


@query
def injection_scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("assessment")
    return screening.screen_rows(
        roles.pages(spark, sf_dir), ["page_id"]).select(
        "page_id", "field", a["risk"].alias("risk"), _list(a["triggered"]).alias("triggered"))


@query
def injection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.pattern_report(_screened(spark, sf_dir), ["source"])


# --- Session state ----------------------------------------------------------------------


@query
def state_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.read_state(
        roles.context_requests(spark, sf_dir), roles.outputs(spark, sf_dir)).select(
        "request_id", "session_id", "output_type", "from_agent", "agent_first_seq", "out_seq",
        "sensitivity", _pairs("data").alias("data"))


@query
def state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.read_violations(
        roles.context_requests(spark, sf_dir), roles.outputs(spark, sf_dir)).drop("row_seq")


@query
def state_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.access_log(
        roles.context_requests(spark, sf_dir), roles.outputs(spark, sf_dir)).select(
        "request_id", "requesting_agent", _list("needed_types").alias("needed_types"),
        _list("received_types").alias("received_types"),
        _list("violations").alias("violations"), "n_excluded")


@query
def state_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.clear_outputs(
        roles.outputs(spark, sf_dir), roles.output_clears(spark, sf_dir)).select(
        "session_id", "agent_id", "out_seq", "output_type")


# --- Cached results ---------------------------------------------------------------------


@query
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.cache_writes(roles.cache_writes(spark, sf_dir)).select(
        "write_id", "cache_key", "ttl", "expires_at")


@query
def cache_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.cache_contents(roles.cache_writes(spark, sf_dir)).select(
        "cache_key", "write_id", "sensitivity_rank")


def _opened_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes with a payload that is opened with the key of its user; some are under another."""
    def key(name: Column) -> Column:
        return F.unhex(F.substring(F.sha2(name, 256), 1, 32))

    writes = roles.cache_writes(spark, sf_dir)
    owner = F.when(F.col("write_id") % 13 == 0, F.lit("other")).otherwise(F.col("user_id"))
    sealed = results.seal(writes.withColumn("said", F.col("query")), ["said"], key(owner))
    opened = results.unseal(sealed, writes.select(F.col("query").alias("said")).schema,
                            key(F.col("user_id")))
    return opened.withColumn("readable", F.col("data").isNotNull()).drop("payload", "data")


@query
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.cache_lookups(
        roles.cache_reads(spark, sf_dir), _opened_writes(spark, sf_dir)).select(
        "read_id", "cache_key", "lookup", "write_id")


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.cache_lookups(
        roles.cache_reads(spark, sf_dir), _opened_writes(spark, sf_dir),
        roles.cache_invalidations(spark, sf_dir))


@query
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir).select("read_id", "lookup", "write_id")


@query
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.cache_stats(_lookups(spark, sf_dir))


@query
def cache_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads sealed under a key that comes from the data, opened again and compared."""
    rows = roles.table(spark, sf_dir, "events").withColumn(
        "key", F.unhex(F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 32)))
    sealed = results.seal(rows.withColumn("before", F.col("value")), ["event_type", "value"],
                          F.col("key"))
    schema = rows.select("event_type", "value").schema
    opened = results.unseal(sealed, schema, F.col("key"))
    return opened.select("event_id", F.col("data.event_type").alias("event_type"),
                         F.col("data.value").alias("value"),
                         F.col("data.value").eqNullSafe(F.col("before")).alias("intact"))


# --- Identity ---------------------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    viewed = identity.claim_view(roles.claims(spark, sf_dir))
    return identity.check_claims(viewed, F.lit(roles.CLAIMS_NOW), "client", "tenant")


def _users_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.user_contexts(_claims(spark, sf_dir), roles.GROUP_BRANDS)


@query
def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select(
        "claim_id", "user_id", "upn", "app_id", _list("scopes").alias("scopes"), "is_app_only",
        "reason_code")


@query
def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users_of(spark, sf_dir).select(
        "claim_id", "user_id", _list("roles").alias("roles"),
        _list("brand_scope").alias("brand_scope"), "clearance_rank",
        _pairs("metadata").alias("metadata"))


@query
def entitlements_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`entitlements` with the groups and roles of the configuration as tables."""
    groups = spark.createDataFrame(
        [(g, b) for g, brands in roles.GROUP_BRANDS.items() for b in brands],
        "group_name string, brand string")
    levels = spark.createDataFrame(list(identity.ROLE_LEVELS.items()), "role string, level string")
    return identity.user_contexts_from_tables(_claims(spark, sf_dir), groups, levels).select(
        "claim_id", "user_id", _list("roles").alias("roles"),
        _list("brand_scope").alias("brand_scope"), "clearance_rank",
        _pairs("metadata").alias("metadata"))


@query
def entitlements_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entitlements under an override, which narrows the scope and never widens it."""
    override = F.when(F.col("claim_id") % 2 == 0, F.array(F.lit("brand_b"), F.lit("brand_z")))
    return identity.user_contexts(
        _claims(spark, sf_dir), roles.GROUP_BRANDS, override=override).select(
        "claim_id", _list("brand_scope").alias("brand_scope"))


@query
def agent_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.agent_principals(_claims(spark, sf_dir)).select(
        "claim_id", "service_principal_oid", "app_id", "tenant_id", _list("roles").alias("roles"),
        "source")


@query
def obo_degrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.degrade_on_behalf_of(_users_of(spark, sf_dir)).select(
        "claim_id", "user_id", _list("roles").alias("roles"),
        _list("brand_scope").alias("brand_scope"), "clearance_rank",
        F.element_at("metadata", F.lit("original_clearance")).alias("original_clearance"),
        F.element_at("metadata", F.lit("original_brand_scope")).alias("original_brand_scope"),
        F.element_at("metadata", F.lit("obo_degraded")).alias("obo_degraded"))


@query
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = roles.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 11).alias("claim_id"), "ts",
        F.col("event_type").alias("request_intent"))
    return identity.sessions(requests, _users_of(spark, sf_dir)).select(
        "session_id", "request_id", "user_id", "request_intent", "created_at",
        _list("brand_scope").alias("brand_scope"), _pairs("metadata").alias("metadata"))


@query
def obo_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are delegated calls on behalf of the session of the event before."""
    events = roles.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 11).alias("claim_id"), "ts",
        F.col("event_type").alias("request_intent"))
    users = _users_of(spark, sf_dir)
    originals = identity.sessions(events, users)
    previous = F.concat(F.lit("ses_"), F.substring(F.sha2(F.concat_ws(
        "|", (F.col("request_id") - 1).cast("string"), F.col("claim_id").cast("string")), 256),
        1, 32))
    calls = events.where("request_intent = 'click'").withColumn("original_session_id", previous)
    return identity.on_behalf_sessions(calls, users, originals).select(
        "session_id", "user_id", _list("brand_scope").alias("brand_scope"), "clearance_rank",
        _pairs("metadata").alias("metadata"))


# --- Denials over time ------------------------------------------------------------------


def _denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where(~F.col("allowed")).select("user_id", "ts")


@query
def denial_windows_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denial_windows(_denials(spark, sf_dir)).select(
        "user_id", _ntz("window_start").alias("window_start"),
        _ntz("window_end").alias("window_end"), "n_denials")


@query
def denial_sessions_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denial_sessions(_denials(spark, sf_dir), 7200).select(
        "user_id", _ntz("burst_start").alias("burst_start"),
        _ntz("burst_end").alias("burst_end"), "n_denials")


def _in_runs(spark: SparkSession, path: str, log: DataFrame, ts: str,
             work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over a log writes that stops after each slice of it and starts again."""
    run_in_slices(path, {"log": (ts, log)}, lambda streams: (
        work(streams["log"]).writeStream.format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()),
        "log", F.lit(END_OF_TIME).cast("timestamp"))
    return spark.read.schema(work(log).schema).parquet(f"{path}/out")


@query
def live_denial_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`denial_windows` from a stream of files that stops and starts again."""
    log = stored(_denials(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return _in_runs(spark, shared_path(spark, "denials"), log, "ts", denial_windows).select(
        "user_id", _ntz("window_start").alias("window_start"),
        _ntz("window_end").alias("window_end"), "n_denials")


@query
def live_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns governed and screened in a stream of files that stops and starts again."""
    log = stored(roles.transfers(spark, sf_dir).withColumn("ts", F.timestamp_seconds("turn")))
    rows = _in_runs(
        spark, shared_path(spark, "transfers"), log, "ts",
        lambda turns: govern_and_screen(
            turns.where(F.coalesce(F.col("ts") < END_OF_TIME, F.lit(True))), "text",
            "ceiling_rank"))
    return rows.select("conv_id", "turn", "redaction_count", "max_rank_seen", "safe_text",
                       F.col("assessment.risk").alias("risk"), "quarantine")
