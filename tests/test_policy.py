"""Policy tables, decisions, eligibility and governed views on the demo policy."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.operators import access, eligibility, policy, views
from wardline.sources import schemas
from wardline.sources.tables import (
    append_with_date, conform, read_table, spread_few_files)

ABC = ["brand_a", "brand_b", "brand_c"]


def asset(name, source, rank, tags=(), pii=(), consent=False, template=None, column="brand"):
    return (name, name, source, f"t.{name}", [], rank, ["read"], list(tags), column, template,
            list(pii), consent, "owner", {})


@pytest.fixture(scope="module")
def tables(spark):
    assets = [
        asset("costs", "delta_lake", 2, [*ABC, "brand_d", "brand_e"]),
        asset("quality", "snowflake", 2, ["brand_b"]),
        asset("hr", "postgres", 3, (), ["name", "salary"], True),
        asset("telemetry", "delta_lake", 2, ABC, ["vin"], True),
        asset("parts", "postgres", 0, template="owner = '{user_id}' AND b IN ({brand_scope})"),
        asset("bad_template", "postgres", 0, template="x = '{tenant}'"),
        asset("no_column", "postgres", 0, ["brand_b"], column=None),
        asset("no_rank", "postgres", None),
    ]
    users = [("analyst", ["r"], ["brand_b"], 2, {}), ("group", [], ABC, 2, {}),
             ("no_scope", [], [], 2, {}), ("intern", [], ["brand_b"], 1, {}),
             ("outsider", [], ["bmw"], 2, {}), ("boss", [], ABC, 4, {}),
             ("unranked", [], ["brand_b"], None, {})]
    agents = [("retrieval", "retrieval", 2, ["read"], ["snowflake", "delta_lake"]),
              ("restricted", "retrieval", 3, ["read"], ["postgres"]),
              ("public", "output", 1, ["read"], []), ("all", "x", 4, ["read", "write"], None)]
    consent = [("boss", "hr", True, datetime(2024, 1, 1), 1),
               ("boss", "telemetry", True, datetime(2024, 1, 1), 2),
               ("boss", "telemetry", False, datetime(2024, 1, 2), 3),
               ("group", "telemetry", True, datetime(2024, 1, 1), 4)]
    events = spark.createDataFrame(consent, schemas.CONSENT_EVENTS)
    return (spark.createDataFrame(users, schemas.USERS),
            spark.createDataFrame(agents, schemas.AGENTS),
            spark.createDataFrame(assets, schemas.ASSETS), policy.latest_consent(events))


@pytest.mark.parametrize("user, agent, name, right, reason", [
    ("analyst", "retrieval", "quality", "read", "ALLOWED"),
    ("analyst", "retrieval", "costs", "read", "ALLOWED"),
    ("no_scope", "retrieval", "quality", "read", "BRAND_SCOPE_EMPTY"),
    ("outsider", "retrieval", "quality", "read", "BRAND_SCOPE_MISMATCH"),
    ("intern", "retrieval", "quality", "read", "USER_CLEARANCE"),
    ("analyst", "public", "quality", "read", "AGENT_CEILING"),
    ("analyst", "retrieval", "quality", "write", "RIGHT_NOT_ALLOWED"),
    ("analyst", "retrieval", "parts", "read", "SOURCE_NOT_ALLOWED"),
    ("analyst", "public", "parts", "read", "ALLOWED"),
    ("boss", "restricted", "hr", "read", "ALLOWED"),
    ("boss", "all", "telemetry", "read", "CONSENT_BLOCKED"),
    ("group", "retrieval", "telemetry", "read", "ALLOWED"),
    ("analyst", "all", "hr", "read", "USER_CLEARANCE"),
    ("unranked", "all", "quality", "read", "USER_CLEARANCE"),
    ("boss", "all", "no_rank", "read", "AGENT_CEILING"),
    ("boss", "all", "quality", None, "RIGHT_NOT_ALLOWED"),
    ("boss", "all", "absent", "read", "ASSET_NOT_FOUND"),
    ("boss", "ghost", "parts", "read", "AGENT_UNKNOWN"),
    ("ghost", "all", "parts", "read", "USER_UNKNOWN"),
])
def test_first_failing_check_decides(decided, user, agent, name, right, reason):
    assert decided[user, agent, name, right] == reason


@pytest.fixture(scope="module")
def decided(spark, tables):
    cases = [mark.args[1] for mark in test_first_failing_check_decides.pytestmark]
    rows = [(i, None, "s", *case[:4]) for i, case in enumerate(cases[0])]
    requests = spark.createDataFrame(rows, schemas.ACCESS_REQUESTS)
    out = access.resolve_access(requests, *tables).collect()
    return {(r["user_id"], r["agent_id"], r["asset_id"], r["access_right"]): r["reason_code"]
            for r in out}


def test_filters_and_masks(spark, tables):
    rows = [(1, None, "s", "group", "all", "costs", "read"),
            (2, None, "s", "group", "all", "parts", "read"),
            (3, None, "s", "group", "all", "bad_template", "read"),
            (4, None, "s", "analyst", "all", "no_column", "read"),
            (5, None, "s", "boss", "all", "hr", "read"),
            (6, None, "s", "group", "all", "hr", "read")]
    out = {r["request_id"]: r for r in access.resolve_access(
        spark.createDataFrame(rows, schemas.ACCESS_REQUESTS), *tables).collect()}
    assert out[1]["row_filter"] == "(brand IN ('brand_a', 'brand_b', 'brand_c'))"
    assert out[2]["row_filter"] == "(owner = 'group' AND b IN ('brand_a','brand_b','brand_c'))"
    assert out[3]["filter_error"] == "TEMPLATE_UNKNOWN_PLACEHOLDER"
    assert out[4]["filter_error"] == "MISSING_BRAND_COLUMN"
    assert out[5]["masked_columns"] == [] and out[6]["masked_columns"] == ["name", "salary"]


def test_decision_counts_are_those_of_all_decisions(spark, tables):
    users, agents, assets, _ = tables
    every = (users.select("user_id").crossJoin(agents.select("agent_id"))
             .crossJoin(assets.select("asset_id"))
             .crossJoin(spark.createDataFrame([(r,) for r in L.ACCESS_RIGHTS],
                                              "access_right string"))
             .withColumn("request_id", F.monotonically_increasing_id()))
    want = access.resolve_access(every, *tables).groupBy(
        "agent_id", "access_right", "reason_code").count().collect()
    got = access.decision_counts(*tables).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_eligibility(spark, tables):
    rows = [(1, "analyst", "retrieval", ["quality"], "read"),
            (2, "analyst", "ghost", ["quality"], "read"),
            (3, "analyst", "restricted", ["hr"], "read"),
            (4, "analyst", "retrieval", ["quality", "hr", "costs"], "read"),
            (5, "analyst", "retrieval", [], "read"),
            (6, "analyst", "retrieval", ["hr", "absent"], "read"),
            (7, "group", "public", ["bad_template", "parts"], "read"),
            (8, "unranked", "retrieval", ["quality"], "read")]
    requests = spark.createDataFrame(rows, "request_id long, user_id string, agent_id string, "
                                           "asset_ids array<string>, access_right string")
    decisions = eligibility.check_eligibility(requests, *tables)
    out = {r["request_id"]: r for r in decisions.collect()}
    assert [out[i]["status"] for i in range(1, 9)] == [
        "eligible", "blocked", "ineligible", "eligible", "eligible", "ineligible", "eligible",
        "ineligible"]
    assert out[3]["outcome"] == "USER_BELOW_AGENT" and out[3]["reason_codes"] == []
    assert out[4]["allowed_asset_ids"] == ["quality", "costs"]
    assert out[4]["reason_codes"] == ["hr:AGENT_CEILING"]
    assert out[4]["applied_filters"]["costs"] == "(brand IN ('brand_b'))"
    assert out[7]["reason_codes"] == ["bad_template:TEMPLATE_UNKNOWN_PLACEHOLDER"]
    passed, stopped = eligibility.gate(decisions)
    assert passed.count() == 4 and stopped.count() == 4


def test_eligible_agents_are_those_found_one_by_one(spark, tables):
    users, agents, *_ = tables
    sessions = users.select(F.concat(F.lit("s_"), "user_id").alias("session_id"), "user_id",
                            F.lit("read").alias("access_right"),
                            F.array(F.lit("quality"), F.lit("parts")).alias("asset_ids"))
    pairs = sessions.crossJoin(agents.select("agent_id")).withColumn(
        "request_id", F.monotonically_increasing_id())
    want = eligibility.check_eligibility(pairs, *tables).where("status = 'eligible'")
    got = eligibility.eligible_agents(sessions, *tables)
    assert {(r["user_id"], r["agent_id"], r["outcome"]) for r in got.collect()} == {
        (r["user_id"], r["agent_id"], r["outcome"]) for r in want.collect()}


def test_latest_registration_wins(spark):
    log = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 1)],
                                "asset_id string, name string, seq int")
    assert {tuple(r) for r in policy.latest_assets(log).collect()} == {
        ("a", "new", 2), ("b", None, 1)}


def test_version_changes_with_any_change_and_not_with_order(tables):
    _, _, assets, consent = tables
    base = policy.policy_version(assets, consent).first()["version_id"]
    assert policy.policy_version(assets.orderBy(F.desc("asset_id")), consent.repartition(3)
                                 ).first()["version_id"] == base
    assert base.startswith("v:") and len(base) == 18
    flipped = consent.withColumn("granted", ~F.col("granted"))
    renamed = assets.withColumn("owner", F.lit("other"))
    versions = {policy.policy_version(a, c).first()["version_id"] for a, c in (
        (assets, flipped), (renamed, consent), (assets.where("asset_id <> 'hr'"), consent))}
    assert len(versions | {base}) == 4


def test_versions_tell_lists_and_nulls_apart(tables):
    _, _, assets, consent = tables
    one = assets.limit(1)
    variants = [one.withColumn("columns", F.array(*map(F.lit, x)).cast("array<string>"))
                for x in (["a", "b"], ["a,b"], [])]
    variants += [one.withColumn("tags", F.create_map(F.lit("k"), F.lit("v"))),
                 one.withColumn("brand_column", F.lit(None).cast("string")),
                 one.withColumn("brand_column", F.lit("~"))]
    found = [policy.policy_version(v, consent).first()["version_id"] for v in variants]
    assert len(set(found)) == len(found)
    nobody = consent.limit(1).withColumn("subject_id", F.lit(None).cast("string"))
    assert policy.policy_version(one, nobody).first() != policy.policy_version(
        one, nobody.withColumn("subject_id", F.col("asset_id"))).first()


def test_timeline_is_that_of_the_state(spark, tables):
    _, _, assets, _ = tables
    rows = [("u", "a", True, 0, 1), ("u", "a", True, 5, 2), ("u", "a", False, 90000, 3),
            ("v", "a", True, 90001, 4), ("u", "a", True, 200000, 5), ("v", "a", False, 200001, 6),
            ("v", "a", True, 300000, 7)]
    events = spark.createDataFrame(rows, "subject_id string, asset_id string, granted boolean, "
                                         "at long, seq int").withColumn("ts", F.timestamp_seconds("at"))
    got = [r["version_id"] for r in policy.policy_timeline(
        policy.consent_changes(events), assets).orderBy("seq").collect()]
    want = [policy.policy_version(assets, policy.latest_consent(events.where(F.col("seq") <= n)))
            .first()["version_id"] for n in range(1, 8)]
    assert got == want
    assert got[0] == got[1] != got[2] and got[4] == got[6]


@pytest.mark.parametrize("value, safe", [
    ("user_1.x-y", True), ("evil'; DROP TABLE users--", False), ("", False), ("ok\n", False),
    ("x" * 128, True), ("x" * 129, False), (None, False), ("naïve", False)])
def test_identifiers(spark, value, safe):
    df = spark.createDataFrame([(value, ["a"])], "id string, scope array<string>")
    good, bad = policy.split_identifiers(df, ["id"], ["scope"])
    assert (good.count(), bad.count()) == ((1, 0) if safe else (0, 1))


def test_levels_compare_by_rank(spark):
    df = spark.createDataFrame([(n,) for n in (*L.SENSITIVITY_LEVELS, "odd")], "n string")
    ranks = [r[0] for r in df.select(L.name_to_rank(F.col("n"))).collect()]
    assert ranks == [0, 1, 2, 3, 4, None]


@pytest.fixture
def parts(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = [(i, f"brand_{'abc'[i % 3]}", float(i)) for i in range(60)]
    spark.createDataFrame(rows, "id int, brand string, price double").write.parquet(path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan_and_masked_column_is_not_read(spark, parts):
    view = views.governed_view(spark.read.parquet(parts), brand_column="brand",
                               brands=["brand_b"], masked=["price"])
    text = plan(view.groupBy("brand").count())
    assert "In(brand, [brand_b])" in text or "EqualTo(brand,brand_b)" in text
    assert "price" not in text
    with pytest.raises(AnalysisException):
        view.select("price")


def test_laid_out_scan_lists_entitled_brands_alone(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"b{i % 6}" if i % 7 else None, i * 1.5) for i in range(60)],
                                 "id long, brand string, price double")
    users = spark.createDataFrame(
        [("u", 4, ["b1", "b1"]), ("v", 1, ["b2", "absent"]), ("w", None, [])],
        "user_id string, clearance_rank int, brand_scope array<string>")
    table = views.lay_out(rows, "brand", f"{tmp_path}/t", ["id"], files=2)
    out = views.laid_out_extract(table, users, "brand", ["price"])
    assert "dynamicpruning" in plan(out).lower()
    got = sorted(tuple(r) for r in out.select("user_id", "id", "brand", "price").collect())
    assert got == sorted((u, i, f"b{i % 6}", i * 1.5 if u == "u" else None)
                         for i in range(60) if i % 7 for u, b in (("u", 1), ("v", 2)) if i % 6 == b)
    scans = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scans


def test_only_touched_decisions_are_made_again(spark, tables):
    from wardline.operators import deltas
    users, agents, assets, consent = tables
    asked = [(i, u, a, s, "read") for i, (u, a, s) in enumerate(
        (u, a, s) for u in ("boss", "analyst", "group", "ghost", None)
        for a in ("retrieval", "all", "ghost", None)
        for s in ("telemetry", "quality", "hr", "absent", None))]
    requests = spark.createDataFrame(
        asked, "request_id long, user_id string, agent_id string, asset_id string, "
               "access_right string")
    old = deltas.Policy(users.where("user_id <> 'analyst'"), agents,
                        assets.where("asset_id <> 'hr'"),
                        consent.where("subject_id <> 'group'"))
    new = deltas.Policy(users, agents.where("agent_id <> 'all'"), assets, consent)
    before = access.resolve_access(requests, *old).checkpoint()
    columns = ("request_id", "reason_code", "allowed", "row_filter", "filter_error")
    after = {tuple(r) for r in deltas.refresh(before, old, new).select(*columns).collect()}
    assert after == {tuple(r) for r in access.resolve_access(requests, *new).select(
        *columns).collect()}
    touched = {r["request_id"] for r in deltas.mark_touched(
        requests, deltas.changes(old, new), ["request_id"]).where("touched").collect()}
    assert touched == {i for i, u, a, s, _ in asked if u == "analyst" or a == "all" or s == "hr"
                       or (u, s) == ("group", "telemetry")}
    same = deltas.changes(new, new)
    assert all(side.isEmpty() for side in same)


def test_entitlements_from_tables(spark):
    from wardline.operators import identity
    claims = spark.createDataFrame(
        [(1, ["a", "b", "a"], ["Reader", "Admin"], False), (2, ["a"], ["odd"], True),
         (3, [], [], False), (4, ["x", None], ["Reader", None], False)],
        "claim_id long, groups array<string>, roles array<string>, overage boolean").selectExpr(
        "*", "'USER' AS reason_code", "concat('u', claim_id) AS user_id", "'n' AS upn",
        "'n' AS name", "'t' AS tid", "'a' AS app_id")
    groups, levels = {"a": ["b2", "b1"], "b": ["b1", "b3"]}, {
        "Reader": "confidential", "Admin": "restricted", "odd": "no such level"}
    tables = (spark.createDataFrame([(g, b) for g, bs in groups.items() for b in bs],
                                    "group_name string, brand string"),
              spark.createDataFrame(list(levels.items()), "role string, level string"))
    for override in (None, F.when(F.col("claim_id") == 1, F.array(F.lit("b3"), F.lit("z")))):
        want = identity.user_contexts(claims, groups, levels, override).orderBy("claim_id")
        got = identity.user_contexts_from_tables(claims, *tables, override).orderBy("claim_id")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("tail", [
    "", "WHERE id > 1 OR 1 = 1", "ORDER BY id DESC", "GROUP BY ALL HAVING count(*) > 0",
    "WHERE brand = 'brand_a' OR true -- x"])
def test_no_query_widens_the_filter(spark, parts, tail):
    def build(session):
        return views.governed_view(session.read.parquet(parts), brand_column="brand",
                                   brands=["brand_b"], masked=["price"])
    out = views.run_governed_sql(spark, f"SELECT brand FROM parts {tail}", {"parts": build})
    assert {r["brand"] for r in out.collect()} == {"brand_b"}


@pytest.mark.parametrize("text", [
    "SELECT * FROM other", "DROP VIEW parts", "SET spark.sql.runSQLOnFiles=true",
    "SELECT price FROM parts", "SELECT * FROM parquet.`{path}`"])
def test_governed_session_knows_only_its_views(spark, parts, text):
    def build(session):
        return views.governed_view(session.read.parquet(parts), masked=["price"])
    spark.range(1).createOrReplaceTempView("other")
    with pytest.raises(Exception):
        views.run_governed_sql(spark, text.format(path=parts), {"parts": build}).collect()


@pytest.mark.parametrize("materialise", [False, True])
def test_failing_expression_does_not_reveal_hidden_rows(spark, parts, materialise):
    def build(session):
        return views.governed_view(session.read.parquet(parts), brand_column="brand",
                                   brands=["brand_b"], materialise=materialise)
    for text in ("SELECT id FROM parts WHERE 1 / (id - 3) > -5",
                 "SELECT 1 / (id - 3) AS x FROM parts",
                 "SELECT id FROM parts WHERE IF(id = 3, raise_error('seen'), true)"):
        assert views.run_governed_sql(spark, text, {"parts": build}).count() == 20


def test_entitlement_join_holds_once_materialised(spark, parts):
    """A semi join alone gives no such promise, so it is only offered written out first."""
    def build(session):
        entitled = session.sql("SELECT 'brand_b' AS brand")
        rows = session.read.parquet(parts).join(entitled, "brand", "left_semi")
        return views.governed_view(rows, materialise=True)
    for text in ("SELECT id FROM parts WHERE 1 / (id - 3) > -5",
                 "SELECT id FROM parts WHERE IF(id = 3, raise_error('seen'), true)"):
        assert views.run_governed_sql(spark, text, {"parts": build}).count() == 20


def test_empty_brand_list_sees_nothing_and_missing_column_is_refused(spark, parts):
    table = spark.read.parquet(parts)
    assert views.governed_view(table, brand_column="brand", brands=[]).count() == 0
    with pytest.raises(ValueError):
        views.governed_view(table, brand_column="nope", brands=["x"])


def test_few_files_are_spread_and_many_are_left(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    one = spread_few_files(spark.read.parquet(path), "id")
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert spread_few_files(many, "id") is many


def test_logs_are_read_back_with_the_declared_schema(spark, tables, tmp_path):
    rows = [("s1", "a1", datetime(2024, 1, 2, 3)), ("s2", "a1", datetime(2024, 1, 3, 4))]
    log = conform(spark.createDataFrame(
        rows, "session_id string, agent_id string, produced_at timestamp"), schemas.AGENT_OUTPUTS)
    for fmt in ("parquet", "orc"):
        path = str(tmp_path / fmt)
        append_with_date(log, path, "produced_at", fmt)
        append_with_date(log, path, "produced_at", fmt)
        back = conform(read_table(spark, path, fmt=fmt), schemas.AGENT_OUTPUTS)
        assert back.count() == 4 and back.schema == schemas.AGENT_OUTPUTS


@pytest.mark.parametrize("text", [
    "SELECT count(*) FROM global_temp.hidden_rows",
    "SELECT brand FROM parts) UNION ALL SELECT brand FROM (SELECT brand FROM global_temp.hidden_rows",
    "SELECT brand FROM parts WHERE brand IN (SELECT brand FROM global_temp.hidden_rows)",
    "SELECT (SELECT max(brand) FROM global_temp.hidden_rows)",
    "WITH x AS (SELECT * FROM global_temp.hidden_rows) SELECT * FROM x",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT upper(java_method('java.lang.System', 'getProperty', 'user.home')) FROM parts",
    "SELECT * FROM parts, LATERAL (SELECT count(*) FROM global_temp.hidden_rows)",
    "SELECT * FROM parts; SELECT 1", "DROP VIEW parts"])
def test_user_sql_stays_within_its_views(spark, text):
    rows = spark.createDataFrame([("a",), ("b",)], "brand string")
    rows.createOrReplaceGlobalTempView("hidden_rows")

    def build(session):
        return views.governed_view(session.createDataFrame([("a",), ("b",)], "brand string"),
                                   brand_column="brand", brands=["a"])

    with pytest.raises((views.UnsafeQuery, ParseException, AnalysisException)):
        views.run_governed_sql(spark, text, {"parts": build})
    for allowed in ("SELECT count(*) FROM parts", "WITH x AS (SELECT * FROM parts) SELECT 1 FROM x",
                    "SELECT brand FROM parts WHERE brand IN (SELECT max(brand) FROM parts) -- end"):
        assert views.run_governed_sql(spark, allowed, {"parts": build}).count() == 1


@pytest.mark.parametrize("user, scope, tags, column, template, code", [
    ("u1", ["b"], ["b"], "brand", None, "ALLOWED"),
    ("x' OR '1'='1", ["b"], ["b"], "brand", "owner = '{user_id}'", "UNSAFE_IDENTIFIER"),
    ("u1", ["b", "c') OR (1=1"], ["b"], "brand", "s IN ({brand_scope})", "UNSAFE_IDENTIFIER"),
    ("u1", ["b'x"], ["b'x"], "brand", None, "UNSAFE_IDENTIFIER"),
    ("u1", ["b"], ["b"], "brand OR 1=1 --", None, "UNSAFE_IDENTIFIER"),
    ("{brand_scope}", ["b"], ["b"], "brand", "owner = '{user_id}'", "UNSAFE_IDENTIFIER"),
    ("u1", ["b"], ["b"], "brand", "r = '{region}'", "TEMPLATE_UNKNOWN_PLACEHOLDER"),
    ("u1", ["b"], ["b"], None, None, "MISSING_BRAND_COLUMN")])
def test_filters_that_cannot_be_built_deny(spark, user, scope, tags, column, template, code):
    requests = spark.createDataFrame([(1, user, "g", "a", "read")],
                                     "request_id long, user_id string, agent_id string, "
                                     "asset_id string, access_right string")
    users = spark.createDataFrame([(user, 2, scope)],
                                  "user_id string, clearance_rank int, brand_scope array<string>")
    agents = spark.createDataFrame(
        [("g", 2, ["read"], [])], "agent_id string, ceiling_rank int, "
        "allowed_rights array<string>, allowed_sources array<string>")
    assets = spark.createDataFrame(
        [("a", "s", 1, tags, column, template, [], False)],
        "asset_id string, source string, sensitivity_rank int, brand_tags array<string>, "
        "brand_column string, row_filter_template string, pii_columns array<string>, "
        "consent_required boolean")
    consent = spark.createDataFrame([], "subject_id string, asset_id string, granted boolean")
    row = access.resolve_access(requests, users, agents, assets, consent).first()
    assert (row["reason_code"], row["allowed"]) == (code, code == "ALLOWED")
    assert (row["row_filter"] is None) == (code != "ALLOWED")
    counts = {r["reason_code"]: r["n"] for r in access.decision_counts(
        users, agents, assets, consent, ["read"]).collect()}
    assert counts == {code: 1}


def test_thousands_of_agents(spark):
    """No list of agents is made; each session meets those that its user outranks."""
    agents = spark.range(4000).selectExpr(
        "concat('g', id) AS agent_id", "CAST(id % 5 AS INT) AS ceiling_rank",
        "array('read') AS allowed_rights", "CAST(array() AS array<string>) AS allowed_sources")
    users = spark.createDataFrame([("u", 1, ["b"])], "user_id string, clearance_rank int, "
                                  "brand_scope array<string>")
    assets = spark.createDataFrame(
        [("a", "s", 0, [], None, None, [], False)],
        "asset_id string, source string, sensitivity_rank int, brand_tags array<string>, "
        "brand_column string, row_filter_template string, pii_columns array<string>, "
        "consent_required boolean")
    consent = spark.createDataFrame([], "subject_id string, asset_id string, granted boolean")
    sessions = spark.createDataFrame([("s", "u", "read", ["a"])], "session_id string, "
                                     "user_id string, access_right string, asset_ids array<string>")
    assert eligibility.eligible_agents(sessions, users, agents, assets, consent).count() == 1600
    counts = access.decision_counts(users, agents, assets, consent, ["read"])
    assert counts.groupBy("reason_code").sum("n").collect()[0][1] == 4000
