"""Tokens, cached results, session state and identity on small fixtures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.tokens import cache_key, query_hash
from wardline.operators import identity, ledger, policy, results, state, views
from wardline.sources import schemas

T0 = datetime(2024, 1, 1, 12)
QUERY = "SELECT model, defect_code, rate FROM quality.division_defect_rates"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def policy_rows(spark):
    users = spark.createDataFrame([
        ("analyst", [], ["brand_b"], 2, {}), ("outsider", [], ["bmw"], 2, {})], schemas.USERS)
    agents = spark.createDataFrame([
        ("a1", "retrieval", 2, ["read"], []), ("a2", "retrieval", 2, ["read"], [])],
        schemas.AGENTS)
    assets = spark.createDataFrame([
        ("quality", "q", "snowflake", "t", [], 2, ["read"], ["brand_b"], "brand", None,
         ["model"], False, "o", {}),
        ("open", "o", "postgres", "t", [], 0, ["read"], [], None, None, [], False, "o", {})],
        schemas.ASSETS)
    consent = spark.createDataFrame([], "subject_id string, asset_id string, granted boolean")
    timeline = policy.policy_timeline(policy.consent_changes(spark.createDataFrame(
        [("x", "quality", True, at(-50), 1), ("x", "quality", False, at(60), 2)],
        "subject_id string, asset_id string, granted boolean, ts timestamp, seq int")), assets)
    return users, agents, assets, consent, timeline


@pytest.fixture(scope="module")
def issued(spark, policy_rows):
    rows = [(1, at(0), "s1", "analyst", "a1", ["quality", "open"], "read", QUERY),
            (2, at(0), "s2", "analyst", "a1", ["open"], "read", QUERY),
            (3, at(0), "s3", "outsider", "a1", ["open", "quality", "absent"], "read", QUERY),
            (4, at(0), "s4", "analyst", "a1", [], "read", "x" * 300),
            (5, at(90), "s2", "analyst", "a1", ["open"], "read", QUERY)]
    requests = spark.createDataFrame(
        rows, "request_id long, ts timestamp, session_id string, user_id string, "
              "agent_id string, asset_ids array<string>, access_right string, query string")
    return ledger.issue_tokens(requests, *policy_rows, F.lit("secret"))


@pytest.fixture(scope="module")
def tokens(issued):
    return {r["request_id"]: r for r in issued[0].collect()}


def test_issue(issued, tokens):
    assert set(tokens) == {1, 2, 4, 5}
    one = tokens[1]
    assert one["row_filters"] == {"quality": "(brand IN ('brand_b'))"}
    assert one["masked_columns"] == {"quality": ["model"]}
    assert one["asset_ids"] == ["quality", "open"]
    assert one["expires_at"] - one["issued_at"] == timedelta(seconds=120)
    assert len(tokens[4]["query_preview"]) == 120 and tokens[4]["asset_ids"] == []
    assert one["policy_version"] == tokens[2]["policy_version"] != tokens[5]["policy_version"]
    denied = issued[1].collect()
    assert [(r["request_id"], r["asset_id"], r["reason_code"]) for r in denied] == [
        (3, "quality", "BRAND_SCOPE_MISMATCH")]


def test_issue_again_gives_the_same_tokens(issued, tokens):
    assert {r["request_id"]: r["token_id"] for r in issued[0].collect()} == {
        i: r["token_id"] for i, r in tokens.items()}


@pytest.fixture(scope="module")
def verdicts(spark, issued, tokens):
    one, two, five = (tokens[i]["token_id"] for i in (1, 2, 5))
    spaced = "  " + QUERY.replace(" ", " \n\t ") + " "
    rows = [
        (1, at(5), QUERY, "a2", one), (2, at(6), "SELECT * FROM t", "a1", one),
        (3, at(7), spaced, "a1", one), (4, at(8), QUERY, "a1", one),
        (5, at(7), QUERY, "a1", one), (6, at(120), QUERY, "a1", one),
        (7, at(5), QUERY, "a1", None), (8, at(5), QUERY, "a1", ""),
        (9, at(5), QUERY, "a1", "forged"), (10, at(19), QUERY, "a1", two),
        (11, at(20), QUERY, "a1", two), (12, at(95), QUERY, "a1", five),
        (13, at(80), QUERY, "a1", five), (14, None, QUERY, "a1", one), (15, at(9), QUERY, None, one)]
    calls = spark.createDataFrame(
        rows, "call_id long, ts timestamp, query string, agent_id string, token_id string")
    revoked = spark.createDataFrame(
        [("token", two, at(20)), ("token", two, at(99)), ("session", "s2", at(85))],
        schemas.REVOCATIONS)
    checked = ledger.check_calls(calls, issued[0], revoked)
    return calls, checked, {r["call_id"]: r for r in ledger.judge_calls(checked).collect()}


def test_verdicts(verdicts):
    assert {i: r["verdict"] for i, r in verdicts[2].items()} == {
        1: "WRONG_AGENT", 2: "QUERY_MISMATCH", 3: "ALLOWED", 4: "REPLAYED", 5: "REPLAYED",
        6: "TOKEN_EXPIRED", 7: "UNGOVERNED", 8: "UNGOVERNED", 9: "TOKEN_UNKNOWN", 10: "ALLOWED",
        11: "TOKEN_REVOKED", 12: "SESSION_REVOKED", 13: "TOKEN_NOT_YET_VALID",
        14: "TOKEN_UNKNOWN", 15: "WRONG_AGENT"}


def test_results_of_calls(verdicts):
    out = {r["call_id"]: r for r in ledger.call_results(ledger.judge_calls(verdicts[1])).collect()}
    assert out[3]["success"] and out[3]["governed"] and out[3]["error"] is None
    assert out[3]["filters_applied"] == {"quality": "(brand IN ('brand_b'))"}
    assert not out[4]["success"] and out[4]["error"] == "REPLAYED"
    assert not out[7]["governed"]


def test_stale_policy(verdicts, policy_rows):
    out = {r["call_id"]: r["policy_stale"]
           for r in ledger.mark_stale(verdicts[1], policy_rows[4], verdicts[0]).collect()}
    assert out[3] is False and out[6] is True and out[9] is None


def test_query_hash_keeps_case(spark):
    df = spark.createDataFrame([("a  b", "a b", "A b")], "x string, y string, z string")
    x, y, z = df.select(query_hash(F.col("x")), query_hash(F.col("y")),
                        query_hash(F.col("z"))).first()
    assert x == y != z


def replay_cache(log):
    """Plain replay of a log of writes, reads and invalidations in order."""
    store, out = {}, {}
    for kind, i, ts, user, version, rank, live in log:
        key = (version, user)
        if kind == "write":
            ttl = results.TTL_SECONDS[rank]
            if ttl:
                store[key] = (i, ts + timedelta(seconds=ttl), version)
        elif kind == "drop":
            for k in [k for k in store if k[1] == user or k[0] == version]:
                del store[k]
        elif key not in store:
            out[i] = "MISS_KEY"
        elif ts > store[key][1]:
            out[i] = "MISS_EXPIRED"
        elif live is not None and live != store[key][2]:
            out[i] = "MISS_VERSION"
            del store[key]
        else:
            out[i] = ("HIT", store[key][0])
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_seconds": 900, "parts": 50, "min_rows": 3}])
def test_cache_lookups_agree_with_a_plain_replay(spark, options):
    rng = random.Random(11)
    log, when = [], 0
    for i in range(900):
        when += rng.choice([1, 20, 200])
        kind = rng.choices(["write", "read", "drop"], [5, 12, 1])[0]
        user, version = rng.choice("uuuvw"), rng.choice(["v:1", "v:1", "v:2"])
        if kind == "drop":
            user, version = rng.choice([(user, None), (None, version)])
        log.append((kind, i, at(when), user, version, rng.randint(0, 4),
                    rng.choice([None, None, None, "v:9"])))
    df = spark.createDataFrame(log, "kind string, id int, ts timestamp, user_id string, "
                                    "policy_version string, sensitivity_rank int, "
                                    "live_version string"
                               ).withColumn("agent_id", F.lit("a")).withColumn("query", F.lit("q"))
    writes = df.where("kind = 'write'").withColumnRenamed("id", "write_id").drop("live_version")
    reads = df.where("kind = 'read'").withColumnRenamed("id", "read_id")
    drops = df.where("kind = 'drop'").select("ts", "user_id", "policy_version")
    got = results.cache_lookups(reads, writes, drops, **options).collect()
    assert {r["read_id"]: ("HIT", r["write_id"]) if r["lookup"] == "HIT" else r["lookup"]
            for r in got} == replay_cache(log)
    lookups = results.cache_lookups(reads, writes, drops)
    rate = results.hit_rate(lookups).first()
    assert rate["hits"] + rate["misses"] == rate["reads"] == reads.count()
    assert results.cache_stats(lookups).agg(F.sum("n_reads")).first()[0] == reads.count()


def test_cache_keys_are_scoped(spark):
    rows = [("v:1", "u1", "a1", " q "), ("v:1", "u1", "a1", "q"), ("v:1", "u2", "a1", "q"),
            ("v:1", "u1", "a2", "q"), ("v:2", "u1", "a1", "q"), ("v:1", "u1", "a1", "q  q")]
    df = spark.createDataFrame(rows, "v string, u string, a string, q string")
    keys = [r[0] for r in df.select(cache_key(*map(F.col, "vuaq"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 5


def test_identity_clash_is_a_miss(spark):
    writes = spark.createDataFrame([(1, at(0), "u:x", "a", "q", "v:1", 1)],
                                   "write_id int, ts timestamp, user_id string, agent_id string, "
                                   "query string, policy_version string, sensitivity_rank int")
    reads = spark.createDataFrame([(1, at(1), "u", "x:a", "q", "v:1"),
                                   (2, at(2), "u:x", "a", "q", "v:1")],
                                  "read_id int, ts timestamp, user_id string, agent_id string, "
                                  "query string, policy_version string")
    got = {r["read_id"]: r["lookup"] for r in results.cache_lookups(reads, writes).collect()}
    assert got == {1: "MISS_IDENTITY", 2: "MISS_KEY"}


def test_payload_opens_only_with_its_key(spark):
    rows = spark.createDataFrame([("k" * 16, "x" * 16, "secret", 5)],
                                 "k string, wrong string, a string, b int")
    sealed = results.seal(rows, ["a", "b"], F.col("k").cast("binary"))
    schema = T.StructType().add("a", "string").add("b", "integer")
    assert "a" not in sealed.columns and b"secret" not in sealed.first()["payload"]
    opened = results.unseal(sealed, schema, F.col("k").cast("binary")).first()
    assert tuple(opened["data"]) == ("secret", 5)
    assert results.unseal(sealed, schema, F.col("wrong").cast("binary")).first()["data"] is None


@pytest.fixture(scope="module")
def shared(spark):
    data = {"model": "A4", "rate": "0.02", "salary": "85000", "email": "a@b.com"}
    outputs = spark.createDataFrame([
        ("s", "writer", "query_result", 1, 0, data, 1, at(1)),
        ("s", "writer", "summary", 3, 0, {"t": "x"}, 1, at(3)),
        ("s", "other", "query_result", 2, 0, data, 3, at(2)),
        ("s", "reader", "query_result", 4, 0, data, 1, at(4)),
        ("s", "writer", "secret_type", 5, 0, data, 1, at(5)),
        ("t", "writer", "query_result", 1, 0, data, 1, at(1))], schemas.AGENT_OUTPUTS)
    requests = spark.createDataFrame([
        (1, "s", "reader", ["query_result", "summary"], {"query_result": ["model", "rate"]}, 1,
         at(9)),
        (2, "s", "writer", ["summary"], {}, 4, at(9)),
        (3, "u", "reader", ["query_result"], {}, 4, at(9))], schemas.CONTEXT_REQUESTS)
    return requests, outputs


def test_reads_get_declared_types_and_fields_only(shared):
    got = {(r["request_id"], r["from_agent"], r["output_type"]): r["data"]
           for r in state.read_state(*shared).collect()}
    assert got == {(1, "writer", "query_result"): {"model": "A4", "rate": "0.02"},
                   (1, "writer", "summary"): {"t": "x"}}


def test_log_holds_every_read(shared):
    log = {r["request_id"]: r for r in state.access_log(*shared).collect()}
    assert log[1]["received_types"] == ["query_result", "summary"]
    assert log[1]["violations"] == ["other/query_result:restricted"]
    assert log[2]["received_types"] == [] and log[3]["n_excluded"] == 0
    assert [r["agent_id"] for r in state.read_violations(*shared).collect()] == ["other"]


def test_cleared_outputs_are_gone_and_later_ones_stay(spark, shared):
    clears = spark.createDataFrame([("s", "writer", at(3)), ("s", "writer", at(2))],
                                   "session_id string, agent_id string, cleared_at timestamp")
    left = state.clear_outputs(shared[1], clears)
    assert {(r["session_id"], r["out_seq"]) for r in left.collect()} == {
        ("s", 2), ("s", 4), ("s", 5), ("t", 1)}


def test_written_outputs_can_be_read(spark, shared, tmp_path):
    path = str(tmp_path / "outputs")
    state.write_outputs(shared[1], path)
    back = spark.read.parquet(path)
    assert state.read_state(shared[0], back).count() == 2


GROUPS = {"Division-A-Analysts": ["brand_b"], "Division-B-Team": ["brand_c"],
          "Corp-Group-All": ["brand_a", "brand_b", "brand_c", "brand_d", "brand_e"]}


def claim(**fields):
    base = dict(claim_id=1, oid="o1", sub="s1", name="n", tid="t", groups=[], roles=[],
                scp="a  b", azp=None, appid="app", aud="c", iss="i", exp=200, iat=50,
                preferred_username="p", overage=None)
    return {**base, **fields}


@pytest.fixture
def resolve(spark):
    def run(override=None, **fields):
        row = claim(**fields)
        df = spark.createDataFrame([tuple(row.get(f) for f in schemas.CLAIMS.names)],
                                   schemas.CLAIMS)
        checked = identity.check_claims(identity.claim_view(df), F.lit(100), "c", "t")
        users = identity.user_contexts(checked, GROUPS, override=override)
        return checked.first(), users.first()
    return run


@pytest.mark.parametrize("fields, code", [
    ({}, "USER"), ({"exp": 100}, "CLAIM_EXPIRED"), ({"exp": 90}, "CLAIM_EXPIRED"),
    ({"aud": "x"}, "AUDIENCE_MISMATCH"), ({"tid": "x"}, "TENANT_MISMATCH"),
    ({"iat": None}, "CLAIM_MISSING"), ({"iat": 101}, "CLAIM_NOT_YET_VALID"),
    ({"oid": None}, "APP_ONLY"), ({"idtyp": "app"}, "APP_ONLY"), ({"oid": ""}, "USER"),
    ({"oid": "", "sub": None}, "NO_IDENTITY"), ({"oid": "a b"}, "UNSAFE_IDENTIFIER")])
def test_claim_checks(resolve, fields, code):
    assert resolve(**fields)[0]["reason_code"] == code


@pytest.mark.parametrize("fields, scope, rank", [
    ({"groups": ["Division-A-Analysts"], "roles": ["DataAnalyst"]}, ["brand_b"], 2),
    ({"groups": ["Division-B-Team", "Division-A-Analysts"], "roles": ["DataReader", "DataAdmin"]},
     ["brand_b", "brand_c"], 3),
    ({"groups": ["unknown"], "roles": ["unknown"]}, [], 1),
    ({"groups": ["Corp-Group-All"], "overage": True}, [], 1),
    ({"groups": None, "roles": None}, [], 1)])
def test_entitlements(resolve, fields, scope, rank):
    user = resolve(**fields)[1]
    assert (user["brand_scope"], user["clearance_rank"]) == (scope, rank)


def test_claim_defaults(resolve):
    row, user = resolve(oid="")
    assert row["upn"] == "p" and row["app_id"] == "app" and row["scopes"] == ["a", "b"]
    assert user["user_id"] == "s1" and user["metadata"]["source"] == "entra_id"


def test_override_narrows_and_never_widens(resolve):
    override = F.array(F.lit("brand_b"), F.lit("brand_z"))
    assert resolve(override, groups=["Corp-Group-All"])[1]["brand_scope"] == ["brand_b"]
    assert resolve(override, groups=[])[1]["brand_scope"] == []


def test_delegation_loses_entitlements_and_says_so(spark):
    users = spark.createDataFrame([(1, "u", ["r"], ["brand_b"], 3, {"upn": "x"})],
                                  "claim_id int, user_id string, roles array<string>, "
                                  "brand_scope array<string>, clearance_rank int, "
                                  "metadata map<string,string>")
    got = identity.degrade_on_behalf_of(users).first()
    assert (got["roles"], got["brand_scope"], got["clearance_rank"]) == ([], [], 1)
    assert got["metadata"] == {"upn": "x", "obo_degraded": "true",
                               "original_clearance": "restricted",
                               "original_brand_scope": "brand_b"}


def test_delegated_sessions_name_their_original(spark):
    users = spark.createDataFrame([(1, "u")], "claim_id int, user_id string")
    originals = spark.createDataFrame([("s0", "u", ["brand_b"], 3)], "session_id string, "
                                      "user_id string, brand_scope array<string>, "
                                      "clearance_rank int")
    requests = spark.createDataFrame(
        [(1, 1, at(0), "x", "s0"), (2, 1, at(1), "x", None), (3, 1, at(2), "x", "gone")],
        "request_id int, claim_id int, ts timestamp, request_intent string, "
        "original_session_id string")
    got = {r["request_id"]: r for r in identity.on_behalf_sessions(
        requests, users, originals).collect()}
    assert got[1]["metadata"]["original_session_id"] == "s0"
    assert got[1]["metadata"]["original_clearance"] == "restricted"
    assert got[1]["brand_scope"] == [] and got[1]["clearance_rank"] == 1
    assert set(got[2]["metadata"]) == set(got[3]["metadata"]) == {"auth_source", "obo_degraded"}


def test_a_step_reads_before_it_writes(spark, shared):
    requests, outputs = shared
    produced = spark.createDataFrame([
        ("s", "writer", "summary", 6, 0, {"t": "late"}, 1, at(6))], schemas.AGENT_OUTPUTS)
    seen, after = state.step(requests, outputs, produced)
    assert seen.count() == 2 and after.count() == outputs.count() + 1
    assert state.read_state(requests, after).count() == 3


def test_rows_of_calls_are_spread_over_tasks(spark):
    """One read with most of the result is not the work of one task."""
    reads = spark.range(300).select(F.col("id").alias("call_id"), F.when(
        F.col("id") < 290, "hot").otherwise(F.concat(F.lit("r"), "id")).alias("read_id"))
    rows = spark.range(200).select(
        F.when(F.col("id") < 190, "hot").otherwise(F.concat(F.lit("r"), F.col("id") + 100))
        .alias("read_id"), F.col("id").alias("p_partkey"))
    got = views.rows_of_calls(reads, rows, "p_partkey", side=20)
    want = reads.join(rows, "read_id")
    assert sorted(map(tuple, got.select("call_id", "p_partkey").collect())) == sorted(
        map(tuple, want.select("call_id", "p_partkey").collect()))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.1 * want.count()
    assert views.rows_of_calls(reads.limit(0), rows, "p_partkey").count() == 0
