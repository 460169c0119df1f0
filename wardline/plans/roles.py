"""Policy tables and facts derived from the star schema and text tables.

The data hold no agents, brands in scope or tokens, so each role is derived from a whole
table by arithmetic on its keys. `oracles.py` derives the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.ledger import token_id
from wardline.operators.skew import salted_join
from wardline.plans.seeds import SEEDS
from wardline.sources.tables import spread_few_files

# The registered agents.
AGENTS = (
    ("agent_0", "retrieval", 2, ("read", "aggregate"), ()),
    ("agent_1", "retrieval", 3, ("read",), ("postgres", "snowflake")),
    ("agent_2", "summarisation", 1, ("read",), ()),
    ("agent_3", "output", 0, ("read", "export"), ()),
    ("agent_4", "analysis", 4, ("read", "write", "aggregate", "export", "admin"), ()),
    ("agent_5", "retrieval", 2, ("read", "aggregate"), ("delta_lake",)),
    ("agent_6", "retrieval", 3, ("read", "write", "aggregate", "export"), ()),
    ("agent_7", "analysis", 3, ("aggregate",), ("postgres", "delta_lake")),
)

# Brands per group of the claims.
GROUP_BRANDS = {
    "BUILDING": ("brand_b",),
    "MACHINERY": ("brand_a", "brand_b", "brand_c", "brand_d", "brand_e"),
    "AUTOMOBILE": ("brand_a",),
    "nation_1": ("brand_c", "brand_b"),
}

TTL_SECONDS = 600
SECRET = "a secret of the test tables"
CLAIMS_NOW = 1_700_000_100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _strings(*values: Column | str) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]).cast("array<string>")


def agents(spark: SparkSession) -> DataFrame:
    """The configured agents as an inline table."""
    def array(values: tuple[str, ...]) -> str:
        return "CAST(array(%s) AS array<string>)" % ", ".join(f"'{v}'" for v in values)
    rows = ", ".join(f"('{i}', '{t}', {c}, {array(r)}, {array(s)})" for i, t, c, r, s in AGENTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(agent_id, agent_type, ceiling_rank, "
                     "allowed_rights, allowed_sources)")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part registers the asset of its brand; the highest part key is the latest."""
    return table(spark, sf_dir, "part").select(
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("asset_id"),
        "p_type", "p_size", F.col("p_partkey").alias("seq"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per brand."""
    brands = (table(spark, sf_dir, "part").select("p_brand").distinct()
              .withColumn("n", F.substring("p_brand", 7, 10).cast("int")))
    n = F.col("n")
    return brands.select(
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("asset_id"),
        F.col("p_brand").alias("name"),
        _pick(["snowflake", "delta_lake", "postgres"], n % 3).alias("source"),
        _name("parts.b", n).alias("table"),
        _strings("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").alias("columns"),
        (n % 4).alias("sensitivity_rank"), _strings("read").alias("required_rights"),
        F.when(n % 6 == 0, _strings()).otherwise(
            _strings(_name("Brand_", n), _name("group_", n % 5))).alias("brand_tags"),
        F.when(n % 11 != 0, F.lit("p_brand")).alias("brand_column"),
        F.when(n % 8 == 3, "p_owner = '{user_id}'")
        .when(n % 8 == 5, "p_scope IN ({brand_scope}) AND p_owner <> '{user_id}'")
        .when(n % 8 == 7, "p_region = '{region}'").alias("row_filter_template"),
        F.when(n % 2 == 0, _strings("p_name", "p_retailprice")).otherwise(_strings())
        .alias("pii_columns"),
        (n % 7 == 0).alias("consent_required"), F.lit("parts_domain").alias("owner"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("tags"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users."""
    s = F.col("c_nationkey") % 5
    return table(spark, sf_dir, "customer").select(
        _name("user_", F.col("c_custkey")).alias("user_id"),
        _strings(F.col("c_mktsegment")).alias("roles"),
        F.when(s == 0, _strings()).otherwise(
            _strings(_name("group_", s), _name("Brand_", F.col("c_nationkey") + 1)))
        .alias("brand_scope"),
        (F.col("c_custkey") % 5).cast("int").alias("clearance_rank"))


def consent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a consent of its customer, given when the order is finished."""
    return table(spark, sf_dir, "orders").select(
        _name("user_", F.col("o_custkey")).alias("subject_id"),
        _name("Brand_", 1 + F.col("o_orderkey") % 25).alias("asset_id"),
        (F.col("o_orderstatus") == "F").alias("granted"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


def shipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the subject and asset of their order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        _name("user_", F.col("o_custkey")).alias("subject_id"),
        _name("Brand_", 1 + F.col("o_orderkey") % 25).alias("asset_id"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return salted_join(items, orders, ["l_orderkey"], ["l_orderkey", "l_linenumber"], "inner")


def _user(column: str = "user_id") -> Column:
    return _name("user_", F.col(column) * 11)


def agent_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event registers its agent anew; the highest event is the latest."""
    return table(spark, sf_dir, "events").select(
        _name("agent_", F.col("event_id") % 9).alias("agent_id"),
        F.col("event_type").alias("agent_type"),
        (F.col("user_id") % 5).cast("int").alias("ceiling_rank"), F.col("event_id").alias("seq"))


def _session(user: Column) -> Column:
    return F.concat(user, F.lit("_"), F.date_format("ts", "yyyyMMdd"))


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}")


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for one asset; some name an unknown user, agent or asset."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "ts", _session(_user()).alias("session_id"),
        _user().alias("user_id"), _name("agent_", F.col("event_id") % 9).alias("agent_id"),
        _name("Brand_", 1 + _div("event_id", 9) % 26).alias("asset_id"),
        F.when(F.col("event_type") == "purchase", "aggregate")
        .when(F.col("event_type") == "error", "write").otherwise("read").alias("access_right"))


def eligibility_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for two assets, and an error for none."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), _user().alias("user_id"),
        _name("agent_", F.col("event_id") % 9).alias("agent_id"), F.lit("read")
        .alias("access_right"),
        F.when(F.col("event_type") == "error", _strings()).otherwise(_strings(
            _name("Brand_", 1 + _div("event_id", 9) % 26),
            _name("Brand_", 1 + _div("event_id", 4) % 25))).alias("asset_ids"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user and day, asking for one asset by the number of its events."""
    events = table(spark, sf_dir, "events").select(
        _session(_user()).alias("session_id"), _user().alias("user_id"))
    return (events.groupBy("session_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
            .select("session_id", "user_id", F.lit("read").alias("access_right"),
                    _strings(_name("Brand_", 1 + F.col("n") % 25), "Brand_6")
                    .alias("asset_ids")))


def token_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events in a row share the token that their first one asks for."""
    g = F.col("request_id")
    return (table(spark, sf_dir, "events").select(
        _div("event_id", 3).alias("request_id"), "event_id", "ts", "user_id")
        .groupBy("request_id").agg(F.min("ts").alias("ts"),
                                   F.min_by("user_id", "event_id").alias("user_id"))
        .select(
            "request_id", "ts", _session(_user()).alias("session_id"), _user().alias("user_id"),
            _name("agent_", g % 8).alias("agent_id"), F.lit("read").alias("access_right"),
            _strings(_name("Brand_", 1 + g % 25)).alias("asset_ids"),
            F.concat(F.lit("SELECT p_name FROM parts.b"), (1 + g % 25).cast("string"),
                     F.lit(" WHERE p_size > "), (g % 50).cast("string")).alias("query")))


def _token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = token_requests(spark, sf_dir)
    return wanted.select("request_id", "query", token_id(F.lit(SECRET)).alias("token_id"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event calls with the token of its three; some change agent, query or drop it."""
    events = table(spark, sf_dir, "events").withColumn("request_id", _div("event_id", 3))
    g, q = F.col("request_id"), F.col("query")
    return events.join(_token_ids(spark, sf_dir), "request_id").select(
        F.col("event_id").alias("call_id"), "ts", F.lit("query").alias("tool"),
        F.lit("parts").alias("source"),
        F.when((F.col("event_type") == "signup") & (F.col("value") > 70),
               F.concat(q, F.lit(" OR 1=1")))
        .when(F.col("event_type") == "click", F.concat(
            F.lit("  "), F.replace(q, F.lit(" "), F.lit(" \t ")), F.lit("\n"))).otherwise(q)
        .alias("query"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 70),
               _name("agent_", (g + 1) % 8)).otherwise(_name("agent_", g % 8)).alias("agent_id"),
        F.when(F.col("value") >= 2.5, F.col("token_id")).alias("token_id"))


def revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error revokes the session of its user, and a costly one its token as well."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    sessions = errors.select(F.lit("session").alias("kind"), _session(_user()).alias("id"), "ts")
    tokens = (errors.where("value > 100").select(_div("event_id", 3).alias("request_id"), "ts")
              .join(_token_ids(spark, sf_dir), "request_id")
              .select(F.lit("token").alias("kind"), F.col("token_id").alias("id"), "ts"))
    return sessions.unionByName(tokens)


def policy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup gives or takes back a consent and so may change the policy."""
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        _user().alias("subject_id"),
        _name("Brand_", 1 + F.col("event_id") % 3).alias("asset_id"),
        (F.col("event_id") % 2 == 0).alias("granted"), "ts", F.col("event_id").alias("seq"))


def seeded(rows: DataFrame, text: str, number: Column) -> DataFrame:
    """Append the seed of the row's number, where there is one, to its whole text."""
    seed = F.get(F.array(*[F.lit(s) for s in SEEDS]), (number % 40).cast("int"))
    return rows.withColumn(text, F.concat_ws(" ", text, seed))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_few_files(table(spark, sf_dir, "documents"), "doc_id")
    return seeded(rows, "text", F.col("doc_id"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_few_files(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return seeded(rows, "text", F.col("conv_id") + F.col("turn"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_few_files(table(spark, sf_dir, "pages"), "page_id")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is passed on to a receiver."""
    return conversations(spark, sf_dir).select(
        "conv_id", "turn", F.col("role").alias("source_agent"), "text",
        ((F.col("conv_id") + F.col("turn")) % 4).cast("int").alias("ceiling_rank"))


def free_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as JSON whose keys and nesting differ from turn to turn."""
    turns = conversations(spark, sf_dir)
    role, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shape = F.col("turn") % 3
    content = (F.when(shape == 0, F.to_json(F.create_map(
                   F.lit("role"), role, F.concat(role, F.lit("_says")), said)))
               .when(shape == 1, F.to_json(F.struct(F.struct(
                   F.col("turn").alias("no"), F.array(said, role).alias("parts")).alias("turn"))))
               .otherwise(F.to_json(F.struct(F.struct(said.alias("text")).alias("a.b")))))
    return turns.select("conv_id", "turn", content.alias("content"),
                        ((F.col("conv_id") + F.col("turn")) % 4).cast("int").alias("ceiling_rank"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is an output of its role."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        _name("conv_", F.col("conv_id")).alias("session_id"), F.col("role").alias("agent_id"),
        _pick(["summary", "query_result", "analysis"], (turn % 3).cast("int"))
        .alias("output_type"),
        turn.alias("out_seq"), F.lit(0).cast("long").alias("row_seq"),
        F.create_map(F.lit("text"), F.col("text"), F.lit("turn"), turn.cast("string"),
                     F.lit("role"), F.col("role")).alias("data"),
        ((F.col("conv_id") + turn) % 5).cast("int").alias("sensitivity_rank"),
        F.timestamp_seconds(1_704_067_200 + turn * 60).alias("produced_at"))


def context_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every role of a conversation reads once, some while the conversation goes on."""
    return (table(spark, sf_dir, "conversations").groupBy("conv_id", "role")
            .agg(F.min("turn").alias("first_turn")).select(
        (F.col("conv_id") * 100 + F.col("first_turn")).alias("request_id"),
        _name("conv_", F.col("conv_id")).alias("session_id"),
        F.col("role").alias("requesting_agent_id"),
        _strings("summary", "query_result").alias("needed_types"),
        F.create_map(F.lit("query_result"), _strings("turn", "role")).alias("needed_fields"),
        (F.col("conv_id") % 4).cast("int").alias("ceiling_rank"),
        F.timestamp_seconds(1_704_067_200 + 60 * F.when(
            F.col("conv_id") % 2 == 0, F.col("first_turn") + 1).otherwise(10_000)).alias("ts")))


def output_clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn ranked secret clears what its role has written so far."""
    return outputs(spark, sf_dir).where("sensitivity_rank = 4").select(
        "session_id", "agent_id", F.col("produced_at").alias("cleared_at"))


def _cache_columns() -> list[Column]:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    version = F.concat(F.lit("v:"), F.substring(
        F.sha2(F.floor(day / 4).cast("string"), 256), 1, 16))
    return [_name("user_", F.col("user_id") % 3).alias("user_id"),
            F.lit("agent_0").alias("agent_id"), F.lit(" SELECT 1 ").alias("query"),
            version.alias("policy_version")]


def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')").select(
        F.col("event_id").alias("write_id"), "ts", *_cache_columns(),
        (F.col("event_id") % 5).cast("int").alias("sensitivity_rank"))


def cache_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _cache_columns()
    other = F.when((F.col("event_type") == "view") & (F.col("value") > 100), F.lit("v:other"))
    return table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select(
        F.col("event_id").alias("read_id"), "ts", *columns, other.alias("live_version"))


def cache_invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error drops the entries of its user, and a costly one those of the version."""
    user, _, _, version = _cache_columns()
    costly = F.col("value") > 70
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        "ts", F.when(~costly, user).alias("user_id"),
        F.when(costly, version).alias("policy_version"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as verified claim records, some incomplete, expired or of applications."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("claim_id"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, "").otherwise(_name("oid-", k))
        .alias("oid"),
        F.when(k % 38 != 0, _name("sub-", k)).alias("sub"),
        F.when(k % 3 != 0, _name("upn-", k)).alias("upn"),
        F.when(k % 2 == 0, _name("pref-", k)).alias("preferred_username"),
        F.col("c_name").alias("name"),
        F.when(k % 29 == 0, "other").otherwise("tenant").alias("tid"),
        _strings(F.col("c_mktsegment"), _name("nation_", n % 5)).alias("groups"),
        F.when(n % 4 == 0, _strings("DataReader")).when(
            n % 4 == 1, _strings("DataReader", "DataAdmin")).when(
            n % 4 == 2, _strings()).otherwise(_strings("DataAnalyst", "Bogus")).alias("roles"),
        F.lit("data.read  data.write").alias("scp"),
        F.when(k % 2 == 1, "azp").alias("azp"), F.lit("appid").alias("appid"),
        F.when(k % 13 == 0, "app").alias("idtyp"),
        F.when(k % 31 == 0, "wrong").otherwise("client").alias("aud"),
        F.lit("issuer").alias("iss"), (F.lit(1_700_000_000) + k).alias("exp"),
        F.lit(1_699_990_000).cast("long").alias("iat"), (k % 23 == 0).alias("overage"))
