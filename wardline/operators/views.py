"""Governed reads: row filters and column masks below the user's query."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.operators.skew import salted_join


def governed_view(table: DataFrame, *, brand_column: str | None = None,
                  brands: Sequence[str] | None = None, row_filter: str | Column | None = None,
                  masked: Sequence[str] = (), materialise: bool = False) -> DataFrame:
    """Table without the rows and columns the user may not see.

    `brands` is None for an unrestricted table; an empty list sees no row. The filter is a
    literal predicate on the relation, so it reaches the scan and no text above widens it.
    `materialise` checkpoints the rows first, for users whose expressions may fail on rows
    they must not learn about.
    """
    view = table
    if brands is not None:
        if brand_column is None or brand_column not in table.columns:
            raise ValueError("a brand filter needs a brand column of the table")
        view = view.where(F.col(brand_column).isin(list(brands)))
    if row_filter is not None:
        view = view.where(F.expr(row_filter) if isinstance(row_filter, str) else row_filter)
    view = view.drop(*masked)
    return view.checkpoint() if materialise else view


def governed_read(token: Mapping, tables: Mapping[str, DataFrame],
                  materialise: bool = False) -> dict[str, DataFrame]:
    """The views that an allowed call reads, one per asset of its token's ledger row.

    `token` has `asset_ids`, `row_filters` and `masked_columns`, as `ledger.issue_tokens` wrote
    them; `tables` gives the table of each asset. Filters hold validated names only. An asset
    without a table here is an error, not an unfiltered read.
    """
    filters, masks = token["row_filters"] or {}, token["masked_columns"] or {}
    return {asset: governed_view(tables[asset], row_filter=filters.get(asset),
                                 masked=masks.get(asset) or (), materialise=materialise)
            for asset in token["asset_ids"]}


def call_reads(judged: DataFrame, ledger: DataFrame) -> DataFrame:
    """What each allowed call reads: one row per asset of its token, with filter and masks.

    `read_id` names an asset, filter and set of masks, which many calls may share.
    """
    allowed = judged.where(F.col("verdict") == "ALLOWED").select("call_id", "token_id")
    both = allowed.join(ledger.select("token_id", "asset_ids", "row_filters", "masked_columns"),
                        "token_id")
    reads = both.withColumn("asset_id", F.explode(F.array_distinct("asset_ids"))).select(
        "call_id", "asset_id", F.try_element_at("row_filters", F.col("asset_id")).alias("row_filter"),
        F.coalesce(F.try_element_at("masked_columns", F.col("asset_id")),
                   F.array().cast("array<string>")).alias("masked"))
    return reads.withColumn("read_id", F.sha2(F.concat_ws(
        "|", "asset_id", F.coalesce("row_filter", F.lit("")), F.array_join("masked", ",")), 256))


def brands_of_filter(brand_column: str) -> Column:
    """The brands of a ledger's `row_filter` that names brands alone; null for any other filter."""
    inner = F.regexp_extract("row_filter", rf"^\({brand_column} IN \('([A-Za-z0-9_.,' -]*)'\)\)$", 1)
    return F.when(inner != "", F.split(inner, "', '"))


def governed_reads(reads: DataFrame, table: DataFrame, brand_column: str) -> DataFrame:
    """The rows of `table` that each different read of `call_reads` gives, masked cells nulled.

    Reads without a filter see all rows. One whose filter names other columns than the brand sees
    none, since the table has no such columns. Rows are kept per read and not per call.
    """
    sets = reads.dropDuplicates(["read_id"]).select(
        "read_id", "masked", "row_filter", brands_of_filter(brand_column).alias("brands"))
    free = table.crossJoin(sets.where("row_filter IS NULL").select("read_id", "masked"))
    named = sets.select("read_id", "masked", F.explode(F.array_distinct("brands")).alias(brand_column))
    bound = table.join(named, brand_column)
    return free.unionByName(bound).select("read_id", *[
        F.when(~F.array_contains("masked", c), F.col(c)).alias(c) for c in table.columns])


#: Calls, and rows of their read, that meet in one cell of `rows_of_calls`.
CELL_SIDE = 1500


def rows_of_calls(reads: DataFrame, rows: DataFrame, key: str,
                  side: int = CELL_SIDE) -> DataFrame:
    """The rows of `governed_reads` once for each call of `call_reads`; `key` tells rows apart.

    The result is as large as calls times rows and few reads may hold most of it, so the calls and
    the rows of a read are cut by hash into parts of about `side`, and each part of one meets each
    part of the other in a cell of its own. Tasks grow in number with the result, not in
    length. Both tables are read several times, so give stored ones.
    """
    parts = (reads.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_calls"))
             .join(rows.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_rows")), "read_id")
             .select("read_id", (F.col("n_calls") * F.col("n_rows")).alias("pairs"),
                     F.ceil(F.col("n_calls") / side).cast("int").alias("_a"),
                     F.ceil(F.col("n_rows") / side).cast("int").alias("_b")))
    pairs = parts.agg(F.sum("pairs").alias("n")).first()["n"] or 0
    tasks = max(reads.sparkSession.sparkContext.defaultParallelism, -(-int(pairs) // side ** 2))

    def dealt(table: DataFrame, spread: str, own: str, other: str) -> DataFrame:
        cells = salted_join(table, parts.drop("pairs"), ["read_id"], [spread], "inner")
        return (cells.withColumn(own, F.pmod(F.xxhash64(spread), F.col(own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .repartition(tasks, "read_id", "_a", "_b"))

    calls = dealt(reads.select("call_id", "read_id"), "call_id", "_a", "_b")
    return calls.join(dealt(rows, key, "_b", "_a"), ["read_id", "_a", "_b"]).drop("_a", "_b")


def run_governed_sql(spark: SparkSession, query: str,
                     views: Mapping[str, Callable[[SparkSession], DataFrame]]) -> DataFrame:
    """Run a user's query in a session of its own that reads the given views alone.

    Each view is built by its function in the new session. The text must be one whole query
    by itself, and its analysed plan may reach data through the views only, and call neither Java
    methods nor registered functions; anything else raises `UnsafeQuery` before a row is read.
    """
    session = spark.newSession()
    for name, build in views.items():
        build(session).createOrReplaceTempView(name)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session._jsparkSession.sessionState().sqlParser().parsePlan(query)  # whole, not a piece
    result = session.sql(f"SELECT * FROM (\n{query}\n)")
    check_plan(result._jdf.queryExecution().analyzed(), {name.lower() for name in views})
    return result


class UnsafeQuery(ValueError):
    """A query that reaches beyond its views."""


# What a plan may rest on besides the views.
_OWN_ROWS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")
_FORBIDDEN = ("reflect", "java_method", "try_reflect")
_FOREIGN_CODE = ("CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "ScalaUDF",
                 "ScalaUDAF", "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF", "HiveUDAFFunction",
                 "PythonUDTF", "ScalaAggregator", "ApplyFunctionExpression")


def check_plan(plan, views: set[str]) -> None:
    """Refuse an analysed plan that reads anything but the named temporary views."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        name = plan.desc().identifier()
        if plan.isTempView() and name.database().isEmpty() and name.table().lower() in views:
            return  # what is below was built by us
        raise UnsafeQuery(f"{name.toString()} is not among the views")
    children = _items(plan.children())
    if not children and kind not in _OWN_ROWS:
        raise UnsafeQuery(f"a query may not read {kind}")
    for child in children:
        check_plan(child, views)
    for expression in _items(plan.expressions()):
        _check_expression(expression, views)


def _check_expression(expression, views: set[str]) -> None:
    kind = expression.getClass().getSimpleName()
    if kind in _FOREIGN_CODE or expression.prettyName() in _FORBIDDEN:
        raise UnsafeQuery(f"{expression.prettyName()} may not be called")
    if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        check_plan(expression.plan(), views)
    for child in _items(expression.children()):
        _check_expression(child, views)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def lay_out(table: DataFrame, brand_column: str, path: str, spread: Sequence[str],
            files: int = 1) -> DataFrame:
    """The table written with a folder per brand, each in up to `files` files, and read back.

    Files are written by a hash of the `spread` columns, so that one brand's rows, however
    many, are the work of `files` tasks. Rows without a brand have a folder of their own.
    """
    dealt = table.repartition(F.col(brand_column), F.pmod(F.xxhash64(*spread), F.lit(files)))
    dealt.write.partitionBy(brand_column).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def laid_out_extract(rows: DataFrame, users: DataFrame, brand_column: str,
                     pii_columns: Sequence[str]) -> DataFrame:
    """`multi_user_extract` from a table that `lay_out` wrote: other brands' folders stay unread.

    The entitled brands prune the scan while the query runs. Adaptive execution splits folders
    that are read at once, so hot brands need no salt.
    """
    entitled = users.select("user_id", "clearance_rank",
                            F.explode(F.array_distinct("brand_scope")).alias(brand_column))
    # Pruning needs a condition on this side; a brand has a name.
    entitled = entitled.where(F.length(brand_column) > 0)
    clear = F.coalesce(F.col("clearance_rank") >= L.RESTRICTED, F.lit(False))
    return rows.join(entitled, brand_column).select("user_id", *[
        F.when(clear, F.col(c)).alias(c) if c in pii_columns else F.col(c)
        for c in rows.columns])


def multi_user_extract(rows: DataFrame, users: DataFrame, brand_column: str,
                       pii_columns: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Rows each of the listed users may see, in one pass, with masked cells nulled.

    The result has one row per row and entitled user, so `users` is an explicit list.
    """
    entitled = users.select("user_id", "clearance_rank",
                            F.explode(F.array_distinct("brand_scope")).alias(brand_column))
    joined = salted_join(rows, entitled, [brand_column], spread, "inner")
    clear = F.coalesce(F.col("clearance_rank") >= L.RESTRICTED, F.lit(False))
    return joined.select("user_id", *[
        F.when(clear, F.col(c)).alias(c) if c in pii_columns else F.col(c)
        for c in rows.columns])
