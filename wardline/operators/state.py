"""Need-to-know reads of outputs shared between the agents of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.operators.skew import salted_join
from wardline.sources.tables import append_with_date

_OUTPUT = ("agent_id", "output_type", "out_seq", "row_seq", "data", "sensitivity_rank")


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Append outputs to the log, partitioned by date and not by session."""
    append_with_date(outputs, path, "produced_at")


def clear_outputs(outputs: DataFrame, clears: DataFrame) -> DataFrame:
    """Outputs that no later clearing of their agent in their session removed.

    `clears` has session_id, agent_id and cleared_at.
    """
    last = clears.groupBy("session_id", "agent_id").agg(F.max("cleared_at").alias("cleared_at"))
    joined = salted_join(outputs, last, ["session_id", "agent_id"], ["out_seq", "row_seq"])
    return joined.where(F.col("cleared_at").isNull() | (F.col("produced_at") > F.col("cleared_at"))
                        ).drop("cleared_at")


def match_outputs(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs of the other agents of a session that each request declared, with `excluded`.

    A request meets only outputs of the types it names that were there at its time. Outputs
    are the large side; a session with a large share of them is split.
    """
    wanted = requests.select("request_id", "session_id", "requesting_agent_id", "needed_fields",
                             "ceiling_rank", F.col("ts").alias("read_at"),
                             F.explode(F.array_distinct("needed_types")).alias("output_type"))
    joined = salted_join(outputs.select("session_id", "produced_at", *_OUTPUT), wanted,
                         ["session_id", "output_type"], ["agent_id", "out_seq", "row_seq"],
                         "inner", base=outputs)
    return joined.where((F.col("agent_id") != F.col("requesting_agent_id"))
                        & (F.col("produced_at") <= F.col("read_at"))).withColumn(
        "excluded", ~F.coalesce(F.col("sensitivity_rank") <= F.col("ceiling_rank"), F.lit(False)))


def read_state(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """Data each request may see, one row per output row.

    Entries of a type are in write order by (agent_first_seq, out_seq, row_seq), where
    agents come in the order of their first output of the session.
    """
    first = (outputs.groupBy("session_id", "agent_id")
             .agg(F.min("out_seq").alias("agent_first_seq")))
    matched = match_outputs(requests, outputs).where(~F.col("excluded"))
    fields = F.element_at("needed_fields", F.col("output_type"))
    data = F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.map_filter(
        "data", lambda k, v: F.array_contains(fields, k))).otherwise(F.col("data"))
    ordered = salted_join(matched, first, ["session_id", "agent_id"],
                          ["request_id", "out_seq", "row_seq"], base=outputs)
    return ordered.select(
        "request_id", "session_id", "output_type", F.col("agent_id").alias("from_agent"),
        "agent_first_seq", "out_seq", "row_seq",
        L.rank_to_name(F.col("sensitivity_rank")).alias("sensitivity"), data.alias("data"))


def step(requests: DataFrame, outputs: DataFrame, produced: DataFrame
         ) -> tuple[DataFrame, DataFrame]:
    """What agents see on entry to a step, and the outputs after it, with what they wrote.

    Reads see only what was there before; nothing is cleared at the end of a step.
    """
    return read_state(requests, outputs), outputs.unionByName(produced)


def read_violations(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """Declared outputs left out because they rank above the reader's ceiling."""
    return match_outputs(requests, outputs).where("excluded").select(
        "request_id", "session_id", "agent_id", "output_type", "out_seq", "row_seq",
        "sensitivity_rank", "ceiling_rank")


def access_log(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per read, also for reads that got nothing.

    Types and violation labels are distinct values, so their lists stay short however
    many outputs a session holds; the violating outputs themselves are in
    `read_violations`.
    """
    label = F.concat(F.col("agent_id"), F.lit("/"), F.col("output_type"), F.lit(":"),
                     L.rank_to_name(F.col("sensitivity_rank")))
    seen = (match_outputs(requests, outputs).groupBy("request_id").agg(
        F.array_sort(F.collect_set(F.when(~F.col("excluded"), F.col("output_type"))))
        .alias("received_types"),
        F.array_sort(F.collect_set(F.when(F.col("excluded"), label))).alias("violations"),
        F.count_if("excluded").alias("n_excluded")))
    nothing = F.array().cast("array<string>")
    return requests.join(seen, "request_id", "left").select(
        "request_id", "session_id", F.col("requesting_agent_id").alias("requesting_agent"),
        "needed_types", F.coalesce("received_types", nothing).alias("received_types"),
        F.coalesce("violations", nothing).alias("violations"),
        F.coalesce("n_excluded", F.lit(0)).alias("n_excluded"), "ts")
