"""Quality rules, in native expressions: two plain rules, then robust multivariate outliers.

Each text gets counts and a vector of transformed shares. Location and scatter of the
vectors are estimated per language and source by minimum covariance determinant: from the
coordinate medians on, concentration steps refit mean and covariance on the nearest half of the
group until no determinant falls any more. There are two starts, with the floors and with the
median deviations as scales, of which each group takes the one with the least determinant. A
document is rejected when its squared Mahalanobis distance, rescaled by the group's median, exceeds
a cutoff.

How the estimate stays bounded and regular. Groups are never gathered: rows are summed per group
and distance step (steps of a 16th of a power of two), and the nearest half is a sum over steps,
of which the last one counts by the fraction that is needed, so one group may hold most rows. Clean shares are often all zero, so that variances get a floor
per coordinate; the scatter of a group is shrunk towards that of all documents by a fixed
number of rows, which settles small groups.

Defined results. A null or empty text has no words and fails the plain rules; null language
or source is a group of its own; repeated rows count as often as they occur and get the same
verdict; empty tables give empty results. Other columns stay; added names replace old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.text import let
from wardline.llm.common import BLANKS, count_words, fits, join_bounded, read, stored, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
WINDOW = 3
#: Coordinates of the vector, with the variance below which no estimate goes. Where a group has
#: no duplicate lines or repeated words, a text with one line repeated of three stays, and shares
#: over 38 % pass the cutoff alone.
FLOORS = {"x_length": 0.04, "x_symbols": 0.16, "x_lines": 0.45, "x_repeats": 0.45}
NEAREST = 0.5
#: Most concentration steps, and the part by which a determinant must fall for one more.
STEPS = 40
FALL = 1e-3
#: The standard deviation of a normal variable by its median deviation.
DEVIATION = 1.4826
SHRINK = 100.0
#: The median of chi-square with four degrees of freedom, and the squared distance that rejects,
#: its quantile of 0.999995.
CHI_MEDIAN = 3.357
CUTOFF = 30.0
PARTS = 16
#: Rejected texts that are broadcast at most, as hashes of about 200 bytes with their group, which
#: the driver holds twice; where there are more, documents are judged again.
MOST_GONE = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(text: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Only texts with an equal pair of hashes sort
    windows with their places, and the places found are merged in order.
    """
    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(
            F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"),
                                                                        i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, k: F.when(
                (F.get(s, k + 1)["h"] == x["h"])
                | (F.when(k > 0, F.get(s, k - 1)["h"]) == x["h"]), x["i"])),
            lambda i: i.isNotNull())))

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(places(hashes), covered))

    def of_words(found: Column) -> Column:
        hashes = F.transform(F.slice(found, 1, F.greatest(F.size(found) - size + 1, F.lit(0))),
                             lambda w, i: F.xxhash64(w, *[F.get(found, i + k)
                                                          for k in range(1, size)]))
        return let(hashes, of_hashes)

    return let(words(text), of_words).cast("long")


def counts(text: Column) -> dict[str, Column]:
    """The counts of a text by name."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dense = F.translate(text, BLANKS, "")
    return {
        "n_words": count_words(text),
        "word_chars": F.length(dense).cast("long"),
        "n_symbols": (F.length(dense) - F.length(F.translate(dense, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("long"),
        "n_repeat_words": repeat_words(text),
    }


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def vector() -> dict[str, Column]:
    """The transformed shares; a document without words is all zero."""
    def percent(part: str, whole: str) -> Column:
        return F.coalesce(F.log1p(100.0 * F.try_divide(F.col(part), F.col(whole))), F.lit(0.0))

    mean = F.try_divide(F.col("word_chars"), F.col("n_words"))
    return {"x_length": F.coalesce(F.log(mean), F.lit(0.0)),
            "x_symbols": percent("n_symbols", "word_chars"),
            "x_lines": percent("n_dup_lines", "n_lines"),
            "x_repeats": percent("n_repeat_words", "n_words")}


def same_group(left: DataFrame, keys: list[str]):
    def condition(right: DataFrame) -> Column:
        found = F.lit(True)
        for k in keys:
            found = found & left[k].eqNullSafe(right[f"g_{k}"])
        return found
    return condition


def moments(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, sums and sums of products of the coordinates of rows that stand for `n` each."""
    xs = list(FLOORS)
    return df.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.sum(F.col(x) * F.col("n")).alias(f"s_{x}") for x in xs],
        *[F.sum(F.col(a) * F.col(b) * F.col("n")).alias(f"q_{a}_{b}")
          for i, a in enumerate(xs) for b in xs[i:]])


def inverse(matrix: list[list[Column]], df: DataFrame) -> DataFrame:
    """Add p_i_j, the inverse of a positive definite matrix of columns, by Cholesky, and `det`."""
    n = len(matrix)
    for i in range(n):
        for j in range(i + 1):
            rest = matrix[i][j]
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j
                               else rest / F.col(f"l_{j}_{j}"))
    det = F.lit(1.0)
    for i in range(n):
        det = det * F.col(f"l_{i}_{i}") * F.col(f"l_{i}_{i}")
    df = df.withColumn("det", det)
    for j in range(n):
        for i in range(j, n):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"m_{k}_{j}")
            df = df.withColumn(f"m_{i}_{j}", rest / F.col(f"l_{i}_{i}"))
    for i in range(n):
        for j in range(i, n):
            total = F.lit(0.0)
            for k in range(j, n):
                total = total + F.col(f"m_{k}_{i}") * F.col(f"m_{k}_{j}")
            df = df.withColumn(f"p_{i}_{j}", total)
    return df.drop(*[c for c in df.columns if c[:2] in ("l_", "m_") and c[2].isdigit()])


def estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, inverse scatter and determinant per group and start, shrunk to those of all.

    `was` is the determinant of the step before.
    """
    xs = list(FLOORS)
    totals = sums.agg(*[F.sum(c).alias(c) for c in sums.columns
                        if c == "n" or c[:2] in ("s_", "q_")])
    total = {k: float(v or 0) for k, v in totals.first().asDict().items()}
    n = max(total["n"], 1.0)
    df = sums
    for x in xs:
        df = df.withColumn(f"u_{x}", (F.col(f"s_{x}") + SHRINK * total[f"s_{x}"] / n)
                           / (F.col("n") + SHRINK))
    cov = [[None] * len(xs) for _ in xs]
    for i, a in enumerate(xs):
        for j, b in enumerate(xs[i:], i):
            own = F.col(f"q_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")
            of_all = total[f"q_{a}_{b}"] / n - total[f"s_{a}"] * total[f"s_{b}"] / n / n
            mixed = (own + SHRINK * of_all) / (F.col("n") + SHRINK)
            cov[j][i] = mixed + FLOORS[a] if a == b else mixed
    df = inverse(cov, df)
    return stored(df.select(*[F.col(f"g_{k}") for k in keys], "start", "was", "det",
                            *[f"u_{x}" for x in xs],
                            *[f"p_{i}_{j}" for i in range(len(xs)) for j in range(i, len(xs))]))


def distance() -> Column:
    xs = list(FLOORS)
    gap = [F.col(x) - F.col(f"u_{x}") for x in xs]
    total = F.lit(0.0)
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            total = total + F.col(f"p_{i}_{j}") * gap[i] * gap[j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def step_of(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * PARTS)


def nearest(df: DataFrame, by: list[str], share: float) -> DataFrame:
    """Of rows with `n` per group and `step`, those steps that hold the nearest share.

    `part` is the fraction of a step that is needed, 1 for all but the last one.
    """
    order = Window.partitionBy(*by).orderBy("step")
    return (df.withColumn("before", F.sum("n").over(order) - F.col("n"))
            .withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
            .where(F.col("before") < share * F.col("all"))
            .withColumn("part", F.least(F.lit(1.0), (share * F.col("all") - F.col("before"))
                                        / F.col("n"))))


def medians(df: DataFrame, keys: list[str], name: str = "u") -> DataFrame:
    """The coordinate medians per group, to a hundredth."""
    xs = list(FLOORS)
    tall = df.select(*keys, "n", F.explode(F.array(*[
        F.struct(F.lit(x).alias("x"), F.round(F.col(x) * 100).cast("long").alias("step"))
        for x in xs])).alias("v")).select(*keys, "n", "v.*")
    half = nearest(tall.groupBy(*keys, "x", "step").agg(F.sum("n").alias("n")),
                   [*keys, "x"], 0.5)
    return half.groupBy(*[F.col(k).alias(f"g_{k}") for k in keys]).agg(*[
        F.max(F.when(F.col("x") == x, F.col("step"))).alias(f"{name}_{x}") for x in xs]).select(
        *[f"g_{k}" for k in keys], *[(F.col(f"{name}_{x}") / 100).alias(f"{name}_{x}") for x in xs])


def starts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Two starts per group, at its medians: scales by the floors, and by median deviations too."""
    xs = list(FLOORS)
    middle = stored(medians(df, keys))
    gaps = join_bounded(df, middle, same_group(df, keys), how="inner").select(
        *keys, "n", *[F.abs(F.col(x) - F.col(f"u_{x}")).alias(x) for x in xs])
    spread = medians(gaps, keys, "v").select(*[F.col(f"g_{k}").alias(f"h_{k}") for k in keys],
                                             *[f"v_{x}" for x in xs])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"g_{k}").eqNullSafe(F.col(f"h_{k}"))
    at = middle.join(spread, match).withColumn(
        "start", F.explode(F.array(F.lit(0), F.lit(1))))
    for i, x in enumerate(xs):
        wide = F.col("start") * F.pow(DEVIATION * F.col(f"v_{x}"), F.lit(2.0))
        for j in range(i, len(xs)):
            at = at.withColumn(f"p_{i}_{j}", 1.0 / (FLOORS[x] + wide) if i == j else F.lit(0.0))
    return stored(at.withColumn("det", F.lit(float("inf"))).drop(
        *[f"h_{k}" for k in keys], *[f"v_{x}" for x in xs]))


def fit(df: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """The estimates per group of a stored table of vectors; equal vectors are one row with `n`."""
    df = stored(df.groupBy(*keys, *FLOORS).agg(F.count(F.lit(1)).alias("n")))
    at = starts(df, keys)
    for _ in range(steps):
        near = join_bounded(df, at, same_group(df, keys), how="inner")
        by = [*keys, "start", "det", "step"]
        by_step = moments(near.withColumn("step", step_of(distance())), by)
        kept = nearest(by_step, [*keys, "start"], NEAREST)
        sums = stored(kept.groupBy(*[F.col(k).alias(f"g_{k}") for k in keys], "start",
                                   F.col("det").alias("was")).agg(*[
            F.sum(F.col(c) * F.col("part")).alias(c) for c in by_step.columns if c not in by]))
        at = estimate(sums, keys)
        if at.where(F.col("det") < F.col("was") * (1 - FALL)).isEmpty():
            break
    least = Window.partitionBy(*[f"g_{k}" for k in keys]).orderBy("det", "start")
    at = stored(at.withColumn("place", F.row_number().over(least)).where("place = 1")
                .drop("place", "start", "was", "det"))
    # Scale: the median distance of the group is that of a normal vector, where it is larger.
    near = join_bounded(df, at, same_group(df, keys), how="inner")
    middle = nearest(near.withColumn("step", step_of(distance())).groupBy(*keys, "step")
                     .agg(F.sum("n").alias("n")), keys, 0.5)
    scale = middle.groupBy(*[F.col(k).alias(f"h_{k}") for k in keys]).agg(
        F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.max("step") + 1) / PARTS) / CHI_MEDIAN)
        .alias("u_scale"))
    match = F.lit(True)
    for k in keys:
        match = match & at[f"g_{k}"].eqNullSafe(scale[f"h_{k}"])
    return stored(at.join(scale, match).drop(*[f"h_{k}" for k in keys]))


def judge(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source"),
          steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """The documents with their counts, `base_failed`, `outlier_d2` and `kept`.

    Estimates come from the documents that pass the plain rules. Counts are stored with the
    other columns of `docs`, texts included.
    """
    return judge_counted(stored(with_counts(docs, text, keys)), keys, steps, cutoff)


def with_counts(docs: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    added = (*COUNTS, "base_failed", "outlier_d2", "kept")
    return (docs.drop(*[c for c in added if c not in (text, *keys)])
            .withColumns(counts(F.col(text))).withColumn("base_failed", base_failed()))


def model_of(table: DataFrame, keys: tuple[str, ...], steps: int = STEPS) -> DataFrame:
    """The estimates per group, from the rows of a stored table of counts that pass the plain rules."""
    good = table.where(~F.col("base_failed")).select(*keys, *COUNTS).withColumns(vector())
    return fit(good.select(*keys, *FLOORS), list(keys), steps)


def measured(table: DataFrame, fitted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The table with `outlier_d2`, by the estimates of each row's group."""
    vectors = table.withColumns(vector())
    return join_bounded(vectors, fitted, same_group(vectors, list(keys))).select(
        *table.columns, (distance() / F.col("u_scale")).alias("outlier_d2"))


def verdicts(table: DataFrame, fitted: DataFrame, keys: tuple[str, ...],
             cutoff: float = CUTOFF) -> DataFrame:
    """The table with `outlier_d2` of rows that pass the plain rules, and `kept`."""
    return measured(table, fitted, keys).withColumn(
        "outlier_d2", F.when(~F.col("base_failed"), F.col("outlier_d2"))).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("outlier_d2", F.lit(0.0)) <= cutoff))


def judge_counted(table: DataFrame, keys: tuple[str, ...] = ("lang", "source"),
                  steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """Verdicts for a stored table of counts, from estimates of the rows that pass the plain rules."""
    return verdicts(table, model_of(table, keys, steps), keys, cutoff)


def filter_quality(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source"),
                   steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that the rules keep, with their own columns as they are.

    A verdict depends on text and group alone, so counts are stored with a hash of the text, and
    rejected hashes leave by an anti-join with a broadcast table. Where rejections are too many
    for that, each document is counted and judged again by the same estimates, so that the driver
    holds none of them and texts are only shuffled for more than 10,000 groups.
    """
    own = tuple(f"m_{k}" for k in keys)
    slim = docs.select(F.col(text).alias("m_text"), F.xxhash64(text).alias("m_hash"),
                       *[F.col(k).alias(o) for k, o in zip(keys, own)])
    table = stored(with_counts(slim, "m_text", own).drop("m_text"))
    fitted = model_of(table, own, steps)
    gone = stored(verdicts(table, fitted, own, cutoff).where(~F.col("kept"))
                  .select("m_hash", *own).distinct())
    whole = F.struct("*").alias("m_doc")
    if not fits(gone, MOST_GONE):
        again = with_counts(docs.select(whole, F.col(text).alias("m_text"),
                                        *[F.col(k).alias(o) for k, o in zip(keys, own)]),
                            "m_text", own)
        # One condition on both sides of the join: the plain rules alone would be moved below it,
        # which takes the counts twice.
        worst = F.greatest(F.coalesce("outlier_d2", F.lit(0.0)),
                           F.when(F.col("base_failed"), float("inf")).otherwise(0.0))
        return measured(again, fitted, own).where(worst <= cutoff).select("m_doc.*")
    wrapped = docs.select(whole, F.xxhash64(text).alias("m_hash_of"),
                          *[F.col(k).alias(f"{o}_of") for k, o in zip(keys, own)])
    same = F.col("m_hash_of") == F.col("m_hash")
    for o in own:
        same = same & F.col(f"{o}_of").eqNullSafe(F.col(o))
    return wrapped.join(F.broadcast(gone), same, "left_anti").select("m_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = stored(with_counts(docs, "text", ("lang", "source")).drop("text"))
    return judge_counted(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "outlier_d2")
