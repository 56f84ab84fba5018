"""Aggregates: corpus statistics, time buckets, cadence, retrieval metrics, usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_of_year(ts: Column) -> Column:
    """Week number of the year with Monday first; days before the first Monday are week 0."""
    monday0 = F.weekday(ts)
    return F.floor((F.dayofyear(ts) - 1 + 7 - monday0) / 7)


def bucket_key(ts: Column, unit: str) -> Column:
    """Text key of a time bucket: day, week, year, else month."""
    if unit == "week":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week_of_year(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"day": "yyyy-MM-dd", "year": "yyyy"}.get(unit, "yyyy-MM"))


def time_buckets(events: DataFrame, unit: str, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per bucket with the kinds that occur; events without a time are left out."""
    key = F.col(kind) if unit == kind else bucket_key(F.col(ts), unit)
    return events.where(F.col(ts).isNotNull()).groupBy(key.alias("bucket")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(kind)).alias("kinds"))


def timeline_compare(events: DataFrame, streams: dict[str, Column], unit: str, ts: str = "ts") -> DataFrame:
    """Counts per named filter and bucket, from one scan: every event is tagged with the streams it is in."""
    tags = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in streams.items()]), lambda x: x.isNotNull())
    tagged = events.where(F.col(ts).isNotNull()).select(bucket_key(F.col(ts), unit).alias("bucket"), F.explode(tags).alias("stream"))
    return tagged.groupBy("stream", "bucket").agg(F.count("*").alias("n"))


def cadence(events: DataFrame, user: str, ts: str, unit: str, forward: Column) -> DataFrame:
    """Per user and bin: events in each direction, the user's mean per occupied bin, and whether it is a burst (above thrice the mean)."""
    binned = events.groupBy(user, bucket_key(F.col(ts), unit).alias("bin")).agg(F.count_if(forward).alias("forward"), F.count_if(~forward).alias("backward"))
    total = F.col("forward") + F.col("backward")
    mean = F.avg(total).over(Window.partitionBy(user))
    return binned.withColumn("mean", mean).withColumn("burst", total > 3 * F.col("mean"))


def gaps(events: DataFrame, key: str, ts: str, least_days: int = 14) -> DataFrame:
    """Silences per key: whole days between successive events above max(2 * upper median gap, ``least_days``); keys with three events or more."""
    order = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    days = F.floor((micros - F.lag(micros).over(order)) / 86_400_000_000).cast("long")
    steps = events.where(F.col(ts).isNotNull()).select(key, ts, days.alias("days")).where("days is not null")
    sorted_gaps = F.sort_array(F.collect_list("days"))
    medians = steps.groupBy(key).agg(sorted_gaps.alias("g")).where(F.size("g") >= 2).select(key, F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1).alias("median_days"))
    return steps.join(medians, key).where(F.col("days") > F.greatest(2 * F.col("median_days"), F.lit(least_days)))


def language_distribution(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


def date_coverage(rows: DataFrame, ts: str) -> DataFrame:
    return rows.agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"), F.count(ts).alias("dated"), F.count("*").alias("total"))


def usage_summary(calls: DataFrame, by: list[str], allowed: list[str]) -> DataFrame:
    """Counts, tokens, cost and failures by allowed columns."""
    unknown = set(by) - set(allowed)
    if unknown:
        raise ValueError(f"cannot group by {sorted(unknown)}")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), total("input_tokens"), total("output_tokens"), total("cost"), F.count_if(F.col("status") != "ok").alias("failed"))


def mode_share(values: DataFrame, key: str, value: str, least: int, share: float) -> DataFrame:
    """Per key the commonest value, if the key has ``least`` values and it holds ``share`` of them; ties to the smaller value."""
    counts = values.groupBy(key, value).agg(F.count("*").alias("n"))
    best = F.max_by(value, F.struct("n", (-F.col(value)).alias("low"))).alias(value)
    return counts.groupBy(key).agg(best, F.max("n").alias("n"), F.sum("n").alias("total")).where((F.col("total") >= least) & (F.col("n") >= share * F.col("total")))


def retrieval_metrics(runs: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per run and query: recall, precision, reciprocal rank and nDCG at ``k``.

    ``runs(run, query, id, rank)``, ``judged(query, id, gain)``; recall and nDCG are 1 for a query without relevant ids.
    """
    relevant = judged.where("gain > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "id"))
    ideal = (
        relevant.withColumn("r", ideal_rank).groupBy("query")
        .agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1))).alias("ideal"))
    )
    top = runs.where(F.col("rank") <= k).join(relevant, ["query", "id"], "left")
    hit = F.col("gain").isNotNull()
    got = top.groupBy("run", "query").agg(
        F.count_if(hit).alias("hits"), F.coalesce(F.max(F.when(hit, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(hit, F.col("gain") / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    return got.join(ideal, "query", "left").select(
        "run", "query", F.coalesce(F.col("hits") / F.col("n_relevant"), F.lit(1.0)).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"),
        "rr", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(1.0)).alias("ndcg"),
    )


def compare_runs(metrics: DataFrame, base: str) -> DataFrame:
    """Mean metrics per run and their difference from the base run, rounded to four places."""
    names = ["recall", "precision", "rr", "ndcg"]
    means = metrics.groupBy("run").agg(*[F.avg(n).alias(n) for n in names])
    first = means.where(F.col("run") == base).select(*[F.col(n).alias(f"base_{n}") for n in names])
    # One row.
    joined = means.join(F.broadcast(first))
    return joined.select("run", *[F.round(n, 4).alias(n) for n in names], *[F.round(F.col(n) - F.col(f"base_{n}"), 4).alias(f"delta_{n}") for n in names])


def ascending_runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Islands of rows whose value ascends: a new run where it doesn't."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.when(F.col(value) > F.lag(value).over(w), 0).otherwise(1)
    return rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w)).drop("starts")


def group_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of several columns from one scan: column, value (null as empty), n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])
