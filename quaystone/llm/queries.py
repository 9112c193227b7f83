"""Queries of the text and sketch operators over their whole tables, with production parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.hashing import row_hash
from quaystone.llm.contamination import leaked_items
from quaystone.llm.packing import fill_report, pack, token_sizes
from quaystone.llm.pii import masked_texts, pii_stretches
from quaystone.llm.quantiles import combine, percentiles, sketches, usable
from quaystone.llm.splitting import split_oversized
from quaystone.session import BROADCAST_BYTES, cut, sizes_of, table

PROBABILITIES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Tokens of a container.
CAPACITY = 2048


def _daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches per metric, span name, route and day."""
    return sketches(_values(spark, d), ["metric", "span_name", "route", "day"], "ms")


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Every duration with its metric, span name, route and day; requests that were logged twice (equal in every column) count once."""
    trace = table(spark, d, "request_trace")
    # All columns count in a hash of 128 bits; only what is read below goes through the shuffle beside it.
    trace = trace.select(*[h.alias(f"h{i}") for i, h in enumerate(row_hash(trace, trace.columns))], "started_at", "route", "total_ms", "spans").distinct()
    one = F.struct(F.lit("total_ms").alias("metric"), F.lit(None).cast("string").alias("span_name"), F.col("total_ms").alias("ms"))
    spans = F.transform(F.coalesce("spans", F.array().cast(trace.schema["spans"].dataType)), lambda s: F.struct(F.lit("duration_ms").alias("metric"), s["name"].alias("span_name"), s["duration_ms"].alias("ms")))
    values = trace.select("route", F.to_date("started_at").alias("day"), F.explode(F.concat(F.array(one), spans)).alias("v"))
    return values.select("v.metric", "v.span_name", "route", "day", "v.ms")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per day, per month and over all days: the periods are combined from the daily sketches, the values are read once."""
    daily = cut(_daily_sketches(spark, d))
    group = ["metric", "span_name", "route"]
    levels = [daily.select(F.lit("day").alias("period_kind"), F.col("day").cast("string").alias("period"), *group, "sketch", "n", "rejected")]
    for kind, period in (("month", F.date_format("day", "yyyy-MM")), ("all", F.lit("all"))):
        one = combine(daily.withColumn("period", period), [*group, "period"])
        levels.append(one.select(F.lit(kind).alias("period_kind"), "period", *group, "sketch", "n", "rejected"))
    return percentiles(reduce(DataFrame.unionByName, levels), PROBABILITIES).drop("sketch")


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per metric, span name and route over all days: how many values were ranked and rejected, and whether the exact ranks of all
    percentiles lie within the stated bound. The values are ranked against the percentiles by one aggregation."""
    groups = ["metric", "span_name", "route"]
    values = cut(_values(spark, d))
    daily = sketches(values, [*groups, "day"], "ms")
    asked = percentiles(combine(daily, groups), PROBABILITIES)
    names = [c for c in asked.columns if c[0] == "p" and c[1:].isdigit()]
    named = asked.select(*[F.col(g).alias(f"g_{g}") for g in groups], "n", "rejected", "rank_error", *names)
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    ok = usable(F.col("ms"))
    sums = [F.sum(F.when(ok & (F.col("ms") < F.col(c)), 1).otherwise(0)).alias(f"under_{c}") for c in names] + [F.sum(F.when(ok & (F.col("ms") <= F.col(c)), 1).otherwise(0)).alias(f"upto_{c}") for c in names]
    # One row per group; groups are names of routes and spans, and their number is measured.
    counted = measured_groups(values, named, same).groupBy(*groups, "n", "rejected", "rank_error").agg(*sums)
    within = F.lit(True)
    for c, p in zip(names, PROBABILITIES):
        within = within & (F.col(f"under_{c}") <= (p + F.col("rank_error")) * F.col("n")) & (F.col(f"upto_{c}") >= (p - F.col("rank_error")) * F.col("n"))
    return counted.select(*groups, "n", "rejected", within.alias("within_bound"))


def measured_groups(values: DataFrame, groups: DataFrame, same: Column) -> DataFrame:
    """Values beside the row of their group; the groups are broadcast if they are small, as measured, else joined by Spark's choice."""
    groups = cut(groups)
    return values.join(F.broadcast(groups) if sizes_of(groups)[0].bytes <= BROADCAST_BYTES else groups, same)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "kb_chunk"), table(spark, d, "chunking_config"), ["doc_id", "chunk_index"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("was_split and piece_no = 0").select("doc_id", "chunk_index").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: rows, rows split, the longest piece, pieces over the limit, rows whose pieces without overlaps are not the content again."""
    p = _pieces(spark, d)
    fresh = F.sum(F.length("content") - F.col("overlap"))
    gone = F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0))
    rows = p.groupBy("doc_id", "chunk_index").agg(fresh.alias("chars"), F.max(F.length("content")).alias("longest"), F.max("was_split").alias("was_split"), gone.alias("firsts"))
    source = table(spark, d, "kb_chunk").select(F.col("doc_id").alias("d"), F.col("chunk_index").alias("i"), "profile", F.length("content").alias("source_chars"))
    limits = table(spark, d, "chunking_config").select(F.col("profile").alias("c"), "max_chars")
    both = rows.join(source, (F.col("doc_id") == F.col("d")) & (F.col("chunk_index") == F.col("i")), "full").join(limits, F.col("profile") == F.col("c"), "left")
    wrong = F.coalesce((F.col("chars") == F.col("source_chars")) & (F.col("firsts") == 1), F.col("chars").isNull() & F.col("source_chars").isNull() & F.col("d").isNotNull() & F.col("doc_id").isNotNull())
    return both.groupBy("profile").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("was_split").cast("long")).alias("split_rows"), F.sum((F.col("longest") > F.col("max_chars")).cast("long")).alias("over_limit"), F.sum((~wrong).cast("long")).alias("not_whole")
    )


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, beside the least number there can be and what best fit decreasing alone needs."""
    return fill_report(token_sizes(table(spark, d, "documents"), "doc_id", "text"), CAPACITY)


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents, documents placed, containers over the capacity, documents split although they fit, documents that lost or gained tokens."""
    sizes = cut(token_sizes(table(spark, d, "documents"), "doc_id", "text"))
    packed = cut(pack(sizes, CAPACITY))
    over = packed.groupBy("container_id").agg(F.sum("size").alias("fill")).where(F.col("fill") > CAPACITY).agg(F.count(F.lit(1)).alias("overfull"))
    placed = packed.groupBy(F.col("row_key").alias("k")).agg(F.sum("size").alias("placed_tokens"), F.count(F.lit(1)).alias("pieces"))
    both = sizes.groupBy("row_key").agg(F.sum("n_tokens").alias("n_tokens")).join(placed, F.col("row_key") == F.col("k"), "full")
    counts = both.agg(
        F.count("row_key").alias("documents"), F.count("k").alias("placed"), F.sum(((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).cast("long")).alias("split_though_fitting"),
        F.sum((~F.col("n_tokens").eqNullSafe(F.col("placed_tokens"))).cast("long")).alias("lost_tokens"),
    )
    return counts.join(over)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_sizes(table(spark, d, "documents"), "doc_id", "text")
    return pack(sizes, CAPACITY).withColumnRenamed("row_key", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs found, those in which 20 words of the item stand in the text word by word as they are, but for case and what parts them."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_item")

    def runs(text: str) -> Column:
        words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1))
        at = lambda w: F.when(F.size(w) >= 20, F.sequence(F.lit(1), F.size(w) - 19)).otherwise(F.array().cast("array<int>"))
        # The words are bound once, not found again for every run.
        return F.flatten(F.transform(F.array(words), lambda w: F.transform(at(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(20)), " ")))))

    pairs = leaked_items(docs, items)
    # Only documents that leak something are read again.
    both = pairs.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", runs("item_text").alias("item_runs")), "item_id")
    return both.where(F.arrays_overlap("item_runs", runs("text"))).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii_stretches(table(spark, d, "documents"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return masked_texts(table(spark, d, "documents"))


def p10_email_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source that hold an e-mail address written plainly: letters, at-sign, domain."""
    docs = table(spark, d, "documents")
    mails = pii_stretches(docs).where((F.col("pii_kind") == "email") & F.col("pii_text").rlike(PLAIN_MAIL)).select("doc_id").distinct()
    return docs.select("doc_id", "source").join(mails, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


#: A whole address without blanks or words for its signs.
PLAIN_MAIL = r"^[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


QUERIES = {
    "p2_percentiles": p2_percentiles,
    "p2_bounds": p2_bounds,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_invariants": p7_invariants,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_verbatim": p9_verbatim,
    "p10_found": p10_found,
    "p10_masked": p10_masked,
    "p10_email_documents": p10_email_documents,
}
