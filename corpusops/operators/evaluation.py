"""Retrieval evaluation: matching of results to expectations and the metrics on top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that cut a distribution in a round of the selection, and values that one task may sort.
SPLITTERS, SORTED_AT_ONCE = 63, 100_000
DOMAINS = ["docs", "lsp"]
RESULT_FIELDS = [
    "chunk_id", "source_url", "file_path", "module", "routine_name", "heading_path", "context",
    "product", "version", "text", "metadata",
]


def haystack(results: DataFrame) -> Column:
    """Lower-cased newline join of the result fields; what a result lacks counts as ''."""
    parts = [
        F.coalesce(F.col(c).cast("string"), F.lit("")) if c in results.columns
        else F.lit("{}" if c == "metadata" else "")
        for c in RESULT_FIELDS
    ]
    return F.lower(F.concat_ws("\n", *parts))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def matches(hay: Column, chunk_id: Column, source_url: Column, file_path: Column) -> Column:
    """A hit when any given check holds; a query without checks is never hit."""
    def holds(target: Column, name: str) -> Column:
        low = F.lower(F.coalesce(target, F.lit("")))
        return F.exists(_given(name), lambda v: F.contains(low, F.lower(v)))

    def signal(s: Column) -> Column:
        return F.contains(hay, F.lower(s))

    every, some = _given("expected_signals_all"), _given("expected_signals_any")
    by_id = F.array_contains(_given("expected_chunk_ids"), F.coalesce(chunk_id, F.lit("")))
    by_signal = (
        ((F.size(every) > 0) | (F.size(some) > 0))
        & F.forall(every, signal)
        & ((F.size(some) == 0) | F.exists(some, signal))
    )
    return (
        by_id | holds(source_url, "expected_source_urls") | holds(file_path, "expected_file_paths")
        | by_signal
    )


def has_expectations() -> Column:
    names = ["expected_chunk_ids", "expected_source_urls", "expected_file_paths",
             "expected_signals_all", "expected_signals_any"]
    out = F.lit(False)
    for n in names:
        out = out | (F.size(_given(n)) > 0)
    return out


def first_hits(golden: DataFrame, ranked: DataFrame, depth: int = 10) -> DataFrame:
    """Per query the smallest matching rank up to ``depth``, -1 where none matches.

    ``ranked``: query_id, rank and the result fields, at most top_k rows per query. Queries
    without expectations are kept, marked as not evaluated.
    """
    expected = golden.select(
        "query_id", "domain", has_expectations().alias("evaluated"),
        *[F.col(c) for c in ("expected_chunk_ids", "expected_source_urls", "expected_file_paths",
                             "expected_signals_all", "expected_signals_any")],
    )
    shown = ranked.filter(F.col("rank") <= depth)
    fields = {c: F.col(c) if c in ranked.columns else F.lit(None).cast("string")
              for c in ("source_url", "file_path")}
    compact = shown.select(
        "query_id", "rank", F.col("chunk_id"), haystack(shown).alias("hay"),
        fields["source_url"].alias("source_url"), fields["file_path"].alias("file_path"),
    )
    hit = F.col("evaluated") & matches(F.col("hay"), F.col("chunk_id"), F.col("source_url"), F.col("file_path"))
    return (
        expected.join(compact, "query_id", "left")
        .groupBy("query_id", "domain", "evaluated")
        .agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(-1)).alias("first_hit"))
    )


def _metrics() -> list[Column]:
    hit = F.col("first_hit")
    return [
        F.count("query_id").alias("queries"),
        F.count_if(F.col("evaluated")).alias("evaluated"),
        F.coalesce(F.avg(F.when(F.col("evaluated"), hit.between(1, 3).cast("double"))), F.lit(0.0)).alias("recall_at_3"),
        F.coalesce(F.avg(F.when(F.col("evaluated"), hit.between(1, 5).cast("double"))), F.lit(0.0)).alias("recall_at_5"),
        F.coalesce(
            F.avg(F.when(F.col("evaluated"), F.when(hit > 0, 1.0 / hit).otherwise(0.0))), F.lit(0.0)
        ).alias("mrr_at_10"),
    ]


def metrics(hits: DataFrame) -> DataFrame:
    return hits.agg(*_metrics())


def metrics_by_domain(hits: DataFrame) -> DataFrame:
    """Every known domain, asked or not, and 'overall'; the hits are read once and reduced to
    one row per domain before they meet the list of domains."""
    listed = hits.sparkSession.createDataFrame([(d,) for d in [*DOMAINS, "overall"]], "domain string")
    twice = hits.withColumn("domain", F.explode(F.array("domain", F.lit("overall"))))
    per = twice.groupBy("domain").agg(*_metrics())
    zeros = {"queries": 0, "evaluated": 0, "recall_at_3": 0.0, "recall_at_5": 0.0, "mrr_at_10": 0.0}
    return listed.join(per, "domain", "left").fillna(zeros)


def misses(hits: DataFrame, depth: int = 5) -> DataFrame:
    """Queries without a hit within ``depth``; those without expectations are listed too."""
    return hits.filter(~F.col("first_hit").between(1, depth))


def percentiles(values: DataFrame, value: str, points: list[int]) -> DataFrame:
    """Element floor(p/100 * n) of the sorted values, capped at the last one; exact. Nulls do not count; without values 0.

    Selection by splitters: a sketch of the values gives SPLITTERS of them that stand at about equal ranks, one
    scan counts how many values lie between and at them, and only the stretch that holds a wanted rank is
    looked at again, until it has few values left, which one task sorts. So rounds grow with the logarithm of the
    number of values, and neither their spread nor repeats matter.
    """
    rows = values.select(F.col(value).alias("v")).where(F.col("v").isNotNull())
    total = rows.count()
    found = [_element(rows, min(total - 1, p * total // 100), total) if total else None for p in points]
    one = values.sparkSession.range(1)
    return one.select(*[F.coalesce(F.lit(v), F.lit(0.0)).alias(f"p{p}") for v, p in zip(found, points)])


def _element(rows: DataFrame, rank: int, n: int):
    """The value of ``rank`` (from 0) among ``n`` values ``v``."""
    while n > SORTED_AT_ONCE:
        shares = [k / (SPLITTERS + 1) for k in range(1, SPLITTERS + 1)]
        splitters = rows.agg(F.array_distinct(F.percentile_approx("v", shares, 10 * SPLITTERS)).alias("s")).first()["s"]
        # stretch 2k lies below splitter k, stretch 2k + 1 is the splitter itself
        above = [(F.col("v") > s).cast("int") + (F.col("v") >= s).cast("int") for s in map(F.lit, splitters)]
        counted = {r.stretch: r.n for r in rows.groupBy(reduce(lambda a, b: a + b, above).alias("stretch")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for stretch in sorted(counted):
            if rank < counted[stretch]:
                break
            rank -= counted[stretch]
        k, n = stretch // 2, counted[stretch]
        if stretch % 2:
            return splitters[k]
        if k:
            rows = rows.where(F.col("v") > F.lit(splitters[k - 1]))
        if k < len(splitters):
            rows = rows.where(F.col("v") < F.lit(splitters[k]))
    return rows.agg(F.get(F.array_sort(F.collect_list("v")), F.lit(rank)).alias("v")).first()["v"]


def top_results(ranked: DataFrame, depth: int = 5) -> DataFrame:
    """First results of each query as one nested list; at most ``depth`` entries per query."""
    fields = [c for c in ranked.columns if c != "query_id" and c != "rank"]
    return (
        ranked.filter(F.col("rank") <= depth)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("results"))
    )
