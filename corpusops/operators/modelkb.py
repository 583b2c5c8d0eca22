"""Mining of report definitions: which tables they use, alone and together.

``refs`` holds one row per report and table: report, table, pos (order of first mention).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusops.session import stored

TOP_TABLES = 50
OFTEN = 5
TOP_PAIRS = 200
COMMON_JOINS = 8
MAX_PATTERN_TABLES = 15
MAX_EXAMPLES = 8
MAX_REPORTS_LISTED = 20

#: Reports with more tables than this are counted by tiles of tables, all others pair by pair.
WIDE_AT = 256
#: Pairs of tables that a task forms from ordinary reports, and groups of reports it does so for.
PAIRS_AT_ONCE, DEALS = 1 << 19, 8
#: Tables of a block, mentions by wide reports in it, and reports in one matrix product.
BLOCK_TABLES, BLOCK_MENTIONS, REPORTS_AT_ONCE = 2048, 1 << 22, 2048

# Dominant tables with a name of their own.
PATTERN_NAMES = {
    "R034FUN": "employee",
    "R044CAL": "payroll_calc",
    "R044MOV": "payroll_movements",
    "R050INS": "benefit_enrollment",
    "R038HCA": "job_history",
    "R038HCC": "cost_center_history",
    "R028FER": "vacation",
    "R069EXM": "medical_exams",
    "R024CAR": "job_positions",
    "R016HIE": "org_hierarchy",
    "R038AFA": "leave_absence",
    "R128CUA": "training_courses",
    "R030EMP": "company",
    "R030FIL": "branches",
    "R005ACI": "work_accidents",
    "R110FIC": "medical_records",
    "R052MOV": "benefit_movements",
    "R038HLO": "location_history",
    "R034USU": "user_employee",
}

# Column type codes of the field dictionary.
TYPE_CODES = {
    "1": "alpha", "2": "numeric", "3": "date", "4": "logical", "5": "memo", "6": "image",
    "7": "currency", "8": "integer", "9": "time", "10": "datetime",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def clean_refs(mentions: DataFrame) -> DataFrame:
    """Mentions (report, pos, ref) as distinct upper-cased tables without their field part."""
    named = mentions.select(
        "report", "pos", F.trim(F.upper(F.split("ref", r"\.")[0])).alias("table")
    ).filter(F.col("table").rlike("^R[0-9]"))
    return named.groupBy("report", "table").agg(F.min("pos").alias("pos"))


def usage(refs: DataFrame) -> DataFrame:
    """Reports per table."""
    return refs.groupBy("table").agg(F.count(F.lit(1)).alias("reports"))


def usage_ranked(refs: DataFrame) -> DataFrame:
    """Usage, with the tables that are among the most used ones or used often marked."""
    used = usage(refs)
    top = used.orderBy(F.desc("reports"), "table").limit(TOP_TABLES).select("table", F.lit(True).alias("is_top"))
    return used.join(F.broadcast(top), "table", "left").select(
        "table", "reports", F.coalesce("is_top", F.lit(False)).alias("is_top"),
        (F.col("reports") >= OFTEN).alias("is_often"),
    )


def _split(refs: DataFrame, wide_at: int) -> tuple[DataFrame, DataFrame, int]:
    """Refs of the reports with up to ``wide_at`` tables, those of the wider ones, and the number of pairs the former give."""
    n, seen = F.col("n"), Observation()
    sizes = refs.groupBy("report").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum(F.when(n <= wide_at, n * (n - 1) / 2)).alias("pairs"))
    wide = stored(sizes.filter(n > wide_at).select("report"), "wide")
    narrow = refs.join(wide, "report", "left_anti").select("report", "table")
    return narrow, refs.join(wide, "report", "left_semi").select("report", "table"), int(seen.get["pairs"] or 0)


def _narrow_pairs(narrow: DataFrame, pairs: int) -> DataFrame:
    """Pairs of tables with their reports. A task forms about PAIRS_AT_ONCE of the ``pairs`` and sums those up before
    they are shuffled, and gets as many sums."""
    tasks = max(narrow.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_AT_ONCE))
    deal = F.pmod(F.xxhash64("report"), F.lit(DEALS * tasks))
    lists = (
        narrow.where(F.col("report").isNotNull()).withColumn("deal", deal).repartition(tasks, "deal")
        .groupBy("deal", "report").agg(F.sort_array(F.collect_list("table")).alias("tables"))
    )
    formed = lists.select("deal", "tables", F.posexplode("tables").alias("at", "a")).select(
        "deal", "a", F.explode(F.slice("tables", F.col("at") + 2, F.size("tables"))).alias("b")
    )
    summed = formed.where(F.col("a") < F.col("b")).groupBy("deal", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return summed.select("a", "b", "n").repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _best_pairs(names: tuple[np.ndarray, np.ndarray], counts: np.ndarray, same: bool, limit: int) -> list[np.ndarray]:
    """Rows, columns and counts of the first ``limit`` pairs by count, then by the smaller and the larger name."""
    if same:
        counts = np.triu(counts, 1)
    flat = counts.ravel()
    least = max(1, np.partition(flat, -limit)[-limit]) if len(flat) > limit else 1
    found = np.flatnonzero(flat >= least)
    row, column = np.divmod(found, max(1, counts.shape[1]))
    place = np.unique(np.concatenate(names), return_inverse=True)[1]
    x, y = place[row], place[len(names[0]) + column]
    first = np.lexsort((np.maximum(x, y), np.minimum(x, y), -flat[found]))[:limit]
    return [row[first], column[first], flat[found][first]]


def _best_partners(names: tuple[np.ndarray, np.ndarray], counts: np.ndarray, limit: int) -> list[np.ndarray]:
    """Per row the first ``limit`` columns by count, then by name (columns stand in the order of their names)."""
    n = counts.shape[1]
    keys = counts * n + np.arange(n - 1, -1, -1)
    best = np.argpartition(-keys, min(limit, n) - 1, axis=1)[:, :limit] if n else np.empty((len(counts), 0), np.int64)
    row, column = np.repeat(np.arange(len(counts)), best.shape[1]), best.ravel()
    held = counts[row, column] > 0
    return [row[held], column[held], counts[row, column][held]]


def _wide_tiles(wide: DataFrame, pairs: DataFrame, limit: int, per_table: bool) -> DataFrame:
    """The pairs of tables that wide reports name, best first: a, b, n, at most ``limit`` per tile (or per table and tile).

    Tables are dealt into blocks, small enough for the mentions of two of them, and two blocks meet in a tile. There the
    common reports of each two tables are counted by matrix products over some reports at a time, summed
    up inside the tile, and what ordinary reports add (``pairs``: a, b, n) is added; only the best leave it. So no
    pair of a wide report is ever a row.
    """
    tables = wide.select("table").distinct().count()
    blocks = max(1, -(-tables // BLOCK_TABLES), -(-wide.count() // BLOCK_MENTIONS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    mentions = wide.select("report", "table", block("table").alias("own"), other.alias("other")).select(
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "report", "table"
    )
    added = pairs.select(F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b", "n")

    def tile(key: tuple, mentions: pa.Table, added: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        right = mentions["right"].to_numpy()
        names = mentions["table"].to_numpy()
        report = mentions["report"].combine_chunks().dictionary_encode().indices.to_numpy()
        sides = [(names[~right], report[~right]), (names[~right], report[~right]) if same else (names[right], report[right])]
        (rows, at_row), (columns, at_column) = (np.unique(n, return_inverse=True) for n, _ in sides)
        counts = np.zeros((len(rows), len(columns)), np.int64)
        for low in range(0, int(report.max()) + 1 if len(report) else 0, REPORTS_AT_ONCE):
            dense = []
            for at, (_, r), n in zip((at_row, at_column), sides, counts.shape):
                here = (r >= low) & (r < low + REPORTS_AT_ONCE)
                block = np.zeros((n, REPORTS_AT_ONCE), np.float32)
                block[at[here], r[here] - low] = 1
                dense.append(block)
            counts += (dense[0] @ dense[1].T).astype(np.int64)
        if len(rows) and len(columns):
            a, b, n = (added[c].to_numpy() for c in ("a", "b", "n"))
            for x, y in ((a, b), (b, a)):
                i, j = np.searchsorted(rows, x), np.searchsorted(columns, y)
                i, j = np.minimum(i, len(rows) - 1), np.minimum(j, len(columns) - 1)
                inside = (rows[i] == x) & (columns[j] == y)
                np.add.at(counts, (i[inside], j[inside]), n[inside])
        if same:
            np.fill_diagonal(counts, 0)
        if per_table:
            parts = [(rows, columns, *_best_partners((rows, columns), counts, limit))]
            parts += [] if same else [(columns, rows, *_best_partners((columns, rows), counts.T, limit))]
        else:
            parts = [(rows, columns, *_best_pairs((rows, columns), counts, same, limit))]
        a = np.concatenate([x[i] for x, _, i, _, _ in parts])
        b = np.concatenate([y[j] for _, y, _, j, _ in parts])
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "n": np.concatenate([n for *_, n in parts])})

    return mentions.groupBy("i", "j").cogroup(added.groupBy("i", "j")).applyInArrow(tile, "a string, b string, n long")


def _counted(refs: DataFrame, limit: int, wide_at: int, per_table: bool) -> DataFrame:
    """Pairs of tables (a, b) with the number of reports that name both; of those between two tables of wide
    reports only the best of every tile, each both ways if ``per_table``."""
    narrow, wide, n = _split(refs, wide_at)
    pairs, wide = _narrow_pairs(narrow, n), stored(wide, "wide_refs")
    in_wide = wide.select("table").distinct()
    a, b = (in_wide.select(F.col("table").alias(c), F.lit(True).alias(f"{c}_wide")) for c in "ab")
    marked = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("both", F.coalesce(F.col("a_wide") & F.col("b_wide"), F.lit(False)))
    marked = stored(marked.select("a", "b", "n", "both"), "pairs")
    plain = marked.where(~F.col("both")).select("a", "b", "n")
    if per_table:
        plain = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return plain.unionByName(_wide_tiles(wide, marked.where("both"), limit, per_table))


def top_pairs(refs: DataFrame, limit: int = TOP_PAIRS, wide_at: int = WIDE_AT) -> DataFrame:
    """The pairs of tables named together by most reports, ties by name; exact.

    Reports of up to ``wide_at`` tables give their pairs, summed up before the shuffle; all wider ones, however
    many, are counted by tiles of tables.
    """
    both = _counted(refs, limit, wide_at, False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("n").alias("reports"))
    return both.orderBy(F.desc("reports"), "a", "b").limit(limit)


def common_joins(refs: DataFrame, limit: int = COMMON_JOINS, wide_at: int = WIDE_AT) -> DataFrame:
    """Per table the tables most often named with it: table, rank, other, reports. Exact, as ``top_pairs``."""
    both_ways = _counted(refs, limit, wide_at, True).select(F.col("a").alias("table"), F.col("b").alias("other"), F.col("n").alias("reports"))
    w = Window.partitionBy("table").orderBy(F.desc("reports"), "other")
    return both_ways.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def dominant(refs: DataFrame) -> DataFrame:
    """The table of each report that most reports use; the first mentioned wins a tie."""
    used = refs.join(usage(refs), "table")
    return used.groupBy("report").agg(
        F.max_by("table", F.struct(F.col("reports"), -F.col("pos"))).alias("dominant")
    )


def patterns(refs: DataFrame) -> DataFrame:
    """Reports grouped by their dominant table, where there are at least two.

    Tables and examples are the first ones in report order; rank windows keep 15 and 8 rows per
    pattern and task, so no list grows beyond that.
    """
    name = F.coalesce(F.try_element_at(literal_map(PATTERN_NAMES), F.col("dominant")), F.lower("dominant"))
    dom = dominant(refs).withColumn("pattern", name)
    counts = dom.groupBy("pattern", "dominant").agg(F.count(F.lit(1)).alias("report_count")).filter("report_count >= 2")

    def firsts(rows: DataFrame, item: str, order: list[str], limit: int, out: str) -> DataFrame:
        w = Window.partitionBy("pattern").orderBy(*order)
        kept = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
        return kept.groupBy("pattern").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(item)))), lambda s: s[item]).alias(out)
        )

    examples = firsts(dom, "report", ["report"], MAX_EXAMPLES, "example_models")
    named = (
        refs.join(dom.select("report", "pattern"), "report")
        .groupBy("pattern", "table").agg(F.min(F.struct("report", "pos")).alias("first"))
    )
    tables = firsts(named, "table", ["first", "table"], MAX_PATTERN_TABLES, "tables")
    return counts.join(tables, "pattern").join(examples, "pattern")


def parse_dump(lines: DataFrame, n_columns: int = 4, line: str = "value") -> DataFrame:
    """Pipe-delimited dump lines as trimmed cells; rulers, row counts and short lines drop out. A position ``pos`` is kept."""
    text = F.trim(F.regexp_replace(line, r"[\r\t]", " "))
    place = ["pos"] if "pos" in lines.columns else []
    kept = lines.select(text.alias("t"), *place).filter(
        (F.col("t") != "") & ~F.startswith("t", F.lit("(")) & ~F.startswith("t", F.lit("---"))
    )
    cells = F.transform(F.split("t", r"\|", -1), lambda c: F.trim(c))
    return kept.select(cells.alias("cells"), *place).filter(F.size("cells") >= n_columns)


def field_dictionary(lines: DataFrame) -> DataFrame:
    """table, field, type, size, description of a dictionary dump; the last line of a field wins.

    Lines need a position column ``pos`` for that, else the order is that of the text itself.
    """
    parsed = parse_dump(lines)
    by_place = "pos" in parsed.columns
    cells = parsed.select(
        (F.col("pos") if by_place else F.lit(0)).alias("pos"),
        F.upper(F.get("cells", F.lit(0))).alias("table"),
        F.get("cells", F.lit(1)).alias("field"),
        F.get("cells", F.lit(2)).alias("description"),
        F.get("cells", F.lit(3)).alias("code"),
        F.coalesce(F.get("cells", F.lit(4)), F.lit("")).alias("length"),
    ).filter((F.col("field") != "") & F.col("table").rlike("^R[0-9]"))
    kind = F.coalesce(
        F.try_element_at(literal_map(TYPE_CODES), F.col("code")),
        F.nullif(F.col("code"), F.lit("")), F.lit("unknown"),
    )
    size = F.coalesce(F.regexp_extract("length", r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    typed = cells.select("pos", "table", "field", kind.alias("type"), size.alias("size"), "description")
    rest = F.struct("type", "size", "description")
    return typed.groupBy("table", "field").agg((F.max_by(rest, F.struct("pos", rest)) if by_place else F.max(rest)).alias("r")).select("table", "field", "r.*")


def assemble(refs: DataFrame, fields: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """One row per referenced table: description, usage, common joins, first reports, fields.

    Fields are attached to the most used tables and to those used often; a table's own columns
    are the only list that is not cut, and its length is that of the dictionary entry.
    """
    used = usage_ranked(refs)
    joins = common_joins(refs).groupBy("table").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda s: s["other"]).alias("common_joins")
    )
    w = Window.partitionBy("table").orderBy("report")
    listed = (
        refs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= MAX_REPORTS_LISTED)
        .groupBy("table").agg(F.array_sort(F.collect_list("report")).alias("used_in_reports"))
    )
    wanted = used.filter("is_top OR is_often").select("table")
    columns = (
        fields.join(wanted, "table", "left_semi").groupBy("table")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("type", "size", "description"))))).alias("fields"))
    )
    known = F.try_element_at(literal_map(descriptions), F.col("table")) if descriptions else F.lit(None).cast("string")
    return (
        used.join(joins, "table", "left").join(listed, "table", "left").join(columns, "table", "left")
        .select(
            "table", F.coalesce(known, F.lit("")).alias("description"),
            F.col("reports").alias("report_count"),
            F.coalesce("common_joins", F.array().cast("array<string>")).alias("common_joins"),
            "used_in_reports", "fields", "is_top",
        )
    )


def meta(refs: DataFrame, fields: DataFrame) -> DataFrame:
    """Counts of the knowledge base in one row."""
    used = usage_ranked(refs)
    described = fields.select("table").distinct().withColumn("has_fields", F.lit(True))
    return (
        used.join(described, "table", "full_outer")
        .agg(
            F.count_if("has_fields").alias("source_tables"),
            F.count("reports").alias("tables_in_kb"),
            F.count_if(F.col("has_fields") & (F.col("is_top") | F.col("is_often"))).alias("tables_with_full_fields"),
        )
        .withColumn("report_files_analyzed", refs.select("report").distinct().agg(F.count(F.lit(1)).alias("n")).scalar())
    )
