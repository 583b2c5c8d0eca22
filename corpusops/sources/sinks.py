"""Writers: CSV, JSON lines and the evaluation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_eval_report(metrics: DataFrame, results: DataFrame, path: str) -> None:
    """Metrics per domain and nested results per query, side by side below ``path``."""
    write_jsonl(metrics, f"{path}/metrics")
    write_jsonl(results, f"{path}/results")


def eval_markdown(metrics: DataFrame) -> str:
    """Summary table; one line per domain, of which there are three."""
    head = "| domain | queries | evaluated | recall@3 | recall@5 | MRR@10 |\n|---|---|---|---|---|---|"
    rows = metrics.orderBy("domain").select(
        F.format_string(
            "| %s | %d | %d | %.2f %% | %.2f %% | %.4f |",
            F.col("domain"), F.col("queries"), F.col("evaluated"), F.col("recall_at_3") * 100,
            F.col("recall_at_5") * 100, F.col("mrr_at_10"),
        ).alias("line")
    )
    return "\n".join([head, *[r["line"] for r in rows.collect()]])
