"""Plans, statistics and costs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Share of rows that a comparison with a literal is expected to keep.
SELECTIVITY = {"=": 0.01, "!=": 0.99, "<": 0.33, "<=": 0.33, ">": 0.33, ">=": 0.33}


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What explain(mode) prints."""
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString(mode))


def nodes(plan) -> list[tuple[int, str]]:
    """Depth and name of a plan's nodes, from the root on."""
    out, open_ = [], [(0, plan)]
    while open_:
        depth, node = open_.pop()
        out.append((depth, node.nodeName().split(" ")[0]))
        below = node.children()
        open_ += [(depth + 1, below.apply(i)) for i in reversed(range(below.size()))]
    return out


def tree(df: DataFrame, which: str = "optimized") -> list[tuple[int, str]]:
    """Depth and name of the nodes of a query's plan: logical, analyzed, optimized or executed."""
    plan = df._jdf.queryExecution()
    return nodes({"logical": plan.logical, "analyzed": plan.analyzed, "optimized": plan.optimizedPlan, "executed": plan.executedPlan}[which]())


def parsed(spark: SparkSession, statement: str) -> list[tuple[int, str]]:
    """Depth and name of the nodes of a statement's syntax tree; no table need exist."""
    return nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))


def analyze(spark: SparkSession, table: str) -> DataFrame:
    """Gathers statistics of a catalog table and its columns; returns the columns' as name and value."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    return statistics(spark, table)


def statistics(spark: SparkSession, table: str) -> DataFrame:
    """What the catalog knows of a table's columns, as column, name and value; the text NULL where it knows nothing."""
    parts = [spark.sql(f"DESCRIBE EXTENDED {table} {c}").selectExpr(f"'{c}' AS column", "info_name AS name", "info_value AS value") for c in spark.table(table).columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def filtered_rows(rows: float, comparisons: list[str]) -> float:
    """Rows that a conjunction of comparisons is expected to keep."""
    return rows * math.prod(SELECTIVITY.get(c, 0.5) for c in comparisons)


def scan_cost(pages: float, indexed: bool) -> float:
    """Pages read by a whole scan, or by a descent of an index and one page."""
    return math.log2(pages) + 1 if indexed else pages


def join_cost(left: tuple[float, float], right: tuple[float, float], hashed: bool) -> float:
    """Cost of joining two inputs of (cost, rows): both once and a step per row, or the right one for every left row."""
    return left[0] + right[0] + left[1] + right[1] if hashed else left[0] + left[1] * right[0]
