"""One declarative plan, two dialects: Spark SQL runs it, DuckDB checks it.

A plan is SQL in which ``@[a@|b@]`` gives ``a`` to Spark and ``b`` to DuckDB, and these
words differ by rule: RX(x, p, r) replaces all matches, MATCH(x, p) tests for one, SPLIT
splits by a pattern, SIZE is an array's length, FILTER(a, FN x: c) keeps elements, MAP(a, FN x: e) maps them,
PCT(x, p) is an exact interpolated percentile, DIV divides integers, R'..' is a string
in which a backslash is one.  Row numbers and
conditional counts are BIGINT in both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _close(sql: str, at: int) -> int:
    """Index of the bracket that closes the one at ``at``; quotes hide brackets."""
    depth, quoted = 0, False
    for k in range(at, len(sql)):
        c = sql[k]
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
            if not depth:
                return k
    raise ValueError("unbalanced brackets")


_SWITCH = re.compile(r"@\[((?:(?!@[\[|\]]).)*)@\|((?:(?!@[\[|\]]).)*)@\]", re.S)


def _chosen(plan: str, side: int) -> str:
    """The plan with every switch set to one side, inner ones first."""
    while _SWITCH.search(plan):
        plan = _SWITCH.sub(lambda m: m[side], plan)
    return plan


def _cast(sql: str, head: str) -> str:
    """Every call that begins with ``head``, which ends in an open bracket, as BIGINT."""
    at = 0
    while (at := sql.find(head, at)) >= 0:
        end = _close(sql, at + len(head) - 1)
        sql = f"{sql[:at]}CAST({sql[at : end + 1]} AS BIGINT){sql[end + 1 :]}"
        at += len("CAST(") + len(head)
    return sql


def spark_sql(plan: str) -> str:
    sql = _cast(_chosen(plan, 1), "row_number() OVER (")
    for word, name in (("RX", "regexp_replace"), ("MATCH", "regexp_like"), ("SPLIT", "split"), ("SIZE", "size"), ("FILTER", "filter"), ("MAP", "transform"), ("PCT", "percentile")):
        sql = re.sub(rf"\b{word}\(", f"{name}(", sql)
    sql = re.sub(r"\bFN (\w+):", r"\1 ->", sql)
    return re.sub(r"\bR'", "r'", sql).replace(" DIV ", " div ")


def duck_sql(plan: str) -> str:
    sql = _cast(_chosen(plan, 2), "count_if(")
    while m := re.search(r"\bRX\(", sql):
        end = _close(sql, m.end() - 1)
        sql = f"{sql[: m.start()]}regexp_replace({sql[m.end() : end]}, 'g'){sql[end + 1 :]}"
    for word, name in (("MATCH", "regexp_matches"), ("SPLIT", "string_split_regex"), ("SIZE", "len"), ("FILTER", "list_filter"), ("MAP", "list_transform"), ("PCT", "quantile_cont")):
        sql = re.sub(rf"\b{word}\(", f"{name}(", sql)
    sql = re.sub(r"\bFN (\w+):", r"lambda \1:", sql)
    return re.sub(r"\bR'", "'", sql).replace(" DIV ", " // ")


def run(spark: SparkSession, sf_dir: str, plan: str) -> DataFrame:
    """The plan over the tables of a folder; only the tables that it names are opened."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", plan):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(spark_sql(plan))


def query(plan: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, plan)
