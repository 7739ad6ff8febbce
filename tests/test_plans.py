"""Every plan of the registry: Spark and DuckDB give the same rows, and most give some."""

import collections
import re

import oracle
import pytest

from lectern.operators import duration, folders
from lectern.plans import dialect, lint, registry

NO_ROWS = {"rate_flag_superset"}  # an invariant: nothing escapes the flags


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_plan_equals_sql(spark, sf_dir, name):
    oracle.compare(spark, registry.QUERIES[name], registry.ORACLE[name], sf_dir)
    assert (registry.QUERIES[name](spark, sf_dir).limit(1).count() == 0) == (name in NO_ROWS)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_python_plan_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def n_sentences(text):
    """Sentences end at . ! ? before white space."""
    return len(re.split(r"(?<=[.!?])\s+", text))


def test_speech_rewrite_returns_every_sentence(spark, sf_dir):
    want = {r.doc_id: n_sentences(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = collections.defaultdict(set)
    for r in registry.QUERIES["speech_rewrite"](spark, sf_dir).collect():
        got[r.doc_id].add(r.sn)
    assert max(want.values()) > 16 and got == {i: set(range(1, n + 1)) for i, n in want.items()}


def test_link_mail_strip_reaches_every_sentence(spark, tmp_path):
    texts = ["One. Two www.a.org/x here. Three me@b.org there. Four. Five http://c.org/?q=1 or d.e@f.co.uk end.", "See doi:10.1/x now."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.sn): r.s for r in registry.QUERIES["link_mail_strip"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, k + 1) for i, t in enumerate(texts) for k in range(n_sentences(t))}
    assert not any("@" in s or "www." in s or "http" in s or "doi:" in s for s in got.values())
    assert got[0, 2].startswith("Two  here.") and got[0, 5].startswith("Five  or  end.")


def test_folder_move_guard_checks_every_folder(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    parent = {1 + r.r_regionkey: 0 for r in read("region")} | {100 + n.n_nationkey: 1 + n.n_regionkey for n in read("nation")} | {1000 + c.c_custkey: 100 + c.c_nationkey for c in read("customer")}

    def allowed(folder, target):
        while target:
            if target == folder:
                return False
            target = parent.get(target)
        return True

    targets = {i: (1 + i % 5, i, 100 + i % 25)[i % 3] for i in parent}
    got = registry.QUERIES["folder_move_guard"](spark, sf_dir).collect()
    assert sorted((r.folder, r.target, r.allowed) for r in got) == sorted((i, t, allowed(i, t)) for i, t in targets.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dialects():
    plan = "SELECT RX(RX(x, R'\\s', ''), '(', 'y') AS a, @[1@|@[2@|3@]@] AS b, count_if(SIZE(x) > 1) FROM t"
    assert dialect.spark_sql(plan) == "SELECT regexp_replace(regexp_replace(x, r'\\s', ''), '(', 'y') AS a, 1 AS b, count_if(size(x) > 1) FROM t"
    assert dialect.duck_sql(plan) == "SELECT regexp_replace(regexp_replace(x, '\\s', '', 'g'), '(', 'y', 'g') AS a, 3 AS b, CAST(count_if(len(x) > 1) AS BIGINT) FROM t"


def test_filters_reach_the_scan(spark, sf_dir):
    df = registry.QUERIES["lint_rollup"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "BatchEvalPython" not in plan


def test_duration_model_is_robust(spark):
    """Rows on a line of 0.06 seconds a character and 0.25, a few far off: these go, and the line stays."""
    rows = [(float(c), 0.06 * c + 0.25 + (0.001 if c % 2 else -0.001)) for c in range(100, 200)] + [(150.0 + k, 40.0 + k) for k in range(7)]
    got = duration.fit(spark.createDataFrame(rows, "chars double, secs double"))
    assert got.n == 100 and abs(got.a - 0.06) < 1e-4 and abs(got.b - 0.25) < 1e-2
    # Under 50 rows at the start: a fixed rate; a trim that leaves fewer keeps the line.
    few = duration.fit(spark.createDataFrame(rows[:49], "chars double, secs double"))
    assert (few.a, few.b) == (1 / 15.5, 0.0)
    assert duration.fit(spark.createDataFrame([], "chars double, secs double")).n == 0
    wild = [(float(c), 0.06 * c) for c in range(100, 145)] + [(100.0 + k, 30.0 + 5 * k) for k in range(9)]
    kept = duration.fit(spark.createDataFrame(wild, "chars double, secs double"))
    assert kept.n == 45 and abs(kept.a - 0.06) < 1e-9


def test_names_take_the_smallest_free_number(spark, tmp_path):
    rows = [(1, "blue x"), (2, "blue y"), (4, "blue z"), (50, "blue q"), (100, "blue r"), (7, "red a")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r.name for r in registry.QUERIES["unique_names"](spark, str(tmp_path)).collect()}
    # 50 and 100 are "blue (2)" by themselves; 2 is free of neither "blue" nor "blue (2)".
    assert got == {1: "blue", 2: "blue (3)", 4: "blue (4)", 50: "blue (2)", 100: "blue (2) (2)", 7: "red"}


def test_folders_of_any_depth(spark):
    rows = [(k, k - 1, f"f{k}") for k in range(1, 41)] + [(100, 101, "x"), (101, 100, "y")]
    got = folders.ancestors(spark.createDataFrame(rows, "id long, parent_id long, name string"))
    by = {r.folder: (r.path, r.depth) for r in folders.paths(got).collect()}
    assert by[40] == ("/".join(f"f{k}" for k in range(1, 41)), 40) and by[1] == ("f1", 1) and set(by) == {*range(1, 41), 100, 101}
    assert folders.ancestors(got.limit(0).selectExpr("folder AS id", "at AS parent_id", "name")).count() == 0


def test_median_by_histograms(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(duration, "EXACT", 5)
    rng = np.random.default_rng(1)
    for values in (rng.standard_normal(1001), rng.integers(0, 3, 500).astype(float), np.full(40, 7.0), rng.standard_normal(300) * 1e-9 + 5):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        assert duration.median(df, df.x, len(values)) == np.median(values)


def test_places_of_a_whole_table(spark):
    """Against a sort in Python: nulls first, a value that half of the rows share, sums with nulls, no rows."""
    from pyspark.sql import functions as F

    from lectern.operators import ranking

    rows = [(k, None if k % 10 == 3 else 0 if k % 2 else k % 7, None if k % 5 == 0 else k % 11, "x" * (k % 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, ord long, n long, x string").repartition(6)
    got = {r.id: r for r in ranking.ranked(df, ["ord", "id"], "at", {"n_before": "n"}).collect()}
    before = 0
    for place, (k, _, n, x) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1):
        assert (got[k].at, got[k].n_before, got[k].x) == (place, before, x)
        before += n or 0
    last = ranking.ranked(df, [F.desc("ord"), F.desc("id")]).collect()
    assert sorted(r.place for r in last) == list(range(1, 501)) and {r.id for r in last if r.place > 450} == {k for k, o, *_ in rows if o is None}
    assert ranking.ranked(df.limit(0), ["id"], "at", {"s": "n"}).collect() == []
    assert [r.at for r in ranking.ranked(df.where("id = 4"), ["id"], "at").collect()] == [1]
    with pytest.raises(ValueError):
        ranking.ranked(df.withColumnRenamed("x", "_at"), ["id"])


def test_whole_orders_take_no_single_task_window(spark, sf_dir):
    for name in ("chapters", "library_sort", "manifest_view", "lint_doc_rank"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan, name


def test_wanted_names_match_whole_or_in_part(spark, tmp_path):
    """Against the rule in Python: a name that is wanted as a whole wins, else all that hold it; the empty one is held by all."""
    parts = [(97, "ab"), (501, "abcdef"), (502, "xabcy"), (1002, "zzz"), (1503, "q r"), (3, None), (5, "")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([("abc",), ("bc",), ("c",), ("ABC",), ("q r",), ("none such",), ("",), (None,)], "s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    wanted = {"abc", "bc", "c", "ABC", "q r", "none such", "", "ab"} | {n[: k % 7] for k, n in parts if n and k % 501 == 0}
    names = {k: n for k, n in parts if n is not None}
    want = {(w, k) for w in wanted for k, n in names.items() if (n == w if w in names.values() else w in n)}
    got = [(r.only, r.p_partkey) for r in registry.QUERIES["select_exact_else_substring"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_folders_of_any_number(spark, sf_dir, tmp_path):
    """Beyond the rows that Spark's recursion allows; with repeated ids, null ids, parents and names, as SQL counts them."""
    names = [(k, k % 30, f"c{k}") for k in range(2000)] + [(7, 3, "again"), (None, 4, "none"), (8, None, "top"), (9000, 5, None), (9001, None, None)]
    spark.createDataFrame([(k, f"r{k}") for k in range(5)], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(k, k % 5, f"n{k}") for k in range(25)], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(names, "c_custkey long, c_nationkey int, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    for t in set(oracle.TABLES) - {"region", "nation", "customer"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        got = {q: registry.QUERIES[q](spark, str(tmp_path)) for q in ("folder_ancestors", "folder_move_guard")}
        assert got["folder_ancestors"].count() == 2000 + 30 + 3
        oracle.compare(spark, lambda *_: got["folder_move_guard"], registry.ORACLE["folder_move_guard"], str(tmp_path))
        # Rows of one id stand in an open order in SQL's path.
        open_ = "folder IS NULL OR folder NOT IN (1007, 1008)"
        oracle.compare(spark, lambda *_: got["folder_ancestors"].where(open_), f"SELECT * FROM ({registry.ORACLE['folder_ancestors']}) x WHERE {open_}", str(tmp_path))
        assert {r.folder: r.depth for r in got["folder_ancestors"].where(f"NOT ({open_})").collect()} == {1007: 6, 1008: 4}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_folders_under_a_circle(spark):
    rows = [(1, 2, "a"), (2, 1, "b"), (3, 1, "c"), (4, 3, "d"), (5, 5, "e"), (None, 5, "f")]
    got = folders.ancestors(spark.createDataFrame(rows, "id long, parent_id long, name string")).collect()
    assert sorted((r.folder, r.steps, r.at) for r in got if r.folder) == [(1, 0, 1), (1, 1, 2), (2, 0, 2), (2, 1, 1), (3, 0, 3), (3, 1, 1), (3, 2, 2), (4, 0, 4), (4, 1, 3), (4, 2, 1), (4, 3, 2), (5, 0, 5)]
    assert sorted(r.steps for r in got if r.folder is None) == [0, 1]


def test_wanted_names_send_no_side_to_all_tasks(spark, sf_dir, tmp_path):
    """The grams of all parts look small to Spark, which takes the files' size; and parts of one name are all found."""
    parts = [(k, ("abcdef", "xabcy", "bc")[k % 3]) for k in range(1, 40)] + [(501, "abc d"), (1002, "abc d")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([("abc",), ("bc",), ("d",), ("none",)], "s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760", "10485760b", "10MB")
    for folder in (sf_dir, str(tmp_path)):
        plan = registry.QUERIES["select_exact_else_substring"](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    got = sorted((r.only, r.p_partkey) for r in registry.QUERIES["select_exact_else_substring"](spark, str(tmp_path)).collect())
    wanted = {"abc", "bc", "d", "none", "abc d"[: 501 % 7], "abc d"[: 1002 % 7]}
    assert got == sorted((w, k) for w in wanted for k, n in parts if (n == w if w == "bc" else w in n))
