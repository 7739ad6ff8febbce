"""The lint operators on rows of a user's own, against the checked plan and hand-made verdicts."""

from pyspark.sql import functions as F

from lectern.operators import lint
from lectern.operators.duration import Model
from lectern.plans import python_plans, registry

LINE = Model(0.06, 0.2, 100)
FINE = {"doc": 1, "i": 0, "chars": 100.0, "secs": 6.2, "src_known": True, "error": None, "math_frac": 0.0, "digit_frac": 0.0, "speakable_frac": 1.0, "lig_frac": 0.0, "max_tok": 12, "exotic_n": 0, "rms_db": -20.0, "silence_frac": 0.1, "max_gap": 0.5, "lead_sil": 0.1, "trail_sil": 0.1, "clip_frac": 0.0, "dc": 0.0, "ratio": None, "ins_rate": 0.0, "del_rate": 0.0, "dup_cov": 0.0, "codepoint_hits": 0}
KINDS = {int: "long", float: "double", bool: "boolean", type(None): "string", str: "string"}
SCHEMA = ", ".join(f"{k} {'double' if k == 'ratio' else KINDS[type(v)]}" for k, v in FINE.items())


def table(spark, *changes):
    return spark.createDataFrame([tuple((FINE | {"i": k} | c).values()) for k, c in enumerate(changes)], SCHEMA)


def test_first_tier_equals_the_plan(spark, sf_dir):
    """With the plan's line, and without the ligatures that it leaves out, every class is the plan's."""
    rows = python_plans.measured_rows(spark, sf_dir).withColumn("lig_frac", F.lit(0.0))
    got = lint.tier1(rows, LINE).select("doc", "i", F.col("cls").alias("mine"))
    plan = registry.QUERIES["tier1_classify"](spark, sf_dir).select("doc", "i", "cls")
    both = plan.join(got, ["doc", "i"], "full")
    assert both.where("NOT (mine <=> cls)").limit(5).collect() == [] and both.select("cls").distinct().count() >= 6


def test_first_tier_by_rule(spark):
    cases = [
        ({}, "ok", []), ({"error": "empty"}, "silence", ["empty"]), ({"error": "unreadable"}, "missing", ["unreadable"]), ({"rms_db": -60.0}, "silence", ["silence", "level-60dB"]),
        ({"max_gap": 3.0}, "silence", ["gap3.0s"]), ({"trail_sil": 2.5}, "silence", ["edge-silence"]), ({"clip_frac": 0.01}, "level", ["clipping"]), ({"dc": -0.5}, "level", ["dc-offset"]),
        ({"secs": 9.3}, "duration", ["long1.50x"]), ({"lig_frac": 0.01}, "ok", ["unspeakable-source"]), ({"lig_frac": 0.01, "secs": 9.3}, "unspeakable", ["long1.50x", "unspeakable-source"]),
        ({"max_tok": 50}, "unspeakable", ["unspeakable-source", "token50"]), ({"exotic_n": 2}, "ok", ["exotic2"]), ({"src_known": False, "secs": 9.3}, "ok", ["no-source"]), ({"src_known": None}, "ok", ["no-source"]),
        ({"chars": 0.0}, "ok", ["no-source"]), ({"rms_db": None, "max_gap": None, "digit_frac": None}, "ok", []),
    ]
    got = {r.i: r for r in lint.tier1(table(spark, *(c for c, *_ in cases)), LINE).collect()}
    assert [(got[k].cls, got[k].flags) for k in range(len(cases))] == [(cls, flags) for _, cls, flags in cases]


def test_second_tier_by_rule(spark):
    cases = [
        ({"secs": 9.3}, "duration"), ({"secs": 9.3, "ratio": 1.0}, "ok"), ({"secs": 9.3, "ratio": 0.8}, "duration"), ({"ratio": 1.0, "codepoint_hits": 1}, "unspeakable"),
        ({"ratio": 1.32, "lig_frac": 0.01}, "unspeakable"), ({"ratio": 1.0, "lig_frac": 0.01}, "ok"), ({"ratio": 1.4, "ins_rate": 0.4, "dup_cov": 0.3}, "repetition"), ({"ratio": 0.7, "del_rate": 0.3}, "truncation"),
        ({"max_gap": 3.0, "ratio": 1.0}, "silence"), ({"secs": 20.0, "ratio": 1.0}, "duration"),
    ]
    got = {r.i: r for r in lint.tier2(lint.tier1(table(spark, *(c for c, _ in cases)), LINE)).collect()}
    assert [got[k].cls for k in range(len(cases))] == [cls for _, cls in cases]
    assert got[0].flags == ["long1.50x"] and got[1].flags == ["long1.50x", "asr1.00"]


def test_summary(spark):
    rows = lint.tier2(lint.tier1(table(spark, {}, {"secs": 9.3}, {"error": "gone", "secs": None}, {"doc": 2, "ratio": 1.0}, {"doc": None}), LINE))
    got = {r.doc: r for r in lint.summarised(rows, spark.createDataFrame([(1, 3), (2, 4)], "doc long, planned long")).collect()}
    one = got[1]
    assert (one.chunks, one.bad, one.classes, one.bad_secs, one.secs, one.bad_frac, one.severity) == (3, 2, {"ok": 1, "duration": 1, "missing": 1}, 9.3, 15.5, 0.6667, 5)
    assert [(got[d].tier2, got[d].plan_mismatch) for d in (1, 2, None)] == [(False, False), (True, True), (False, True)]
    assert lint.summarised(rows.limit(0), spark.createDataFrame([], "doc long, planned long")).collect() == []
