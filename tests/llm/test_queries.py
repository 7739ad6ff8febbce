"""The registered queries against their SQL, and the pipeline stage by stage."""

import collections
import random

import pytest

import corpus_pipeline
import oracle
from lectern.llm import queries, shared

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.compare(spark, queries.queries()[name], SQL[name], sf_dir)


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage."""
    docs, out = shared.table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = shared.cut(stage(spark, docs, sf_dir))
        out[name] = (docs, made)
        docs = made
    return out


def test_quality_stage_drops_what_it_predicts_bad(spark, sf_dir, stages):
    before, after = stages["quality_classifier"]
    labels = {r.doc_id: r.quality for r in shared.table(spark, sf_dir, "labels").collect()}
    kept = rows(after)
    judged = [i for i in rows(before) if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in judged) >= 0.97 * len(judged)
    assert after.columns == before.columns


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup_stage_against_all_pairs(stages):
    before, after = (rows(x) for x in stages["simhash_near_dedup"])
    sets = {i: shingles(t) for i, t in before.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first, holders, near = {}, collections.defaultdict(list), 0
    for i in sorted(sets):
        a, b = find(i), find(first.setdefault(sets[i], i))
        parent[max(a, b)] = min(a, b)
    for i in first.values():
        for s in sets[i]:
            holders[s].append(i)
    pairs = collections.Counter((a, b) for group in holders.values() for k, a in enumerate(group) for b in group[k + 1 :])
    for (a, b), n in pairs.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            near += 1
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert near and set(after) == {i for i in sets if find(i) == i}
    assert all(after[i] == before[i] for i in after)


def test_substring_stage_against_brute_force(stages):
    before, after = (rows(x) for x in stages["substring_dedup"])
    first, want = {}, {}
    for i in sorted(before):
        w = before[i].encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in before.items():
        w = t.encode().split()
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want[i] = [x for p, x in enumerate(w) if p not in gone]
    assert {i: t.encode().split() for i, t in after.items()} == want


def test_decontamination_stage_against_plain_search(spark, sf_dir, stages):
    before, after = (rows(x) for x in stages["benchmark_decontamination"])
    items = [r.text for r in shared.table(spark, sf_dir, "benchmark").collect()]
    assert {i for i, t in before.items() if any(x in t for x in items)} == set(before) - set(after)


def test_packing_stage_packs_every_document(stages):
    before, made = stages["packing"]
    got = made.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in got} == set(rows(before))
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)


def test_empty_documents_pass_through_every_stage(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        assert made.count() == 0
        docs = made if "text" in made.columns else docs


def test_awkward_documents_pass_through_every_stage(spark, sf_dir):
    """Nulls, repeated ids and rows, very long texts and clashing extra columns."""
    rng = random.Random(5)
    plain = [r.text for r in shared.table(spark, sf_dir, "documents").orderBy("doc_id").limit(12).collect()]
    passage = " ".join(f"q{rng.randrange(999)}" for _ in range(60))
    made = [(i, t, "en", None, None) for i, t in enumerate(plain)]
    made += [(50, f"AAA {passage} tailA", "en", "s", 1), (50, " ".join(f"z{rng.randrange(9999)}" for _ in range(77)), "de", "s", 2), (3, f"first {passage} end", None, "s", 3)]
    made += [(None, None, None, None, None), (None, "", None, None, None), (None, " ".join(f"y{rng.randrange(9999)}" for _ in range(50_000)), None, None, None), (40, plain[0], "en", None, None), (40, plain[0], "en", None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in made], "doc_id long, text string, lang string, source string, n_chars long, id long, found string, quality_score int")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "packing" or out.columns == columns
        got = out.collect()
        if name == "substring_dedup":
            by = sorted(r.text for r in got if r.doc_id == 50)
            assert by == sorted(["AAA tailA", made[13][1]]) and len(got) == len(made)
            assert any(passage in (r.text or "") for r in got if r.doc_id == 3)
        elif name == "simhash_near_dedup":
            assert collections.Counter(r.doc_id for r in got)[40] == 0 and sum(r.doc_id == 50 for r in got) == 1
            assert sum(not (r.text or "").strip() for r in got) == 1
        elif name == "packing":
            assert sum(r.start == 0 for r in got) == len(made)


def test_quality_on_held_out_documents(spark, sf_dir):
    scored = queries.queries()["op9_quality"](spark, sf_dir.replace("sf0.01", "sf0.1"))
    labels = shared.table(spark, sf_dir.replace("sf0.01", "sf0.1"), "labels")
    held = scored.where("held_out").join(labels, "doc_id").where("quality IN (0, 1)").selectExpr("avg(CAST(predicted = quality AS INT)) AS hit", "count(*) AS n").first()
    assert held.n > 900 and held.hit >= 0.98
