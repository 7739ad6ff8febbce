"""Every operator against a brute-force version, and on awkward tables."""

import collections
import datetime
import hashlib
import io
import itertools
import math
import random
import subprocess
import sys
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, embeddings, hilbert, html, packing, quality, queries, shared, simhash, substrings, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns of names that operators use inside."""
    rng = random.Random(3)
    base = words(rng, 60)
    texts = [None, "", "   \n\t ", base, base, base + " tail", "x", words(rng, 30_000, 5000), "é ﬁ 𝜋 " * 40, base.upper(), words(rng, 20) + " " + base]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, i, "k", 1.0) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base, "en", "s", 5, 9, "k", 1.0), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", id long, key string, found double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


#: A task of its own process: how many MB go back to the system only when asked to after it.
FREED = """
import ctypes, random, re
import pyarrow as pa
from lectern.llm import packing, simhash, shared

class Frame:
    def mapInArrow(self, run, schema):
        return run

def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches():
    draw = random.Random(1)
    for _ in range(4):
        texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(400)) for _ in range(2000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(texts)], ["order", "th", "text"])

for _ in simhash.described(Frame(), simhash.Similar())(batches()):
    pass
before = held()
ctypes.CDLL(None).malloc_trim(0)
print(before - held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="asks glibc and /proc")
def test_tasks_give_back_what_they_freed():
    said = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True)
    assert float(said.stdout) < 10


def test_only_packing_keeps_its_encoder():
    """Tasks that need no encoder do not run beside one that packing left in their worker."""
    from pyspark import cloudpickle

    def sent(keeps):
        return cloudpickle.loads(cloudpickle.dumps(shared.giving_back(lambda batches: batches, keeps)))

    encode = packing.encoder(queries.tokenizer_path())
    assert list(sent(True)(iter([1]))) == [1] and packing.encoder(queries.tokenizer_path()) is encode
    assert list(sent(False)(iter([1]))) == [1] and not shared.KEPT


def test_giving_back_changes_no_row(spark):
    rows = spark.range(5000).repartition(3)
    assert rows.mapInArrow(shared.giving_back(lambda batches: batches), "id long").agg(F.count("id"), F.sum("id")).first() == (5000, 4999 * 2500)
    assert rows.mapInArrow(shared.giving_back(lambda batches: batches), "id long").limit(3).count() == 3


# --- 1 packing


def test_packing_places_every_id_once(spark, awkward, empty):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    docs = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = packing.pack_documents(docs.coalesce(1), path, with_ids=True).collect()
    want = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        assert r.doc_tokens == len(want[r.id])
        by[r.id].append((r.start, r.ids))
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in by.items()} == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and len(pieces) <= 256
    total = sum(len(v) for v in want.values())
    assert len(sequences) <= total // 4096 + 2
    assert packing.pack_documents(empty, path).count() == 0
    assert packing.pack_documents(awkward, path).count() >= awkward.count()


def test_packing_keeps_all_three_limits():
    limits = packing.Limits(tokens=100, segments=3, loss=40)
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 99, n).astype("<u4") for n in rng.integers(1, 150, 300)]
    bears = [rng.random(len(x)) < rng.random() for x in ids]
    items = [packing.Item(k, x, None if k % 5 == 0 else y) for k, (x, y) in enumerate(zip(ids, bears))]
    got, full = collections.defaultdict(list), 0
    for made in packing.pack(items, limits, last=True):
        n, loss = sum(len(p[2]) for p in made), sum(p[3] for p in made)
        assert 0 < n <= 100 and len(made) <= 3 and loss <= 40
        full += loss == 40
        for name, start, some, loss, size in made:
            assert size == len(ids[name]) and loss == (len(some) if name % 5 == 0 else bears[name][start : start + len(some)].sum())
            got[name].append((start, some.tolist()))
    assert {k: [x for _, y in sorted(v) for x in y] for k, v in got.items()} == {k: x.tolist() for k, x in enumerate(ids)}
    assert full > 50 and not items


def test_conversations_pack_with_their_own_loss(spark):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    turns = [(c, t, ("user", "assistant")[t % 2], words(rng, rng.randrange(40))) for c in range(40) for t in range(4)] + [(99, 0, None, None), (98, 0, "assistant", "")]
    table = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = packing.pack_conversations(table.coalesce(1), path, limits=packing.Limits(256, 4, 48), with_ids=True).collect()
    ids, loss, used = collections.defaultdict(list), collections.Counter(), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        ids[r.id] += r.ids
        loss[r.id] += r.loss_tokens
        used[r.sequence_id].append(r)
    for c in range(40):
        own = [(tokenizer.encode(t, add_special_tokens=False).ids, role == "assistant") for k, _, role, t in turns if k == c]
        assert ids[c] == [x for y, _ in own for x in y] + [2] and loss[c] == sum(len(y) for y, learned in own if learned) + 1
    assert ids[99] == ids[98] == [2] and (loss[99], loss[98]) == (0, 1)
    sums = [(sum(r.length for r in v), len(v), sum(r.loss_tokens for r in v)) for v in used.values()]
    assert all(a <= 256 and b <= 4 and c <= 48 for a, b, c in sums) and sum(c == 48 for *_, c in sums) > len(sums) // 2


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = [*map(chr, range(0x21, 0x7F)), "\u0120", "\u010a"]
    vocabulary = {x: k for k, x in enumerate(letters)} | {"\u0120w": 300, "\u0120w0": 301}
    tokenizer = Tokenizer(models.BPE(vocabulary, [("\u0120", "w"), ("\u0120w", "0")]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "own.json")
    tokenizer.save(path)
    text = "w0 w0  w1\nw0"
    assert packing.WordEncoder(path)(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, own = Tokenizer.from_file(path), packing.WordEncoder(path, most=50)
    for text in ["", "It's Été, straße...", "a<|endoftext|>b <|STARTOFTEXT|>", "ΟΔΟΣ. ΣΑ", "é é", "x\x1cy z 12½", "w!! (a) b). ''s", words(random.Random(2), 500)]:
        assert own(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


# --- 2 SimHash


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_all_pairs(spark):
    rng = random.Random(5)
    base = [words(rng, 40).split() for _ in range(15)]
    texts = []
    for k in range(160):
        w = list(base[k % 15])
        for _ in range(k // 40):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += ["", None, "a b", " A  B"]
    docs = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = {10 * i: (simhash.signed(p), 10 * g) for i, (p, g) in enumerate(zip(prints, groups(len(texts), links)))}
    assert {r.id: (r.f0, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_bit_sliced_counters_equal_popcounts():
    rng = np.random.default_rng(0)
    for parts, radius in ((1, 0), (1, 4), (2, 60), (4, 46)):
        x = rng.integers(0, 1 << 63, (200, parts), dtype=np.uint64)
        x[50:120] = x[0] ^ (rng.integers(0, 1 << 63, (70, parts), dtype=np.uint64) & rng.integers(0, 1 << 63, (70, parts), dtype=np.uint64) & rng.integers(0, 1 << 63, (70, parts), dtype=np.uint64))
        planes = simhash.bit_planes(x ^ x[0])
        near = simhash.lanes_of(simhash.close_lanes(planes, planes.shape[1:], radius), 200)
        assert near.tolist() == np.flatnonzero(np.bitwise_count(x ^ x[0]).sum(axis=1) <= radius).tolist()


def test_similar_sets_join_as_all_pairs_do():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = [rng.integers(0, 1000, rng.integers(3, 60)) for _ in range(5)]
        sets = []
        for _ in range(rng.integers(2, 40)):
            x = base[rng.integers(5)].copy()
            n = rng.integers(0, 6)
            x[rng.integers(0, len(x), n)] = rng.integers(0, 1000, n)
            sets.append(np.unique(x).astype(np.uint64))
        alike = [(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
        a, b = simhash.similar_links(sets, 0.8)
        assert len(a) < len(sets)
        assert groups(len(sets), list(zip(a.tolist(), b.tolist()))) == groups(len(sets), alike)


def test_checked_links_join_only_similar_texts(spark):
    rng = random.Random(8)
    base = [words(rng, 80).split() for _ in range(6)]
    texts = []
    for k in range(120):
        w = list(base[k % 6])
        for _ in range(k // 12):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += ["", None, "one two"]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "node long, text string")
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    links = [(i, j) for i in range(120) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    want = groups(len(texts), links)
    labels = spark.createDataFrame([(3 * i, 0) for i in range(len(texts))], "node long, component long")
    for block in (16, 2048):
        got = list(range(len(texts)))
        for r in shared.components(simhash.checked_links(docs, labels, 5, 0.8, rows=block)).collect():
            got[r.node // 3] = r.component // 3
        assert got == want


def plain_classes(texts):
    """Class of each text by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return groups(len(sets), links)


def edited(rng, base, k):
    w = list(base)
    for _ in range(k):
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.randrange(2)] = [f"n{rng.randrange(50)}"] * rng.randrange(2)
    return " ".join(w)


def test_similar_texts_of_all_lengths_are_found(spark):
    """Every pair at 0.8, short texts and just reached thresholds among them; a frequent passage changes nothing."""
    rng = random.Random(21)
    hot = words(rng, 30)
    texts = ["", None, " ", "a", "A", "a b"]
    for n in [*range(4, 24), 40, 80, 200]:
        base = words(rng, n, 2000).split()
        texts += [edited(rng, base, k) for k in (0, 0, 1, 1, 1, 2, 2, 3, n // 12, n // 8)]
    texts += [f"{hot} {words(rng, 12, 5000)}" for _ in range(150)]
    want = plain_classes(texts)
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for s in (simhash.Similar(), simhash.Similar(often=2, total=4)):
        assert sorted(r.doc_id // 3 for r in simhash.first_of_each(docs, s=s).collect()) == sorted(set(want))


def test_small_sets_stay_within_the_radius():
    """At a similarity of 0.8 fingerprints of small sets, which differ the most, keep well below the radius."""
    rng = np.random.default_rng(5)
    s = simhash.Similar()
    for both, one, two in [(4, 1, 0), (4, 0, 1), (8, 1, 1), (8, 2, 0), (12, 3, 0), (16, 2, 2), (40, 5, 5), (400, 50, 50)]:
        far = []
        for _ in range(150):
            x = rng.integers(0, 1 << 63, both + one + two, dtype=np.uint64)
            a, b = x[: both + one], np.concatenate((x[:both], x[both + one :]))
            far.append(int(np.bitwise_count(simhash.majority(iter([a]), 4) ^ simhash.majority(iter([b]), 4)).sum()))
        assert np.mean(far) + 5 * np.std(far) < s.radius, (both, one, two, np.mean(far), np.std(far))


def test_one_row_of_each_class_stays(spark, awkward, empty):
    kept = simhash.first_of_each(awkward).collect()
    assert collections.Counter(r.doc_id for r in kept) == collections.Counter([0, 3, 6, 7, 8, 10])
    assert simhash.first_of_each(awkward).columns == awkward.columns and simhash.first_of_each(empty).count() == 0
    rows = [(9, "x " * 9, "a"), (9, words(random.Random(1), 20), "b"), (None, "x " * 9, "c"), (None, "only here", "d"), (None, "only here", "e"), (4, "z z z", "f"), (4, "z z z", "g")]
    got = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert collections.Counter(r.text for r in got) == {r: 1 for r in {t for _, t, _ in rows}}


def test_meetings_go_over_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 7), (1, 9), (2, 3), (3, 4), (3, 4), (4, 1), (4, 6)]
    for cuts in ([8], [2, 6], [1] * 8):
        batches, at = [], 0
        for n in cuts:
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + n]], pa.int64()) for k in (0, 1)], ["key", "h"]))
            at += n
        got = {(r["key"], r["h"]) for b in simhash.meetings(batches) for r in b.to_pylist()}
        assert got == {(5, 5), (5, 7), (5, 9), (1, 1), (1, 6)}


def test_blocks_of_a_large_bucket_link_like_one(spark):
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 20, 300).astype(np.int64)
    nodes = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints)], "node long, f0 long")
    links = [(i, j) for i in range(300) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3]
    want = groups(300, links)
    for block in (16, 4096):
        found = shared.components(simhash.near_links(simhash.block_keys(nodes, 3), 3, block=block)).collect()
        got = list(range(300))
        for r in found:
            got[r.node] = r.component
        assert got == want


def test_blocks_compare_all_pairs_however_they_are_grouped():
    rng = np.random.default_rng(3)
    for n, few in ((200, 2), (200, 60), (700, 9)):
        prints = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        prints = prints[rng.integers(0, max(1, n // few), n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 2), dtype=np.uint64))
        want = groups(n, [(i, j) for i in range(n) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= 3])
        links = [(int(i), int(j)) for a, b in simhash.spanning_links(prints, 3, queries=16) for i, j in zip(a, b)]
        assert groups(n, links) == want


def test_simhash_on_awkward_tables(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = {r.component_id for r in rows if r.f0 == 0}
    assert len(zero) == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(500, 500)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}}


# --- 3 embeddings


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + rng.standard_normal((20, 16)) * 0.02, np.repeat(base[:1], 5, axis=0), base[:1] + rng.standard_normal((60, 16)) * 0.12]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0, 1) for i, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [1.0, 2.0])]
    table = spark.createDataFrame(rows + [(*r, 0, 1) for r in odd], "vec_id long, embedding array<float>, label int, node int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want_groups = groups(len(u), [(int(i), int(j)) for i, j in np.argwhere(near)])
    for block in (16, 1024):
        got = {r.id: r for r in embeddings.near_vectors(table, p=embeddings.Passes(block=block)).collect()}
        assert [got[i].component_id for i in range(len(u))] == want_groups
        assert [got[i].n_links for i in range(len(u))] == near.sum(axis=1).tolist()
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
        assert (got[907].component_id, got[907].n_links, got[907].kept) == (906, 1, False)
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    assert embeddings.near_vectors(table.where("vec_id < 903 AND vec_id >= 900")).count() == 3


def test_links_inside_a_dense_group_are_found(spark):
    """A third of all rows just below the threshold: windows are full of what is no link."""
    rng = np.random.default_rng(4)
    centre = np.eye(64)[0]

    def around(k):
        r = rng.standard_normal((k, 64))
        r[:, 0] = 0
        return np.sqrt(0.88) * centre + np.sqrt(0.12) * r / np.linalg.norm(r, axis=1, keepdims=True)

    x = around(1500)
    other = around(60)
    other -= np.einsum("ij,ij->i", other, x[:60])[:, None] * x[:60]
    x = np.concatenate([x, 0.955 * x[:60] + np.sqrt(1 - 0.955**2) * other / np.linalg.norm(other, axis=1, keepdims=True), rng.standard_normal((3000, 64))])
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r.id: r.n_links for r in embeddings.near_vectors(table).collect()}
    assert want.sum() >= 120 and [got[i] for i in range(len(x))] == want.tolist()


def test_vectors_of_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 0.01]), (None, [5.0, -5.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (0, 1, 0, False), (1, 1, 0, False), (1, 1, 1, True), (2, 1, 1, False)] or len(got) == 5


# --- 4 substrings


def plain_substrings(rows, window):
    """Sorted answers for (id, text) rows; rows of one id take nothing from each other."""
    rows = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in rows:
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out)


#: One byte of a hash, small rounds and buckets: everything collides and is cut everywhere.
NARROW = substrings.Sizes(sent=1, round=60, opened=50, bucket_bytes=300)


def test_substrings_equal_brute_force(spark, awkward, empty):
    rng = random.Random(9)
    shared_part = words(rng, 40)
    rows = [(i, f"{words(rng, rng.randrange(60), 12)} {shared_part if i % 3 == 0 else ''}\n{words(rng, 15, 4)}") for i in range(120)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, "a " * 500), (204, "a " * 400)]
    # Rows of one id with different and with equal texts, and a negative id.
    rows += [(50, words(rng, 30, 12)), (50, rows[7][1]), (9, f"AAA {shared_part} tail"), (-3, rows[3][1]), (60, rows[60][1])]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (1, 5, 13):
        for sizes in (substrings.Sizes(), NARROW):
            got = substrings.remove_repeats(docs, window=window, digest=True, sizes=sizes).collect()
            assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_substrings(rows, window)
    full = substrings.remove_repeats(docs.withColumn("found", F.lit("x")), window=13, keep=("found",)).collect()
    assert all(sum(x["end"] - x["start"] for x in r.intervals) == r.n_removed and r.found == "x" for r in full)
    assert sorted((r.id, r.n_words, r.n_removed, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in full) == plain_substrings(rows, 13)
    assert substrings.remove_repeats(awkward, window=13).count() == awkward.count()
    assert substrings.remove_repeats(empty).count() == 0


def test_rows_without_an_id_give_way(spark):
    text = words(random.Random(2), 30)
    rows = spark.createDataFrame([(None, text), (7, text), (None, "only " + words(random.Random(3), 30))], "doc_id long, text string")
    assert sorted((r.id or 0, r.n_removed) for r in substrings.remove_repeats(rows).collect()) == [(0, 0), (0, 30), (7, 0)]


def test_texts_are_shuffled_once(spark, sf_dir):
    df = substrings.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_runs_come_back():
    rng = np.random.default_rng(6)
    for n in (1, 2, 500):
        who, nth, at = rng.integers(-5, 1 << 62, n), rng.integers(0, 2, n), rng.integers(0, 1 << 20, n)
        order = np.lexsort((at, nth, who))
        back = substrings.run_values(*substrings.run_lengths(who[order], nth[order], at[order]))
        assert all((a == b[order]).all() for a, b in zip(back, (who, nth, at)))


# --- 5 HTML


def page(title, paras, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paras)
    return f"<html><head><title>{title}</title><script>var t='</p>';</script></head><body><header>Site <a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div class='cookie-notice'>We use cookies</div><div id=content><h1>{title}</h1>{body}<div class=share>Share this</div></div><aside>Other news</aside><form><input name=q>Search</form><div class=comments><p>first!</div>{extra}<footer>&copy; Site</footer></body></html>"


def test_html_without_article_markup():
    rng = random.Random(6)
    sources = [page(f"Title {i}", [words(rng, 30), words(rng, 25) + " &amp; more\n  spaces"]) for i in range(6)]
    for i, text in enumerate(html.extract_group(sources)):
        lines = text.split("\n")
        assert lines[0] == f"Title {i}" and len(lines) == 3 and lines[2].endswith("& more spaces")


def test_html_constant_nodes_are_template():
    rng = random.Random(8)
    sources = [f"<div><div>Terms apply to this site</div><div><h2>{words(rng, 3)}</h2><p>{words(rng, 40)}</p><p>All rights reserved here</p></div></div>" for _ in range(6)]
    for text in html.extract_group(sources):
        assert "Terms" not in text and "rights" not in text and len(text.split("\n")) == 2


def test_tree_matching_equals_plain_recursion():
    rng = random.Random(11)

    def grow(depth):
        return [rng.choice("abc"), *([grow(depth - 1) for _ in range(rng.randrange(4))] if depth else [])]

    def source(t):
        return f"<{t[0]}>" + "".join(map(source, t[1:])) + f"</{t[0]}>"

    def plain(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * len(b) for _ in range(len(a))]
        for i in range(1, len(a)):
            for j in range(1, len(b)):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain(a[i], b[j]))
        return best[-1][-1] + 1

    for _ in range(60):
        a, b = grow(3), grow(3)
        m = html.Matcher()
        pa_, pb = (html.parse("<b>" + source(x).replace("<a>", "<i>").replace("</a>", "</i>") + "</b>") for x in (a, b))
        sa, sb = m.shape(pa_), m.shape(pb)
        assert m.weight(sa[0][1], sb[0][1]) == 1 + plain(a, b) if a[0] == b[0] else m.weight(sa[0][1], sb[0][1]) == 1
        pairs = m.align(sa, sb)
        assert len(pairs) == 1 + m.weight(sa[0][1], sb[0][1])


def test_html_of_any_depth_keeps_its_ancestors():
    deep = "<div><article>" + "<div>" * 200 + "</div>" * 200 + "<p>rest</p></article></div>"
    assert html.extract_group([deep]) == ["rest"]
    unclosed = "<article>" + "<font>" * 200 + "<nav>menu</nav><p>prose</p><aside>other</aside></article>"
    assert html.extract_group([unclosed]) == ["prose"]
    pages = [f"<div>{'<div>' * 2000}{'<i>' * k}word{k}{'</i>' * k}{'</div>' * 2000}<p>tail</p></div>" for k in range(5)]
    assert html.extract_group(pages) == [f"word{k}" for k in range(5)]


def test_long_child_lists_align_as_short_ones_do(monkeypatch):
    rng = random.Random(12)
    trees = [["<div>" + "".join(f"<{t}></{t}>" for t in rng.choices(["b", "i", "u", "s", "p"], k=n)) + "</div>" for n in (40, 35)] for _ in range(40)]
    weights = []
    for cells in (html.CELLS, 30):
        monkeypatch.setattr(html, "CELLS", cells)
        for a, b in trees:
            m = html.Matcher()
            sa, sb = m.shape(html.parse(a)), m.shape(html.parse(b))
            weights.append(m.weight(sa[0][0], sb[0][0]))
            pairs = m.align(sa, sb)
            assert len(pairs) == weights[-1] == len(set(pairs.values()))
            assert sorted(pairs) == [y for _, y in sorted((x, y) for y, x in pairs.items())]
    assert weights[:40] == weights[40:]
    monkeypatch.undo()
    # Every second child is missing: over a quarter million cells, and no run of equal shapes is longer than one.
    tags = [rng.choice("bius") for _ in range(1400)]
    source = lambda x: "<div>" + "".join(f"<{t}></{t}>" for t in x) + "</div>"
    m = html.Matcher()
    sa, sb = m.shape(html.parse(source(tags))), m.shape(html.parse(source(tags[::2])))
    assert len(m.align(sa, sb)) == 2 + len(tags[::2])


def test_html_table(spark, sf_dir):
    pages = spark.createDataFrame([(1, "http://h/x", None, 5), (2, None, "", 5), (None, "http://h/y", "<p>a<p>b &lt; c", 5), (3, "odd", "<div>" * 3000 + "deep", 5), (3, "odd", "text only <", 5)], "page_id long, url string, html string, salt int")
    got = sorted((r.id is None, r.id or 0, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got == [(False, 1, "", 0), (False, 2, "", 0), (False, 3, "deep", 4), (False, 3, "text only <", 11), (True, 0, "a\nb < c", 7)]
    assert html.extract(pages.limit(0)).count() == 0
    a, b = (html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), salt_over=20, broadcast_hosts=n) for n in (0, 50_000))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_html_leftovers_and_copies_have_a_template(spark):
    rng = random.Random(13)
    source = lambda: f"<div><div>Terms apply here</div><div><h2>{words(rng, 3)}</h2><p>{words(rng, 40)}</p><p>All rights reserved here</p></div></div>"
    odd = [source() for _ in range(33)] + [source() for _ in range(2)]
    hot = [source()] * 64 + [source() for _ in range(4)]
    # Equal texts in different html, too.
    hot += [hot[0].replace("<div>", f"<div data-n={k}>") for k in range(40)]
    rows = [(k, f"http://{host}/{k}", s) for host, some in (("a", odd[:33]), ("b", odd), ("c", hot)) for k, s in enumerate(some)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.id, r.url) for r in got) == sorted((i, u) for i, u, _ in rows)
    assert all("Terms" not in r.text and "rights" not in r.text and len(r.text.split("\n")) == 2 for r in got)


def laid_out(rng, layout):
    """A page of one of three layouts, constant furniture without telling names, and its main text."""
    paras, title = [words(rng, 30, 900) for _ in range(rng.randrange(2, 6))], words(rng, 4, 900)
    body = "".join(f"<p>{p}</p>" for p in paras)
    if layout == 0:
        related = words(rng, 12, 900)
        inner = f"<div class='post-header'><h1>{title}</h1></div>{body}<section class='related-work'><h2>Related work</h2><p>{related}</p></section><p>All rights reserved by us</p>"
        return f"<body><div class='content main'>Welcome to our portal <p>Terms apply to all visits and more words</p></div><div class='sidebar'>{inner}</div><div class='footer-box'>Contact us</div></body>", "\n".join([title, *paras, "Related work", related])
    if layout == 1:
        return f"<body><table><tr><td>Our offices are open daily</td><td><h2>{title}</h2>{body}<div>Sign in to read more of this</div></td></tr></table></body>", "\n".join([title, *paras])
    head = f"<header><h1>{title}</h1><span>By someone</span></header>"
    return f"<body><header><h1>The Site</h1></header><main><article>{head}{body}<div class='comments'><p>{words(rng, 20)}</p></div></article><div class='share-box'>Share</div></main><footer>x</footer></body>", "\n".join([title, *paras])


def test_induction_decides_on_hosts_of_all_sizes(spark, monkeypatch):
    rng = random.Random(31)
    every = [laid_out(rng, k % 3) for k in range(600)]
    few, some = every[:9], every[:32]
    rows = [(k, f"http://{host}/{k}", s) for host, made in (("three", few[::3]), ("nine", few), ("some", some), ("many", every)) for k, (s, _) in enumerate(made)]
    want = {(f"http://{host}/{k}"): t for host, made in (("three", few[::3]), ("nine", few), ("some", some), ("many", every)) for k, (_, t) in enumerate(made)}
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.url: r.text for r in got} == want and len(got) == len(rows)
    monkeypatch.setattr(html, "templates", lambda pages, least=3: [set() for _ in pages])
    plain = html.extract_host([s for s, _ in some], [], 32)
    assert sum(a != t for a, (_, t) in zip(plain, some)) >= len(some) // 2


def test_copies_of_one_article_are_no_template():
    rng = random.Random(32)
    body = "".join(f"<p>{words(rng, 30)}</p>" for _ in range(5))
    pages_ = [f"<body><div>{body}</div><div><a href=/{k}>{words(rng, 3)}</a> copy {k}</div></body>" for k in range(5)]
    assert all(len(t) > 400 for t in html.extract_group(pages_))


def test_names_of_furniture():
    for name in ("sidebar", "site-header", "comment-list", "adBox", "ad-slot-3", "cookie_notice", "share"):
        assert html.names_furniture(name), name
    for name in ("post-header", "related-work", "article", "ad-hoc-analysis", "entry-content", "menuetto"):
        assert not html.names_furniture(name), name


def test_a_very_long_page(spark):
    long_ = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    r = html.extract(spark.createDataFrame([(1, "http://h/", long_)], "page_id long, url string, html string")).first()
    assert r.n_chars == 30_000 * 10 - 1


# --- 6 WARC


def test_warc_round_trip(spark):
    big = "x" * 150
    rows = [(5, "http://a", big), (3, "http://b\r\nX: 1", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "é", None), (7, "u", "é" * 99), (8, "u", "é" * 99), (8, "u", "é" * 99), (11, "h", "a\r\n\r\nb" * 50)]
    rows += [(12 + k, "hot", "hot page " * 20) for k in range(40)] + [(60, "long", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    archives = warc.archive_pages(pages, archive_bytes=2000, date=datetime.datetime(2020, 1, 2))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(archives).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = min(k for k, _, g in rows if (g or "").encode() == data)
        again = len(data) >= 100 and same != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", same if again else None))
    assert got == sorted(want)
    fields = [f for a in archives.collect() for f, _ in warc.entries(a.path)]
    assert len({f["WARC-Record-ID"] for f in fields}) == len(rows) and {f["WARC-Date"] for f in fields} == {"2020-01-02T00:00:00Z"}
    assert {f["WARC-Refers-To-Target-URI"] for f in fields if f["WARC-Type"] == "revisit"} == {"http://b%0D%0AX:%201", "u", "hot"}
    assert warc.read_back(warc.archive_pages(pages.limit(0))).count() == 0


def test_warc_keeps_no_shuffled_pages(spark):
    """Once archives are written, the pages' shuffle is gone, whenever the driver collects its garbage."""
    draw = random.Random(5)
    pages = spark.createDataFrame([(k, "u", draw.randbytes(10_000).hex()) for k in range(200)], "page_id long, url string, html string")

    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getPath(): f.length() for f in map(found.apply, range(found.size())) if f.getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = shuffled(), spark.conf.get(key)
    archives = warc.archive_pages(pages)
    until = time.time() + 5
    while (left := sum(n for p, n in shuffled().items() if p not in before)) > 500_000 and time.time() < until:
        time.sleep(0.2)
    assert left <= 500_000
    assert spark.conf.get(key) == own
    assert warc.read_back(archives).count() == 200


def test_warc_pages_without_an_id(spark):
    rows = [(None, "a", "z" * 200), (None, "b", "z" * 200), (None, "c", "y" * 200), (4, "d", "y" * 200)]
    got = warc.read_back(warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [(0, "response", 0, 200), (0, "response", 0, 200), (0, "revisit", 4, 200), (4, "response", 0, 200)]


def test_warc_normaliser_on_files(tmp_path):
    import uuid

    data = [warc.record("response", str(uuid.uuid4()), i, f"http://x/{i}", f"body {i}\r\n\r\n".encode() * (i + 1), "d", "2020-01-01T00:00:00Z") for i in range(20)]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "whole.gz").write_bytes(packed.compress(b"".join(data)) + packed.flush())
    target = str(tmp_path / "parts.gz")
    assert warc.normalise_file(str(tmp_path / "whole.gz"), target) == 20
    parts = (tmp_path / "parts.gz").read_bytes()
    import json

    for line, whole in zip((tmp_path / "parts.gz.idx").read_text().splitlines(), data):
        entry = json.loads(line)
        assert zlib.decompress(parts[entry["offset"] : entry["offset"] + entry["length"]], 31) == whole
    assert [body for _, body in warc.entries(target)] == [f"body {i}\r\n\r\n".encode() * (i + 1) for i in range(20)]
    again = io.BytesIO()
    assert len(list(warc.normalise(io.BytesIO(parts), again))) == 20 and again.getvalue() == parts
    with pytest.raises(ValueError):
        list(warc.records(iter([data[0][:-9]])))


# --- 7 decontamination


def plain_tiles(doc, item, least):
    marked_d, marked_i, total = set(), set(), []
    while True:
        best = (0,)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in marked_d and j + n not in marked_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sorted(total)
        n, i, j = best
        marked_d |= set(range(i, i + n))
        marked_i |= set(range(j, j + n))
        total.append(n)


def test_tiles_equal_plain_greedy_tiling():
    rng = random.Random(12)
    for size in (3, 40):
        for _ in range(30):
            item = np.array([rng.randrange(size) for _ in range(25)], dtype=np.uint64)
            doc = np.array([rng.randrange(size) for _ in range(40)] + item[10:20].tolist() + [99] + item[:9].tolist(), dtype=np.uint64)
            found = decontaminate.tiles(doc, item, 3)
            assert all((doc[i : i + n] == item[j : j + n]).all() for i, j, n in found)
            covered = sum(n for *_, n in found)
            assert len({p for _, j, n in found for p in range(j, j + n)}) == covered
            want = plain_tiles(doc.tolist(), item.tolist(), 3)
            if size == 40:
                assert sorted(n for *_, n in found) == want
            else:
                assert max(n for *_, n in found) == max(want)


def test_reordered_passages_are_found(spark, awkward, empty):
    rng = random.Random(13)
    items = [(k, " ".join(f"q{k}x{i}" for i in range(40))) for k in range(5)] + [(8, None), (9, "too short"), (10, "")]
    parts = items[2][1].split()
    docs = [(7, "it is Too, short!"), (None, items[4][1]), (1, words(rng, 50) + " " + items[0][1].upper() + ", " + words(rng, 10)), (2, " ".join(parts[20:] + ["gap"] * 3 + parts[:20])), (3, " ".join(parts[:15])), (4, words(rng, 400)), (5, None), (6, "")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for rules in (decontaminate.Rules(), decontaminate.Rules(block_tokens=50)):
        assert sorted((r.id or 0, r.item_id) for r in decontaminate.leaks(d, b, rules=rules).collect()) == [(0, 4), (1, 0), (2, 2), (7, 9)]
        assert sorted(r.doc_id for r in decontaminate.without_leaks(d, b, rules=rules).collect()) == [3, 4, 5, 6]
    assert decontaminate.without_leaks(awkward, b).count() == awkward.count() and decontaminate.leaks(empty, b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


# --- 8 chat

ODD_TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "[[INST]", "<", "[", "[/INST", "INST]", "a</s", "\\", "é𝜋\n<s>", "<s><s>", "[/INST]</s>\\"]


def test_chat_turns_come_back_exactly():
    for role in ["user", "", "as<s>st", "[", "<"]:
        for text in ODD_TEXTS:
            out, i, j = chat.render(role, text)
            assert chat.parse(out) == [(role, text, i, j)] and chat.unescape(out[i:j]) == text
    both = "".join(chat.render("user", t)[0] for t in ODD_TEXTS)
    assert [t[1] for t in chat.parse(both)] == ODD_TEXTS
    for bad in ["<s>a", "x", "<s>a[INST]b</s>", "[INST]", "<s>a[INST]b[/INST] </s>"]:
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "B</s>", 0), (1, 0, "user", "A", 0), (2, None, None, None, 0), (2, 0, "assistant", "", 0), (None, 0, "user", "x", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digests(shared.cut(chat.format_turns(table))).collect()}
    assert got[1].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"user\nA\nassistant\nB</s>\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, hashlib.sha256(b"B</s>").hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\nassistant\n\n").hexdigest() and got[None].n_turns == 1
    assert chat.digests(chat.format_turns(table.limit(0))).count() == 0


# --- 9 quality


def test_quality_learns_and_holds_out(spark, awkward, empty):
    rng = random.Random(14)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = words(rng, rng.randrange(5, 60)) if good else " ".join(w.upper() + "!!" for w in words(rng, 30).split())
        docs.append((i, text))
        labels.append((i, int(good), 0))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(7, None, 0), (9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(d, y).collect()
    held = [r for r in rows if r.held_out]
    assert {r.id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == int(r.id % 3 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    odd = quality.quality_scores(awkward, y).collect()
    assert len(odd) == awkward.count() and all(math.isfinite(r.score) for r in odd)
    assert quality.quality_scores(empty, y).count() == 0
    assert {r.score for r in quality.quality_scores(d, y.limit(0)).collect()} == {0.5}


def test_quality_features_of_pieces_and_space(monkeypatch):
    s = quality.Settings()
    text = words(random.Random(15), 400) + " " + "long" * 400 + " é ﬁ  tail\n"
    own = np.sort(quality.features(text, s))
    assert (np.sort(quality.features("\n\t ".join(text.split()) + " ", s)) == own).all()
    for piece in (1, 7, 300):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert (np.sort(quality.features(text, s)) == own).all()
    assert len(quality.features(None, s)) == len(quality.features("", s)) == 0


def test_quality_features_are_words_pairs_and_grams():
    s = quality.Settings(buckets=1 << 40, grams=(3,))
    a, b = quality.features("ab cd", s), quality.features("cd ab", s)
    # Two words, one pair, three grams of three bytes.
    assert len(a) == len(b) == 2 + 1 + 3 and len(np.intersect1d(a, b)) == 2
    assert len(np.intersect1d(quality.features("xx xx", s), quality.features("yy yy", s))) == 1


def test_quality_learns_from_counts_in_a_file():
    """Counts of all rows at once would be some 24 MB here, which the driver would hold to its end."""
    s = quality.Settings(dim=2, epochs=1)

    def made():
        draw = np.random.default_rng(3)
        for _ in range(300):
            yield draw.integers(33, 127, 4000, dtype=np.uint8).tobytes().decode()

    tracemalloc.start()
    try:
        quality.train(made(), [k % 2 for k in range(300)], s)
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()
    counted = quality.Counted([None, "", *itertools.islice(made(), 3), "a b a"], s)
    for k, text in enumerate([None, "", *itertools.islice(made(), 3), "a b a"]):
        at, n, size = counted[k]
        want = np.unique(quality.features(text, s), return_counts=True)
        assert (at == want[0]).all() and (n == want[1]).all() and size == max(1, n.sum()), k
    assert len(counted) == 6


def test_scores_are_the_plain_forward_pass():
    rng = random.Random(16)
    texts, labels = [words(rng, 20, 40) if k % 2 else words(rng, 20, 40).upper() for k in range(60)], [k % 2 for k in range(60)]
    s = quality.Settings(buckets=1 << 12)
    numbers, bias = quality.train(texts, labels, s)
    for t in ("", *texts[:8]):
        f = quality.features(t, s)
        assert abs(quality.mean_of(t, numbers, s) - (sum(float(numbers[k]) for k in f) / len(f) if len(f) else 0)) < 1e-6
    assert all((bias + quality.mean_of(t, numbers, s) > 0) == (y == 1) for t, y in zip(texts, labels))


# --- 10 Hilbert


def test_hilbert_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (1, 3)):
        side = 1 << bits
        cells = spark.range(side**n).select(*((F.floor(F.col("id") / side**k) % side).cast("long").alias(f"c{k}") for k in range(n)))
        rows = cells.select("*", hilbert.hilbert_index([F.col(f"c{k}") for k in range(n)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(side**n))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark, awkward, empty, sf_dir):
    for docs, shards in ((awkward, 4), (spark.read.parquet(f"{sf_dir}/documents.parquet"), 24), (awkward.limit(2), 24)):
        rows = hilbert.hilbert_shards(docs, shards=shards).collect()
        want = sorted(((r.doc_id is not None, r.doc_id or 0), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
        assert sorted(((r.id is not None, r.id or 0), r.size, r.text_crc32) for r in rows) == want
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        sizes = [len(by[k]) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)
    assert hilbert.hilbert_shards(empty).count() == 0


def test_shard_files_and_manifest(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    places = shared.cut(hilbert.hilbert_shards(docs, shards=6))
    hilbert.write_shards(docs, places, "doc_id", str(tmp_path / "s"), 6)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1000
    rows = hilbert.manifest(docs, places, "doc_id", ["n_chars", "source"]).collect()
    assert sum(r.rows for r in rows) == 1000 and all(r.min_n_chars <= r.max_n_chars for r in rows)


def test_manifest_prunes_on_every_dimension(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    places = shared.cut(hilbert.hilbert_shards(docs))
    rows = hilbert.manifest(docs, places, "doc_id", ["lang", "source"]).collect()
    for column in ("lang", "source"):
        holds = docs.join(places, docs.doc_id == places.id).groupBy(column).agg(F.countDistinct("shard").alias("n")).collect()
        opened = sum(r[f"min_{column}"] <= h[column] <= r[f"max_{column}"] for r in rows for h in holds)
        assert opened <= 1.5 * sum(h.n for h in holds)
    sizes = places.groupBy("shard").agg(F.min("size").alias("a"), F.max("size").alias("b")).collect()
    assert all(sum(r.a <= q <= r.b for r in sizes) <= 12 for q in (100, 1500, 8000))


def test_codes_rise_with_values(spark):
    rows = spark.createDataFrame([(v,) for v in ["", "a", "ab", "abc", "b", "é", "zz"] for _ in range(50)], "dim string")
    got = [r.code for r in hilbert.order_codes(rows, "dim", 5).orderBy(F.col("dim").cast("binary")).collect()]
    assert got == sorted(got) and len(set(got)) == 7
