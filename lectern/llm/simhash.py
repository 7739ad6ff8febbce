"""SimHash near-duplicates by bit-sliced comparison.

Rows that may be near meet in a group.  For a plain radius r a group is a bucket of
fingerprints that agree on two of r + 2 bit blocks, which every pair within r does.
For a Jaccard similarity of shingle sets it is what shares a shingle of the sets'
prefixes, which every pair of that similarity does, and the shingle sets of what the
fingerprints join are compared at the end.

In a group the bit planes are stored vertically: bit b of 64 fingerprints is one
machine word.  A query's bit is XORed with a whole plane at once, the results go
into carry-save counters, and a block is abandoned as soon as every lane exceeds
the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared
from lectern.llm.substrings import window_hashes, word_hashes

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK = 1 << 14


def shingle_hashes(words: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words joined by a space, repeats included,
    in chunks; all the words where there are fewer; nothing where there are none."""
    hashed = xxhash.xxh64_intdigest
    if not words:
        return
    last = max(1, len(words) - size + 1)
    for at in range(0, last, CHUNK):
        some = words[at : min(at + CHUNK, last) + size - 1]
        text = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(size, len(some))
        yield np.array([hashed(text[i:j], seed) for i, j in zip(starts[: len(some) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: Iterator[np.ndarray], parts: int = 1) -> np.ndarray:
    """``parts`` unsigned 64-bit numbers: bit i is 1 if set in over half of the hashes.
    Parts after the first come from the hashes mixed anew."""
    ones, n = np.zeros((parts, 64), dtype=np.int64), 0
    for every in hashes:
        for at in range(0, len(every), CHUNK):
            h = every[at : at + CHUNK]
            n += len(h)
            for p in range(parts):
                ones[p] += np.unpackbits(remixed(h, p).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()


def remixed(h: np.ndarray, part: int) -> np.ndarray:
    """Part 0: the hashes; other parts: as if hashed anew."""
    if not part:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * part & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's shingles, repeats included.  Only A-Z is lower-cased;
    words are parted by ASCII white space."""
    return int(majority(shingle_hashes(shared.utf8(text).lower().split(), size, seed))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, seed: int = 42) -> DataFrame:
    """(id, f0): the signed 64-bit fingerprint of each row."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, size, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "f0"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(shared.giving_back(run), "id long, f0 long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(n, parts) fingerprints as (64 * parts, words) planes; lane i is bit i % 64 of word i // 64."""
    n, parts = prints.shape
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * parts), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -n % 64), (0, 0)))
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)


def close_lanes(planes: Iterator[np.ndarray], shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Lanes whose planes hold at most ``radius`` ones, by carry-save counters."""
    levels = [np.zeros(shape, dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(shape, dtype=np.uint64)

    def add(carry: np.ndarray, level: int) -> None:
        nonlocal over
        while level < len(levels):
            levels[level], carry = levels[level] ^ carry, levels[level] & carry
            level += 1
        over |= carry

    def beyond() -> np.ndarray:
        more, same = over.copy(), ~over
        for level in reversed(range(len(levels))):
            if radius >> level & 1:
                same &= levels[level]
            else:
                more |= same & levels[level]
                same &= ~levels[level]
        return more

    planes = iter(planes)
    for step in itertools.count(1):
        three = list(itertools.islice(planes, 3))
        if len(three) == 3:
            a, b, c = three
            half = a ^ b
            add(half ^ c, 0)
            add((a & b) | (c & half), 1)
        else:
            for x in three:
                add(x, 0)
            return ~beyond()
        if step % 4 == 0 and step * 3 > radius and (beyond() == ONES).all():
            return np.zeros(shape, dtype=np.uint64)


def lanes_of(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def spanning_links(prints: np.ndarray, radius: int, queries: int = 128, worth: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (rows, rows) that join the rows of one block as all pairs within the radius
    would.  While groups of ``worth`` rows or more turn up, breadth first from one root:
    every row once a query against those not reached.  What is left then is compared in
    pairs, ``queries`` rows at a time."""
    n, parts = prints.shape
    planes = bit_planes(prints)
    masks = np.where(np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * parts), axis=1, bitorder="little") > 0, ONES, np.uint64(0))
    open_ = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
    open_[:n] = 1

    def near(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = np.packbits(open_, bitorder="little").view(np.uint64)
        use = np.flatnonzero(left)
        return close_lanes((planes[b][None, use] ^ masks[some, b][:, None] for b in range(64 * parts)), (len(some), len(use)), radius) & left[use], use, left

    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = 0
        queue, size = [root], 1
        while queue and open_.any():
            some, queue = np.array(queue[:queries]), queue[queries:]
            hits, use, left = near(some)
            hit = np.zeros_like(left)
            hit[use] = np.bitwise_or.reduce(hits, axis=0)
            found = lanes_of(hit, n)
            open_[found] = 0
            queue += found.tolist()
            size += len(found)
            yield found, np.full(len(found), root)
        if size < worth:
            break
    rest = np.flatnonzero(open_[:n])
    for at in range(0, len(rest), queries):
        some = rest[at : at + queries]
        hits, use, _ = near(some)
        bits = np.unpackbits(np.ascontiguousarray(hits).view(np.uint8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        lane = use[lane // 64] * 64 + lane % 64
        open_[some] = 0
        i, j = shared.stars(np.arange(n), some[row], lane)
        yield i, j


def run_links(prints: np.ndarray, runs: np.ndarray, radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``runs`` values (rows stand together).  Short runs
    share lanes: lane i compares rows i and i + d; long ones go by blocks."""
    n = len(runs)
    starts = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    sizes = np.diff(np.append(starts, n))
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    at = np.flatnonzero(size_of <= small)
    for d in range(1, small):
        at = at[at + d < n]
        at = at[runs[at] == runs[at + d]]
        if not len(at):
            break
        for k in range(0, len(at), CHUNK):
            i = at[k : k + CHUNK]
            planes = bit_planes(prints[i] ^ prints[i + d])
            hit = lanes_of(close_lanes(planes, planes.shape[1:], radius), len(i))
            left.append(i[hit])
            right.append(i[hit] + d)
    for s, m in zip(starts[sizes > small], sizes[sizes > small]):
        for i, j in spanning_links(prints[s : s + m], radius):
            left.append(s + i)
            right.append(s + j)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def streamed_links(batches, parts: int, radius: int):
    """Links of rows that come sorted by the key columns; holds the last run only."""
    kept, keys = None, None

    def out(prints, ids, runs):
        a, b = shared.stars(ids, *run_links(prints, runs, radius))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = np.stack(cols, axis=1)
        rows = rows if kept is None else np.concatenate([kept, rows])
        if not len(rows):
            continue
        keys = rows[:, : rows.shape[1] - parts - 1]
        changed = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if not len(changed):
            kept = rows
            continue
        done, kept = rows[: changed[-1]], rows[changed[-1] :]
        runs = np.zeros(len(done), dtype=np.int64)
        runs[changed[:-1]] = 1
        yield out(np.ascontiguousarray(done[:, -parts:]).view(np.uint64), done[:, -parts - 1], np.cumsum(runs))
    if kept is not None and len(kept):
        yield out(np.ascontiguousarray(kept[:, -parts:]).view(np.uint64), kept[:, -parts - 1], np.zeros(len(kept), dtype=np.int64))


def block_masks(radius: int) -> list[int]:
    """Masks of the pairs of radius + 2 blocks of 64 bits."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    blocks = [((1 << (j - i)) - 1) << i for i, j in zip(edges, edges[1:])]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_keys(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, node, f0), once for each pair of bit blocks.  Two buckets that share a hash
    are compared in vain, never linked in error."""
    keys = (F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(block_masks(radius)))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "f0")


def near_links(keyed: DataFrame, radius: int, *, block: int = 4096) -> DataFrame:
    """(a, b) links between rows of one ``key`` in (key, node, f0, ...) at most ``radius``
    bits apart.  A group of over ``block`` rows is dealt out as pairs of blocks, each a
    task's worth of its own."""
    prints = [c for c in keyed.columns if c not in ("key", "node")]
    large = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    dealt = shared.with_few(keyed, large, "key").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", *prints)
    parts = len(prints)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(shared.giving_back(lambda batches: streamed_links(batches, parts, radius)), "a long, b long")


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root) that join what all pairs of Jaccard ``similarity`` join:
    breadth first over rows sorted by size, every row once a query against those not
    reached whose size allows the similarity.  Sets are distinct and not empty."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    n_codes = int(codes.max()) + 1
    size = np.array([len(sets[k]) for k in order])
    start = np.concatenate(([0], np.cumsum(size)))
    row_of, open_ = order, np.ones(len(order), dtype=bool)
    rows, roots = [], []
    for first in order:
        if not open_[row_of == first].any():
            continue
        queue = [(first, sets[first])]
        open_[row_of == first] = False
        own = {int(first): codes[start[at] : start[at + 1]] for at in np.flatnonzero(row_of == first)}
        while queue and open_.any():
            row, values = queue.pop()
            lo = np.searchsorted(size, similarity * len(values) - 1e-9)
            hi = np.searchsorted(size, len(values) / similarity + 1e-9, side="right")
            if lo == hi or not open_[lo:hi].any():
                continue
            mark = np.zeros(n_codes, dtype=np.int32)
            mark[own.pop(int(row))] = 1
            both = np.add.reduceat(mark[codes[start[lo] : start[hi]]], start[lo:hi] - start[lo])
            hit = lo + np.flatnonzero(open_[lo:hi] & (both * (1 + similarity) >= similarity * (size[lo:hi] + len(values)) - 1e-9))
            open_[hit] = False
            for at in hit:
                own[int(row_of[at])] = codes[start[at] : start[at + 1]]
                queue.append((row_of[at], sets[row_of[at]]))
            rows += row_of[hit].tolist()
            roots += [int(first)] * len(hit)
        if 2 * open_.sum() < len(open_):
            if not open_.any():
                break
            codes = codes[np.repeat(open_, size)]
            row_of, size = row_of[open_], size[open_]
            start, open_ = np.concatenate(([0], np.cumsum(size))), np.ones(len(size), dtype=bool)
    return np.array(rows, dtype=np.int64), np.array(roots, dtype=np.int64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of all its words where it has fewer."""
    words = shared.utf8(text).lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, size) if len(words) >= size else window_hashes(h, len(words)) ^ np.uint64(len(words)))


def checked_links(docs: DataFrame, labels: DataFrame, size: int, similarity: float, *, rows: int = 2048, hashes: int = 1 << 21) -> DataFrame:
    """(a, b) links between ids whose texts reach ``similarity``, for every pair of a
    component of ``labels`` (node, component).  ``docs``: (node, text).  A component beyond
    ``rows`` rows or ``hashes`` shingles is dealt out as pairs of blocks, each of about that size."""

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t, size) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["c", "id", "hashes", "n_hashes"])

    def links(ids: list[int], found: list[bytes]):
        at = np.array(ids, dtype=np.int64)
        a, b = shared.stars(at, *similar_links([np.frombuffer(x, dtype=np.uint64) for x in found], similarity))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare(batches):
        key, ids, found = None, [], []
        for batch in batches:
            for c, i, j, row, values in zip(*(col.to_pylist() for col in batch.columns)):
                if key != (c, i, j):
                    if len(ids) > 1:
                        yield links(ids, found)
                    key, ids, found = (c, i, j), [], []
                ids.append(row)
                found.append(values)
        if len(ids) > 1:
            yield links(ids, found)

    texts = docs.join(labels, "node").select(F.col("component").alias("c"), F.col("node").alias("id"), "text")
    some = shared.cut(texts.mapInArrow(shared.giving_back(sets), "c long, id long, hashes binary, n_hashes long").where("n_hashes > 0"), "sets")
    large = some.groupBy("c").agg(F.ceil(F.greatest(F.count("*") / rows, F.sum("n_hashes") / hashes)).cast("int").alias("n")).where("n > 1")
    dealt = shared.with_few(some, large, "c").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("c", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "id", "hashes")
    return dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInArrow(shared.giving_back(compare), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(id, f0, component_id): SimHash of each row and the smallest id that links of at
    most ``radius`` differing bits reach.  Every pair within the radius meets.

    Null and empty texts have the fingerprint zero and link like any other.
    Repeated rows stay rows; equal ids count as one document.  A null id links
    and takes its group's smallest id, null if all there are null.  Ids must be below
    2^62.  An empty table gives an empty result; other columns are not looked at.
    """
    prints = shared.cut(fingerprints(docs, id_col, text_col, size=size, seed=seed), "prints")
    nodes = shared.cut(prints.groupBy("f0").agg(F.min("id").alias("least")).select("f0", shared.order_id("least", "f0").alias("node")), "nodes")
    labels = shared.components(near_links(block_keys(nodes, radius), radius))
    classes = nodes.join(labels, "node", "left").select("f0", shared.real_id("component").alias("far"), shared.real_id("node").alias("near"), F.col("component").isNull().alias("alone"))
    classes = classes.select("f0", F.when(F.col("alone"), F.col("near")).otherwise(F.col("far")).alias("component_id"))
    return prints.join(classes, "f0").select("id", "f0", "component_id")


@dataclass(frozen=True)
class Similar:
    """``radius`` of 64 * ``parts`` bits decides whose sets are compared.  Two sets of Jaccard
    similarity 0.8 differ in 15 to 19 % of the bits (small sets in more), so in at most 48
    of 256 on average with a standard deviation of 6.3; 84 lies 5.7 of these beyond.

    ``chunk``, ``often``, ``total``, ``listed``: shingles that occur ``often`` times among
    ``chunk`` of one task and ``total`` times in all, the ``listed`` most frequent ones, come
    last in the order that prefixes are taken in.  The order changes who meets in vain and
    nothing else."""

    size: int = 5
    similarity: float = 0.8
    parts: int = 4
    radius: int = 84
    chunk: int = 1 << 21
    often: int = 8
    total: int = 128
    listed: int = 100_000


def prefix_length(n: int, similarity: float) -> int:
    """How many of a set's ``n`` members, in any common order, hold one of the common
    members of each set of that similarity to it."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def described(docs: DataFrame, s: Similar) -> DataFrame:
    """From (order, th, text): the rows (order, th, h, g, f0, ...) with two hashes of the shingle
    set and its fingerprint; and rows of ``key`` and ``times`` alone for shingles that are
    frequent among those that could be in a prefix."""
    names = [f"f{p}" for p in range(s.parts)]
    columns = ["order", "th", "h", "g", *names, "key", "times"]

    def frequent(keys):
        at, times = np.unique(np.concatenate(keys), return_counts=True)
        at, times = at[times >= s.often].view(np.int64), times[times >= s.often]
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([none] * (4 + s.parts) + [pa.array(at), pa.array(times, pa.int64())], columns)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            out = np.zeros((batch.num_rows, 2 + s.parts), dtype=np.uint64)
            for k, text in enumerate(batch.column(2).to_pylist()):
                every = shingle_set(text, s.size)
                out[k, :2] = np.frombuffer(xxhash.xxh3_128_digest(every.tobytes()), dtype=np.uint64)
                out[k, 2:] = majority(iter([every]), s.parts)
                head = every[: 2 * prefix_length(len(every), s.similarity)]
                held.append(head)
                size += len(head)
                if size >= s.chunk:
                    yield frequent(held)
                    held, size = [], 0
            signed_ = out.view(np.int64)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(signed_[:, k]) for k in range(2 + s.parts)), none, none], columns)
        if held:
            yield frequent(held)

    return docs.mapInArrow(shared.giving_back(run), ", ".join(f"{c} long" for c in columns))


def prefix_keys(docs: DataFrame, frequent: np.ndarray, s: Similar) -> DataFrame:
    """From (order, th, text): (key, h), each shingle of a set's prefix and the set's hash.
    Members are ordered by hash, frequent ones last.  Sets met before in a batch are skipped."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        last = known.value
        for batch in batches:
            keys, names, seen = [], [], set()
            for text in batch.column(2).to_pylist():
                every = shingle_set(text, s.size)
                name = xxhash.xxh3_128_digest(every.tobytes())[:8]
                if name in seen or not len(every):
                    continue
                seen.add(name)
                n = prefix_length(len(every), s.similarity)
                if len(last):
                    at = np.minimum(np.searchsorted(last, every), len(last) - 1)
                    every = every[np.argsort(last[at] == every, kind="stable")]
                keys.append(every[:n])
                names.append(np.full(n, int.from_bytes(name, "little"), dtype=np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, names)], ["key", "h"])

    return docs.mapInArrow(shared.giving_back(run), "key long, h long")


def meetings(batches):
    """(key, h): from rows sorted by key and h, every h with the smallest h of its key,
    which is the new key, where there are several; each pair once a batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(heads, len(key)))
        root = np.repeat(h[heads], sizes)
        if last and last[0] == key[0]:
            root[: sizes[0]] = last[1]
        last = key[-1], root[-1]
        pairs = np.unique(np.stack([root, h], axis=1)[root != h], axis=0)
        own = np.unique(pairs[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((pairs[:, 0], own))), pa.array(np.concatenate((pairs[:, 1], own)))], ["key", "h"])


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Similar = Similar()) -> DataFrame:
    """(order, th, n, stays): every different (id, text), named by ``order_id`` and the text's
    hash, its number of rows, and whether it stays.  Links join texts whose sets of shingles
    reach ``Similar.similarity``; of what links join, the smallest id stays.

    Equal sets, empty ones among them, are one class.  An id that rows of several different
    sets share counts as the largest, like a null one.  Ids must be below 2^62.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select(shared.order_id("id", "text").alias("order"), F.xxhash64("text").alias("th"), "text")
    every = shared.cut(described(rows, s), "prints")
    names = [f"f{p}" for p in range(s.parts)]
    frequent = every.where("key IS NOT NULL").groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= s.total).orderBy(F.desc("times"), "key").limit(s.listed)
    last = np.sort(np.array([r.key for r in frequent.select("key").collect()], dtype=np.int64).view(np.uint64))
    prints = every.where("key IS NULL")
    counts = shared.cut(prints.groupBy("order", "th").agg(F.count("*").alias("n")), "counts")
    sets = prints.groupBy("h", "g", *names).agg(F.min(F.struct("order", "th")).alias("first")).select("h", "g", *names, "first.*")
    clashes = sets.groupBy("order").count().where("count > 1").select("order", F.lit(True).alias("clash"))
    node = F.when(F.col("clash"), shared.late_id("h", "g")).otherwise(F.col("order"))
    nodes = shared.cut(sets.join(clashes, "order", "left").select("h", *names, "order", "th", node.alias("node")), "nodes")
    pairs = prefix_keys(rows, last, s).repartition("key").sortWithinPartitions("key", "h").mapInArrow(shared.giving_back(meetings), "key long, h long").distinct()
    met = shared.cut(pairs.join(nodes.select("h", "node", *names), "h").select("key", "node", *names), "met")
    labels = shared.cut(shared.components(near_links(met, s.radius)), "labels")
    texts = rows.join(nodes.join(labels, "node", "left_semi").select("order", "th", "node"), ["order", "th"]).select("node", "text")
    if not counts.where("n > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    links = shared.components(checked_links(texts, labels, s.size, s.similarity))
    firsts = nodes.join(links.where("node <> component"), "node", "left_anti").select("order", "th", F.lit(True).alias("stays"))
    return counts.join(firsts, ["order", "th"], "left").select("order", "th", "n", F.coalesce("stays", F.lit(False)).alias("stays"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Similar = Similar()) -> DataFrame:
    """The rows of ``docs``, whole, of which one stays for each class of ``similar_classes``.
    Of repeated rows of one id and text one stays.  Null texts and ids take part like
    others; an empty table stays empty."""
    classes = shared.cut(similar_classes(docs, id_col, text_col, s), "classes")
    text = F.col(text_col).cast("string")
    named = docs.withColumns({"__order": F.coalesce(F.col(id_col).cast("long"), shared.late_id(text)), "__th": F.xxhash64(text)})
    name = [F.col("order").alias("__order"), F.col("th").alias("__th")]
    out = named.join(classes.where("NOT stays OR n > 1").select(*name), ["__order", "__th"], "left_anti")
    again = classes.where("stays AND n > 1").select(*name)
    if not again.isEmpty():
        out = out.unionByName(named.join(again, ["__order", "__th"], "left_semi").dropDuplicates(["__order", "__th"]))
    return out.select(*docs.columns)
