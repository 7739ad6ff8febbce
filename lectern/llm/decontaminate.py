"""Benchmark decontamination by greedy string tiling.

Texts meet where they share a seed, a run of ``least`` tokens.  For a pair that shares
enough of them, tiling marks the longest match of unmarked tokens, again and again,
found by Karp-Rabin hashes of a search length that falls from long to ``least``.
Tiles may stand in any order, so reordered passages count in full.  The share of the
benchmark item that tiles cover decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared
from lectern.llm.substrings import window_hashes, word_hashes

TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Rules:
    """``least``: shortest tile, in tokens; ``coverage``: share of an item's tokens under
    tiles that marks a document; ``block_tokens``: most benchmark tokens sent to the
    executors at once, beyond which documents are read again for the next block."""

    least: int = 5
    coverage: float = 0.6
    block_tokens: int = 2_000_000


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the case-folded runs of letters, digits and underscores."""
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in TOKEN.findall((text or "").lower())])


def longest(doc: np.ndarray, item: np.ndarray, i: int, j: int, doc_free: np.ndarray, item_free: np.ndarray) -> int:
    """Length of the match of unmarked tokens that starts at doc[i] and item[j]."""
    n = min(len(doc) - i, len(item) - j)
    bad = np.flatnonzero((doc[i : i + n] != item[j : j + n]) | ~doc_free[i : i + n] | ~item_free[j : j + n])
    return int(bad[0]) if len(bad) else n


def free_windows(free: np.ndarray, s: int) -> np.ndarray:
    """Starts of windows of ``s`` unmarked tokens."""
    if len(free) < s:
        return np.zeros(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(total[s:] - total[:-s] == s)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc start, item start, length), longest first, without overlap."""
    doc_free, item_free = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    out: list[tuple[int, int, int]] = []
    s = min(len(doc), len(item))
    while s >= least:
        at_item, at_doc = free_windows(item_free, s), free_windows(doc_free, s)
        h_item, h_doc = window_hashes(item, s)[at_item], window_hashes(doc, s)[at_doc]
        order = np.argsort(h_item, kind="stable")
        h_item, at_item = h_item[order], at_item[order]
        low, high = np.searchsorted(h_item, h_doc, "left"), np.searchsorted(h_item, h_doc, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            s = s // 2 if s > 2 * least else s - 1 if s == least else least
            continue
        found = []
        for k in hit.tolist():
            for m in range(low[k], high[k]):
                i, j = int(at_doc[k]), int(at_item[m])
                n = longest(doc, item, i, j, doc_free, item_free)
                if n >= s:
                    found.append((-n, j, i))
        # matches of the greatest length first; one whose tokens were marked meanwhile
        # is looked for again with what is left of it
        found.sort()
        for n, j, i in found:
            if doc_free[i : i - n].all() and item_free[j : j - n].all():
                doc_free[i : i - n] = False
                item_free[j : j - n] = False
                out.append((i, j, -n))
            elif longest(doc, item, i, j, doc_free, item_free) >= s:
                break
        else:
            s = s // 2 if s > 2 * least else s - 1 if s == least else least
    return out


@dataclass
class Block:
    """Benchmark items and a sorted table of their seeds; ``short``: items shorter than a
    seed, by length and hash of the whole."""

    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    item_of: np.ndarray
    at: np.ndarray
    short: dict[int, dict[int, list[int]]]


def block_of(rows: list[tuple], least: int) -> Block:
    ids, items = [i for i, _ in rows], [t for _, t in rows]
    hashes = [window_hashes(t, least) for t in items]
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    item = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
    at = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else item
    order = np.argsort(h, kind="stable")
    short: dict[int, dict[int, list[int]]] = {}
    for k, t in enumerate(items):
        if len(t) < least:
            short.setdefault(len(t), {}).setdefault(int(window_hashes(t, len(t))[0]), []).append(k)
    return Block(ids, items, h[order], item[order], at[order], short)


def covered(starts: np.ndarray, least: int) -> int:
    """Tokens under windows of ``least`` at the sorted distinct starts."""
    return int(np.minimum(np.diff(starts), least).sum()) + least


def against(text: str | None, block: Block, rules: Rules) -> Iterator[tuple]:
    """(item id, coverage, tiles, item tokens) of items that the text covers enough."""
    doc = tokens(text)
    for size, by in block.short.items():
        for h in set(window_hashes(doc, size).tolist()) & by.keys():
            for k in by[h]:
                yield block.ids[k], 1.0, 1, size
    h = window_hashes(doc, rules.least)
    if not len(h) or not len(block.seeds):
        return
    low = np.searchsorted(block.seeds, h, "left")
    hit = np.flatnonzero(block.seeds[np.minimum(low, len(block.seeds) - 1)] == h)
    if not len(hit):
        return
    known = np.unique(h[hit])
    low, high = np.searchsorted(block.seeds, known, "left"), np.searchsorted(block.seeds, known, "right")
    entries = np.concatenate([np.arange(i, j) for i, j in zip(low.tolist(), high.tolist())])
    item_of, at = block.item_of[entries], block.at[entries]
    order = np.lexsort((at, item_of))
    item_of, at = item_of[order], at[order]
    near = np.zeros(len(doc), dtype=bool)
    for k in range(rules.least):
        near[hit + k] = True
    # Only tokens inside seeds can be in a tile; a gap between them stays one foreign token.
    keep = near | np.concatenate(([False], near[:-1]))
    part = np.where(near, doc, np.uint64(0))[keep]
    edges = np.append(np.flatnonzero(np.concatenate(([True], item_of[1:] != item_of[:-1]))), len(item_of))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        item = block.items[item_of[i]]
        if covered(np.unique(at[i:j]), rules.least) < rules.coverage * len(item):
            continue
        found = tiles(part, item, rules.least)
        share = sum(n for _, _, n in found) / len(item)
        if share >= rules.coverage:
            yield block.ids[item_of[i]], share, len(found), len(item)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, rules: Rules) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_tokens`` tokens or one longer item."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        item = tokens(r.text)
        if not len(item):
            continue
        if rows and size + len(item) > rules.block_tokens:
            yield block_of(rows, rules.least)
            rows, size = [], 0
        rows.append((r.id, item))
        size += len(item)
    if rows:
        yield block_of(rows, rules.least)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(id, item_id, coverage, n_tiles, item_tokens): documents that hold a benchmark
    item, one row for each pair whose tiles cover ``Rules.coverage`` of the item or more.

    The benchmark is the stated query set: it goes to the executors in blocks of proven
    size, each against all documents.  Tokens are case-folded runs of word characters.
    An item of fewer than ``least`` tokens is found where all its tokens stand in a row.
    Items and texts without a token, nulls among them, match nothing.
    Repeated documents give repeated rows; a null id is given as it is.  An empty table
    on either side gives an empty result; other columns are not used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_kind = benchmark.schema[item_col].dataType
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id {item_kind.simpleString()}, coverage double, n_tiles int, item_tokens int"
    context = docs.sparkSession.sparkContext

    def one(block: Block) -> DataFrame:
        held = context.broadcast(block)

        def run(batches):
            for batch in batches:
                found = [(k, *x) for k, text in enumerate(batch.column(1).to_pylist()) for x in against(text, held.value, rules)]
                if found:
                    k, item, share, n, size = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(item), pa.array(share), pa.array(n, pa.int32()), pa.array(size, pa.int32())], ["id", "item_id", "coverage", "n_tiles", "item_tokens"])

        return rows.mapInArrow(shared.giving_back(run), schema)

    parts = [one(b) for b in blocks(benchmark, item_col, item_text_col, rules)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs``, whole, whose text holds no benchmark item; see ``leaks``.  Each
    row is judged by itself, whatever its id; nothing is shuffled."""
    at = docs.columns.index(text_col)
    context = docs.sparkSession.sparkContext
    schema = docs.schema
    for block in blocks(benchmark.withColumn("__item", F.lit(0)), "__item", item_text_col, rules):
        held = context.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                texts = batch.column(at).cast(pa.string()).to_pylist()
                clean = [next(against(t, held.value, rules), None) is None for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(shared.giving_back(run), schema)
    return docs
