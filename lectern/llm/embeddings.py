"""Embedding near-duplicates by sorted projection passes.

A pass draws random hyperplanes; the signs of a vector's projections, one after the
other, are its key.  Vectors are ordered by that key and compared with a bounded window
of neighbours; pairs of a cosine of ``reach`` or more unite.  Inside each group that the
passes unite every pair is then compared, in blocks, and pairs of enough cosine become
links.  Reach is well below the cosine of a link: where a dense group fills the windows
with neighbours that are no links, these neighbours hold the group together, and the
comparison in blocks finds the links that no window has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared


@dataclass(frozen=True)
class Passes:
    """``block``: rows of one side of a comparison inside a group."""

    cosine: float = 0.95
    reach: float = 0.85
    passes: int = 24
    bits: int = 60
    window: int = 24
    block: int = 4096
    seed: int = 11


def planes(width: int, p: Passes) -> np.ndarray:
    return np.random.default_rng(p.seed).standard_normal((p.passes, p.bits, width))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that very small and large numbers survive."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_width(batches, k: int = 0) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches in runs of one vector length, which column ``k`` gives."""
    for batch in batches:
        width = batch.column(k).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(width)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield int(width[i]), batch.slice(i, j - i)


def keyed(vectors: DataFrame, p: Passes) -> DataFrame:
    """(width, pass, key, node, v), once for every pass, from (width, node, v)."""

    def run(batches):
        drawn = {}
        weights = np.int64(1) << np.arange(p.bits - 1, -1, -1, dtype=np.int64)
        for width, part in by_width(batches):
            if width not in drawn:
                drawn = {width: planes(width, p)}
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                x = unit(matrix(some.column(2), width))
                for k in range(p.passes):
                    key = ((x @ drawn[width][k].T) > 0).astype(np.int64) @ weights
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(x), k)), pa.array(key), some.column(1), some.column(2)], ["width", "pass", "key", "node", "v"])

    return vectors.mapInArrow(run, f"width int, pass long, key long, node long, v {vectors.schema['v'].dataType.simpleString()}")


def window_links(rows: DataFrame, p: Passes) -> DataFrame:
    """(a, b) pairs of neighbours within reach; rows come sorted by width, pass and key."""

    def run(batches):
        held, last = None, None
        for width, batch in by_width(batches):
            at, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
            x = unit(matrix(batch.column(4), width))
            if held is not None and last == width:
                at, node, x = (np.concatenate(pair) for pair in zip(held, (at, node, x)))
            left, right = [], []
            for d in range(1, min(p.window, len(x) - 1) + 1):
                near = np.flatnonzero((np.einsum("ij,ij->i", x[:-d], x[d:]) >= p.reach) & (at[:-d] == at[d:]))
                left.append(near)
                right.append(near + d)
            if left:
                a, b = shared.stars(node, np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held, last = tuple(c[-p.window :] for c in (at, node, x)), width

    return rows.mapInArrow(run, "a long, b long")


def compared_pairs(members: DataFrame, p: Passes) -> DataFrame:
    """(node, n, other): rows with ``n`` count a member's links inside its group, copies
    counted by ``copies``; rows with ``other`` link two members.

    ``members``: (width, component, node, v, copies).  A group of several blocks is dealt
    out as pairs of blocks, so that no task holds more than two of them at once."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / p.block).cast("long").alias("n")).where("n > 1")
    dealt = shared.with_few(members, sizes, "component").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select("width", "component", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "copies", "v")

    def compare(own, node, copies, x):
        first = own == own[0]
        n = np.zeros(len(node), dtype=np.int64)
        everyone = np.arange(len(node))
        sides = [(everyone, everyone)] if first.all() else [(np.flatnonzero(first), np.flatnonzero(~first))]
        stars = []
        for a, b in sides:
            for at in range(0, len(a), 512):
                some = a[at : at + 512]
                near = x[some] @ x[b].T >= p.cosine
                near &= node[some][:, None] != node[b][None, :]
                n[some] += near @ copies[b]
                if len(sides[0][0]) < len(node):
                    n[b] += copies[some] @ near
                i, j = np.nonzero(near)
                stars.append(shared.stars(node, some[i], b[j]))
        a, b = (np.concatenate(s) for s in zip(*stars))
        return node, n, a, b

    def made(found):
        node, n, a, b = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        names = pa.array(np.concatenate((node, pairs[:, 0])))
        return pa.RecordBatch.from_arrays([names, pa.concat_arrays([pa.array(n), pa.nulls(len(pairs), pa.int64())]), pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(pairs[:, 1])])], ["node", "n", "other"])

    def run(batches):
        kept, last = None, None
        for width, batch in by_width(batches):
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7)]
            cols.append(unit(matrix(batch.column(7), width)))
            if kept is not None and last == width:
                cols = [np.concatenate([a, b]) for a, b in zip(kept, cols)]
            elif kept is not None:
                yield made([compare(*kept[3:])])
            keys = np.stack(cols[:3], axis=1)
            edges = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
            start, found = 0, []
            for end in edges[:-1].tolist():
                found.append(compare(*(c[start:end] for c in cols[3:])))
                start = end
            kept, last = [c[start:] for c in cols], width
            if found:
                yield made(found)
        if kept is not None:
            yield made([compare(*kept[3:])])

    keys = ["width", "component", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "own").mapInArrow(run, "node long, n long, other long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", p: Passes = Passes()) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Links join pairs found whose cosine in double precision is at least ``p.cosine``.
    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths with each other.  Equal vectors are
    compared once and counted as often as they occur.  component_id is the smallest id
    that links reach; kept is true for that id alone.  Rows of equal ids each count as a
    vector, an id of several different vectors as the largest; a null id links, is never
    the smallest unless all are null, and is not kept.  Ids must be below 2^62.  An empty
    table gives an empty result; other columns are not used.
    """
    kind = rows.schema[vector_col].dataType
    # Floats travel as floats; every cosine is computed in double precision.
    v = F.col(vector_col) if kind.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    top = F.array_max(F.transform(v, F.abs))
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (top > 0)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.when(fit, v).alias("v"))
    classes = named.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = classes.select("v", "least", "copies", F.size("v").alias("width"))
    clashes = classes.where("least IS NOT NULL").groupBy("least").count().where("count > 1").select("least", F.lit(True).alias("clash"))
    node = F.when(F.col("clash"), shared.late_id("v")).otherwise(shared.order_id("least", "v"))
    classes = shared.cut(classes.join(clashes, "least", "left").select("width", node.alias("node"), "v", "least", "copies"), "vectors")
    order = ["width", "pass", "key", "node"]
    found = window_links(keyed(classes.select("width", "node", "v"), p).repartitionByRange(*order).sortWithinPartitions(*order), p)
    members = classes.join(shared.components(found), "node").select("width", "component", "node", "v", "copies")
    compared = shared.cut(compared_pairs(members, p), "compared")
    labels = shared.components(compared.where("other IS NOT NULL"), "node", "other")
    counts = compared.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    told = classes.join(labels, "node", "left").join(counts, "node", "left")
    component = F.when(F.col("component").isNull(), F.col("least")).otherwise(shared.real_id("component"))
    told = told.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component.alias("component_id"))
    out = named.join(told, "v", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
