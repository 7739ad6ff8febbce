"""Sharding by Hilbert-curve order, with DataFrame functions only.

Metadata dimensions are quantised by rank, the cells they form are visited along a
Hilbert curve, and the order is cut into runs of equal row counts.  A shard then covers a
compact box of every dimension at once, so that a manifest of minima and maxima
prunes files for a filter on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import shared


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of a cell with coordinates 0 .. 2^bits - 1.

    Works on an array of the coordinates: undo excess rotations from the high bit
    down, Gray-encode, then read the bits of all dimensions plane by plane."""
    n = len(dims)
    at = F.array(*(d.cast("long") for d in dims))
    turns = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def turn(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        head, own = x[0], F.get(x, i)
        mask = q - 1
        swap = head.bitwiseXOR(own).bitwiseAND(mask)
        flip = own.bitwiseAND(q) != 0
        new_head = F.when(flip, head.bitwiseXOR(mask)).otherwise(head.bitwiseXOR(swap))
        new_own = F.when(flip, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_head).when(k == i, new_own).otherwise(v))

    at = F.aggregate(turns, at, turn) if bits > 1 else at
    gray = F.transform(at, lambda v, k: F.aggregate(F.slice(at, F.lit(1), k + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))

    def last_flip(x: Column) -> Column:
        steps = F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)))
        last = F.element_at(x, -1)
        return F.aggregate(steps, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    gray = F.transform(gray, lambda v: v.bitwiseXOR(last_flip(gray))) if bits > 1 else gray
    places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("h"), gray.alias("x")),
        lambda s, p: F.struct((s["h"] * 2 + F.call_function("shiftright", F.get(s["x"], p["i"]), p["b"]).bitwiseAND(1)).alias("h"), s["x"].alias("x")),
        lambda s: s["h"],
    )


def order_codes(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, code): for every value a cell coordinate that rises with the value, by the
    share of rows before its middle.  Ranges of values are ranges of cells, and each cell
    has about as many rows.  Values are summed by their first two bytes first, so that no
    window holds more of them than begin alike."""
    values = rows.groupBy(column).agg(F.count("*").alias("n")).withColumn("head", F.substring(F.col(column).cast("binary"), 1, 2))
    heads = values.groupBy("head").agg(F.sum("n").alias("n"))
    heads = heads.select("head", before("head").alias("head_at"), F.sum("n").over(Window.partitionBy()).alias("total"))
    told = values.select(column, "head", "n", before(column, by=("head",)).alias("at")).join(heads, "head")
    middle = (2 * (F.col("head_at") + F.col("at")) + F.col("n")) / (2 * F.col("total"))
    return told.select(column, F.least(F.floor(middle * (1 << bits)), F.lit((1 << bits) - 1)).cast("long").alias("code"))


def before(*order: str, by: tuple[str, ...] = ()) -> Column:
    """The sum of n over what comes before a row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))


def hilbert_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source"), *, shards: int = 24, bits: int = 5, spread: int = 64) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot): every row's place, counts of shards
    at most one apart (law "rows").

    The dimensions are the size, cut at its quantiles, and ``dims``, cut at shares of rows in
    the order of their values, so that a manifest of minima and maxima prunes shards for a
    filter on any of them.  The order is (curve index, hash of the text, salt of the id, id):
    copies of one text that agree in all dimensions stand together, with a shard's end
    between them at most; copies in other cells stand elsewhere.  A rank is a sum of starts:
    of the cell (at most 2^(bits * dimensions) of them), of one of ``spread`` blocks of the
    cell, of the text there, and the row number within text and salt, so that no window
    holds more than a bounded number of rows or a ``spread``-th of the copies of one text.

    Null text: size 8, the checksum of nothing.  Null and empty values of a dimension share
    a cell.  Null ids sort first; repeated rows get slots of their own.  An empty table
    gives an empty result; columns that are not named are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    cells_ = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"dim_{k}") for k, d in enumerate(dims)]
    th = F.xxhash64(text)
    base = shared.cut(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), th.alias("th"), *cells_), "sizes")
    bounds = base.agg(F.percentile_approx("size", [k / (1 << bits) for k in range(1, 1 << bits)], 10_000)).first()[0] or []
    coded = base.withColumn("code", sum((F.when(F.col("size") > b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("long"))
    for k in range(len(dims)):
        codes = order_codes(base, f"dim_{k}", bits).withColumnRenamed("code", "own")
        coded = coded.join(codes, f"dim_{k}").withColumn("code", F.col("code") + F.col("own") * (1 << bits * (k + 1))).drop("own")
    salted = coded.select("id", "size", "text_crc32", "code", "th", F.pmod("th", F.lit(spread)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(spread)).alias("salt"))
    rows = shared.cut(salted, "places")
    keys = ["code", "block", "th", "salt"]
    texts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    blocks = texts.groupBy("code", "block").agg(F.sum("n").alias("n"))
    cells = blocks.groupBy("code").agg(F.sum("n").alias("n"))
    mask = (1 << bits) - 1
    cells = cells.withColumn("curve", hilbert_index([F.call_function("shiftright", F.col("code"), F.lit(bits * k)).bitwiseAND(mask) for k in range(len(dims) + 1)], bits))
    cells = cells.select("code", "curve", before("curve").alias("cell_at"), F.sum("n").over(Window.partitionBy()).alias("total"))
    blocks = blocks.select("code", "block", before("block", by=("code",)).alias("block_at")).join(cells, "code")
    texts = texts.select(*keys, before("th", "salt", by=("code", "block")).alias("text_at")).join(blocks, ["code", "block"])
    texts = texts.select(*keys, "curve", "total", (F.col("cell_at") + F.col("block_at") + F.col("text_at")).alias("at"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "size")) - 1
    placed = rows.withColumn("own", own).join(texts, keys)
    rank, total = F.col("at") + F.col("own"), F.col("total")
    base_, more = F.floor(total / shards).cast("long"), total % shards
    large = base_ + 1
    rest = rank - more * large
    first = rank < more * large
    down = lambda a, b: F.floor(a / b).cast("long")
    shard = F.when(first, down(rank, large)).otherwise(more + down(rest, F.greatest(base_, F.lit(1))))
    slot = F.when(first, rank % large).otherwise(rest % F.greatest(base_, F.lit(1)))
    return placed.select("id", "size", "text_crc32", "curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def manifest(docs: DataFrame, places: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per shard: rows and the minimum and maximum of each column, for file pruning."""
    joined = docs.select(F.col(id_col).alias("id"), *columns).join(places.select("id", "shard"), "id")
    return joined.groupBy("shard").agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def write_shards(docs: DataFrame, places: DataFrame, id_col: str, path: str, shards: int = 24) -> None:
    """One folder of files per shard, rows in slot order; ids must be unique."""
    joined = docs.join(places.select(F.col("id").alias(id_col), "shard", "slot"), id_col)
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
