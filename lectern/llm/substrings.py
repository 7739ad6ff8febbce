"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words.

Two counts over hash buckets decide.  The first finds candidates: every window of every
document sends four bytes of its 64-bit hash to a bucket that the rest of the hash
names, and windows whose hash starts in two documents come back.  The second counts the
candidates alone by a 128-bit hash of their words (two independent polynomials over the
halves of each word's own 128-bit hash, of which a bucket sees 96 bits and its number)
and names those that a smaller id has too.  So a chance match of the first count costs
work and no words.  An Arrow batch decides what it can by itself and sends of each hash
the smallest document only; a hot window is one entry a batch.  Named windows merge
into maximal removal intervals of their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import shared

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Sizes:
    """Bounds of memory: windows of one Arrow batch's round, windows that a bucket opens
    at once, bytes of text behind one bucket; and the bytes of a hash that the first
    count sends (fewer only make more candidates)."""

    round: int = 1 << 20
    opened: int = 1 << 22
    bucket_bytes: int = 1 << 23
    most_buckets: int = 1 << 16
    sent: int = 4


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def word_halves(words: list[bytes]) -> np.ndarray:
    """The two halves of each word's 128-bit hash, as rows of two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def window_hashes(hashed: np.ndarray, window: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp polynomial of every ``window`` consecutive word hashes, modulo 2^64,
    with its bits mixed afterwards."""
    n = len(hashed) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashed[:n].copy()
    for k in range(1, window):
        out *= np.uint64(base)
        out += hashed[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest width that holds them; its first byte is the
    width.  Zeros alone take no byte each."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (0, 1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + (values.astype(f"<u{width}").tobytes() if width else len(values).to_bytes(8, "little"))


def unpacked(blob: bytes) -> np.ndarray:
    if not blob[0]:
        return np.zeros(int.from_bytes(blob[1:], "little"), dtype=np.int64)
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


def run_lengths(who: np.ndarray, nth: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Entries, sorted by id, row of that id and start, as runs of one row: packed run
    lengths, the first id and the steps to the next ones, rows, and steps between starts."""
    heads = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (nth[1:] != nth[:-1]))))
    steps = np.diff(at, prepend=0)
    steps[heads] = at[heads]
    ids = who[heads]
    return packed(np.diff(np.append(heads, len(who)))), ids[:1].tobytes() + packed(np.diff(ids).astype(np.uint64)), packed(nth[heads]), packed(steps)


def run_values(counts: bytes, ids: bytes, rows: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, row, start) of every entry of ``run_lengths``."""
    n, steps = unpacked(counts), unpacked(starts)
    first = np.frombuffer(ids[:8], dtype=np.int64)
    who = np.concatenate((first, first[0] + np.cumsum(unpacked(ids[8:]))))
    total = np.cumsum(steps)
    heads = np.cumsum(n) - n
    return np.repeat(who, n), np.repeat(unpacked(rows), n), total - np.repeat(total[heads] - steps[heads], n)


RUNS = [("counts", pa.binary()), ("ids", pa.binary()), ("nths", pa.binary()), ("starts", pa.binary())]


def batch_of(rows: list[tuple], head: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    kinds = [*head, *RUNS]
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], [n for n, _ in kinds])


def extremes(keys: tuple[np.ndarray, ...], who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the smallest and the largest id among the entries of its key."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    differ = np.zeros(max(0, len(who) - 1), dtype=bool)
    for key in keys:
        sorted_ = key[order]
        differ |= sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(np.concatenate(([True], differ)))
    size = np.diff(np.append(starts, len(who)))
    out = []
    for least in (np.minimum, np.maximum):
        values = np.empty(len(who), dtype=np.int64)
        values[order] = np.repeat(least.reduceat(who[order], starts), size)
        out.append(values)
    return out[0], out[1]


def parted(who: np.ndarray, nth: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple[int, tuple[bytes, ...]]]:
    """Entries as runs, by the part of the answer, of ``parts``, that their id belongs to."""
    part = (who.astype(np.uint64) * np.uint64(BASES[0]) >> np.uint64(40)) % np.uint64(parts)
    order = np.lexsort((at, nth, who, part))
    who, nth, at, part = who[order], nth[order], at[order], part[order]
    edges = np.searchsorted(part, np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        i, j = edges[k], edges[k + 1]
        yield k, run_lengths(who[i:j], nth[i:j], at[i:j])


def dealt(keys: tuple[np.ndarray, ...], seal, who: np.ndarray, nth: np.ndarray, at: np.ndarray, buckets: int, decided) -> pa.RecordBatch:
    """Rows for buckets (bucket, hashes and runs) of the entries of one round: of each key
    those of the smallest id.  ``decided(least, most)`` says which entries need no
    bucket to be answers; they go, with bucket -1 - n, to part n of the answer."""
    least, most = extremes(keys, who)
    sure = decided(who, least, most)
    rows = [(-1 - k, b"", *runs) for k, runs in parted(who[sure], nth[sure], at[sure], buckets)] if sure.any() else []
    bucket = (keys[0] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, nth, who, bucket))
    order = order[(who == least)[order]]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        o = order[edges[k] : edges[k + 1]]
        rows.append((k, seal(o), *run_lengths(who[o], nth[o], at[o])))
    return batch_of(rows, [("bucket", pa.int64()), ("hashes", pa.binary())])


def rounds(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows (id, row, hashes..., starts) in rounds of about ``most`` windows or one longer text."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[-1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield held


def joined(some: list[tuple]) -> list[np.ndarray]:
    """Columns of a round's entries: id, row, hashes..., starts."""
    n = [len(r[-1]) for r in some]
    ids = [np.repeat(np.array([r[k] for r in some], dtype=np.int64), n) for k in (0, 1)]
    return ids + [np.concatenate([r[k] for r in some]) for k in range(2, len(some[0]))]


def octets(values: np.ndarray, n: int) -> bytes:
    """The lowest ``n`` bytes of every number."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def numbers(blob: bytes, n: int, width: int, at: int) -> np.ndarray:
    """Numbers of ``n`` bytes that begin at byte ``at`` of every ``width`` bytes."""
    out = np.zeros((len(blob) // width, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, width)[:, at : at + n]
    return out.view(np.uint64).ravel()


def sent(batches, window: int, buckets: int, sizes: Sizes):
    """First count: all windows of (order, text)."""

    def rows():
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = window_hashes(word_hashes(shared.utf8(text).split()), window)
                if len(h):
                    yield i, 0, h, np.arange(len(h))

    for some in rounds(rows(), sizes.round):
        who, nth, h, at = joined(some)
        rest = h // np.uint64(buckets)
        yield dealt((h,), lambda o: octets(rest[o], sizes.sent), who, nth, at, buckets, lambda who, least, most: least < most)  # noqa: B023


def sent_again(batches, window: int, buckets: int, sizes: Sizes):
    """Second count: the candidates of (order, nth, text, starts) rows, in that order of columns."""

    def rows():
        for batch in batches:
            for i, nth, text, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = shared.utf8(text).split() if found else []
                at = unpacked(found) if found else np.zeros(0, dtype=np.int64)
                at = at[at + window <= len(words)]
                if len(at):
                    halves = word_halves(words)
                    yield i, nth, *(window_hashes(np.ascontiguousarray(halves[:, k]), window, BASES[1 + k])[at] for k in (0, 1)), at

    for some in rounds(rows(), sizes.round):
        who, nth, one, two, at = joined(some)

        def seal(o):
            return np.concatenate((one[o].view(np.uint8).reshape(-1, 8), two[o].view(np.uint8).reshape(-1, 8)[:, :4]), axis=1).tobytes()  # noqa: B023

        yield dealt((one, two), seal, who, nth, at, buckets, lambda who, least, most: least < who)


def counted(batches, parts: int, widths: tuple[int, ...], again: bool, sizes: Sizes):
    """(part, runs): of each bucket the entries that are answers, a row for each part of
    the answer; rows come sorted by bucket.  ``widths``: bytes of a hash's numbers.  The
    first count answers entries whose hash several ids have, the second, ``again``, those
    of all ids but the smallest.  A bucket's rows stay packed; what is opened at once is
    bounded by taking its hashes in classes."""
    width = sum(widths)
    found: list[list[np.ndarray]] = []

    def decide(rows):
        total = sum(len(r[0]) // width for r in rows)
        classes = -(-total // sizes.opened)
        for c in range(classes):
            keys, entries = [], []
            for blob, *runs in rows:
                ks = [numbers(blob, n, width, sum(widths[:k])) for k, n in enumerate(widths)]
                mine = np.flatnonzero(ks[0] % np.uint64(classes) == c) if classes > 1 else slice(None)
                keys.append([k[mine] for k in ks])
                entries.append([x[mine] for x in run_values(*runs)])
            keys_, (who, nth, at) = tuple(map(np.concatenate, zip(*keys))), map(np.concatenate, zip(*entries))
            if len(who):
                least, most = extremes(keys_, who)
                hit = who > least if again else least < most
                found.append([who[hit], nth[hit], at[hit]])

    def out():
        rows = list(parted(*(np.concatenate(x) for x in zip(*found)), parts))
        found.clear()
        return batch_of([(k, *runs) for k, runs in rows], [("part", pa.int64())])

    held, bucket = [], None
    for batch in batches:
        for b, blob, *runs in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                if held:
                    decide(held)
                held, bucket = [], b
                if sum(len(x[0]) for x in found) > sizes.opened:
                    yield out()
            if b < 0:
                found.append(list(run_values(*runs)))
                if sum(len(x[0]) for x in found) > sizes.opened:
                    yield out()
            else:
                held.append((blob, *runs))
    if held:
        decide(held)
    if sum(len(x[0]) for x in found):
        yield out()


FOUND = pa.list_(pa.struct([("nth", pa.int64()), ("starts", pa.binary())]))


def gathered(batches):
    """(key, found): all answers of an id, by its rows; input rows come sorted by part."""

    def out(rows):
        who, nth, at = (np.concatenate(x) for x in zip(*(run_values(*r) for r in rows)))
        order = np.lexsort((at, nth, who))
        who, nth, at = who[order], nth[order], at[order]
        edges = np.append(np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (nth[1:] != nth[:-1])))), len(who))
        keys, found = [], []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if not keys or keys[-1] != who[i]:
                keys.append(int(who[i]))
                found.append([])
            found[-1].append({"nth": int(nth[i]), "starts": packed(np.unique(at[i:j]))})
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, FOUND)], ["key", "found"])

    held, part = [], None
    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                if held:
                    yield out(held)
                held, part = [], p
            held.append(row)
    if held:
        yield out(held)


def answers(made: DataFrame, buckets: int, widths: tuple[int, ...], again: bool, sizes: Sizes) -> DataFrame:
    """(key, found) from the rows of a count."""
    runs = "counts binary, ids binary, nths binary, starts binary"
    task = F.pmod(F.col("bucket"), F.lit(buckets)).cast("int")
    told = made.repartitionById(buckets, task).sortWithinPartitions("bucket").mapInArrow(shared.giving_back(lambda x: counted(x, buckets, widths, again, sizes)), f"part long, {runs}")
    return told.repartitionById(buckets, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(shared.giving_back(gathered), "key long, found array<struct<nth:long,starts:binary>>")


def intervals(found: bytes | None, n_words: int, window: int) -> list[tuple[int, int]]:
    """Maximal half-open word intervals that the windows cover."""
    if not found:
        return []
    starts = unpacked(found)
    cuts = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(s[0]), int(s[-1]) + window) for s in np.split(starts, cuts)]


def spans_of(text: bytes, words: list[bytes]) -> list[int]:
    """Byte offset of every word."""
    out, at = [], 0
    for w in words:
        at = text.index(w, at)
        out.append(at)
        at += len(w)
    return out


def without(text: bytes, words: list[bytes], cut: list[tuple[int, int]]) -> bytes:
    """The text less the words of the intervals and the white space after each of them."""
    offsets = [*spans_of(text, words), len(text)]
    out, at = [], 0
    for i, j in cut:
        out.append(text[at : offsets[i]])
        at = offsets[j]
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13, digest: bool = False, keep: tuple[str, ...] = (), sizes: Sizes = Sizes()) -> DataFrame:
    """(id, n_words, n_removed, intervals, text): each row less the words covered by a
    window of ``window`` words that also starts in a row with a smaller id.  Windows
    are judged on the input.  With ``digest``, kept_sha256 (of the kept words joined by
    one space) stands for intervals and text.  ``keep``: columns that follow unchanged.

    Words are parted by ASCII white space and compared byte for byte.  A null text
    has no words; texts shorter than the window lose none.  Rows of equal ids are one
    document: they take nothing from each other, but each is cut by its own windows.
    Null ids come after all others and in the order of their texts' hashes, so a text
    of several rows without an id stays in all of them if no other row has it.  Ids
    must be below 2^62.  An empty table gives an empty result; other columns are not
    looked at.

    The number of buckets, each a task, follows the bytes of all texts (``Sizes.bucket_bytes``).
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *(F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)))
    rows = own.withColumn("order", shared.order_id("id", "text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min(sizes.most_buckets, max(1, -(-total // sizes.bucket_bytes)))

    made = rows.select("order", "text").mapInArrow(shared.giving_back(lambda x: sent(x, window, buckets, sizes)), "bucket long, hashes binary, counts binary, ids binary, nths binary, starts binary")
    near = answers(made, buckets, (sizes.sent,), False, sizes).select("key", F.col("found")[0]["starts"].alias("near"))
    # Texts meet their windows by id; rows of one id are told apart by their place among them.  Both joins read one shuffle of the texts.
    texts = rows.withColumn("nth", F.row_number().over(Window.partitionBy("order").orderBy("text")).cast("long") - 1)
    asked = texts.join(near, texts["order"] == near["key"], "left").select("order", "nth", "text", "near", *(c for c in texts.columns if c not in ("order", "nth", "text")))
    made = asked.mapInArrow(shared.giving_back(lambda x: sent_again(x, window, buckets, sizes)), "bucket long, hashes binary, counts binary, ids binary, nths binary, starts binary")
    told = answers(made, buckets, (8, 4), True, sizes)
    both = texts.join(told, texts["order"] == told["key"], "left").select("id", "nth", "text", "found", *(f"keep_{k}" for k in range(len(keep))))
    kinds = [("kept_sha256", pa.string())] if digest else [("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())]
    names = ["id", "n_words", "n_removed", *(k for k, _ in kinds), *keep]

    def run(batches):
        for batch in batches:
            n, removed, one, two = [], [], [], []
            for nth, text, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                data = shared.utf8(text)
                words = data.split()
                cut = intervals(next((f["starts"] for f in found or () if f["nth"] == nth), None), len(words), window)
                n.append(len(words))
                removed.append(sum(j - i for i, j in cut))
                if digest:
                    kept, at = [], 0
                    for i, j in cut:
                        kept += words[at:i]
                        at = j
                    one.append(hashlib.sha256(b" ".join([*kept, *words[at:]])).hexdigest())
                else:
                    one.append([{"start": i, "end": j} for i, j in cut])
                    two.append(text if not cut else without(data, words, cut).decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            cols += [pa.array(v, t) for v, (_, t) in zip((one, two), kinds)]
            yield pa.RecordBatch.from_arrays(cols + batch.columns[4:], names)

    ends = "kept_sha256 string" if digest else "intervals array<struct<start:long,end:long>>, text string"
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return both.mapInArrow(shared.giving_back(run), f"id long, n_words long, n_removed long, {ends}{kept}")
