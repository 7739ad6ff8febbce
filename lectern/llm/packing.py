"""Packing into training sequences: vector bin packing with the dot-product heuristic.

An item is a piece of an example with a demand in three dimensions: tokens, segments
(one) and loss-bearing tokens.  The open sequence takes, of the items that fit, the one
whose demand has the largest dot product with what the sequence has left.  Where none
fits, an item is cut to fill it.  Every partition packs its own rows, so nothing is
shuffled and one sequence a partition at most is left unfilled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for
    themselves, the others, in order, from code point 256 on.  A space stays one."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + others.index(b)) for b in others if b != 0x20}


class WordEncoder(dict):
    """Token ids of texts under a tokenizers file.

    Where the file's normalizer and pre-tokenizer are known to part words at white space
    and drop it, a word between ASCII white space is encoded once and remembered as bytes
    of ids (at most ``most`` words), and the ids of a text are those of its words.  Most
    words are lower-case Latin letters and a tail of ASCII punctuation; they go to the
    file's model directly.  Under any other file whole texts go to the tokenizer."""

    SIMPLE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most = most
        self.letters = byte_letters()
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        config = json.loads(self.tokenizer.to_str())
        steps = [[x["type"] for x in (config[k] or {}).get(n, [])] for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.lower = steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and not any(self.SIMPLE.fullmatch(b"a" + x) for x in self.specials)
        if self.lower:
            trial = [b"word", b"stra\xc3\x9fe,", b"\xc3\xa9t\xc3\xa9...", b"a-'"]
            texts = [" a  b\n", "word\tword", "It's 12 \x1c x", "stra\u00dfe, \u00e9t\u00e9"]
            self.lower = all(self[w] == self.whole(w) for w in trial) and all(self(t).tobytes() == self.whole(t.encode()) for t in texts)
            self.clear()

    def whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)[0].ids
        return array("I", ids).tobytes()

    def piece(self, word: bytes) -> bytes:
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        m = self.SIMPLE.fullmatch(word)
        if m:
            tail = self.tails.get(m[2])
            if tail is None:
                tail = self.piece(m[2])
                if len(self.tails) < 10_000:
                    self.tails[m[2]] = tail
            ids = self.piece(m[1]) + tail
        else:
            ids = self.whole(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids

    def words(self, text: str | None) -> list[bytes]:
        data = shared.utf8(text)
        return (data if any(x[:2] in data for x in self.specials) else data.lower()).split()

    def __call__(self, text: str | None) -> np.ndarray:
        if not self.lower:
            return np.frombuffer(self.whole(shared.utf8(text)), dtype="<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, self.words(text))), dtype="<u4")


def encoder(path: str) -> WordEncoder:
    if path not in shared.KEPT:
        shared.KEPT[path] = WordEncoder(path)
    return shared.KEPT[path]


class Item:
    """What is left of an example: ids from ``start`` on, the loss-bearing tokens among the
    first n of them as ``sums[n]`` (None if all bear loss), and the example's size."""

    def __init__(self, name, ids: np.ndarray, bears: np.ndarray | None) -> None:
        self.name, self.ids, self.start, self.size = name, ids, 0, len(ids)
        self.sums = None if bears is None else np.concatenate(([0], np.cumsum(bears)))

    def __len__(self) -> int:
        return len(self.ids)

    def loss(self, n: int) -> int:
        return n if self.sums is None else int(self.sums[n])

    def most(self, tokens: int, loss: int) -> int:
        """The most tokens of the beginning within both bounds."""
        n = min(len(self), tokens)
        return min(n, loss) if self.sums is None else min(n, int(np.searchsorted(self.sums, loss, "right")) - 1)

    def cut(self, n: int) -> tuple:
        """(name, start, ids, loss, size) of the first n tokens, which go."""
        piece = (self.name, self.start, self.ids[:n], self.loss(n), self.size)
        # A copy, so that what went does not stay in memory.
        self.ids, self.start = self.ids[n:].copy(), self.start + n
        if self.sums is not None:
            self.sums = self.sums[n:] - self.sums[n]
        return piece


def pack(items: list[Item], limits: Limits, *, last: bool, spare: int = 0) -> Iterator[list[tuple]]:
    """Sequences of pieces (name, start, ids, loss, size) of the items, which shrink and
    leave the list.  Without ``last``, stops as soon as under ``spare`` tokens are left."""
    most = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
    tokens = np.array([len(x) for x in items], dtype=np.int64)
    loss = np.array([x.loss(len(x)) for x in items], dtype=np.int64)
    while (left := tokens.sum()) and (last or left >= spare):
        room, made, open_ = most.copy(), [], tokens > 0
        while room[0] > 0 and room[1] > 0 and open_.any():
            share = room / most
            gain = share[0] * tokens / most[0] + share[1] / most[1] + share[2] * loss / most[2]
            fits = open_ & (tokens <= room[0]) & (loss <= room[2])
            i = int(np.argmax(np.where(fits if fits.any() else open_, gain, -1.0)))
            n = items[i].most(int(room[0]), int(room[2]))
            if not n:
                open_[i] = False  # its next token bears loss and no more may
                continue
            piece = items[i].cut(n)
            made.append(piece)
            tokens[i], loss[i] = len(items[i]), items[i].loss(len(items[i]))
            open_[i] &= tokens[i] > 0
            room -= (n, 1, piece[3])
        if not made:
            raise ValueError("limits must leave room for one token")
        yield made
    items[:] = [x for x in items if len(x)]


def pack_examples(rows: DataFrame, tokenizer: str, id_col: str = "id", parts_col: str = "parts", *, end_id: int = 2, limits: Limits = Limits(), pool: int = 2048, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens): pieces of
    examples; ``with_ids`` adds the pieces' ids.

    ``parts`` is an array of (text, loss): the example's ids are those of its texts in order
    and ``end_id``; tokens of a part with ``loss`` bear loss, and ``end_id`` does if the last
    part does.  A null loss is false; null and empty texts have no ids, a null or empty array
    is ``end_id`` alone.  Long examples fill whole sequences first.  Up to ``pool`` items wait
    to be packed (a bound of memory; a pool is packed down to what fills no more than a few
    sequences and filled again).  Repeated rows and null ids are packed like others.  An
    empty table gives an empty result; other columns are not looked at.
    """
    picked = rows.select(F.col(id_col).alias("id"), F.transform(parts_col, lambda p: F.struct(p["text"].cast("string").alias("text"), F.coalesce(p["loss"].cast("boolean"), F.lit(False)).alias("loss"))).alias("parts"))
    kinds = [pa.int64()] * 7

    def run(batches):
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        count = 0
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"][: 8 + with_ids]
        id_kind = pa.int64()

        def placed(made):
            nonlocal count
            count += 1
            offset = 0
            for name, start, ids, loss, size in made:
                yield (name, start, len(ids), zlib.crc32(ids.tobytes()), size, (task << 32) + count - 1, offset, loss, ids)
                offset += len(ids)

        def out(rows):
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], id_kind), *(pa.array(c, t) for c, t in zip(cols[1:8], kinds))]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        def item(name, parts):
            made = [(encode(p["text"]), p["loss"]) for p in parts or ()]
            made.append((np.array([end_id], dtype="<u4"), made[-1][1] if made else True))
            ids = np.concatenate([x for x, _ in made]).astype("<u4")
            return Item(name, ids, None if all(y for _, y in made) else np.repeat([y for _, y in made], [len(x) for x, _ in made]))

        items = []
        for batch in batches:
            id_kind = batch.column(0).type
            rows = []
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = item(name, parts)
                while len(x) and (n := x.most(limits.tokens, limits.loss)) and (n == limits.tokens or x.loss(n) == limits.loss):
                    rows += placed([x.cut(n)])
                if len(x):
                    items.append(x)
                if len(items) >= pool:
                    for made in pack(items, limits, last=False, spare=4 * limits.tokens):
                        rows += placed(made)
                if len(rows) >= 4096:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)
        rows = [r for made in pack(items, limits, last=True) for r in placed(made)]
        if rows:
            yield out(rows)

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(shared.giving_back(run, keeps=True), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``pack_examples`` of documents: one text, every token of which bears loss."""
    whole = F.array(F.struct(F.col(text_col).cast("string").alias("text"), F.lit(True).alias("loss")))
    return pack_examples(docs.select(F.col(id_col).alias("id"), whole.alias("parts")), tokenizer, **more)


def pack_conversations(turns: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = ("assistant",), **more) -> DataFrame:
    """``pack_examples`` of conversations: turns in order, of which those of ``learned`` roles
    bear loss.  Rows of one turn number are ordered by role and text."""
    part = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(role_col).isin(*learned), F.lit(False)).alias("loss"))
    whole = turns.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return pack_examples(whole, tokenizer, **more)
