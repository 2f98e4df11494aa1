"""Packing token sequences by vector bin packing.

An example has a demand in three dimensions: tokens, one segment, and loss-bearing
tokens.  A sequence is filled by the dot-product heuristic: of the examples that
still fit, one with the largest product of demand and remaining room goes in.  Examples wait in
classes by the share of their tokens that bear loss (``SHARES``), and in each class by length; of a class the
longest that fits has the largest product, so only one example of each class is weighed and a placement takes
constant time.  When nothing fits, a cut example fills the sequence to its last token.  Packing
runs inside each task over bounded batches without a shuffle; a sequence left
open goes on with the next batch, and at a task's end it is cut into pieces whose
lengths are powers of two, which need no padding.

``pack_documents``: a document's ids are its tokens and one end id; all but the first bear loss, as nothing predicts that
one.  Null texts are empty: the end id alone.  ``pack_conversations``: the turns of a conversation in order, each ended by the
end id; only the turns of ``roles`` bear loss.  Rows of equal id are separate examples, repeated rows too; of examples that tie
the last one read goes first; texts of any length are cut into pieces; other columns are not read; an empty table packs to nothing.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
SEGMENTS = 256
END = 1
BATCH_BYTES = 4 << 20
#: Classes of loss shares.
SHARES = 16
ROLES = ("assistant",)
VOCABULARY = "byte_bpe_50k"


class Tokens:
    """Ids of byte_bpe_50k.json by the tokenizers library's rules.

    The same merges are read as ranks by tiktoken, which gives equal ids about six times
    faster; a text with a special token's string goes through tokenizers itself.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path or P.path(f"{VOCABULARY}.json"))
        with open(ranks_path or P.path(f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([END], "<u4")
        if any(s in text for s in self.special):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(END)
        return np.array(ids, "<u4")


class Packer:
    """Fills one sequence after another; calls ``emit(item, start, length, sequence, offset)``.

    Items are (item, loss), where loss[i] is the number of loss-bearing tokens before its token i, and
    loss[-1] that of all; so len(loss) - 1 is its length.
    """

    def __init__(self, emit, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH), first: int = 0) -> None:
        self.emit, self.limits, self.sequence = emit, limits, first
        self.open: list[tuple] = []  # (item, start, length) of the sequence being filled
        self.room = list(limits)
        #: Of each class a bit for each length that has examples, and these.
        self.lengths = [0] * (SHARES + 1)
        self.waiting: list[dict[int, list]] = [{} for _ in range(SHARES + 1)]
        self.long: list[tuple] = []  # (item, loss, start) of more tokens than a sequence has

    def _put(self, item, loss, start: int, length: int) -> None:
        self.open.append((item, start, length))
        self.room[0] -= length
        self.room[1] -= 1
        self.room[2] -= int(loss[start + length] - loss[start])

    def _write(self, pieces) -> None:
        at = 0
        for item, start, length in pieces:
            self.emit(item, start, length, self.sequence, at)
            at += length
        if at:
            self.sequence += 1

    def _close(self) -> None:
        """The open sequence is over: whole if full, else in powers of two."""
        pieces, self.open, self.room = self.open[::-1], [], list(self.limits)
        total = sum(p[2] for p in pieces)
        if total == self.limits[0]:
            self._write(pieces[::-1])
            return
        while total:
            take, part = 1 << (total.bit_length() - 1), []
            total -= take
            while take:
                item, start, length = pieces.pop()
                n = min(length, take)
                part.append((item, start, n))
                take -= n
                if n < length:
                    pieces.append((item, start + n, length - n))
            self._write(part)

    def _wait(self, item, loss, start: int) -> None:
        length = len(loss) - 1 - start
        if length > self.limits[0]:
            self.long.append((item, loss, start))
        elif length > 0:
            share = -(-int(loss[-1] - loss[start]) * SHARES // length)
            self.lengths[share] |= 1 << length
            self.waiting[share].setdefault(length, []).append((item, loss, start))

    def _take(self, share: int, length: int) -> tuple:
        own = self.waiting[share][length]
        found = own.pop()
        if not own:
            del self.waiting[share][length]
            self.lengths[share] ^= 1 << length
        return found

    def _best(self) -> tuple[int, int] | None:
        """The class and length with the largest product of demand and room, of those that fit."""
        tokens, segments, lossy = self.room
        if segments <= 0:
            return None
        a, b, c = (r / m / m if m else 0.0 for r, m in zip(self.room, self.limits, strict=True))
        best, most = None, -1.0
        for share, lengths in enumerate(self.lengths):
            if not lengths:
                continue
            cap = tokens if not share else min(tokens, lossy * SHARES // share)  # a class's examples bear no more than its share
            length = (lengths & ((1 << (cap + 1)) - 1)).bit_length() - 1
            if length > 0:
                product = a * length + b + c * length * share / SHARES
                if product > most:
                    best, most = (share, length), product
        return best

    def _cut(self) -> bool:
        """The longest example gives as many leading tokens as there is room for, with their share of the loss."""
        if self.long:
            item, loss, start = self.long.pop()
        else:
            share = max(range(SHARES + 1), key=lambda k: self.lengths[k])
            length = self.lengths[share].bit_length() - 1
            if length <= 0:
                return False
            item, loss, start = self._take(share, length)
        n = 0
        if self.room[1] > 0:
            most = min(len(loss) - 1, start + self.room[0])
            n = min(most, int(np.searchsorted(loss, loss[start] + self.room[2], "right")) - 1) - start
        if n > 0:
            self._put(item, loss, start, n)
        self._wait(item, loss, start + max(n, 0))
        return True

    def pack(self, items: list[tuple]) -> None:
        for item, loss in items:
            start = 0
            while len(loss) - 1 - start >= self.limits[0] and loss[start + self.limits[0]] - loss[start] <= self.limits[2]:
                self._write([(item, start, self.limits[0])])  # whole sequences of long examples
                start += self.limits[0]
            self._wait(item, loss, start)
        while True:
            best = self._best()
            if best:
                item, loss, start = self._take(*best)
                self._put(item, loss, start, len(loss) - 1 - start)
            elif self._cut():
                self._close()
                continue
            else:
                return
            if not self.room[0] or not self.room[1]:
                self._close()

    def finish(self) -> None:
        if self.open:
            self._close()


def all_but_first(n: int) -> np.ndarray:
    """Loss counts of a text of n tokens."""
    loss = np.arange(-1, n)
    loss[0] = 0
    return loss


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(schema: pa.Schema, limits: tuple[int, int, int], paths: tuple, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*paths)
        out: dict[str, list] = {c: [] for c in schema.names}

        def emit(item, start, length, sequence, offset):
            doc_id, own = item
            piece = own[start : start + length]
            for c, v in (("doc_id", doc_id), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(own)), ("sequence_id", sequence), ("offset", offset)):
                out[c].append(v)
            if ids:
                out["ids"].append(piece.astype(np.int32))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for v in out.values():
                v.clear()
            return batch

        packer = Packer(emit, limits, TaskContext.get().partitionId() << 36)
        items, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = tokens.ids(text.as_py())
                items.append(((doc_id, own), all_but_first(len(own))))
                size += own.nbytes + 64
                if size >= BATCH_BYTES:
                    packer.pack(items)
                    items, size = [], 0
                    yield flush()
        packer.pack(items)
        packer.finish()
        yield flush()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH), paths: tuple = (None, None), ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``ids`` the piece's token ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if ids else "")
    return rows.mapInArrow(_pack(to_arrow_schema(StructType.fromDDL(ddl)), limits, paths, ids), ddl)


def _pack_turns(schema: pa.Schema, limits: tuple[int, int, int], paths: tuple, roles: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*paths)
        out: dict[str, list] = {c: [] for c in schema.names}

        def emit(item, start, length, sequence, offset):
            conv_id, number, own, loss = item
            piece = own[start : start + length]
            row = (conv_id, number, start, length, zlib.crc32(piece.tobytes()), int(loss[start + length] - loss[start]), len(own), sequence, offset)
            for c, v in zip(schema.names, row, strict=True):
                out[c].append(v)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for v in out.values():
                v.clear()
            return batch

        packer = Packer(emit, limits, TaskContext.get().partitionId() << 36)
        items, size = [], 0
        name, number, ids, bears = None, 0, [], []

        def example():
            own = np.concatenate(ids)
            loss = np.concatenate(([0], np.cumsum(np.concatenate(bears))))
            return ((name, number, own, loss), loss), own.nbytes * 4 + 64

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                # A conversation of more than a batch goes on as its next part.
                if ids and (conv_id != name or sum(map(len, ids)) * 16 > BATCH_BYTES):
                    found, weight = example()
                    items.append(found)
                    size += weight
                    number, ids, bears = (number + 1 if conv_id == name else 0), [], []
                    if size >= BATCH_BYTES:
                        packer.pack(items)
                        items, size = [], 0
                        yield flush()
                name = conv_id
                ids.append(tokens.ids(text))
                bears.append(np.full(len(ids[-1]), role in roles))
        if ids:
            items.append(example()[0])
        packer.pack(items)
        packer.finish()
        yield flush()

    return run


def pack_conversations(turns: DataFrame, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH // 2), paths: tuple = (None, None), roles: tuple = ROLES) -> DataFrame:
    """A row for each piece of the conversations of a table (conv_id, turn, role, text): conv_id, part, start, length, ids_crc32,
    loss_tokens, part_tokens, sequence_id, offset.  Turns stand in order of turn, role and text; null roles bear no loss; null ids are one conversation.
    A conversation meets in one task as a stream, and one of more than 256 Ki tokens goes on as its next part."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = turns.select("conv_id", "turn", "role", "text")
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part long, start long, length long, ids_crc32 long, loss_tokens long, part_tokens long, sequence_id long, offset long"
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_pack_turns(to_arrow_schema(StructType.fromDDL(ddl)), limits, paths, roles), ddl)
