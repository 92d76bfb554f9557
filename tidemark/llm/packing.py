"""Hierarchical multi-length packing of tokenised documents.

Each task tokenises and packs its own partition, so nothing is shuffled and memory is a round of documents. Whole windows
are cut off a long document first. The rest of a document is routed to the smallest context size that holds it. Tiers are
packed from the longest window to the shortest: a window takes its document, then its gap takes the largest documents of
shorter tiers that fit, and what no whole document fits is filled by cutting the smallest one left, whose other part goes
back to the tier of its size. A window that cannot be filled waits for the next round. What a task has left at its end is
strung together and cut into windows of falling powers of two, so at most one short window a task is padded.

Step groups are balanced in a second pass over the windows' counts, one row a task and tier: windows of a tier are numbered
through all tasks and dealt into steps of STEP_TOKENS tokens, so every step has the same number of tokens and only the last
of each tier is short. Pieces are not shuffled for it.

Tokens come from the tokenizers library. Texts of plain Latin characters take a faster encoder with the same vocabulary
and the same result; texts with any other character, or with the name of a special token, take the library itself.

Null text counts as empty: the document is its end id. Repeated rows are documents of their own. An empty table gives an
empty result. Only the key and text columns are read. sequence_id is made of the partition and a number in it.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, parts, spread

#: Longest window, shortest tier, shortest window of a task's rest, tokens of a round and of a step, id after a document.
WINDOW, SHORTEST, LAST, ROUND, STEP_TOKENS, END_ID = 2048, 256, 16, 1 << 18, 16384, 1
#: Characters that both encoders cut alike: printable ASCII, tab, line ends, Latin-1 and Latin Extended-A letters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")
#: Longest run without a space or line end that takes the faster encoder.
RUN = re.compile(r"[^ \n\t\r]{2000}")


class Encoder:
    """Ids of texts by the tokenizer file, with the same vocabulary as ranks for plain texts if ranks is given."""

    def __init__(self, file: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.plain = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.plain is not None and "<|" not in text and PLAIN.fullmatch(text) and not RUN.search(text):
            return self.plain.encode_to_numpy(text, disallowed_special=())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


class Piece:
    __slots__ = ("doc", "ids", "start")

    def __init__(self, doc: int, ids: np.ndarray, start: int):
        self.doc, self.ids, self.start = doc, ids, start

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids[:n], self.start), Piece(self.doc, self.ids[n:], self.start + n)


class Shelf:
    """Pieces by length; equal lengths in the order they came."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.of: dict[int, Piece] = {}
        self.n = 0

    def put(self, p: Piece) -> None:
        insort(self.keys, (len(p.ids), self.n))
        self.of[self.n] = p
        self.n += 1

    def pop(self, at: int) -> Piece:
        return self.of.pop(self.keys.pop(at)[1])

    def largest(self, most: int) -> Piece | None:
        at = bisect_right(self.keys, (most, self.n)) - 1
        return self.pop(at) if at >= 0 else None


class Packer:
    def __init__(self, window: int = WINDOW, shortest: int = SHORTEST):
        self.window, self.tiers = window, [window]
        while self.tiers[-1] > shortest:
            self.tiers.append(self.tiers[-1] // 2)
        self.shelf, self.held, self.done = Shelf(), 0, []

    def add(self, p: Piece) -> None:
        while len(p.ids) >= self.window:
            whole, p = p.split(self.window)
            self.done.append((self.window, [whole]))
        if len(p.ids):
            self.shelf.put(p)
            self.held += len(p.ids)

    def pack(self) -> None:
        """Close the windows that can be filled whole."""
        waiting = []
        for tier in self.tiers:
            below = tier // 2 if tier != self.tiers[-1] else 0
            while self.shelf.keys and self.shelf.keys[-1][0] > below:
                window, gap = [self.shelf.pop(-1)], tier
                gap -= len(window[0].ids)
                while gap and (p := self.shelf.largest(gap)):
                    window.append(p)
                    gap -= len(p.ids)
                if gap and self.shelf.keys:  # none fits whole: cut the smallest
                    cut, rest = self.shelf.pop(0).split(gap)
                    window.append(cut)
                    self.shelf.put(rest)
                    gap = 0
                if gap:
                    waiting += window
                else:
                    self.done.append((tier, window))
        for p in waiting:
            self.shelf.put(p)
        self.held = sum(len(p.ids) for p in waiting)

    def finish(self) -> None:
        """Windows of all that is left."""
        self.pack()
        left = [self.shelf.pop(-1) for _ in range(len(self.shelf.keys))]
        total, size = sum(len(p.ids) for p in left), self.window
        while total:
            while size > total and size > LAST:
                size //= 2
            window, gap = [], min(size, total)
            while gap:
                p = left.pop(0)
                if len(p.ids) > gap:
                    p, rest = p.split(gap)
                    left.insert(0, rest)
                window.append(p)
                gap -= len(p.ids)
                total -= len(p.ids)
            n = sum(len(p.ids) for p in window)
            self.done.append((n if n == size else self.window, window))
        self.held = 0


PACKED = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, task int, window long"


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row a piece: the key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset in it,
    tier (length of its window), task and window (its number among the task's windows of that tier, from 0)."""
    docs = spread(docs.select(F.col(key), F.col(text)))
    schema = T.StructType([docs.schema[0], *T.StructType.fromDDL(PACKED).fields])
    bound_batches(docs.sparkSession)

    def run(batches):
        encode, packer = Encoder(tokenizer, ranks, pattern), Packer()
        task, made = TaskContext.get().partitionId(), 0
        base = task << 32
        keys: dict[int, tuple] = {}  # document: key, tokens, pieces' ids still to come
        numbers: dict[int, int] = {}
        n_docs = 0

        def emit():
            nonlocal made
            rows = [[] for _ in range(10)]
            for tier, window in packer.done:
                at, number = 0, numbers.get(tier, 0)
                numbers[tier] = number + 1
                for p in window:
                    k, total, left = keys[p.doc]
                    left -= len(p.ids)
                    keys[p.doc] = (k, total, left)
                    if not left:
                        del keys[p.doc]
                    for column, x in zip(rows, (k, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), total, base | made, at, tier, task, number), strict=True):
                        column.append(x)
                    at += len(p.ids)
                made += 1
            packer.done = []
            types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t or key_type) for c, t in zip(rows, types, strict=True)], names=schema.names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in parts(batch):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(t or ""), np.uint32(END_ID)).astype(np.uint32)
                    keys[n_docs] = (k, len(ids), len(ids))
                    packer.add(Piece(n_docs, ids, 0))
                    n_docs += 1
                    if packer.held >= ROUND:
                        packer.pack()
                if packer.done:
                    yield emit()
        packer.finish()
        if packer.done:
            yield emit()

    return docs.mapInArrow(run, schema)


def balance_steps(pieces: DataFrame) -> DataFrame:
    """pieces (from pack, checkpointed, as they are read twice) with step long instead of task and window: the number of the
    step among those of its tier."""
    counts = pieces.groupBy("tier", "task").agg((F.max("window") + 1).alias("_windows"))  # a row a task and tier
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("tier", "task", F.coalesce(F.sum("_windows").over(before), F.lit(0)).alias("_first"))
    room = F.greatest(F.lit(1), F.floor(F.lit(STEP_TOKENS) / F.col("tier")))
    out = pieces.join(first, ["tier", "task"])
    return out.withColumn("step", F.floor((F.col("_first") + F.col("window")) / room).cast("long")).drop("_first", "task", "window")


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    narrow = out.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "task", "window")
    return balance_steps(cut(narrow, compact=True)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")
