"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. Whole windows of a long document go out at once; its tail goes
into the open window that it fills best. When none has room, the fullest is topped up with the tail's first ids and
goes out; the rest opens a new window. What is still open at the end of a partition is merged with the leftovers of
a fixed number of other partitions; the last window of each such group is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, pieces, slim, staged

END = "<|endoftext|>"
PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteEncoder:
    """Ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit numbers, equal to those of the tokenizers library.

    tiktoken refuses white space of over a million characters in a row; such a text goes through that library itself.
    """

    def __init__(self, ranks_path: str, pattern: str, end_id: int, library_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END: end_id})
        self.library_path, self.library = library_path, None

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return self._by_library(text)

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.library_path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Packer:
    """Pieces come in by add(), rows of finished windows come out."""

    def __init__(self, base: int, size: int = 1024, windows: int = 16):
        self.base, self.size, self.windows, self.made = base, size, windows, 0
        self.open: list[list] = []  # [fill, [(doc, start, ids, doc_tokens)]]

    def _emit(self, content: list[tuple]) -> Iterator[tuple]:
        at, sequence = 0, self.base + self.made
        self.made += 1
        for doc, start, ids, total in content:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, sequence, at
            at += n

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        size, n, at = self.size, len(ids) // 4, 0
        while n - at >= size:
            yield from self._emit([(doc, start + at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        tail = n - at
        if not tail:
            return
        rest = ids[4 * at :]
        fits = [w for w in self.open if size - w[0] >= tail]
        if not fits and len(self.open) >= self.windows:
            fullest = max(self.open, key=lambda w: w[0])
            room = size - fullest[0]
            fullest[1].append((doc, start + at, rest[: 4 * room], total))
            self.open.remove(fullest)
            yield from self._emit(fullest[1])
            at, rest, tail = at + room, rest[4 * room :], tail - room
            fits = []
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            best = [0, []]
            self.open.append(best)
        best[0] += tail
        best[1].append((doc, start + at, rest, total))
        if best[0] == size:
            self.open.remove(best)
            yield from self._emit(best[1])

    def leftovers(self) -> Iterator[tuple]:
        """Contents of the open windows, fullest first."""
        for _, content in sorted(self.open, key=lambda w: -w[0]):
            yield from content
        self.open = []

    def finish(self) -> Iterator[tuple]:
        """Chain the open windows, cut them into whole ones, and the last into powers of two."""
        content = list(self.leftovers())
        while content:
            total = sum(len(c[2]) // 4 for c in content)
            take = self.size if total >= self.size else 1 << (total.bit_length() - 1)
            now, later, room = [], [], take
            for doc, start, ids, total_ids in content:
                n = min(room, len(ids) // 4)
                if n:
                    now.append((doc, start, ids[: 4 * n], total_ids))
                if 4 * n < len(ids):
                    later.append((doc, start + n, ids[4 * n :], total_ids))
                room -= n
            yield from self._emit(now)
            content = later


def pack(
    df: DataFrame,
    encoder: Callable[[], Callable[[str], bytes]],
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    end_id: int = 0,
    size: int = 1024,
    windows: int = 16,
    merged: int = 64,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    encoder() is called once a task and gives the function from text to little-endian 32-bit ids; end_id closes
    every document. A null text is the empty text, so its document is the end id alone; null ids and repeated rows
    are packed like others. An empty table gives no rows. A partition holds `windows` open windows at most, and a
    merging task the leftovers of `merged` partitions: windows * merged * size ids, whatever the input's size.
    """
    kind = df.schema[id_col].dataType.simpleString()
    first_schema = PIECE.format(kind=kind) + ", part long, ids binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, last_arrow = (to_arrow_schema(StructType.fromDDL(x)) for x in (first_schema, PIECE.format(kind=kind)))
    end = end_id.to_bytes(4, "little")

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer = encoder(), Packer(part << 32, size, windows)
        for some in pieces(batches):
            rows: list[tuple] = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                rows += [(*r, part, None) for r in packer.add(doc, 0, ids, len(ids) // 4)]
            yield batch(rows, arrow)
        left = [(doc, start, len(ids) // 4, 0, total, k, 0, part, ids) for k, (doc, start, ids, total) in enumerate(packer.leftovers())]
        if left:
            yield batch(left, arrow)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for some in batches:
            rows: list[tuple] = []
            for doc, start, total, ids, now in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if now != group:
                    rows += packer.finish() if packer else []
                    group, packer = now, Packer((1 << 62) + (now << 32), size, windows)
                rows += packer.add(doc, start, ids, total)
            yield batch(rows, last_arrow)
        if packer:
            yield batch(list(packer.finish()), last_arrow)

    made = staged(slim(df, id_col, text_col).mapInArrow(run, first_schema), "pieces")
    left = made.filter("ids IS NOT NULL").select("doc_id", "start", "doc_tokens", "ids", F.floor(F.col("part") / merged).alias("g"), "part", "sequence_id")
    left = left.repartition("g").sortWithinPartitions("g", "part", "sequence_id").select("doc_id", "start", "doc_tokens", "ids", "g")
    return made.filter("ids IS NULL").drop("part", "ids").union(left.mapInArrow(merge, PIECE.format(kind=kind)))


def byte_encoder() -> ByteEncoder:
    import public_tokenizers

    return ByteEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256, public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), byte_encoder)
