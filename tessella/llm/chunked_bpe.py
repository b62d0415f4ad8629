"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over a document's bytes picks some of its blanks as chunk ends, so that a passage that many documents
share is cut alike in all of them. Chunks are counted over the whole table by their digests. Each that occurs twice or
more is encoded once, in the document of least place that has it, and its ids go to all others by a join; a chunk
that occurs once is encoded where it stands. Documents are put together from their chunks. At each joint the words on
both sides are encoded together; if that does not give the ids of its two halves, a growing window around the joint is
encoded again until two windows in a row give exactly the same ids, or until it holds both chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, inner, located, pieces, staged
from tessella.llm.units import Cache

#: Fixed random multipliers of the rolling hash, one a byte value.
GEAR = np.random.default_rng(20240917).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, bits: int = 7) -> np.ndarray:
    """Places of the blanks that end a chunk: those where the hash of the 16 bytes before has `bits` zero bits."""
    codes = np.frombuffer(data, np.uint8)
    h = GEAR[codes]
    for shift in (1, 2, 4, 8):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return np.flatnonzero((codes == 32) & (h >> np.uint32(32 - bits) == 0))


def chunks(data: bytes, bits: int = 7, blanks_apart: bool = True) -> list[bytes]:
    """data cut at its chunk ends. The blank at a cut belongs to no chunk where the tokenizer drops it, else to the next one."""
    out, at = [], 0
    for end in chunk_ends(data, bits).tolist():
        out.append(data[at:end])
        at = end + blanks_apart
    return [*out, data[at:]]


class ChunkEncoder:
    """ids and decoded text of whole texts, exactly as the tokenizer gives them.

    words_apart says that the tokenizer drops white space and never joins across it; then the inside of a chunk is
    put together from single words, which are remembered. Joints are checked either way.
    """

    def __init__(self, path: str, *, words_apart: bool = True, bits: int = 7, words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words_apart, self.bits = words_apart, bits
        self.model = self.tokenizer.model
        steps = str(self.tokenizer.normalizer) + str(self.tokenizer.pre_tokenizer)
        self.lower_only = words_apart and "Lowercase()" in steps and "ByteLevel(" in steps and "[\\p{L}]+" in steps.replace("\\\\", "\\")
        self.words = Cache(self._plain, words)
        self.joints = Cache(self._joint, words // 8)
        self.repairs = 0
        self.tokens = None

    def _ids(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32).tobytes()

    def _plain(self, word: bytes) -> bytes:
        """Ids of one word; the model alone is asked where the steps before it can only lower-case a run of letters."""
        body = word[:-1] if word[-1:] in (b".", b",") else word
        if self.lower_only and body.isalpha():  # bytes.isalpha() is true of ASCII letters only
            ids = [x.id for x in self.model.tokenize(body.decode().lower())]
            if body is not word:
                ids += [x.id for x in self.model.tokenize(word[-1:].decode())]
            return np.array(ids, np.uint32).tobytes()
        return self._ids(word)

    def _joint(self, both: bytes) -> bool:
        """Do the ends of two neighbouring chunks, kept apart by a zero byte, give the same ids together as apart?"""
        left, _, right = both.rpartition(b"\0")
        return self._ids(self._glue(left, right)) == self._ids(left) + self._ids(right)

    def _glue(self, left: bytes, right: bytes) -> bytes:
        return left + b" " + right if self.words_apart else left + right

    def _ends(self, left: bytes, right: bytes) -> bytes:
        """The last word of left and the first of right, with a zero byte between them; white space that counts goes along."""
        if self.words_apart:
            start = max(left.rfind(b" "), left.rfind(b"\n")) + 1
            ends = [x for x in (right.find(b" "), right.find(b"\n")) if x >= 0]
            return left[start:] + b"\0" + (right[: min(ends)] if ends else right)
        left, right = left.decode(), right.decode()  # any white space of Unicode counts
        tail, head = left.rstrip(), right.lstrip()
        first = head.split(None, 1)[0] if head else head
        words = tail.rsplit(None, 1)
        both = left[len(tail) - len(words[-1]) :] if words else left, right[: len(right) - len(head) + len(first)]
        return both[0].encode() + b"\0" + both[1].encode()

    def _has_word(self, part: bytes) -> bool:
        return bool(part.strip() if self.words_apart else part.decode().strip())

    def chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk, as little-endian unsigned 32-bit numbers."""
        if self.words_apart:
            words = self.words
            return b"".join([words[w] for w in chunk.replace(b"\n", b" ").split(b" ")])
        return self._ids(chunk)

    def _repaired(self, left: bytes, a: bytes, right: bytes, b: bytes) -> bytes:
        """Ids of left and right joined, from ids a of left and b of right.

        A window reaches from a single blank between words to another one. It counts only if its parts left and right
        of the joint have, encoded apart, the ids that a ends and b begins with, so that replacing these touches
        nothing else. The widest window is all of both.
        """
        self.repairs += 1
        reach, before = 32, None
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            while i and not self._between_words(left, i):
                i -= 1
            while j < len(right) and not self._between_words(right, j):
                j += 1
            window = self._ids(self._glue(left[i:], right[:j]))
            if i == 0 and j == len(right):
                return window
            ids_tail, ids_head = self._ids(left[i:]), self._ids(right[:j])
            if a.endswith(ids_tail) and b.startswith(ids_head):
                now = a[: len(a) - len(ids_tail)] + window + b[len(ids_head) :]
                if now == before:
                    return now
                before = now
            reach *= 2

    @staticmethod
    def _between_words(text: bytes, at: int) -> bool:
        return text[at : at + 1] == b" " and 32 < text[at - 1] < 127 and 32 < (text[at + 1 : at + 2] or b" ")[0] < 127

    def encode(self, text: str) -> np.ndarray:
        return self.join(self.cut(text.encode()))

    def cut(self, data: bytes) -> list[bytes]:
        return chunks(data, self.bits, self.words_apart)

    def join(self, parts: list[bytes], known: dict[int, bytes] | None = None) -> np.ndarray:
        """ids of a text from its chunks; known: ids of some of them, by their number."""
        known = known or {}
        done, last, ids = [], parts[0], known[0] if 0 in known else self.chunk(parts[0])
        for k, part in enumerate(parts[1:], 1):
            own = known[k] if k in known else self.chunk(part)
            full = self._has_word(last) and self._has_word(part)
            if self.words_apart and not full:  # nothing meets here
                ids += own
                last = last if self._has_word(last) else part
            elif full and b"\0" not in part and self.joints[self._ends(last, part)]:
                done.append(ids)
                last, ids = part, own
            else:  # the two are one chunk from here on
                last, ids = self._glue(last, part), self._repaired(last, ids, part, own)
        return np.frombuffer(b"".join([*done, ids]), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """tokenizer.decode(ids, skip_special_tokens=False); tokens are joined by blanks where it has no decoder."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(self.pieces()[ids].tolist())

    def pieces(self) -> np.ndarray:
        if self.tokens is None:
            self.tokens = np.array([self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())], dtype=object)
            self.numbers = np.array([str(i) for i in range(len(self.tokens))], dtype=object)
        return self.tokens


def _in_arrow(function: Callable[..., Iterator[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that turns a row, given as its values, into rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches):
            rows = [made for row in zip(*(c.to_pylist() for c in some.columns), strict=True) for made in function(*row)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


def encode_decode(df: DataFrame, encoder: Callable[[], ChunkEncoder], id_col: str = "doc_id", text_col: str = "text", *, contents: bool = False) -> DataFrame:
    """One row a row of df: doc_id, n_tokens, ids_sha256, decoded_sha256, n_shared_bytes; with contents also ids and decoded.

    n_shared_bytes: bytes in chunks that occur twice or more in the table; these are encoded once for all. A null text
    counts as empty and has no tokens. Null ids and repeated rows are encoded like others; an empty table gives no
    rows. Very long texts are encoded whole, by their chunks. Chunks are equal if 128 bits of hash are. What a worker
    remembers of words has a fixed number of entries of bounded length; a chunk's ids travel with the documents that
    have it, so memory does not grow with the input.
    """
    kind = df.schema[id_col].dataType.simpleString()
    held: list[ChunkEncoder] = []

    def coder() -> ChunkEncoder:
        if not held:
            held.append(encoder())
            held[0].pieces()
        return held[0]

    def keys_of(file, row, text):
        yield file, row, [xxhash.xxh3_128_digest(x) for x in coder().cut((text or "").encode())]

    def packed(doc_id, file, row, text):
        yield doc_id, file, row, zstandard.compress((text or "").encode(), 3)

    def encode_owned(z, owned):
        own, wanted = coder(), set(owned)
        for part in own.cut(zstandard.decompress(z)):
            key = xxhash.xxh3_128_digest(part)
            if key in wanted:
                wanted.discard(key)
                yield key, own.chunk(part)

    def put_together(doc_id, z, shared):
        own = coder()
        parts, known = own.cut(zstandard.decompress(z)), {x["k"]: x["ids"] for x in shared or ()}
        ids = own.join(parts, known)
        decoded = own.decode(ids)
        n_shared = sum(len(parts[k]) for k in known)
        row = doc_id, len(ids), hashlib.sha256(" ".join(own.numbers[ids].tolist()).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), n_shared
        yield row + ((ids.tolist(), decoded) if contents else ())

    # a row's place as two numbers: the hash of its file and row, and the row
    place, at = ["at", "__row"], F.xxhash64("__file", "__row").alias("at")
    rows, text = located(df), inner(df, text_col).cast("string").alias("text")
    cut = "at long, __row long, keys array<binary>"
    keys = staged(rows.select(at, "__row", text).mapInArrow(_in_arrow(keys_of, cut), cut), "keys")
    each = keys.select(*place, F.posexplode("keys").alias("k", "key"))
    # the hash alone keeps the count a hash aggregation; equal hashes of two rows give two owners of one chunk
    repeated = each.select("key", "at").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).filter("n > 1")
    owned = repeated.groupBy("at").agg(F.collect_list("key").alias("owned"))
    bodies = f"doc_id {kind}, at long, __row long, z binary"
    small = rows.select(inner(df, id_col).alias("doc_id"), at, "__row", text).mapInArrow(_in_arrow(packed, bodies), bodies)
    once = small.select("at", "z").join(owned, "at").select("z", "owned").mapInArrow(_in_arrow(encode_owned, "key binary, ids binary"), "key binary, ids binary")
    # staged, so that the join of a chunk that very many documents share can be split; two owners of one chunk do no harm
    encoded = staged(once, "encoded")
    shared = each.join(encoded, "key").groupBy(*place).agg(F.collect_list(F.struct("k", "ids")).alias("shared"))
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_shared_bytes long" + ", ids array<long>, decoded string" * contents
    return small.join(shared, place, "left").select("doc_id", "z", "shared").mapInArrow(_in_arrow(put_together, schema), schema)


def word_encoder() -> ChunkEncoder:
    import public_tokenizers

    return ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), word_encoder)
