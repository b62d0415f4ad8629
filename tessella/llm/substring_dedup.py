"""Substring deduplication by repeated-phrase automata.

Of every stretch of `window` words, the phrase of `phrase` words with the least hash is an anchor, so texts that share
a window share an anchor. An anchor that occurs in two texts is a recurring phrase. Its words are taken from one
document that has it, and go to all others that do. A shard of documents compiles the phrases it is
given into one Aho-Corasick automaton over word numbers and streams its documents through it: that alone tells where
the phrases stand. The windows around an occurrence are candidates; those that a document with a smaller id has too are
confirmed, and their words are removed.

Documents with the same words are collapsed first: they share one set of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import documents, drop_staged, pieces, slim, staged

#: Odd multipliers of two polynomial hashes modulo 2**64.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of `size` words: a polynomial by doubling, then mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, level, width, power = None, 0, hashes, 1, int(base)
    left = size
    while True:
        if left & 1:
            part = level[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += width
        left >>= 1
        if not left:
            break
        level = level[:-width] * np.uint64(power) + level[width:]
        width, power = 2 * width, power * power % (1 << 64)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def _extreme(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """best over each run of `size` values, by doubling."""
    width, out = 1, values
    while 2 * width <= size:
        out, width = best(out[:-width], out[width:]), 2 * width
    return best(out[: len(out) - (size - width)], out[size - width :]) if size > width else out


def anchors(hashes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Places of the phrases that are the least of some window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    grams = run_hashes(hashes, phrase, BASES[0])
    span = window - phrase + 1
    least = _extreme(grams, span, np.minimum)
    top = np.uint64(0)
    padded = np.concatenate((np.full(span - 1, top), least, np.full(span - 1, top)))
    return np.flatnonzero(_extreme(padded, span, np.maximum) == grams)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _first_pass(window: int, phrase: int, kind: pa.DataType):
    schema = pa.schema(
        [("oid", kind), ("key", pa.binary()), ("k1", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("z", pa.binary()), ("anchors", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for some in pieces(batches):
            key, first, sha, n, z, found = [], [], [], [], [], []
            for text in some.column(1).to_pylist():
                words = (text or "").encode().split()
                joined = b" ".join(words)
                digest = hashlib.sha256(joined).digest()
                key.append(digest[:16])
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                sha.append(digest)
                n.append(len(words))
                z.append(packer.compress(joined))
                if len(words) < window:
                    found.append([])
                else:
                    hashes = word_hashes(words)
                    found.append(np.unique(_signed(run_hashes(hashes, phrase, BASES[0])[anchors(hashes, window, phrase)])))
            columns = (some.column(0), key, first, sha, n, z, found)
            yield pa.RecordBatch.from_arrays([c if k == 0 else pa.array(c, type=schema[k].type) for k, c in enumerate(columns)], schema=schema)

    return run


def _phrase_words(phrase: int):
    schema = pa.schema([("a", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for some in pieces(batches):
            hashes, phrases = [], []
            for z, owned in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                words = opener.decompress(z).split()
                grams = _signed(run_hashes(word_hashes(words), phrase, BASES[0]))
                at = np.flatnonzero(np.isin(grams, np.array(owned, np.int64)))
                at = at[np.unique(grams[at], return_index=True)[1]]
                hashes += grams[at].tolist()
                phrases += [b" ".join(words[p : p + phrase]) for p in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(phrases, pa.binary())], schema=schema)

    return run


def locate(shard: list[list[bytes]], phrases: Iterable[bytes]) -> list[np.ndarray]:
    """Compile phrases (words joined by blanks) into one automaton and stream the shard's documents through it.

    Gives for each document the places of the first words of all occurrences of all phrases.
    """
    import ahocorasick

    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for words in map(bytes.split, phrases):
        automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words]), len(words))
    if not len(automaton):
        return [np.zeros(0, np.int64) for _ in shard]
    automaton.make_automaton()
    found = []
    for words in shard:
        hits = np.array(list(automaton.iter(tuple([numbers.get(w, 0) for w in words]))), np.int64).reshape(-1, 2)
        found.append(hits[:, 0] - hits[:, 1] + 1)
    return found


def _candidates(window: int, phrase: int, kind: pa.DataType):
    schema = pa.schema(
        [("k1", pa.int64()), ("oid", kind), ("z", pa.binary()), ("p", pa.list_(pa.int32())), ("w", pa.list_(pa.int64())), ("v", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for some in pieces(batches, 512, 1 << 22):
            columns = dict(zip(some.schema.names, some.columns, strict=True))
            shard = [opener.decompress(z).split() for z in columns["z"].to_pylist()]
            phrases = {x for given in columns["phrases"].to_pylist() for x in given}
            places, first, second = [], [], []
            for words, starts in zip(shard, locate(shard, phrases), strict=True):
                n = len(words) - window + 1
                lo, hi = np.maximum(starts + phrase - window, 0), np.minimum(starts + 1, n)
                edges = np.zeros(n + 1, np.int64)
                ok = lo < hi
                np.add.at(edges, lo[ok], 1)
                np.add.at(edges, hi[ok], -1)
                near = np.flatnonzero(np.cumsum(edges[:n]) > 0)
                hashes = word_hashes(words)
                places.append(near.astype(np.int32))
                first.append(_signed(run_hashes(hashes, window, BASES[0]))[near])
                second.append((run_hashes(hashes, window, BASES[1])[near] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            kept = [columns[c] for c in ("k1", "oid", "z")]
            lists = [pa.array(x, type=schema.field(c).type) for c, x in (("p", places), ("w", first), ("v", second))]
            yield pa.RecordBatch.from_arrays([*kept, *lists], schema=schema)

    return run


def _removal(window: int, kind: pa.DataType):
    schema = pa.schema([("k1", pa.int64()), ("oid", kind), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for some in pieces(batches, 128, 1 << 21):
            removed, digests, texts = [], [], []
            for z, gone in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                words = opener.decompress(z).split()
                edges = np.zeros(len(words) + 1, np.int64)
                at = np.array(gone, np.int64)
                edges[at] += 1
                edges[at + window] -= 1  # places differ
                stay = np.cumsum(edges[:-1]) == 0
                kept = b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])
                removed.append(int((~stay).sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            made = [pa.array(x, type=t) for x, t in ((removed, pa.int64()), (digests, pa.string()), (texts, pa.string()))]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made], schema=schema)

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50, phrase: int = 8, texts: bool = False) -> DataFrame:
    """One row a row of df: doc_id, n_words, n_removed, kept_sha256; with texts also kept_text, its words joined by blanks.

    A word goes when a window of `window` words that covers it also starts in a document with a smaller id, in the
    input as it came. Ids are of any type that has an order, and keep it. A null text has no words. A null id is later
    than all ids, and rows that repeat an id are no earlier documents to each other. Texts shorter than a window lose
    nothing; very long ones are read whole. An empty table gives no rows. Phrases are located by their words, windows
    are compared by 96 bits of hash, whole texts by 128.
    """
    table = slim(df, id_col, text_col)
    ddl = df.schema[id_col].dataType.simpleString()
    kind = to_arrow_type(df.schema[id_col].dataType)
    first = f"oid {ddl}, key binary, k1 long, sha binary, n long, z binary, anchors array<long>"
    rows = staged(table.mapInArrow(_first_pass(window, phrase, kind), first), "words")

    def same(a: DataFrame, b: DataFrame, key: str) -> Column:
        return (a[key] == b[key]) & a["oid"].eqNullSafe(b["oid"])

    groups = rows.groupBy("key").agg(F.min("oid").alias("oid"))
    # any row of a group has its words; the one whose id is least speaks for it
    spoken = rows.filter(F.size("anchors") > 0).select("key", "k1", "oid", "anchors")
    single = spoken.join(groups, same(spoken, groups, "key"), "left_semi").dropDuplicates(["key"])
    phrases = staged(single.select("key", "oid", F.explode("anchors").alias("a")), "phrases")
    # staged tables on both sides of a join let frequent keys be split (AQE does not split below an aggregation)
    recurring = staged(phrases.groupBy("a").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("owner")).filter("times > 1").select("a", "owner"), "recurring")
    owned = recurring.groupBy(F.col("owner").alias("key")).agg(F.collect_list("a").alias("owned"))
    speakers = rows.filter(F.size("anchors") > 0).select("key", "k1", "oid", "z")
    known = groups.join(owned, "key")
    sources = speakers.join(known, same(speakers, known, "key")).select(speakers["key"], "z", "owned").dropDuplicates(["key"])
    words = staged(sources.select("z", "owned").mapInArrow(_phrase_words(phrase), "a long, words binary"), "phrase-words")
    wanted = phrases.join(words, "a").groupBy("key", "oid").agg(F.collect_list("words").alias("phrases"))
    bodies = speakers.join(wanted, same(speakers, wanted, "key")).select(speakers["key"], "k1", speakers["oid"], "z", "phrases").dropDuplicates(["key"])
    found = f"k1 long, oid {ddl}, z binary, p array<int>, w array<long>, v array<int>"
    found = staged(bodies.select("k1", "oid", "z", "phrases").mapInArrow(_candidates(window, phrase, kind), found), "candidates")
    drop_staged(phrases, recurring, words)
    each = found.select("k1", "oid", F.explode(F.arrays_zip("p", "w", "v")).alias("x")).select("k1", "oid", "x.p", "x.w", "x.v")
    earliest = each.groupBy("w", "v").agg(F.min("oid").alias("lo"), F.count(F.lit(1)).alias("times")).filter("times > 1 AND lo IS NOT NULL")
    earliest = staged(earliest.select("w", "v", "lo"), "earliest")
    later = each.join(earliest, ["w", "v"]).filter("oid > lo OR oid IS NULL").groupBy("k1", "oid").agg(F.collect_list("p").alias("gone"))
    bodies = found.select("k1", "oid", "z")
    removal = f"k1 long, oid {ddl}, n_removed long, kept_sha256 string, kept_text string"
    changed = bodies.join(later, same(bodies, later, "k1")).select(bodies["k1"], bodies["oid"], "z", "gone").mapInArrow(_removal(window, kind), removal)
    changed = staged(changed if texts else changed.drop("kept_text"), "changed")
    drop_staged(found, earliest)
    groups = rows.groupBy("key", "k1").agg(F.min("oid").alias("oid"))
    by_words = groups.join(changed, same(groups, changed, "k1"), "left").select("key", groups["oid"].alias("first_oid"), *[changed[c] for c in changed.columns[2:]])
    out = rows.select("oid", "key", "sha", "n", *(["z"] if texts else [])).join(by_words, "key")
    copy = F.coalesce(F.col("oid") > F.col("first_oid"), F.col("oid").isNull() & F.col("first_oid").isNotNull()) & (F.col("n") >= window)
    columns = [
        F.col("oid").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ]
    if not texts:
        return out.select(*columns)
    opened = F.udf(lambda z: zstandard.ZstdDecompressor().decompress(z).decode(), "string", useArrow=True)
    return out.select(*columns, F.when(copy, F.lit("")).otherwise(F.coalesce("kept_text", opened("z"))).alias("kept_text"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
