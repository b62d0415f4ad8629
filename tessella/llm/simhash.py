"""SimHash near-deduplication by a self-join of a binary trie.

Fingerprints are 64-bit majorities over shingle hashes. Two of them link at few differing bits. The bits are cut into
`budget + 2` blocks, and each distinct fingerprint goes, once for each pair of blocks, into the trie that starts with
those two: of any linked pair at least two blocks are equal, so each pair's tries can be joined with themselves apart
from each other. A trie is never built: sorted fingerprints are its leaves, a node is a range of them. The join walks pairs of nodes together,
adds up differing bits, and drops a pair once the error budget is exceeded.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, drop_staged, inner, located, map_texts, restored, slim, staged
from tessella.llm.components import components

SEED = 42


def fingerprint(text: str, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; zero without words."""
    found = text.encode().lower().split()  # bytes.lower() touches A-Z only, bytes.split() splits at ASCII white space
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(found) > words else ends[-1:]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(ids: list, texts: list[str]) -> dict[str, list]:
        fps = np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)
        return {"doc_id": ids, "fp": fps}

    return map_texts(slim(df, id_col, text_col), run, f"doc_id {kind}, fp long")


def settle(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of each node's component, n nodes, links a-b; label: a settlement to go on from."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, la, lb)
        np.minimum.at(label, lb, la)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_links(leaves: np.ndarray, roots: list[tuple[int, int, int, int, int]], top: int, budget: int, most: int = 1 << 19) -> np.ndarray:
    """Settle the components of leaves (uint64) under links of at most `budget` differing bits.

    roots: pairs of nodes to begin with, as ranges (a_lo, a_hi, b_lo, b_hi) of leaves sorted within a node, and the
    bits by which they differ above `top`, the first bit below the roots. A pair is expanded into pairs of
    children; pairs over budget are dropped, so are pairs that lie in one component already. Pairs of small nodes
    are compared leaf by leaf. `most` bounds the pairs held at once: the walk goes depth first in portions.
    """
    n = len(leaves)
    label, pending, held = np.arange(n), [], 0
    ones: dict[int, np.ndarray] = {}

    def below(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((leaves >> np.uint64(bit)) & np.uint64(1)))).astype(np.int32)
        return ones[bit]

    def flush() -> None:
        nonlocal label, pending, held, run_end
        if pending:
            a, b = (np.concatenate(x) for x in zip(*pending, strict=True))
            label = settle(n, a, b, label)
            pending, held = [], 0
            run_end = _run_ends(label)

    run_end = _run_ends(label)
    stack = [(top, np.array(roots, np.int64).reshape(-1, 5).T)] if len(roots) else []
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > most:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
            continue
        alo, ahi, blo, bhi, err = pairs
        one = (run_end[alo] >= ahi) & (run_end[blo] >= bhi) & (label[alo] == label[blo])
        whole = ~one & (err + bit + 1 <= budget)
        if whole.any():  # whatever differs below is within the budget: link all to the first leaf, not each to each
            for lo, hi, other in zip(np.concatenate((alo[whole], blo[whole])), np.concatenate((ahi[whole], bhi[whole])), np.tile(alo[whole], 2), strict=True):
                pending.append((np.arange(lo, hi), np.full(hi - lo, other)))
                held += hi - lo
        small = ~one & ~whole & (((ahi - alo) * (bhi - blo) <= 64) | (bit < 0))
        if small.any():
            a, b = _leaf_pairs(*pairs[:4, small])
            near = np.bitwise_count(leaves[a] ^ leaves[b]) <= budget
            pending.append((a[near], b[near]))
            held += int(near.sum())
        if held > most:
            flush()
        pairs = pairs[:, ~one & ~whole & ~small]
        if pairs.shape[1]:
            alo, ahi, blo, bhi, err = pairs
            count = below(bit)
            amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
            own = alo == blo
            made = np.concatenate(
                [
                    np.stack((alo, amid, blo, bmid, err)),
                    np.stack((amid, ahi, bmid, bhi, err)),
                    np.stack((alo, amid, bmid, bhi, err + 1)),
                    np.stack((amid, ahi, blo, bmid, err + 1))[:, ~own],
                ],
                axis=1,
            )
            stack.append((bit - 1, made[:, (made[0] < made[1]) & (made[2] < made[3]) & (made[4] <= budget)]))
    flush()
    return label


def _run_ends(label: np.ndarray) -> np.ndarray:
    """For each place, the end of the run of equal labels that it lies in."""
    n = len(label)
    ends = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, n) if n else np.zeros(0, np.int64)
    return ends[np.searchsorted(ends, np.arange(n), side="right")] if n else ends


def _leaf_pairs(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    of = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    a, b = alo[of] + k // nb[of], blo[of] + k % nb[of]
    return a[a != b], b[a != b]


def _block_links(widest: int, budget: int, portion: int = 100_000):
    """mapInArrow function: rows (r, block, lo, hi, bits, rot, fp), sorted by all of these; gives (a, b) of forests."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys: np.ndarray, rot: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        leaves = rot.view(np.uint64)
        cut = np.append(np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(rot))
        shared = np.flatnonzero(np.diff(cut) > 1)  # most tries have one leaf
        begin, end = cut[shared], cut[shared + 1]
        for bits in np.unique(keys[begin, 4]).tolist():
            roots = []
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                if keys[lo, 4] != bits:
                    continue
                child_a, child_b = int(keys[lo, 2]), int(keys[lo, 3])
                if child_a == child_b:
                    roots.append((lo, hi, lo, hi, 0))
                    continue
                child = (leaves[lo:hi] >> np.uint64(64 - widest - bits)) & np.uint64((1 << bits) - 1)
                mid = lo + int((child == child_a).sum())
                if lo < mid < hi:
                    roots.append((lo, mid, mid, hi, (child_a ^ child_b).bit_count()))
            label = trie_links(leaves, roots, 63 - widest - bits, budget)
            moved = np.flatnonzero(label != np.arange(len(label)))
            for at in range(0, len(moved), 10_000):
                some = moved[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(fp[label[some]])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            n += batch.num_rows
            if n < portion:
                continue
            rows = np.concatenate(held)
            last = rows[-1, :5]
            whole = int(np.flatnonzero((rows[:, :5] != last).any(1))[-1]) + 1 if (rows[:, :5] != last).any() else 0
            if whole:
                yield from links(rows[:whole, :5], np.ascontiguousarray(rows[:whole, 5]), np.ascontiguousarray(rows[:whole, 6]))
            held, n = [rows[whole:]], len(rows) - whole
        if n:
            rows = np.concatenate(held)
            yield from links(rows[:, :5], np.ascontiguousarray(rows[:, 5]), np.ascontiguousarray(rows[:, 6]))

    return run


def near_components(fps: DataFrame, budget: int = 4, largest: int = 50_000) -> DataFrame:
    """(fp, root) for each distinct fp that links with another: the components under `budget` differing bits.

    The 64 bits are cut into budget + 2 blocks, of which a linked pair has two equal: 15 tries of 20 leading bits for
    a budget of 4, so 5 billion fingerprints make tries of 5000 leaves, and the copies of a fingerprint do not grow
    with the table. Only a trie of over `largest` leaves (fingerprints that crowd together) is split further: its
    fingerprints go, by their next few bits, to one task for each child node within the budget, so that no task holds
    more than about two such children, whatever the size of a group.
    """
    count = budget + 2
    width = 64 // count
    lows = [64 - width * (k + 1) for k in range(count)]
    distinct = fps.select("fp").distinct()

    def first(i: int, j: int) -> Column:
        """The bits of fp with blocks i and j in front."""
        fields = [(lows[i], width), (lows[j], width), *((lows[k], width) for k in range(count) if k not in (i, j)), (0, 64 - width * count)]
        out, at = F.lit(0).cast("long"), 64
        for low, bits in fields:
            at -= bits
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1), at))
        return out

    pairs = list(itertools.combinations(range(count), 2))
    lead = 2 * width
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), first(i, j).alias("rot")) for r, (i, j) in enumerate(pairs)])).alias("x"))
    keyed = staged(keyed.select("fp", F.col("x.r").alias("r"), F.col("x.rot").alias("rot"), F.shiftrightunsigned("x.rot", 64 - lead).alias("block")), "tries")
    bits = F.least(F.lit(12), F.greatest(F.lit(1), F.length(F.bin(F.floor(F.col("count") / largest))))).alias("bits")
    split = staged(keyed.groupBy("r", "block").count().filter(F.col("count") > largest).select("r", "block", bits), "crowded")
    if not split.isEmpty():
        rows = keyed.join(split, ["r", "block"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
        child = F.expr(f"shiftrightunsigned(rot, {64 - lead} - bits) & (shiftleft(1L, bits) - 1)")
        masks = F.expr(f"filter(sequence(0L, shiftleft(1L, bits) - 1), m -> bit_count(m) <= {budget})")
        rows = rows.withColumn("child", child).withColumn("mask", F.explode(masks)).withColumn("other", F.col("child").bitwiseXOR(F.col("mask")))
        rows = rows.select("r", "block", F.least("child", "other").alias("lo"), F.greatest("child", "other").alias("hi"), "bits", "rot", "fp")
    else:
        rows = keyed.select("r", "block", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("bits"), "rot", "fp")
    parted = rows.repartition("r", "block", "lo", "hi").sortWithinPartitions("r", "block", "lo", "hi", "bits", "rot")
    edges = staged(parted.mapInArrow(_block_links(lead, budget), "a long, b long"), "links")
    found = components(edges)
    drop_staged(keyed, edges, split)
    return found.select(F.col("node").alias("fp"), F.col("root"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, budget: int = 4, largest: int = 50_000) -> DataFrame:
    """One row a row of df: doc_id, fp (signed long), component_id, the smallest id that can be reached.

    A null text counts as empty; texts without words have fingerprint zero and link like any other. Repeated rows
    and equal fingerprints meet as one fingerprint. A null id takes part but is never a component's id, unless
    the component has no other. An empty table gives no rows. Very long texts are read whole, 65,536 shingles at a time.
    """
    fps = staged(fingerprints(df, id_col, text_col, words), "fingerprints")
    return _with_components(fps, budget, largest)


def _with_components(fps: DataFrame, budget: int, largest: int) -> DataFrame:
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = near_components(fps, budget, largest)
    named = groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(ids, "root").select("fp", "component_id"), "fp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, budget: int = 4) -> DataFrame:
    """df with one row of each group of near copies: the one with the smallest id, the first of repeated rows.

    Null and empty texts are one group; null ids come last; an empty table stays empty; all columns stay.
    """

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x or "", words) for x in texts], np.uint64).view(np.int64))

    rows = located(df)
    fps = staged(rows.select(inner(df, id_col).alias("doc_id"), "__file", "__row", fp(inner(df, text_col).cast("string")).alias("fp")), "fingerprints")
    roots = near_components(fps, budget)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__file", "__row"))
    groups = fps.groupBy("fp").agg(best.alias("best"))
    named = groups.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    stay = named.select("best.__file", "best.__row")
    return restored(rows.join(stay, ["__file", "__row"], "left_semi"), df)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
