"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so token labels are derived first: a token of a toxic document is toxic when its word is
far commoner in toxic than in clean documents. The field (states clean and toxic, hashed word and prefix features,
four transitions) is trained on these. For every document, forward-backward gives each token's marginal; the
marginals give the offending offsets and, through a logistic curve fitted on other labelled documents, the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, map_texts, quoted, runs, slim
from tessella.llm.units import Cache

BUCKETS = 1 << 18
_WORD = re.compile(r"[^ \t\n\v\f\r]+")
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>-"


def clean_word(word: str) -> str:
    return word.strip(_EDGE).lower()


def features(word: str) -> tuple[int, int]:
    """Buckets of the word and of its first six letters."""
    word = clean_word(word)
    return zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(b"^" + word[:6].encode()) % BUCKETS


@dataclass
class Field:
    """weights: of a token's features, for the toxic state. trans[y, z]: from y to z. curve: of the document's score."""

    weights: np.ndarray
    start: float
    trans: np.ndarray
    curve: np.ndarray
    words: frozenset = frozenset()

    def emission(self, word: str) -> float:
        a, b = features(word)
        return float(self.weights[a] + self.weights[b])


def marginals(emission: np.ndarray, first: np.ndarray, start: float, trans: np.ndarray, steps: int = 128, pairs: bool = False):
    """P(toxic) of each token of many documents laid end to end; first marks where documents begin.

    The chain is cut into lanes that are walked at once, each with the product of its transfer matrices; what
    enters a lane is multiplied in afterwards. At a document's first token the matrix forgets what came before.
    pairs: also P(previous, this) as an array [token, 2, 2], zero at first tokens.
    """
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((0, 2, 2))) if pairs else np.zeros(0)
    lanes = -(-n // steps)
    size = lanes * steps
    e = np.exp(np.clip(emission, -30, 30))
    m = np.empty((2, 2, size))
    m[:, :, n:] = np.eye(2)[:, :, None]
    t = np.exp(trans)
    for y in range(2):
        m[y, 0, :n], m[y, 1, :n] = t[y, 0], t[y, 1] * e
        m[y, 0, :n][first], m[y, 1, :n][first] = 1.0, np.exp(start) * e[first]
    m /= m.max((0, 1))
    m = np.ascontiguousarray(m.reshape(2, 2, lanes, steps).transpose(3, 0, 1, 2))

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        for y in range(2):
            for z in range(2):
                out[y, z] = a[y, 0] * b[0, z] + a[y, 1] * b[1, z]
        return out / out.sum((0, 1))

    ahead, behind = np.empty_like(m), np.empty_like(m)
    now = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, lanes)).copy()
    for k in range(steps):
        now = ahead[k] = product(now, m[k])
    now = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, lanes)).copy()
    for k in range(steps - 1, -1, -1):
        behind[k] = now
        now = product(m[k], now)
    enter, leave = np.empty((2, lanes)), np.empty((2, lanes))
    v = np.array([0.5, 0.5])
    for k in range(lanes):
        enter[:, k] = v
        v = v @ ahead[-1, :, :, k]
        v /= v.sum()
    v = np.array([0.5, 0.5])
    for k in range(lanes - 1, -1, -1):
        leave[:, k] = v
        v = now[:, :, k] @ v
        v /= v.sum()
    alpha = enter[0] * ahead[:, 0] + enter[1] * ahead[:, 1]
    beta = behind[:, :, 0] * leave[0] + behind[:, :, 1] * leave[1]
    both = alpha * beta
    flat = lambda x: x.transpose(2, 0, 1).reshape(size, -1)[:n]
    both = flat(both)
    p = both[:, 1] / both.sum(1)
    if not pairs:
        return p
    a = flat(alpha)
    a = np.concatenate((a[:1], a[:-1]))
    joint = a[:, :, None] * m.transpose(3, 0, 1, 2).reshape(size, 2, 2)[:n] * flat(beta)[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    joint[first] = 0
    return p, joint


def toxic_words(texts: list[list[str]], toxic: np.ndarray, share: float = 0.6, chance: float = 0.3) -> frozenset:
    """Words most of whose documents are toxic, and too many of them for chance, given how many words there are."""
    counts = (Counter(), Counter())
    for words, y in zip(texts, toxic.tolist(), strict=True):
        counts[y].update(set(words))
    prior = toxic.mean()
    most = np.log(chance / max(1, len(counts[0].keys() | counts[1].keys())))

    def unlikely(a: int, b: int) -> bool:
        return lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + a * np.log(prior) + b * np.log1p(-prior) < most

    return frozenset(w for w, c in counts[1].items() if w and c >= share * (c + counts[0][w]) and unlikely(c, counts[0][w]))


def without_copies(texts: list[str]) -> list[int]:
    """Indexes of texts that share less than half of their eight least shingle hashes with the texts before."""
    seen: set[int] = set()
    out = []
    for k, text in enumerate(texts):
        words = text.split()
        marks = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:8]
        if 2 * sum(m in seen for m in marks) < len(marks):
            out.append(k)
        seen.update(marks)
    return out


def train(texts: list[str], labels: list[int], *, rounds: int = 40, penalty: float = 0.05, rate: float = 0.4, most_tokens: int = 400_000) -> Field:
    """Fit the field on two thirds of the documents, copies left out, and the score's curve on the rest.

    The chains that are walked have `most_tokens` tokens, so that the driver's memory is bounded. Without both labels
    every score is their mean (near 0 without any).
    """
    single = without_copies(texts)
    texts, y = [texts[k] for k in single], np.array([labels[k] for k in single], np.int64)
    if not len(y) or y.min() == y.max():
        base = 1e-3 if not len(y) else float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return Field(np.zeros(BUCKETS, np.float32), -20.0, np.array([[0.0, -20.0], [0.0, -20.0]]), np.array([np.log(base / (1 - base)), 0, 0]))
    pool: dict[str, str] = {}  # one object a word
    words = [[pool.setdefault(c, c) for c in map(clean_word, _WORD.findall(x))] for x in texts]
    held = np.arange(len(y)) % 3 == 2
    if not (y[~held].any() and y[held].any()):
        held[:] = False
    fit = np.flatnonzero(~held)
    lexicon = toxic_words([words[k] for k in fit], y[fit])
    toxic, clean = fit[y[fit] == 1].tolist(), fit[y[fit] == 0].tolist()
    chain, held_tokens = [], 0
    for k, one in enumerate(toxic):
        for doc in (one, *clean[2 * k : 2 * k + 2]):
            if words[doc] and held_tokens + len(words[doc]) <= most_tokens:
                chain.append(doc)
                held_tokens += len(words[doc])
    if not chain:
        return train([], [])
    tokens = [w for k in chain for w in words[k]]
    first = np.cumsum([0, *(len(words[k]) for k in chain)])[:-1]
    truth = np.array([y[k] == 1 and w in lexicon for k in chain for w in words[k]], np.float64)
    known = {w: features(w) for w in set(tokens)}
    feats = np.array([known[w] for w in tokens], np.int64).reshape(-1, 2)
    del words, tokens, known, pool
    start, trans = -3.0, np.array([[0.0, -3.0], [0.0, -1.0]])
    weights = np.zeros(BUCKETS)
    momentum, square = np.zeros(BUCKETS + 5), np.zeros(BUCKETS + 5)
    prior = np.concatenate(([0.0], truth[:-1]))
    inner = np.ones(len(truth), bool)
    inner[first] = False
    for step in range(1, rounds + 1):
        p, joint = marginals(weights[feats].sum(1), first, start, trans, pairs=True)
        slope = np.zeros(BUCKETS + 5)
        diff = truth - p
        slope[:BUCKETS] = np.bincount(feats.ravel(), np.repeat(diff, 2), BUCKETS) - penalty * weights
        slope[BUCKETS] = diff[first].sum()
        for k, (a, b) in enumerate(((0, 1), (1, 0), (1, 1))):
            seen = ((prior == a) & (truth == b) & inner).sum()
            slope[BUCKETS + 1 + k] = seen - joint[:, a, b].sum()
        momentum = 0.9 * momentum + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = rate * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        weights += move[:BUCKETS]
        start += move[BUCKETS]
        for k, (a, b) in enumerate(((0, 1), (1, 0), (1, 1))):
            trans[a, b] += move[BUCKETS + 1 + k]
    field = Field(weights.astype(np.float32), float(start), trans, np.zeros(3), lexicon)
    which = np.flatnonzero(held) if held.any() else np.arange(len(y))
    evidence = []
    for at in range(0, len(which), 128):
        raw = [_WORD.findall(texts[k]) for k in which[at : at + 128]]
        evidence += [_evidence(p) for p in _by_text(field, raw, field.emission)]
    evidence = np.array(evidence)
    field.curve = _logistic(evidence, y[which])
    return field


def _by_text(field: Field, raw: list[list[str]], emission) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in raw], np.int64)
    at = np.cumsum(np.concatenate(([0], sizes)))
    flat = np.array([emission(w) for x in raw for w in x], np.float64)
    p = marginals(flat, at[:-1][sizes > 0], field.start, field.trans)
    return [p[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _evidence(p: np.ndarray) -> tuple[float, float]:
    """The strongest marginal, and the expected number of toxic tokens on a log scale."""
    return (float(p.max()), float(np.log1p(p.sum()))) if len(p) else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Bias and two weights of a ridge logistic regression, by Newton's steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, longest: int) -> tuple[list[str], list[int]]:
    """At most `most` labelled rows outside the held-out fold, those of least hash; rows over `longest` characters are passed over.

    Held out is every id whose crc32, of the id as text, is divisible by 5. Ids are sampled before texts are read,
    so the broadcast side has `most` rows at most.
    """
    ids = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = df.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).filter(F.length("text") <= longest)
    # an id that repeats gives one text, always the same: at most `most` rows come to the driver
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas()
    found = found.sort_values("doc_id", key=lambda s: [zlib.crc32(str(x).encode()) for x in s])
    return found["text"].tolist(), found["toxic"].astype(int).clip(0, 1).tolist()


def fitted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = 6000, longest: int = 20_000) -> Field:
    """A field trained on a bounded sample of labelled rows: `sample` rows of up to `longest` characters each."""
    return train(*labelled_sample(df, labels, id_col, text_col, sample, longest))


def toxicity(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: doc_id, score, predicted and spans (start:end in code points of offending words, comma-joined).

    A null or empty text has no tokens and the score of no evidence. Null ids and repeated rows are scored like
    others; an empty table gives no rows. The model that is broadcast has a fixed size (1 MB).
    """
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(field)
    held: list[Cache] = []

    def run(ids: list, texts: list[str]) -> dict[str, list]:
        field = sent.value
        if not held:
            held.append(Cache(lambda w: field.emission(w.decode())))
        raw = [x.encode().split() for x in texts]
        known = held[0]
        p = _by_text(field, raw, known.__getitem__)
        logits = np.array([_evidence(x) for x in p]).reshape(-1, 2) @ field.curve[1:] + field.curve[0]
        score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        spans = []
        for text, q in zip(texts, p, strict=True):
            hot = np.flatnonzero(q >= 0.5)
            where = [m.span() for m in _WORD.finditer(text)] if len(hot) else []
            spans.append(",".join("{}:{}".format(*where[k]) for k in hot.tolist()))
        return {"doc_id": ids, "score": score, "predicted": (score >= 0.5).astype(np.int32), "spans": spans}

    return map_texts(slim(df, id_col, text_col), run, f"doc_id {kind}, score double, predicted int, spans string")


def keep_clean(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """df without the rows that the field predicts toxic, all columns as they were.

    Null and empty texts have the score of no evidence and, by a field that learnt of clean rows, stay; null ids and
    repeated rows are judged like others; an empty table stays empty. Very long texts are read whole.
    """
    sent = df.sparkSession.sparkContext.broadcast(field)
    held: list[Cache] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        field = sent.value
        if not held:
            held.append(Cache(lambda w: field.emission(w.decode())))
        out = []
        for _, some in runs([x or "" for x in texts]):
            raw = [x.encode().split() for x in some]
            evidence = np.array([_evidence(x) for x in _by_text(field, raw, held[0].__getitem__)]).reshape(-1, 2)
            out.append(1 / (1 + np.exp(-np.clip(evidence @ field.curve[1:] + field.curve[0], -30, 30))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return df.filter(score(quoted(text_col).cast("string")) < 0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir)
    field = fitted(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    return toxicity(table, field).select("doc_id", held_out, "score", "predicted", "spans")
