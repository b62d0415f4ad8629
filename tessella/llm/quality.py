"""Quality rules as a short-circuit cascade.

Every rule has a measure and a bound. On a sample the measures are timed and their rejections counted; rules run in
the order of rejections per second, so that most rejected documents cost little. A measure is taken when a rule first
asks for it: documents that a rule before rejects never pay for it. Only the five base measures, which the result
holds, are taken of all. The order changes costs only: a document is kept when it passes all rules.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, documents, map_texts, quoted, slim

SYMBOLS = "#*$%&|<>"


class Measures:
    """Measures of one text, each computed at first use."""

    def __init__(self, text: str):
        self.text = text
        self.data = text.encode()
        self.words = self.data.split()
        self.n_words = len(self.words)
        self._known: dict[str, float] = {}

    def __getattr__(self, name: str):
        known = self.__dict__["_known"]
        if name not in known:
            known[name] = getattr(type(self), "_" + name)(self)
        return known[name]

    def _word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(x) for x in SPACES)

    def _n_symbols(self) -> int:
        return sum(self.text.count(x) for x in SYMBOLS)

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        m = len(known)
        pair = ids[:-1] * m + ids[1:]
        if m > 2_000_000:  # the product below would overflow
            pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        return int(covered.sum())

    def take_base(self) -> "Measures":
        for name in BASE:
            getattr(self, name)
        return self

    def taken(self) -> set[str]:
        """Names of the measures taken so far."""
        return set(self._known)

    def _n_upper(self) -> int:
        return len(_UPPER.findall(self.text))

    def _n_digits(self) -> int:
        return len(_DIGIT.findall(self.text))

    def _n_lettered(self) -> int:
        return sum(_LETTER.search(w.decode()) is not None for w in self.words)

    def _n_ellipses(self) -> int:
        return sum(x.rstrip(SPACES).endswith(("...", "…")) for x in self.lines)

    def _n_bullets(self) -> int:
        return sum(x.lstrip(SPACES)[0] in "-*•" for x in self.lines)

    def _top_pair(self) -> int:
        """How often the most frequent pair of neighbouring words occurs."""
        return max(Counter(zip(self.words, self.words[1:], strict=False)).values(), default=0)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER, _DIGIT, _LETTER = (regex.compile(rf"\p{{{x}}}") for x in ("Lu", "Nd", "L"))

#: (name, does the text fail?). Bounds are far from what clean prose shows.
RULES: tuple[tuple[str, Callable[[Measures], bool]], ...] = (
    ("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    ("dup_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    ("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    ("upper_case", lambda m: 10 * m.n_upper > 4 * m.word_chars),
    ("digits", lambda m: 10 * m.n_digits > 3 * m.word_chars),
    ("lettered", lambda m: 2 * m.n_lettered < m.n_words),
    ("ellipses", lambda m: 10 * m.n_ellipses > 3 * len(m.lines)),
    ("bullets", lambda m: 10 * m.n_bullets > 9 * len(m.lines)),
    ("top_pair", lambda m: 5 * m.top_pair > m.n_words - 1),
)


def ordered(rules, texts: list[str]) -> list[int]:
    """Indexes of the rules by rejections per second on a sample of texts, most first; ties keep the given order.

    A rule is timed on texts whose base measures are known, as in the cascade.
    """
    value = []
    for k, (_, fails) in enumerate(rules):
        fresh = [Measures(x).take_base() for x in texts]
        began = time.perf_counter()
        rejected = sum(fails(m) for m in fresh)
        value.append((-rejected / max(time.perf_counter() - began, 1e-9), k))
    return [k for _, k in sorted(value)]


def cascade_order(df: DataFrame, text_col: str = "text", rules=RULES, sample: int = 500, longest: int = 20_000) -> list[int]:
    """The cascade's order from about `sample` rows, of texts of up to `longest` characters.

    It decides cost, not results, so a bounded sample will do: the rows whose places have the least hashes. The
    hashes are ordered without the texts; then only the texts below the bound are read.
    """
    rows = df.select(quoted(text_col).cast("string").alias("t"), F.xxhash64(F.monotonically_increasing_id()).alias("h")).filter(F.length("t").between(1, longest))
    bound = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if bound is None:
        return list(range(len(rules)))
    return ordered(rules, [x["t"] for x in rows.filter(F.col("h") <= bound).select("t").limit(2 * sample).toLocalIterator()])


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules=RULES, order: list[int] | None = None, sample: int = 500) -> DataFrame:
    """One row a row of df: doc_id, n_words, the four base measures, base_failed, kept.

    base_failed: fewer than 50 words, or over half the words in repeated three-word windows. Such a document is
    rejected without asking a rule. A null text is empty and fails; null ids and repeated rows are judged like
    others; an empty table gives no rows. Very long texts are read whole, every word and line of them.
    """
    kind = df.schema[id_col].dataType.simpleString()
    table = slim(df, id_col, text_col)
    order = cascade_order(table, "text", rules, sample) if order is None else order

    def run(ids: list, texts: list[str]) -> dict[str, list]:
        measures = [Measures(x) for x in texts]
        out: dict[str, list] = {"doc_id": ids}
        for name in BASE:
            out[name] = [getattr(m, name) for m in measures]
        out["base_failed"] = [m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words for m in measures]
        out["kept"] = [not bad and not any(rules[k][1](m) for k in order) for m, bad in zip(measures, out["base_failed"], strict=True)]
        return out

    counts = ", ".join(f"{x} long" for x in BASE)
    return map_texts(table, run, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), t AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), r AS (
  SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), p AS (
  SELECT doc_id, max(k) AS top_pair
  FROM (SELECT doc_id, g, count(*) AS k FROM (SELECT doc_id, words[i] || ' ' || words[i + 1] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) >= 2)) GROUP BY doc_id, g) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) AS n_digits,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets, coalesce(top_pair, 0) AS top_pair
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN p ON w.doc_id = p.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
         OR word_chars > 20 * n_words OR 10 * n_upper > 4 * word_chars OR 10 * n_digits > 3 * word_chars OR 2 * n_lettered < n_words
         OR 10 * n_ellipses > 3 * n_lines OR 10 * n_bullets > 9 * n_lines OR 5 * top_pair > n_words - 1) AS kept
FROM f
"""
