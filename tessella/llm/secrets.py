"""Secret scans by one combined deterministic automaton.

All rules are compiled together; one pass over a batch's bytes gives the state after each byte. Between two places at
which that pass is in its start state lies a stretch that no match leaves. Only stretches in which a rule ends are
looked at again: the rule's automaton read backwards marks where its matches begin, and read forwards, from the first
such place behind the match before, gives the longest match. Each byte is read a fixed number of times, so time is
linear in the text. No rule matches a line break, so texts are joined by line breaks and scanned as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.automaton import Dfa, run_states
from tessella.llm.common import documents, map_texts, quoted, runs, slim


@dataclass(frozen=True)
class Rule:
    """A kind, its expression, and the least bytes of a match; value: least bytes behind the first : or = (and quote)."""

    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 0
    value: int = 0
    base: bool = False


#: The kinds in their order. The keyword's letters are in either case and all in ASCII; the value has no letter of
#: one case only, so ignoring case throughout is the same.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", ignore_case=True, value=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
)


class Scanner:
    def __init__(self, rules: Iterable[Rule] = RULES):
        self.rules = tuple(rules)
        self.all = Dfa([(r.pattern, r.ignore_case) for r in self.rules], search=True)
        each = [Dfa([(r.pattern, r.ignore_case)], search=False) for r in self.rules]
        if any(d.next[0, d.kind[10]] != d.dead for d in each):
            raise ValueError("a rule may not begin with a line break")
        back = [Dfa([(r.pattern, r.ignore_case)], search=True, backwards=True) for r in self.rules]
        self.tables, self.back = ([(d.next.tolist(), d.kind.tobytes(), d.accepts.tolist(), d.dead) for d in x] for x in (each, back))

    def _longest(self, rule: int, data: bytes, at: int, end: int) -> int:
        """End of the longest match that begins at `at`, or -1."""
        table, kind, accepts, dead = self.tables[rule]
        state, found = 0, -1
        for i in range(at, end):
            state = table[state][kind[data[i]]]
            if state == dead:
                break
            if accepts[state]:
                found = i + 1
        return found

    def _matches(self, rule: int, data: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """Leftmost matches in data[begin:end] that do not overlap; no match leaves that stretch."""
        table, kind, accepts, _ = self.back[rule]
        state, starts = 0, []
        for i in range(end - 1, begin - 1, -1):
            state = table[state][kind[data[i]]]
            if accepts[state]:
                starts.append(i)
        at = begin
        for s in reversed(starts):
            if s >= at:
                at = self._longest(rule, data, s, end)
                yield s, at

    @staticmethod
    def _value(match: bytes) -> int:
        at = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0) + 1
        rest = match[at:].lstrip(b" ")
        return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans (start, rule, end), in code points, sorted."""
        raw = [x.encode() for x in texts]
        ends = np.cumsum([len(x) + 1 for x in raw])
        data = b"\n".join([*raw, b""])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not data:
            return found
        states = run_states(self.all, np.frombuffer(data, np.uint8))
        bits = self.all.accepts[states]
        at = np.flatnonzero(bits)
        rest = np.concatenate(([-1], np.flatnonzero(states == 0), [len(data)]))
        stretch = np.searchsorted(rest, at)
        for k, rule in enumerate(self.rules):
            for right in np.unique(stretch[bits[at] >> k & 1 == 1]).tolist():
                for s, stop in self._matches(k, data, int(rest[right - 1]) + 1, int(rest[right])):
                    if stop - s >= rule.least and (not rule.value or self._value(data[s:stop]) >= rule.value):
                        doc = int(np.searchsorted(ends, s, side="right"))
                        base = int(ends[doc]) - len(raw[doc]) - 1
                        found[doc].append((s - base, k, stop - base))
        for doc, spans in enumerate(found):
            if spans and len(raw[doc]) > len(texts[doc]):  # bytes to code points: count those that begin one
                points = np.concatenate(([0], np.cumsum(np.frombuffer(raw[doc], np.uint8) & 0xC0 != 0x80)))
                found[doc] = [(int(points[s]), k, int(points[e])) for s, k, e in spans]
        return [sorted(x) for x in found]


@lru_cache(1)
def default_scanner() -> Scanner:
    """Compiled once, on the driver; tasks get the arrays (about 2 MB, set by the rules alone) as a broadcast."""
    return Scanner()


def _joined(rules: tuple[Rule, ...], spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row a row of df: doc_id, a count of each base kind, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by start, then in the order of the rules. A null text is
    empty and has none; null ids and repeated rows are scanned like others; an empty table gives no rows. Very long
    texts are scanned whole, in linear time; they take about 20 bytes of memory a byte of text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    scanner = scanner or default_scanner()
    rules, sent = scanner.rules, df.sparkSession.sparkContext.broadcast(scanner)
    base = [k for k, r in enumerate(rules) if r.base]

    def run(ids: list, texts: list[str]) -> dict[str, list]:
        found = sent.value.scan(texts)
        out: dict[str, list] = {"doc_id": ids}
        for k in base:
            out[f"n_{rules[k].kind}"] = [sum(x[1] == k for x in spans) for spans in found]
        out["base_sha256"] = [hashlib.sha256(_joined(rules, [x for x in spans if rules[x[1]].base]).encode()).hexdigest() for spans in found]
        out["spans"] = [_joined(rules, spans) for spans in found]
        return out

    counts = ", ".join(f"n_{rules[k].kind} long" for k in base)
    return map_texts(slim(df, id_col, text_col), run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(df: DataFrame, text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """df with each found span replaced by [KIND]; overlapping spans by the first one's. Null texts stay null; other columns stay.

    Empty texts stay empty, very long ones are scanned whole, repeated rows and null ids each on their own; an empty
    table stays empty.
    n_chars, where df has it, is not changed: it tells of the text as it came.
    """
    scanner = scanner or default_scanner()
    rules, sent = scanner.rules, df.sparkSession.sparkContext.broadcast(scanner)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = list(texts)
            for lo, some in runs([x or "" for x in out]):
                for k, spans in enumerate(sent.value.scan(some)):
                    if spans:
                        out[lo + k] = _mask(some[k], spans)
            yield pd.Series(out, dtype=object)

    def _mask(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, at = [], 0
        for start, k, end in spans:
            if start >= at:
                parts += [text[at:start], f"[{rules[k].kind.upper()}]"]
            at = max(at, end)
        return "".join(parts) + text[at:]

    return df.select(*[mask(quoted(c).cast("string")).alias(c) if c == text_col else quoted(c) for c in df.columns])


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
