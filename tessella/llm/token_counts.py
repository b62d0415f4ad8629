"""Token counts of a unigram model by a count-only Viterbi search.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each character. The search keeps the
best score and the number of pieces for every end, nothing else. Ties go as in the tokenizers library: of equal
scores the path whose last piece begins first stays. Text between blanks is searched apart, as the library's
Metaspace splits it, and remembered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import documents, map_texts, slim
from tessella.llm.units import Cache

BLANK = "▁"
#: What an unknown character costs beyond the lowest score of the vocabulary; fixed in the library.
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """len(tokens) of a unigram model with Metaspace (prepend always, split) before it.

    byte_fallback: an unknown character counts as its UTF-8 bytes; otherwise each run of unknown characters is one token.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], *, byte_fallback: bool = True, most: int = 200_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.units = Cache(self.search, most)

    def search(self, unit: str) -> int:
        """Pieces of the best path through BLANK + unit."""
        text = BLANK + unit
        n = len(text)
        score, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)  # by end; at one end the longest comes first
        at, piece = next(matches, (n, None))
        for end in range(1, n + 1):
            best, found, single = None, 0, False
            while at == end - 1:
                length, value = piece
                now = value + score[end - length]
                if best is None or now > best:
                    best, found = now, count[end - length] + 1
                single |= length == 1
                at, piece = next(matches, (n, None))
            if not single:
                now = self.unknown + score[end - 1]
                if best is None or now > best:
                    best, lost[end] = now, True
                    if self.byte_fallback:
                        found = count[end - 1] + len(text[end - 1].encode())
                    else:
                        found = count[end - 1] + (not lost[end - 1])
            score[end], count[end] = best, found
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        units = text.split(" ")
        if text[0] == " ":
            del units[0]
        known = self.units
        return sum([known[x] for x in units])


def token_counts(df: DataFrame, counter: Callable[[], UnigramCounter], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: doc_id, n_tokens.

    A null or empty text has none; null ids and repeated rows are counted like others; an empty table gives no rows.
    Very long texts are counted whole: a stretch without blanks holds three numbers a character, no list of matches.
    """
    kind = df.schema[id_col].dataType.simpleString()
    held: list[UnigramCounter] = []

    def run(ids: list, texts: list[str]) -> dict[str, list]:
        if not held:
            held.append(counter())
        return {"doc_id": ids, "n_tokens": [held[0].count(x) for x in texts]}

    return map_texts(slim(df, id_col, text_col), run, f"doc_id {kind}, n_tokens long")


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def piece_counter() -> UnigramCounter:
    import public_tokenizers

    return UnigramCounter(piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), piece_counter)
