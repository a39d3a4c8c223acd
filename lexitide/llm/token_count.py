"""Operator 3: token counts of a unigram vocabulary by count-only Viterbi.

Spaces become word starts (U+2581), and each word is scored by itself. An Aho-Corasick automaton enumerates the
vocabulary pieces that end at each character; the recurrence carries the best score and the number of pieces of
that best path, never the path. Ties and unknown characters follow the common unigram tokenizer: of equal scores
the piece that starts first wins, an unknown character costs 10 below the lowest score, and neighbouring unknown
characters count as one token. Words repeat, so each worker keeps the results of up to `cache_words` of them.

Edge cases: a null or empty text has no tokens; a leading space does not start a further word, other runs of
spaces do; very long texts are read whole; repeated rows and null ids are counted like any other; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.textvec import chunks

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model in its order, scored by rank (the file has merge ranks, not probabilities)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(piece, -math.log(rank + 2)) for rank, piece in enumerate(dict.fromkeys(pieces))]


class UnigramCounter(dict):
    """word -> (pieces, score), filled as words come."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], cache_words: int = 600_000) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.cache_words = cache_words

    def viterbi(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation. Matches come by their end, the longest, which starts first, first."""
        n, lost = len(text), self.unknown
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, best, pieces, single = 1, -math.inf, 0, False

        def close(at: int, best: float, pieces: int, single: bool) -> None:
            if not single and score[at - 1] + lost > best:
                best, pieces, loose[at] = score[at - 1] + lost, count[at - 1] + (not loose[at - 1]), True
            score[at], count[at] = best, pieces

        for end, (length, own) in self.automaton.iter(text) if len(self.automaton) else ():
            while at <= end:
                close(at, best, pieces, single)
                at, best, single = at + 1, -math.inf, False
            start = at - length
            own += score[start]
            if own > best:
                best, pieces = own, count[start] + 1
            if length == 1:
                single = True
        while at <= n:
            close(at, best, pieces, single)
            at, best, single = at + 1, -math.inf, False
        return count[n], score[n]

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.cache_words:
            self.clear()
        out = self[word] = self.viterbi(MARK + word)
        return out

    def count(self, text: str) -> tuple[int, int, float]:
        """(words, pieces, score)."""
        if not text:
            return 0, 0, 0.0
        words = text.replace(MARK, " ").split(" ")
        found = list(map(self.__getitem__, words[1:] if not words[0] else words))
        return len(found), sum(x[0] for x in found), math.fsum(x[1] for x in found)


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(zipf_vocabulary(path))


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, best_score."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    path = str(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            for a, b in chunks(batch.column(1), 1 << 22):
                part = batch.slice(a, b - a)
                found = [count(t) if t else (0, 0, 0.0) for t in part.column(1).to_pylist()]
                words, tokens, scores = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "best_score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long, best_score double")
