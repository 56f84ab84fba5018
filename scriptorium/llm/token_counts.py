"""Token counts without tokenizing: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
position; dynamic programming carries the best score and its number of pieces.
Ties follow the unigram tokenizer: among paths of equal score the piece that
begins earlier wins, and a character without a piece of its own is an unknown
of the least score minus 10, counted by its UTF-8 bytes where the vocabulary
has byte pieces, else with its unknown neighbours as one.

Texts are cut before every space, which the sign U+2581 stands for, and begin
with one; so each such word is scored once per worker and remembered (bounded).

Defined results: null counts as empty; the empty text has no
piece; a null
``doc_id`` or repeated rows are counted like others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, worker_cache

SPACE_SIGN = "▁"
UNKNOWN_PENALTY = 10.0
DEFAULT_VOCABULARY = "piece_bpe_32k.model"
_COUNTERS: dict[str, UnigramCounter] = {}


class UnigramCounter:
    """Piece counts of texts under ``vocabulary``, (piece, score) pairs."""

    def __init__(self, vocabulary: list[tuple[str, float]], budget: int | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.budget = budget
        worker_cache("pieces").clear()  # of another vocabulary

    def word(self, text: str) -> int:
        """Pieces of the best path over one word."""
        best, count, odd = [0.0], [0], [False]
        top, pieces, single = None, 0, False  # of the position under way

        def settle() -> None:
            """Close the position under way; without a piece of its own, its character may be unknown."""
            nonlocal top, pieces, single
            unknown = False
            if not single and (top is None or self.unknown + best[-1] > top):
                size = len(text[len(best) - 1].encode()) if self.bytes else int(not odd[-1])
                top, pieces, unknown = self.unknown + best[-1], count[-1] + size, True
            best.append(top)
            count.append(pieces)
            odd.append(unknown)
            top, pieces, single = None, 0, False

        # Pieces come by their end, the longest (which begins earliest) first, so that it wins ties.
        for end, (size, score) in self.automaton.iter(text):
            while len(best) <= end:
                settle()
            begin = end + 1 - size
            total = score + best[begin]
            if top is None or total > top:
                top, pieces = total, count[begin] + 1
            if size == 1:
                single = True
        while len(best) <= len(text):
            settle()
        return count[-1]

    def text(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        words = text.replace(SPACE_SIGN, " ").split(" ")
        if len(words) > 1 and words[0] == "":
            words = words[1:]
        known = worker_cache("pieces", self.budget).values_of(words, lambda new: [self.word(SPACE_SIGN + w) for w in new])
        return sum(map(known.__getitem__, words))


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counter(path: str) -> UnigramCounter:
    """This worker's counter for a vocabulary file (kept between tasks)."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(read_vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens (pieces of the whole text under the vocabulary file), n_chars."""
    small_batches(docs.sparkSession, "8m")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_VOCABULARY)

    @F.pandas_udf("long")
    def pieces(texts: pd.Series) -> pd.Series:
        count = counter(path).text
        return pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", pieces(text).alias("n_tokens"), F.length(text).cast("long").alias("n_chars"))
