"""Token counts of a unigram tokenizer by Viterbi, without building the tokens.

An Aho-Corasick automaton lists all vocabulary matches that end at a position; dynamic programming carries the best
score and its number of pieces. Ties go as in the tokenizer: of equal sums the piece that starts first wins, since
candidates are compared from the longest on and only a greater sum replaces one. A code point that is no piece scores
10 below the lowest piece, and counts as its UTF-8 bytes where the model falls back to bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import Memo

#: Score of an unknown code point, below that of the lowest piece.
_UNKNOWN = 10.0
_SPACE = "▁"
_LOW = float("-inf")


class Unigram:
    """Counter over pieces and scores. ``bytes_fallback``: unknown code points count as their UTF-8 bytes, else as one token for each run."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_fallback: bool = True) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - _UNKNOWN
        self.bytes_fallback = bytes_fallback
        #: No piece crosses from another code point to a space, so texts can be cut there and the counts added.
        self.cut = None if any(_SPACE in piece.lstrip(_SPACE) for piece, _ in pieces) or not bytes_fallback else re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
        self.memo = Memo(self.viterbi)

    def viterbi(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over ``text``, taken whole."""
        n = len(text)
        ending: list = [()] * n
        for end, found in self.automaton.iter(text):
            if ending[end]:
                ending[end].append(found)
            else:
                ending[end] = [found]
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end, found in enumerate(ending):
            top, pieces, run, single = _LOW, 0, False, False
            for length, score in sorted(found, reverse=True):
                start = end + 1 - length
                total = best[start] + score
                if total > top:
                    top, pieces = total, count[start] + 1
                single |= length == 1
            if not single and (total := best[end] + self.unknown) > top:
                top, run = total, True
                if self.bytes_fallback:
                    pieces = count[end] + len(text[end].encode("utf-8", "surrogatepass"))
                else:
                    pieces = count[end] + (not open_run[end])
            best[end + 1], count[end + 1], open_run[end + 1] = top, pieces, run
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a raw text: a space is put before it, spaces become the mark of spaces."""
        if not text:
            return 0, 0.0
        text = _SPACE + text.replace(" ", _SPACE)
        if self.cut is None:
            return self.viterbi(text)
        tokens = total = 0
        for n, score in map(self.memo.__getitem__, self.cut.findall(text)):
            tokens += n
            total += score
        return tokens, float(total)


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Normal pieces and scores of a sentencepiece model file; unknown, control and byte pieces match no text and are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(maxsize=2)
def _loaded(path: str) -> Unigram:
    return Unigram(load_pieces(path))


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens`` and ``best_score`` of the whole text under the unigram model of the pieces and scores in ``path``.

    A null or empty text has 0 tokens and score 0. Null and repeated ids are kept as rows of their own; other
    columns are ignored. Scores are summed in double precision. No shuffle; a lost task is simply run again.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(path)
        for batch in batches:
            found = [model.count(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], [id_col, "n_tokens", "best_score"])

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, best_score double")
