"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each position of a word; dynamic programming
keeps the best score, the number of pieces on that path and whether it ends in an unknown piece. No piece is ever
built. Tie rules are those of the unigram tokenizer: of equal scores the path whose last piece starts first wins,
an unknown character costs the smallest score less 10 and is tried only where no piece of one character matches.
Unknown characters fall back to byte pieces, one for each byte of their UTF-8 form. Byte pieces stand for such bytes only; their
spelling in a text (`<0x0A>`) is text like any other.

Spaces become the word mark, which also begins the text; words are counted on their own, so counts of words are cached.

Defined cases: a null or empty text has 0 tokens; rows that repeat an id are counted each; only doc_id and text are read.
"""

from __future__ import annotations

import functools

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, arrow_type, out

MARK = "▁"
UNKNOWN = "<unk>"
UNKNOWN_PENALTY = 10.0
RESULT = "doc_id long, n_tokens long, n_words long, n_chars long"


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of the model's ordinary pieces; the first entry stands for unknown text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(UNKNOWN, 0.0)] + [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


class UnigramCounter:
    """Counts the pieces of the best segmentation of a word."""

    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            self.automaton.add_word(piece, (len(piece), score, i == 0))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.words = Cache(self.count)

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        at, top, start, is_unknown, single = 1, None, 0, False, False
        # Matches come by their end, the longest (which starts first) before the shorter ones.
        for last, (length, score, unk) in self.automaton.iter(word):
            while at <= last:
                self.close(word, at, top, start, is_unknown, single, best, pieces, unknown)
                at, top, start, is_unknown, single = at + 1, None, 0, False, False
            value = best[at - length] + score
            if length == 1:
                single = True
            if top is None or value > top:
                top, start, is_unknown = value, at - length, unk
        while at <= n:
            self.close(word, at, top, start, is_unknown, single, best, pieces, unknown)
            at, top, start, is_unknown, single = at + 1, None, 0, False, False
        return pieces[n]

    def close(self, word, at, top, start, is_unknown, single, best, pieces, unknown) -> None:
        """Settles a position: its best score, its pieces, and where the run of unknown text that ends there starts (-1: none does)."""
        if not single and (top is None or best[at - 1] + self.unknown > top):
            top, start, is_unknown = best[at - 1] + self.unknown, at - 1, True
        best[at] = top
        if is_unknown:
            unknown[at] = start = unknown[start] if unknown[start] >= 0 else start
            run = word[start:at]
            pieces[at] = pieces[start] + (1 if run == UNKNOWN else len(run.encode("utf-8", "replace")))
        else:
            pieces[at] = pieces[start] + 1

    def count_text(self, text: str | None) -> tuple[int, int]:
        """(tokens, words) of a text."""
        if not text:
            return 0, 0
        words = text.replace(" ", MARK).removeprefix(MARK).split(MARK)
        return sum(map(self.words.__getitem__, [MARK + w for w in words])), len(words)


@functools.lru_cache(2)
def counter_for(model_file: str) -> UnigramCounter:
    """One counter for each worker process, with its cache of words."""
    return UnigramCounter(vocabulary(model_file))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """Tokens, words and characters of every row; a map over partitions, without a shuffle.

    model_file is opened on the executors; each worker process builds its automaton once.
    """
    schema = arrow_type(RESULT)

    def task(batches):
        counter = counter_for(model_file)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [counter.count_text(t) for t in texts]
            yield out(schema, b.column(0), [c for c, _ in counts], [w for _, w in counts], [len(t or "") for t in texts])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, RESULT)
