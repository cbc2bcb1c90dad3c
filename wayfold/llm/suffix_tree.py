"""Substring dedup of words by prefix-partitioned suffix trees.

Suffixes are split into groups by a prefix of variable length: the GRAM words of an anchor (see repeats.py), or all
WINDOW words where that prefix is too frequent. Each group is small enough for memory, and its subtree is built from
its sorted suffixes: the common-prefix lengths of neighbours are the depths of the inner nodes. An inner node at least
WINDOW words deep is a repeat; of its leaves, all but the earliest are repeated windows.

Defined cases: a null text has no words; texts under 20 words lose nothing; rows with a null id take no part and keep
all words; a repeat in the same document counts from its second start on; rows that repeat an id and text lose the same
words; words are compared unchanged; all windows are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from .common import arrow_type, out, word_hashes
from .repeats import Alphabet, covered, mask, texts_of

WINDOW, GRAM = 20, 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_HASHES = word_hashes(23)


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (rows of positive symbols) as leaves of their tree, and the depth of the node above neighbours."""
    rows = np.ascontiguousarray(suffixes.astype(">u4"))
    order = np.argsort(rows.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    near = suffixes[order]
    differ = near[1:] != near[:-1]
    depth = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1]) if len(near) > 1 else np.empty(0, np.int64)
    return order, depth


def names(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the deep node (or lone leaf) above each window of each context, and each context's windows.

    Suffixes run to the ends of their contexts, so inner nodes are as deep as the repeats in the group are long.
    """
    symbols: dict[bytes, int] = {}
    split = [c.split(b" ") for c in contexts]
    longest = max(map(len, split))
    end = 1 << 31  # symbols from here on close a context and are equal to no other
    rows, windows = [], []
    for k, words in enumerate(split):
        ids = np.fromiter((symbols.setdefault(w, len(symbols) + 1) for w in words), np.uint32, len(words))
        windows.append(len(ids) - WINDOW + 1)
        rows.append(sliding_window_view(np.append(ids, np.full(longest - WINDOW, end + k, np.uint32)), longest)[: windows[-1]])
    order, depth = subtree(np.concatenate(rows))
    node = np.zeros(len(order), np.int64)
    node[order] = np.concatenate([[0], np.cumsum(depth < WINDOW)])
    return node, np.array(windows, np.int64)


def codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


WORDS = Alphabet(WINDOW, GRAM, lambda text: text.encode("utf-8", "replace").split(), codes, lambda words, s, e: b" ".join(words[s:e]), names, True)


def removed_words(docs: DataFrame) -> DataFrame:
    """For every row: how many words go, and the digest of the rest joined by single spaces."""
    schema = arrow_type(RESULT)

    def task(batches):
        for b in batches:
            rows = []
            for d, text, ranges in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "replace").split()
                gone = mask(len(words), ranges, WORDS)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if ranges else words
                rows.append((d, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield out(schema, *(list(zip(*rows, strict=True)) or [[]] * 4))

    return covered(docs, WORDS).mapInArrow(task, RESULT)
