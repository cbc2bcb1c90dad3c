"""Suffix-array dedup of bytes by bucket-pointer refinement.

Within a group of contexts (see repeats.py) the suffixes are put into buckets by their first Q bytes, in order. A
bucket of several suffixes is refined by sorting on the bucket pointers as many places later as the bucket is deep; its
parts are then as deep as both together. Pointers are updated in place, so buckets that are refined later in the same
round already use the finer ones. Buckets at least 50 bytes deep need no more; neighbours in the resulting order that
agree on 50 bytes share a 50-byte string.

Defined cases: a null text counts as empty; texts under 50 bytes lose nothing; matches never cross documents; rows
with a null id take no part and keep all bytes; rows that share an id do not remove each other's bytes; overlapping
matches count, and all strings are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_type, out
from .repeats import Alphabet, covered, mask, texts_of

WINDOW, GRAM, Q = 50, 20, 8
#: Suffixes that are refined at once.
BATCH = 1 << 17
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def refine(bucket: np.ndarray, depth: np.ndarray, size: np.ndarray, part: np.ndarray) -> None:
    """Splits the buckets of the suffixes in part by the bucket pointers at their depth; pointers change in place.

    A bucket's pointer is its first place in the order of suffixes; depth and size are kept at that place. The parts of
    a bucket are as deep as the bucket and the one that their suffixes point to together.
    """
    old = bucket[part]
    d = depth[old]
    at = part + d
    inside = at < len(bucket)
    later = np.where(inside, bucket[np.minimum(at, len(bucket) - 1)], -1)
    deeper = np.where(inside, d + depth[np.maximum(later, 0)], WINDOW)
    order = np.lexsort((later, old))
    old, later, deeper, part = old[order], later[order], deeper[order], part[order]
    new_old = np.concatenate([[True], old[1:] != old[:-1]])
    head = np.flatnonzero(new_old | np.concatenate([[True], later[1:] != later[:-1]]))
    first = np.flatnonzero(new_old)[np.cumsum(new_old) - 1]  # where each suffix's old bucket starts in this part
    n = np.diff(np.append(head, len(old)))
    pointer = old[head] + head - first[head]
    depth[pointer], size[pointer] = deeper[head], n
    bucket[part] = np.repeat(pointer, n)


def names(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window of each context, equal for equal windows, and the number of windows of each context."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts) + bytes(WINDOW), np.uint8)
    total = int(sizes.sum())
    gram = np.zeros(total, np.uint64)
    for k in range(Q):
        gram = (gram << np.uint64(8)) | text[k : total + k].astype(np.uint64)
    # Suffixes near a context's end read into the next one; only windows that end inside are asked for below.
    _, which, n = np.unique(gram, return_inverse=True, return_counts=True)
    start = np.cumsum(n) - n
    bucket = start[which]
    depth, size = np.full(total, Q), np.ones(total, np.int64)
    size[start] = n
    while len(open_ := np.flatnonzero((size[bucket] > 1) & (depth[bucket] < WINDOW))):
        open_ = open_[np.argsort(bucket[open_], kind="stable")]
        # Whole buckets at a time; those that come later in the round already read the new pointers.
        ends = [0, *(int(np.searchsorted(bucket[open_], bucket[open_[k]])) for k in range(BATCH, len(open_), BATCH)), len(open_)]
        for low, high in zip(ends, ends[1:], strict=False):
            if low < high:
                refine(bucket, depth, size, open_[low:high])
    windows = sizes - WINDOW + 1
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts, windows) + (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))
    # Some buckets are deeper than a window by now: neighbours in the order that agree on a whole window are one name.
    _, head, rank = np.unique(bucket[at], return_index=True, return_inverse=True)
    place = at[head]
    same = np.ones(max(0, len(place) - 1), bool)
    for k in (*range(0, WINDOW - Q, Q), WINDOW - Q):
        same &= gram[place[1:] + k] == gram[place[:-1] + k]
    return np.concatenate([[0], np.cumsum(~same)])[rank] if len(place) else rank, windows


BYTES = Alphabet(WINDOW, GRAM, lambda text: text.encode("utf-8", "replace"), lambda raw: np.frombuffer(raw, np.uint8).astype(np.uint64), lambda raw, s, e: raw[s:e], names, False)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """For every row: how many bytes and runs go, and the digest of the rest."""
    schema = arrow_type(RESULT)

    def task(batches):
        for b in batches:
            rows = []
            for d, text, ranges in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                gone = mask(len(raw), ranges, BYTES)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if ranges else raw
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                rows.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            yield out(schema, *(list(zip(*rows, strict=True)) or [[]] * 5))

    return covered(docs, BYTES).mapInArrow(task, RESULT)
