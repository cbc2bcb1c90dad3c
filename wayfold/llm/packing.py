"""Packing documents into token sequences: first-fit decreasing with a tournament tree of bin capacities.

Rows are dealt to randomised groups of about GROUP_DOCS documents by a hash of the row, of its input partition and of
how many equal rows that partition has shown before: each group fits one task and holds a fair mix of lengths, and
equal rows are spread like all others. Equal rows can stand for each other, so a partition that is read again in another
order deals out the same groups. Inside a group, documents longer than a sequence are cut into full sequences and a rest;
the pieces go, longest first, into the first bin with room, which a tournament tree over the bins' free places finds
in logarithmic time. Then the emptiest bins are taken apart and their tokens, cut freely, fill the gaps of the others;
what remains at the end of a group is laid out in sequences whose lengths are powers of two, which need no padding.

Defined cases: a null text counts as empty and is one end token; rows that repeat an id are packed each on their own;
a null id stays null. A group never depends on other groups, and a lost task redoes one group.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Cache, arrow_type, out, partitions_for

LENGTH = 4096
END_ID = 2
GROUP_DOCS = 1024
#: Groups that one task packs, one after another.
TASK_GROUPS = 16
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of a text from a byte-level tokenizer that drops white space and never joins across it.

    Words are encoded once and cached. Words of plain characters are cut into runs of letters, single digits and runs
    of signs, as the tokenizer's own pattern does, and each run goes straight to the tokenizer's model; any other word
    (apostrophes, "<" of special tokens, letters outside Latin-1) goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
    RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Cache(self.encode, 1_000_000)
        self.runs = Cache(self.encode_run, 300_000)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        # Bytes that print stand for themselves in a byte-level vocabulary, the others for code points from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def encode_run(self, run: str) -> bytes:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def encode(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.runs[word.decode()]
        if word[-1:] in b".," and word[:-1].isalpha():
            return self.runs[word[:-1].decode()] + self.runs[word[-1:].decode()]
        text = word.decode("utf-8", "replace")
        if self.PLAIN.fullmatch(text):
            return b"".join(map(self.runs.__getitem__, self.RUNS.findall(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.words.__getitem__, (text or "").encode("utf-8", "replace").lower().split()))


@functools.lru_cache(2)
def tokenizer_for(path: str) -> WordTokenizer:
    """One tokenizer for each worker process, with its caches."""
    return WordTokenizer(path)


class Tournament:
    """Free places of bins in a complete binary tree; each inner node has the larger of its two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes size places of the first bin that has them."""
        at = 1
        while at < self.leaves:
            at = 2 * at if self.most[2 * at] >= size else 2 * at + 1
        found = at - self.leaves
        self.most[at] -= size
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])
        return found


def pack_group(lengths: list[int], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) for documents of the given token counts."""
    sequences, pieces = [], []
    for d, n in enumerate(lengths):
        full = n // room
        sequences += [[(d, k * room, room)] for k in range(full)]
        if n % room:
            pieces.append((d, full * room, n % room))
    pieces.sort(key=lambda p: (-p[2], p[0]))
    tree = Tournament(len(pieces), room)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for p in pieces:
        bins.setdefault(tree.first_fit(p[2]), []).append(p)
    opened = sorted(((sum(p[2] for p in b), k) for k, b in bins.items()), reverse=True)
    low, high = 0, len(opened) - 1
    spare: list[tuple[int, int, int]] = []
    while low <= high:
        filled, k = opened[low]
        gap, low = room - filled, low + 1
        chosen = bins[k]
        while gap and (spare or low <= high):
            if not spare:
                spare, high = bins[opened[high][1]][::-1], high - 1
            d, start, n = spare.pop()
            take = min(n, gap)
            chosen.append((d, start, take))
            gap -= take
            if n > take:
                spare.append((d, start + take, n - take))
        if gap:
            spare = chosen[::-1]
            break
        sequences.append(chosen)
    left = sum(p[2] for p in spare)
    while left:  # the remainder, in powers of two
        size = 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            d, start, n = spare.pop()
            take = min(n, need)
            part.append((d, start, take))
            need -= take
            if n > take:
                spare.append((d, start + take, n - take))
        sequences.append(part)
        left -= size
    return sequences


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, _h (a hash for dealing), _nth (equal rows before it in its partition) and ids, as packed unsigned 16-bit where the vocabulary allows it."""
    schema = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("_nth", pa.int64()), ("ids", pa.binary())])

    def task(batches):
        encoder = tokenizer_for(tokenizer_file)
        end = np.asarray([end_id], "<u4").tobytes()
        seen: Counter = Counter()
        for b in batches:
            ids = [encoder.ids(t) + end for t in b.column(2).to_pylist()]
            nth = []
            for h in b.column(1).to_pylist():
                nth.append(seen[h])
                seen[h] += 1
            yield out(schema, b.column(0), b.column(1), nth, ids if encoder.wide else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids])

    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "text", F.spark_partition_id())
    return docs.select(F.col("doc_id").cast("long"), h.alias("_h"), "text").mapInArrow(task, "doc_id long, _h long, _nth long, ids binary")


def pack(docs: DataFrame, tokenizer_file: str, room: int = LENGTH, group_docs: int = GROUP_DOCS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence, and the CRC-32 of its ids.

    keep_ids adds the piece's ids (little-endian unsigned 32-bit) as a binary column. sequence_id is the group's
    number times 2**32 plus the sequence's number in the group. One shuffle moves the ids to their groups; the
    number of groups follows the number of rows.
    """
    n = docs.count()
    groups = max(1, -(-n // group_docs))
    wide = Tokenizer.from_file(tokenizer_file).get_vocab_size() > 1 << 16
    result = RESULT + (", ids binary" if keep_ids else "")
    schema = arrow_type(result)

    def fill(key, t):
        t = t.combine_chunks().sort_by([("doc_id", "ascending"), ("_h", "ascending"), ("_nth", "ascending")])
        g, names = key[0].as_py(), t.column("doc_id").to_pylist()
        ids = [np.frombuffer(x, "<u4" if wide else "<u2") for x in t.column("ids").to_pylist()]
        rows = []
        for k, sequence in enumerate(pack_group([len(x) for x in ids], room)):
            offset = 0
            for d, start, n in sequence:
                raw = ids[d][start : start + n].astype("<u4").tobytes()
                rows.append((names[d], start, n, zlib.crc32(raw), len(ids[d]), (g << 32) + k, offset) + ((raw,) if keep_ids else ()))
                offset += n
        return pa.Table.from_batches([out(schema, *(list(zip(*rows, strict=True)) or [[]] * len(schema)))])

    dealt = tokenized(docs, tokenizer_file, end_id).withColumn("_g", F.pmod(F.xxhash64("_h", "_nth"), F.lit(groups)))
    # The number of partitions follows the rows, so that a task's share stays the same at any size.
    return dealt.repartition(partitions_for(docs, groups, TASK_GROUPS), "_g").groupBy("_g").applyInArrow(fill, result)
