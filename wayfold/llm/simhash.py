"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a common variant within 2 bits of both, and two fingerprints that share
such a variant are at distance 4 or less: so every fingerprint emits its variants within half the radius, a shuffle
brings equal variants together, and all holders of a variant link to the least of them, without pairs.

2,081 variants for every fingerprint of a corpus would be wasted on those without a neighbour. A lossless filter
comes first, with the same method on two thirds of the bits: of any 4 differing bits, two of three blocks hold at most
2, so each fingerprint emits the variants within 1 bit of each pair of blocks, and only fingerprints that meet another
one emit their full balls. Inside a task, fingerprints that share a variant are linked at once and send it once, so a
large group of near copies adds at most one row for each task to a variant.

Defined cases: a null text counts as empty; texts without words have fingerprint 0 and link like any other; rows that
repeat an id get a row each; a null id takes part, but component ids are the least non-null id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, checkpointed, free, looked_up, out, partitions_for
from .links import components

SHINGLE = 4
SEED = 42
RADIUS = 4
CHUNK = 1 << 15
BALL = 1024
#: Fingerprints a task emits balls of, and variants a task matches.
SOURCE_PART, VARIANT_PART = 20_000, 2_000_000

_ONE = np.uint64(1)
#: Bits of the three blocks whose pairs the filter looks at.
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half the hashes of the shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _k (a hash of the text) and fp (the fingerprint as a signed long), a map without a shuffle."""
    schema = arrow_type("doc_id long, _k long, fp long")

    def task(batches):
        for b in batches:
            yield out(schema, b.column(0), b.column(1), np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_k"), "text").mapInArrow(task, "doc_id long, _k long, fp long")


def ball_masks(bits, radius: int) -> np.ndarray:
    """All masks over the given bits with at most `radius` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def collisions(fps: DataFrame, families: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct (a, b), a > b: fingerprints of fps (fp) that share a variant with a smaller one.

    families: (number, bits kept, masks); a variant is (number, (fp & bits kept) ^ mask).
    """
    schema = arrow_type("key long, a long, b long")

    def variants(batches):
        for batch in batches:
            every = np.unique(batch.column(0).to_numpy().view(np.uint64))
            for at in range(0, len(every), BALL):
                fp = every[at : at + BALL]
                for number, kept, masks in families:
                    keys = (((fp & kept)[:, None] ^ masks[None, :]) + np.uint64(number * 0x9E3779B97F4A7C15 & (2**64 - 1))).ravel()
                    owner = np.repeat(fp, len(masks))
                    order = np.argsort(keys, kind="stable")  # owners of a key stay in rising order
                    keys, owner = keys[order], owner[order]
                    first = np.concatenate([[True], keys[1:] != keys[:-1]])
                    head = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
                    met = np.unique(np.stack([owner[~first], head[~first]], 1), axis=0)
                    # Links found here ride along under keys of their own; b is -1 for a variant still to be matched.
                    spread = met[:, 0] * np.uint64(0xD6E8FEB86659FD93)
                    yield out(schema, keys[first].view(np.int64), owner[first].view(np.int64), pa.nulls(int(first.sum()), pa.int64()))
                    if len(met):
                        yield out(schema, spread.view(np.int64), met[:, 0].copy().view(np.int64), met[:, 1].copy().view(np.int64))

    found = arrow_type("a long, b long")

    def match(batches):
        keys, owners = [], []
        for t in batches:
            linked = t.filter(t.column(2).is_valid())
            if linked.num_rows:
                yield out(found, linked.column(1), linked.column(2))
            open_ = t.filter(t.column(2).is_null())
            keys.append(open_.column(0).to_numpy())
            owners.append(open_.column(1).to_numpy().view(np.uint64))
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        head = owner[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(key) else owner
        met = ~first & (owner != head)
        pairs = np.unique(np.stack([owner[met], head[met]], 1), axis=0)
        yield out(found, pairs[:, 0].copy().view(np.int64), pairs[:, 1].copy().view(np.int64))

    # Both sides are cut by counts: few fingerprints a task before they multiply, few variants a task where they meet.
    n = fps.count()
    every = n * sum(len(masks) for _, _, masks in families)
    spread = fps.select("fp").repartition(partitions_for(fps, n, SOURCE_PART), "fp")
    dealt = spread.mapInArrow(variants, "key long, a long, b long").repartition(partitions_for(fps, every, VARIANT_PART), "key")
    return dealt.mapInArrow(match, "a long, b long").distinct()


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within RADIUS bits; star links, not pairs."""
    filters = [(i, np.uint64(sum(1 << b for x in pair for b in x)), ball_masks([b for x in pair for b in x], RADIUS // 4)) for i, pair in enumerate(combinations(BLOCKS, 2))]
    met = checkpointed(collisions(fps, filters))
    near = checkpointed(met.select(F.col("a").alias("fp")).unionAll(met.select(F.col("b").alias("fp"))).distinct())
    full = [(9, np.uint64(2**64 - 1), ball_masks(range(64), RADIUS // 2))]
    # Each colliding pair is verified; a common variant within half the radius implies it, a wrong key would not pass.
    return collisions(near, full).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def rooted(prints: DataFrame) -> DataFrame:
    """prints (distinct fp, and other columns) with root, the least fingerprint that fp reaches by links."""
    roots = components(near_links(prints.select("fp")))
    return prints.join(roots, prints.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, one row per row of docs."""
    fps = checkpointed(fingerprints(docs))
    prints = checkpointed(rooted(checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))))
    least = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    named = looked_up(prints.select("fp", "root"), "root", least).select("fp", "component_id")
    return looked_up(fps.select("doc_id", "fp"), "fp", named).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least id; columns as they were.

    Rows with a null id stay only in groups without any other; of rows that repeat the id, one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_k"))
    prints = checkpointed(fingerprints(docs).groupBy("fp").agg(first.alias("x")))
    id_, key, n = free(docs, "__wf_id", "__wf_k", "__wf_n")
    chosen = rooted(prints).groupBy("root").agg(F.min("x").alias("x")).select(F.coalesce("x.doc_id", F.lit(-(2**62))).alias(id_), F.col("x._k").alias(key))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))), key: F.xxhash64("text")})
    kept = keyed.join(chosen, [id_, key], "left_semi").select(*docs.columns, id_, key)
    same = Window.partitionBy(id_, key).orderBy(id_)  # on the join's own partitioning: no further shuffle
    return kept.withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).drop(n, id_, key)
