"""Repeated windows of a corpus as a Spark job; suffix_array.py and suffix_tree.py give the alphabets and refinements.

A window is `window` symbols in a row of one document. To find which windows also start earlier without moving every
position, the job works from anchors, as both methods refine small groups of suffixes at a time:

1. Whole copies of a text are found by a digest and need no more. In each other document the grams (`gram` symbols) that are least by a hash in some window are its anchors; equal windows
   have equal anchors. Anchors are dealt by hash, packed by task, and those that occur once are forgotten.
2. Each remaining anchor carries its context, all windows around it, to the group of its gram. A task sends a context
   once: later documents of the same task are settled there, so thousands of copies cost one row a task.
3. Groups are refined (the named methods): suffixes get equal names if and only if their first `window` symbols are
   equal, and the least origin of each name decides which windows are repeats.
4. The repeats return to their documents as ranges.

What is dealt goes to one partition for each PART_BYTES of text (no fewer than the session's shuffle partitions), so
that a task gathers the same amount at any size of the corpus.

Grams that a large share of documents hold (found on a sample of documents, which changes how work is dealt and never
what is found) would make a hot group; their contexts are sent by whole windows instead, a longer key that splits
them, again once a task. The table of such grams has at most (anchors a document) / HOT_SHARE entries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, checkpointed, out, partitions_for, slabs, with_row_key

SLAB_BYTES = 24 << 20  # of text; packed text counts double
PART_BYTES = 32 << 20  # of text behind a partition that one task gathers
CHUNK_CONTEXTS = 20_000
SAMPLE_ONE_IN = 64
HOT_SHARE, HOT_LEAST = 0.005, 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Alphabet:
    """How texts become symbols.

    split(text) gives the pieces that cut() and codes() take; codes: one unsigned 64-bit code a symbol;
    cut(pieces, start, stop): the bytes of a stretch; names(contexts): an integer for each window of each context,
    equal for equal windows, and how many windows each context has.
    """

    window: int
    gram: int
    split: Callable
    codes: Callable
    cut: Callable
    names: Callable
    #: Whether an earlier start in the same document counts as earlier.
    within: bool


def zipped(rows: DataFrame) -> DataFrame:
    """doc_id, _r, z: the text as a Zstandard frame, which halves what is shuffled."""
    schema = arrow_type("doc_id long, _r long, z binary")

    def task(batches):
        packer = zstandard.ZstdCompressor(level=6)
        for b in batches:
            yield out(schema, b.column(0), b.column(1), [packer.compress(t.encode("utf-8", "replace")) for t in b.column(2).to_pylist()])

    return rows.select("doc_id", "_r", "text").mapInArrow(task, "doc_id long, _r long, z binary")


def texts_of(column) -> list[str]:
    reader = zstandard.ZstdDecompressor()
    return [reader.decompress(z).decode("utf-8") for z in column.to_pylist()]


def to_bytes(batch: pa.RecordBatch) -> bytes:
    """An Arrow stream of one batch, compressed: many small rows travel as one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least (or largest) of each `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return best(x[:-rest], x[rest:]) if rest else x


def grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` neighbouring symbols."""
    n = len(codes) - gram + 1
    h, power, have, at = np.zeros(n, np.uint64), codes, 1, 0
    bits = gram
    scale = _BASE
    while bits:  # binary powers: hashes of 1, 2, 4 ... symbols are put together
        if bits & 1:
            h = h * scale + power[at : at + n]
            at += have
        bits >>= 1
        if bits:
            power = power[:-have] * scale + power[have:]
            have *= 2
            scale = scale * scale + np.uint64(have)
    return mixed(h)


def anchors(codes: np.ndarray, a: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window."""
    if len(codes) < a.window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = grams(codes, a.gram)
    width = a.window - a.gram + 1
    least = sliding(h, width, np.minimum)
    # A gram is an anchor if it equals the largest of the window minima over it.
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    return at, h[at]


def frequent_grams(docs: DataFrame, a: Alphabet) -> np.ndarray:
    """Sorted hashes of grams in at least HOT_SHARE of a sample of documents."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE_ONE_IN)) == 0).select("text")
    schema = arrow_type("h long, n long")

    def task(batches):
        for t in slabs(batches, "text", SLAB_BYTES):
            found = [np.unique(anchors(a.codes(a.split(x)), a)[1]) for x in t.column(0).to_pylist() if x]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield out(schema, h.view(np.int64), n)
        yield out(schema, np.array([0], np.int64), np.array([0], np.int64))

    least = max(HOT_LEAST, HOT_SHARE * sample.count())
    rows = sample.mapInArrow(task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def repeated_anchors(docs: DataFrame, a: Alphabet, hot, parts: int) -> DataFrame:
    """_r and positions (array) of anchors, not frequent ones, that occur at least twice in the corpus."""
    packed = pa.schema([("part", pa.int32()), ("rows", pa.binary())])

    def pack(batches):
        for t in slabs(batches, "z", SLAB_BYTES // 2):
            keys, hashes, places, counts = [], [], [], []
            for d, r, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), texts_of(t.column(2)), strict=True):
                if d is None:
                    continue
                at, h = anchors(a.codes(a.split(x)), a)
                cold = ~member(h, hot.value)
                keys.append(r)
                hashes.append(h[cold])
                places.append(at[cold])
                counts.append(int(cold.sum()))
            if not keys:
                continue
            h, at, row = np.concatenate(hashes), np.concatenate(places).astype(np.int64), np.repeat(np.arange(len(keys)), counts)
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")  # documents stay together within a part
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            keys = np.array(keys, np.int64)
            for p in range(parts):
                o = order[ends[p] : ends[p + 1]]
                if len(o):
                    own, first = np.unique(row[o], return_index=True)
                    step = np.diff(at[o], prepend=0)
                    step[first] = at[o][first]
                    # 32 bits of the hash beside the part leave few chance candidates in a part; refinement is exact.
                    code = ((h[o] // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    start = np.zeros(len(o), bool)
                    start[first] = True
                    body = pa.record_batch({"code": code, "step": step.astype(np.int32), "start": start})
                    yield out(packed, [p], [to_bytes(body) + keys[own].tobytes() + len(own).to_bytes(8, "little")])

    def unpack(batches):
        schema = pa.schema([("_r", pa.int64()), ("at", pa.list_(pa.int32()))])
        part, key, at, code = [], [], [], []
        for b in batches:
            for p, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = int.from_bytes(raw[-8:], "little")
                body = from_bytes(raw[: -8 * (n + 1)])
                which = np.cumsum(body.column("start").to_numpy()) - 1
                key.append(np.frombuffer(raw[-8 * (n + 1) : -8], np.int64)[which])
                step = body.column("step").to_numpy().astype(np.int64)
                total = np.cumsum(step)
                first = np.flatnonzero(body.column("start").to_numpy())
                at.append(total - (total[first] - step[first])[which])
                code.append(body.column("code").to_numpy().astype(np.uint64))
                part.append(np.full(len(code[-1]), p))
        if not key:
            return
        key, at, code, part = map(np.concatenate, (key, at, code, part))
        code = code | (part.astype(np.uint64) << np.uint64(32))
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        kept = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        kept = kept[np.lexsort((at[kept], key[kept]))]
        ids, starts = np.unique(key[kept], return_index=True)
        offsets = np.concatenate([starts, [len(kept)]]).astype(np.int32)
        for i in range(0, len(ids), 4096):
            o = offsets[i : i + 4097]
            lists = pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(at[kept[o[0] : o[-1]]].astype(np.int32)))
            yield out(schema, ids[i : i + 4096], lists)

    dealt = docs.select("doc_id", "_r", "z").mapInArrow(pack, "part int, rows binary").repartitionById(parts, "part")
    return dealt.mapInArrow(unpack, "_r long, at array<int>").groupBy("_r").agg(F.flatten(F.collect_list("at")).alias("at"))


CONTEXT = "key long, doc_id long, _r long, at long, symbols int, context binary"
PACKED = "part int, rows binary"


def contexts(joined: DataFrame, a: Alphabet, hot, parts: int) -> DataFrame:
    """Contexts of the repeated anchors of joined (doc_id, _r, z, at), in packed rows (part, rows of CONTEXT).

    A row with a null context is settled: its range (at, symbols) is wholly repeated, because an earlier document of
    the same task has the same context.
    """
    schema, packed = arrow_type(CONTEXT), arrow_type(PACKED)
    reach = a.window - a.gram

    def dealt(rows: list):
        key, *rest = zip(*rows, strict=True)
        key = np.array([k & (2**64 - 1) for k in key], np.uint64)
        batch = out(schema, key.view(np.int64), *rest)
        part = (mixed(key) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            if ends[p] < ends[p + 1]:
                yield out(packed, [p], [to_bytes(batch.take(pa.array(order[ends[p] : ends[p + 1]])))])

    def task(batches):
        for t in slabs(batches, "z", SLAB_BYTES // 2):
            t = t.sort_by("doc_id")
            seen: dict = {}
            rows: list = []
            for d, r, x, hits in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), texts_of(t.column(2)), t.column(3).to_pylist(), strict=True):
                if d is None or not (hits or len(hot.value)):
                    continue
                pieces = a.split(x)
                codes = a.codes(pieces)
                n = len(codes)
                if n < a.window:
                    continue
                at, h = anchors(codes, a)
                chosen = np.isin(at, np.asarray(hits, np.int64)) if hits else np.zeros(len(at), bool)
                # Keys: the anchor's hash, or a hash of the whole window for frequent grams (None until then).
                stretches = [(max(0, p - reach), min(n, p + a.window), k) for p, k in zip(at[chosen].tolist(), h[chosen].tolist(), strict=True)]
                frequent = at[member(h, hot.value)].tolist()
                if frequent:
                    stretches += [(s, s + a.window, None) for s in sorted({s for p in frequent for s in range(max(0, p - reach), min(p, n - a.window) + 1)})]
                for low, high, key in stretches:
                    context = a.cut(pieces, low, high)
                    first = seen.setdefault(context, (d, low))
                    if first[0] < d or (a.within and first[0] == d and first[1] < low):
                        rows.append((r ^ low, d, r, low, high - low, None))
                    else:
                        rows.append((xxhash.xxh64_intdigest(context) if key is None else key, d, r, low, high - low, context))
            if rows:
                yield from dealt(rows)

    return joined.select("doc_id", "_r", "z", "at").mapInArrow(task, PACKED)


def repeats(dealt: DataFrame, a: Alphabet, parts: int) -> DataFrame:
    """doc_id, _r, start, stop: ranges of symbols covered by windows that also start earlier."""
    schema = arrow_type("doc_id long, _r long, start int, stop int")

    def settle(rows: pa.Table):
        """One chunk: whole groups of contexts with the same key."""
        doc, key_row, at, size = (rows.column(c).to_numpy() for c in ("doc_id", "_r", "at", "symbols"))
        group = rows.column("key").to_numpy()
        classes: dict = {}
        cls = np.array([classes.setdefault(x, len(classes)) for x in zip(group.tolist(), rows.column("context").to_pylist(), strict=True)], np.int64)
        order_of_doc = np.unique(doc, return_inverse=True)[1].astype(np.int64)
        origin = (order_of_doc << 32) + (at if a.within else 0)
        first = np.full(len(classes), np.iinfo(np.int64).max)
        np.minimum.at(first, cls, origin)
        class_group = np.zeros(len(classes), np.int64)
        class_group[cls] = group
        _, group_no, n_classes = np.unique(class_group, return_inverse=True, return_counts=True)
        alone = n_classes[group_no] == 1
        easy = alone[cls]
        late = easy & (origin > first[cls])
        yield out(schema, doc[late], key_row[late], at[late].astype(np.int32), (at + size)[late].astype(np.int32))
        hard = np.flatnonzero(~alone)
        if not len(hard):
            return
        contexts_ = list(classes)
        names, windows = a.names([contexts_[c][1] for c in hard])
        offset = np.concatenate([[0], np.cumsum(windows)])
        place = np.arange(offset[-1]) - np.repeat(offset[:-1], windows)
        here = np.repeat(first[hard], windows) + (place if a.within else 0)
        least = np.full(int(names.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, names, here)
        number = np.full(len(classes), -1)
        number[hard] = np.arange(len(hard))
        mine = np.flatnonzero(~easy)
        k = number[cls[mine]]
        n = windows[k]
        flat = np.repeat(offset[k], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        own = np.repeat(origin[mine], n) + (place[flat] if a.within else 0)
        row = np.repeat(mine, n)
        bad = least[names[flat]] < own
        row, start = row[bad], at[row[bad]] + place[flat[bad]]
        if len(row):  # neighbouring windows of a row become one range
            cut = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
            last = np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(row) - 1]])
            yield out(schema, doc[row[cut]], key_row[row[cut]], start[cut].astype(np.int32), (start[last] + a.window).astype(np.int32))

    def task(batches):
        held = []
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                b = from_bytes(raw)
                done = b.filter(b.column("context").is_null())
                if done.num_rows:
                    at = done.column("at").to_numpy()
                    yield out(schema, done.column("doc_id").combine_chunks(), done.column("_r").combine_chunks(), at.astype(np.int32), (at + done.column("symbols").to_numpy()).astype(np.int32))
                held.append(b.filter(b.column("context").is_valid()))
        if not held:
            return
        rows = pa.concat_tables(held)
        keys = rows.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = 0
        while at < len(keys):
            stop = min(at + CHUNK_CONTEXTS, len(keys))
            stop = int(np.searchsorted(keys, keys[stop - 1], side="right"))
            yield from settle(rows.take(pa.array(order[at:stop])))
            at = stop

    return dealt.repartitionById(parts, "part").mapInArrow(task, "doc_id long, _r long, start int, stop int")


def whole_copies(rows: DataFrame) -> DataFrame:
    """_r and copied (ids) of rows whose whole text also is in a row of a smaller id: all their windows start earlier there."""
    ids = rows.where("doc_id is not null").select("_r", "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    first = ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # A key of its own on this side gives both sides an exchange, so that adaptive execution can split a frequent text.
    first = first.select(F.concat("sha", F.unhex(F.lit("00"))).alias("key"), "first")
    return checkpointed(ids.withColumn("key", F.concat("sha", F.unhex(F.lit("00")))).join(first, "key").where("doc_id > first").groupBy("_r").agg(F.collect_set("doc_id").alias("copied")))  # one id, but for a chance collision


def covered(docs: DataFrame, a: Alphabet) -> DataFrame:
    """doc_id, z (see texts_of) and ranges (array of start, stop; null if none) for every row of docs, whose null texts are empty.

    Whole copies leave at the start with the range (-1, -1): their windows are never the earliest. The joins on _r share
    one exchange of the other documents; what they bring is taken for rows of the same id only, as _r is a hash (more
    candidates from another row would change nothing).
    """
    rows = with_row_key(docs).select(F.col("doc_id").cast("long"), F.col("_k").alias("_r"), "text")
    marked = zipped(rows).join(whole_copies(rows), "_r", "left")
    copy = F.coalesce(F.array_contains("copied", F.col("doc_id")), F.lit(False))
    live = marked.where(~copy).select("doc_id", "_r", "z")
    hot = docs.sparkSession.sparkContext.broadcast(frequent_grams(rows, a))
    parts = partitions_for(docs, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART_BYTES)
    joined = live.join(repeated_anchors(live, a, hot, parts), "_r", "left")
    found = repeats(contexts(joined, a, hot, parts), a, parts).groupBy("_r").agg(F.collect_list(F.struct("doc_id", "start", "stop")).alias("ranges"))
    whole = F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"))).alias("ranges")
    mine = F.transform(F.filter("ranges", lambda x: x["doc_id"] == F.col("doc_id")), lambda x: F.struct(x["start"], x["stop"])).alias("ranges")
    return live.join(found, "_r", "left").select("doc_id", "z", mine).unionAll(marked.where(copy).select("doc_id", "z", whole))


def mask(n: int, ranges, a: Alphabet) -> np.ndarray:
    """True for each of n symbols in a range."""
    edge = np.zeros(n + 1, np.int64)
    for x in ranges or ():
        if x["start"] < 0:
            return np.full(n, n >= a.window)
        edge[x["start"]] += 1
        edge[x["stop"]] -= 1
    return np.cumsum(edge[:n]) > 0
