"""Each corpus operator against a brute-force version on small tables with nulls, ties, repeats, copies and empty input."""

import hashlib
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.oracle import DATA, rows_of, sql_rows
from wayfold.llm import decontamination, packing, quality, repeats, secret_scan, simhash, suffix_array, suffix_tree, token_counts, topk, toxicity
from wayfold.llm.queries import ORACLE_SQL, QUERIES

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(9000))
PASSAGE = " ".join(f"common{i}" for i in range(60))
ROWS = [
    (0, "alpha beta gamma " + PASSAGE + " tail one"), (1, "other words here " + PASSAGE + " and more"), (2, "alpha beta gamma " + PASSAGE + " tail one"), (3, None), (4, ""), (5, "short"),
    (6, LONG), (7, LONG + " end"), (7, LONG + " end"), (None, PASSAGE), (9, "na na " * 60), (10, "é ß İ \x0b tab\tend " + PASSAGE[:200]), (12, "password = hunter2secret AKIA" + "A" * 20 + " deadbeef" * 4),
]


@pytest.fixture
def frequent(monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLE_ONE_IN", 1)
    monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    monkeypatch.setattr(repeats, "HOT_SHARE", 0.0)


def brute_bytes(rows):
    found = []
    for d, t in rows:
        raw = (t or "").encode()
        earlier = {o[s : s + 50] for e, u in rows if d is not None and e is not None and e < d for o in [(u or "").encode()] for s in range(len(o) - 49)}
        gone = [False] * len(raw)
        for s in range(len(raw) - 49):
            if raw[s : s + 50] in earlier:
                gone[s : s + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        found.append((d, len(raw), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def brute_words(rows):
    found = []
    for d, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        if d is not None:
            seen = {tuple(o[s : s + 20]) for e, u in rows if e is not None and e < d for o in [(u or "").encode().split()] for s in range(len(o) - 19)}
            for s in range(len(words) - 19):
                w = tuple(words[s : s + 20])
                if w in seen:
                    gone[s : s + 20] = [True] * 20
                seen.add(w)
        found.append((d, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    return sorted(found, key=repr)


def test_suffix_array(docs_of):
    assert sorted(map(tuple, suffix_array.removed_bytes(docs_of(ROWS)).collect()), key=repr) == brute_bytes(ROWS)


def test_suffix_array_frequent_grams(docs_of, frequent):
    assert sorted(map(tuple, suffix_array.removed_bytes(docs_of(ROWS)).collect()), key=repr) == brute_bytes(ROWS)


def test_suffix_tree(docs_of):
    assert sorted(map(tuple, suffix_tree.removed_words(docs_of(ROWS)).collect()), key=repr) == brute_words(ROWS)


def test_suffix_tree_frequent_grams(docs_of, frequent):
    assert sorted(map(tuple, suffix_tree.removed_words(docs_of(ROWS)).collect()), key=repr) == brute_words(ROWS)


def test_repeats_over_more_partitions(docs_of, monkeypatch):
    """Partitions follow the bytes of the corpus; how many there are changes no row."""
    monkeypatch.setattr(repeats, "PART_BYTES", 4096)
    assert sorted(map(tuple, suffix_array.removed_bytes(docs_of(ROWS)).collect()), key=repr) == brute_bytes(ROWS)
    assert sorted(map(tuple, suffix_tree.removed_words(docs_of(ROWS)).collect()), key=repr) == brute_words(ROWS)


def test_bucket_numbers_group_equal_windows():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 90).tolist()) for _ in range(20)]
    texts += [texts[0][5:80], texts[1]]
    names, n = suffix_array.names(texts)
    windows = [t[s : s + 50] for t, k in zip(texts, n) for s in range(k)]
    assert len(set(zip(names.tolist(), windows))) == len(set(windows)) == len(set(names.tolist()))


def test_bucket_pointers_of_periodic_and_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [b"a" * 300, b"ab" * 100, b"ab" * 60, b"abc" * 50, bytes(rng.integers(97, 99, 5000).tolist()), bytes(rng.integers(97, 123, 3000).tolist())]
    texts += [texts[4][1000:2000], texts[5][5:900], bytes(60)]
    for batch in (1, 64, 1 << 17):
        monkeypatch.setattr(suffix_array, "BATCH", batch)
        names, n = suffix_array.names(texts)
        windows = [t[s : s + 50] for t, k in zip(texts, n) for s in range(k)]
        assert len(set(zip(names.tolist(), windows))) == len(set(windows)) == len(set(names.tolist()))


def test_nodes_are_as_deep_as_repeats():
    words = [f"w{i}" for i in range(40)]
    order, depth = suffix_tree.subtree(np.array([[*range(1, 33)], [*range(1, 31), 90, 91], [2, *range(2, 33)]], np.uint32))
    assert order.tolist() == [0, 1, 2] and depth.tolist() == [30, 0]
    names, n = suffix_tree.names([" ".join(words[:32]).encode(), " ".join(words[4:30]).encode(), " ".join(["x"] * 25).encode()])
    windows = [c[s : s + 20] for c in (words[:32], words[4:30], ["x"] * 25) for s in range(len(c) - 19)]
    assert n.tolist() == [13, 7, 6] and [[a == b for b in names] for a in names] == [[a == b for b in windows] for a in windows]


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (suffix_array.removed_bytes(none), suffix_tree.removed_words(none), simhash.groups(none), secret_scan.find_secrets(none), token_counts.count_tokens(none, PIECE_BPE), packing.pack(none, WORD_BPE), toxicity.rate(none, labels), quality.grade(none, labels), decontamination.contaminated(none, spark.createDataFrame([], "item_id long, text string"))):
        assert found.collect() == []
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_simhash(docs_of):
    def plain(t):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    rows = ROWS + [(20 + i, LONG.replace(f"w{i}x{i}", "changed", 3)) for i in range(8)]
    got = simhash.groups(docs_of(rows)).collect()
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, root)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = [r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()]
    assert sorted(kept) == sorted(least.values())


def test_secret_scan(docs_of):
    text = 'api_key: "abcdef123" secret:token token=abc é AKIA' + "Z" * 15 + "\nAKIA" + "Q" * 16 + " 0123456789abcdef01234567"
    spans = secret_scan.base_spans(text)
    for kind, pattern, ok in (("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        assert [(s, e) for s, e, k in spans if k == kind] == [m.span() for m in re.finditer(pattern, text) if ok(m)]
    code = 'DB = "Xk29dLq81mZp"\nsigning_key = DB\nauth_token_value = "qW8" + "zR5tY7uI1o"\nname = "not a secret at all"\n'
    assert [code[s:e] for s, e, _ in secret_scan.named_spans(code)] == ["Xk29dLq81mZp", 'qW8" + "zR5tY7uI1o']
    rows = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(ROWS)).collect()}
    assert rows[3].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[3].spans == ""
    assert (rows[12].n_assign, rows[12].n_access) == (1, 1)
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs_of(ROWS)).collect()}
    assert masked[3] is None and "hunter2secret" not in masked[12] and masked[6] == LONG


def test_token_counts(docs_of):
    vocab = token_counts.vocabulary(PIECE_BPE)
    full = Tokenizer(models.Unigram(vocab + [(f"<0x{b:02X}>", 0.0) for b in range(256)], unk_id=0, byte_fallback=True))
    full.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = ROWS + [(30, " a  b"), (31, "<unk> x<unk>"), (32, "日本語 ☃☃ x☃"), (33, "▁a ▁"), (34, "\t\n a\n"), (35, "one\n\ntwo\n"), (36, "☃<unk> <unk>☃")]
    got = {(r.doc_id, r.n_chars): r.n_tokens for r in token_counts.count_tokens(docs_of(rows), PIECE_BPE).collect()}
    for d, t in rows:
        assert got[d, len(t or "")] == (len(full.encode(t).ids) if t else 0), (d, t)


def test_packing(docs_of):
    full = Tokenizer.from_file(WORD_BPE)
    rows = [(d, t) for d, t in ROWS if d != 7] + [(40, "it's <|endoftext|>. x 12. ΑΣ,")]
    got = packing.pack(docs_of(rows), WORD_BPE, keep_ids=True).toPandas()
    for d, t in rows:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        mine = got[got.doc_id.isna() if d is None else got.doc_id == d].sort_values("start")
        assert b"".join(mine.ids) == ids.tobytes() and set(mine.doc_tokens) == {len(ids)}
        assert [zlib.crc32(x) for x in mine.ids] == mine.ids_crc32.tolist()
        assert mine.start.tolist() == np.concatenate([[0], mine.length.cumsum()[:-1]]).astype(int).tolist()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = int(s.length.sum())
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and total <= 4096 and total & (total - 1) == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(60)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (None, [1.0] * 6), (550, [1e12, 1.0]), (600, [])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    vecs = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in vecs if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q)[:5]
        want += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [(7, 3), (40, 2), (1000, 1000)])
def test_top_k_blocks_change_no_result(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * rng.exponential()).tolist()) for i in range(151)] + [(200, [1e30] * 3), (250, [-1e30, 2.0]), (251, [1e12, 3.0]), (252, [1e12, 3.5]), (300, [0.0] * 20), (300, [0.1] * 20)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q_block", F.lit(1)).withColumn("norm", F.lit("x")), block=size[0], query_block=size[1]).collect()))
    want = []
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, u)), i) for i, u in rows if i != q)
            want += [(q, -s, i) for s, i in scores[:5]]
    # a repeated query id gets the best five over both of its rows
    by = {}
    for q, s, i in want:
        by.setdefault(q, []).append((-s, i))
    want = sorted((q, r, i, max(-(2**63), min(2**63 - 1, -s))) for q, x in by.items() for r, (s, i) in enumerate(sorted(x)[:5], 1))
    assert got == want


def test_packing_spreads_equal_rows(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack(rows, WORD_BPE).toPandas()
    assert len(got) == 20_000 and set(got.doc_tokens) == {1}
    sizes = got.groupby(got.sequence_id // 2**32).size()
    assert len(sizes) == 20 and sizes.max() < 2 * packing.GROUP_DOCS


def test_simhash_large_groups(docs_of):
    rows = [(i, LONG) for i in range(300)] + [(300 + i, LONG + f" end{i}") for i in range(60)] + [(400 + i, f"lone text number {i} of {i * 7} and {i * i}") for i in range(40)]
    got = {r.doc_id: r.component_id for r in simhash.groups(docs_of(rows)).collect()}
    assert set(got) == {d for d, _ in rows} and all(got[i] == 0 for i in range(300))
    assert len(simhash.keep_one(docs_of(rows)).collect()) == len(set(got.values()))


def test_decontamination(spark, docs_of):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "klmn" for b in "aeiou" for c in "prst"]
    items = [" ".join(rng.choice(words, 30)) for _ in range(6)]
    edited = items[1].split()
    edited[7:9] = ["new"]
    edited[20] = "other"
    filler = lambda: " ".join(rng.choice(words, 200))
    rows = [(0, filler()), (1, filler() + " " + items[0].upper() + ". " + filler()), (2, filler() + " " + " ".join(edited)), (3, None), (4, ""), (5, items[2]), (6, " ".join(items[3].split()[:9]) + " " + filler())]
    benchmark = spark.createDataFrame([*enumerate(items), (None, items[4]), (8, None), (9, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs_of(rows), benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (5, 2)} and got[1, 0] == 1.0 and 0.5 < got[2, 1] < 1
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs_of(rows), benchmark).collect()) == [0, 3, 4, 6]


def test_alignment_against_plain():
    rng = np.random.default_rng(7)
    for _ in range(30):
        a, b = rng.integers(0, 4, 14).astype(np.uint64), rng.integers(0, 4, 9).astype(np.uint64)
        h = np.zeros((len(b) + 1, len(a) + 1))
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (decontamination.MATCH if a[j - 1] == b[i - 1] else decontamination.MISMATCH), h[i - 1, j] + decontamination.GAP, h[i, j - 1] + decontamination.GAP)
        assert decontamination.align(a, b)[0] == pytest.approx(h.max())


def test_ordinal_models_on_held_out_rows(spark):
    d = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    t = toxicity.rate(docs, train).toPandas().merge(held, on="doc_id")
    assert (t.is_toxic == (t.toxic == 1)).mean() > 0.95
    q = quality.grade(docs, train).toPandas().merge(held, on="doc_id")
    assert (q.keep == (q.quality == 1)).mean() > 0.95


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    d = f"{DATA}/sf0.001"
    assert rows_of(QUERIES[name](spark, d)) == sql_rows(ORACLE_SQL[name], d)


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, d)
        assert docs.columns == before.columns, name
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, d).toPandas()
    assert isinstance(packed, pd.DataFrame) and set(packed.doc_id) == left


def test_item_with_many_copies_keeps_its_seeds(spark, docs_of):
    item = " ".join(f"leak{i}" for i in range(25))
    rows = [(i, f"before{i} {item} after{i}") for i in range(60)]
    found = decontamination.contaminated(docs_of(rows), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [i for i, _ in rows]


@pytest.mark.parametrize("exact", [0, 1])
def test_many_edited_copies_of_an_item_are_all_found(spark, docs_of, exact):
    words = [f"word{i}" for i in range(38)]
    edited = " ".join([*words[:30], "other", *words[31:]])
    rows = [(i, f"before{i} {edited} after{i}") for i in range(1000)] + [(1000 + i, " ".join(words)) for i in range(exact)] + [(2000, "word1 word2 word3 word4 word5 and no more")]
    benchmark = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.contaminated(docs_of(rows), benchmark).collect()}
    assert set(found) == set(range(1000 + exact))
    # 4/3 of half the item's words may be broken pairs, three more are seeds; the two pairs that the edit broke are the rarest ones.
    assert all((r.score, r.start_word, r.end_word, r.n_seeds) == ((1.0, 0, 38, 28) if r.doc_id >= 1000 else (36.5 / 38, 1, 39, 26)) for r in found.values())
    assert [r.doc_id for r in decontamination.drop_contaminated(docs_of(rows), benchmark).collect()] == [2000]


def all_pairs(rows, items, least=decontamination.LEAST_SCORE):
    """Every document and item whose alignment reaches the least score, without seeds: (doc, item, score)."""
    found = []
    for d, t in rows:
        ids = decontamination.word_ids([t])[0]
        for i, u in items:
            item = decontamination.word_ids([u])[0]
            if i is not None and len(item) > 1:
                value = decontamination.align(ids, item)[0]
                if value / len(item) >= least and value > 1:
                    found.append((d, i, value / len(item)))
    return sorted(found, key=repr)


def edited(rng, words, kind):
    """A copy of words with every third one changed, one word put after each, or cut, swapped and filled at random."""
    if kind == 0:
        return [w if k % 3 != 1 else f"x{rng.integers(1e6)}" for k, w in enumerate(words)]
    if kind == 1:
        return [x for w in words for x in (w, f"y{rng.integers(1e6)}")]
    made = list(words[int(rng.integers(4)) :])
    for _ in range(int(rng.integers(1, max(2, len(words) // 3)))):
        at = int(rng.integers(len(made)))
        made[at : at + int(rng.integers(2))] = [rng.choice(words)] * int(rng.integers(2))
    return made


def test_decontamination_equals_all_pairs(spark, docs_of):
    rng = np.random.default_rng(11)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.integers(300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([2, 3, 4, 5, 6, 8, 9, 12, 15, 20, 20, 30, 41])] + [(20, "what is two plus"), (20, "what is two plus"), (21, "alone"), (22, ""), (23, None), (None, "the of the of the")]
    rows = [(d, " ".join(word() for _ in range(60))) for d in range(40)]
    for kind in range(12):
        for i, t in items[3:13]:
            rows.append((len(rows), " ".join([word() for _ in range(9)] + edited(rng, t.split(), kind) + [word() for _ in range(9)])))
    rows += [(900, "So: what is TWO plus?"), (901, "what is two"), (902, None), (903, ""), (None, items[9][1]), (904, items[9][1]), (904, items[9][1]), (905, " ".join([items[12][1]] * 300))]
    got = [(r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = all_pairs(rows, items)
    assert sorted(got, key=repr) == want and len(want) > 90


def test_short_items_are_aligned_like_all_others(spark, docs_of):
    items = [(0, "alpha beta gamma delta"), (1, "one two"), (2, "red green blue"), (3, "lonely")]
    rows = [(0, "x alpha beta zeta delta y"), (1, "one and two"), (2, "one"), (3, "red blue"), (4, "green x y blue"), (5, "gamma delta"), (6, "lonely"), (7, "beta x x delta"), (8, "delta gamma beta alpha")]
    rows += [(100 + i, "the one thing of alpha") for i in range(50)]
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i): s for d, i, s in all_pairs(rows, items)}
    assert got == {(0, 0): 0.625, (1, 1): 0.75, (3, 2): 0.5, (5, 0): 0.5}
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"w{rng.integers(12)}" for _ in range(2 + i % 4))) for i in range(40)]
    rows = [(d, " ".join(f"w{rng.integers(12 + d)}" for _ in range(12))) for d in range(80)]
    got = [(r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=repr) == all_pairs(rows, items) and len(got) > 50


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"some text number {i} with words that differ {i * 7}", i) for i in range(6)] + [(9, "some text number 5 with words that differ 35", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __wf_id long").selectExpr("*", "__wf_id as __WF_K", "'n' as __wf_n", "1 as __wf_n_", "2.5 as __wf_toxicity")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()} and 9 not in {r.doc_id for r in kept.collect()}
    left = toxicity.drop_toxic(docs, labels, threshold=1.0)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(map(tuple, docs.collect()))


def test_repeats_of_the_given_documents(spark):
    """All of sf0.001 by one dictionary of first holders."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    for query, width, split in ((suffix_array.removed_bytes, 50, lambda t: t.encode()), (suffix_tree.removed_words, 20, lambda t: tuple(t.encode().split()))):
        first, want = {}, {}
        for d, t in rows:
            x, gone = split(t), set()
            for at in range(len(x) - width + 1):
                origin = first.setdefault(hash(x[at : at + width]), (d, at))
                if origin[0] < d or width == 20 and origin < (d, at):
                    gone.update(range(at, at + width))
            kept = [x[i : i + 1] for i in range(len(x)) if i not in gone]
            want[d] = (len(gone), hashlib.sha256(b"".join(kept) if width == 50 else b" ".join(w for k in kept for w in k)).hexdigest())
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in query(docs).collect()} == want


def test_decontamination_recall_on_the_given_tables(spark):
    d = f"{DATA}/sf0.001"
    docs, benchmark = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet").where("item_id < 60")
    want = all_pairs([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs, benchmark).collect()) == sorted(want)


def test_parts_of_the_test_set_change_no_result(spark, docs_of, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(9)]
    rows = [(i, f"a b {t} c d") for i, t in items[:6]] + [(50, "a b c d")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "PART_WORDS", 30)
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs_of(rows), benchmark).collect()) == [(i, i, 1.0) for i in range(6)]
    assert [r.doc_id for r in decontamination.drop_contaminated(docs_of(rows), benchmark).collect()] == [50]
    assert decontamination.contaminated(docs_of(rows), benchmark.limit(0)).collect() == []


def test_alignment_window_holds_long_insertions(spark, docs_of):
    words = [f"word{i}" for i in range(40)]
    inside = " ".join([*words[:20], *(f"added{i}" for i in range(30)), *words[20:]])
    found = decontamination.contaminated(docs_of([(0, inside)]), spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")).collect()
    assert [(r.score, r.start_word, r.end_word) for r in found] == [(25 / 40, 0, 70)]


VALUE = "qW8zR5tY7uI1o"
FORMS = [
    'signing_key: str = "@"', 'const signingKey: string = "@"', 'let api_key: &str = "@";', "static API_KEY: &'static str = \"@\";", 'val signingKey: String? = "@"', 'signing_key: Optional[str] = "@"', 'signing_key: str | None = "@"', 'signing_key: dict[str, list[int]] = "@"', 'signing_key:str="@"',
    'let signing_key: std::string::String = "@"', 'var signingKey string = "@"', 'char signing_key[] = "@";', 'signing_key            = "@"', 'signing_key\t=\t"@"', "signing_key \t :\t  '@'", "x" * 70 + '.signing_key = "@"', "app." * 40 + 'signing.key: "@"', 'config["signing_key"] = "@"',
    "os.environ['SIGNING_KEY'] = '@'", 'cfg["db"][ "signing_key" ] = "@"', 'signing_keys["db"] = "@"', 'signing_keys[0] = "@"', 'load()["signing_key"] = "@"', 'signing_key = """@"""', "signing_key: str = \'\'\'\n@\n\'\'\'", 'signing_key = b"@"', 'log: signing_key="@"', 'x = 1; signing_key: str = "a@" + "b"',
]


@pytest.mark.parametrize("form", FORMS)
def test_secret_forms(form):
    text = "first: line = of text\n" + form.replace("@", VALUE) + "\nother: line\n"
    (start, end, _), = secret_scan.named_spans(text)
    assert VALUE in text[start:end] and len(text[start:end].strip()) <= len(VALUE) + 7
    # base spans stay as they are, whatever the lexer adds
    spans = secret_scan.base_spans(text)
    assert spans == [(m.start(), m.end(), "assign") for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 6] and set(secret_scan.spelled(spans).split(",")) - {""} <= set(secret_scan.scan(text)[4].split(","))
    assert VALUE not in secret_scan.masked(text, "[SECRET]")


def spans_of(code):
    return [code[s:e] for s, e, _ in secret_scan.named_spans(code)]


def test_constants_concatenations_and_markup():
    assert spans_of(f'signing_key = LATE\nLATE = "{VALUE}"') == [VALUE]
    assert spans_of('a = "qW8zR5"\nauth_key = a + b\nb = "tY7uI1o"') == ["qW8zR5", "tY7uI1o"]
    assert spans_of(f'signing_key = "{VALUE[:6]}" + rest\nrest = \'{VALUE[6:]}\'') == [VALUE[:6], VALUE[6:]]
    assert spans_of(f"<config><signing-key id='1'>{VALUE}</signing-key><note>{VALUE}</note></config>") == [VALUE]
    assert spans_of(f'signing_key = f"{VALUE}"') == [VALUE]
    assert spans_of('signing_key = other\nother = third\nthird = signing_key') == []
    assert spans_of(f'K = "{VALUE}"\nx = K\nK = "plain words"\nsigning_key = x\n') == [VALUE]
    text = " ".join(f'signing_key="{VALUE}{i}" token="{VALUE}{i}"' for i in range(20_000))
    began = time.perf_counter()
    found = secret_scan.scan(text)
    assert found[0] == 20_000 and found[5] == 20_000 and time.perf_counter() - began < 10
    chain = "\n".join(f"a{i} = a{i + 1}" for i in range(5000)) + f'\na5000 = "{VALUE}"\nsigning_key = a0'
    assert spans_of(chain) == [VALUE]


def test_secret_scan_equals_plain(docs_of):
    text = ["api_key: 'Zz9_abc.def'", "AKIA" + "7" * 18, "deadbeef" * 4, 'signing_key = "qW8zR5tY7uI1o"', "é ☃ plain words", "PASSWORD=short", "token=abcdefgh;"]
    rng = np.random.default_rng(8)
    rows = [(i, " \n".join(rng.choice(text, int(rng.integers(0, 9))))) for i in range(60)] + [(None, text[0]), (3, None), (4, "")]
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}")]
    want = []
    for d, t in rows:
        base = sorted((m.start(), k, name, m.end()) for k, (name, p) in enumerate(kinds) for m in re.finditer(p, t or ""))
        spelled = [f"{name}:{s}:{e}" for s, _, name, e in base]
        named = [(m.start(1), 3, "named", m.end(1)) for m in re.finditer('signing_key = "(qW8zR5tY7uI1o)"', t or "")]
        every = ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(base + named))
        want.append((d, *(sum(x[2] == k for x in base) for k, _ in kinds), hashlib.sha256(",".join(spelled).encode()).hexdigest(), every, len(named)))
    assert sorted(map(tuple, secret_scan.find_secrets(docs_of(rows)).collect()), key=repr) == sorted(want, key=repr) and any(w[3] for w in want)


def test_types_are_no_values():
    pairs = lambda t: [(n, v) for n, v, *_ in secret_scan.assignments(t)]
    assert pairs('password: str = "hunter2Secret99"')[0] == ("password", "hunter2Secret99")
    assert pairs("note: the value = 12345678") == [("note", "the"), ("value", "12345678")]
    assert pairs("token: abc=def\nkey: a, b = c") == [("token", "abc=def"), ("key", "a"), ("b", "c")]
    assert pairs('a = """x"" \\""" y"""\nb = "z"') == [("a", 'x"" \\""" y'), ("b", "z")]
    assert pairs("a = \'\'\'open\nb: c") == [("b", "c")]


@pytest.mark.parametrize("piece", ["a: [", "a:b::", "a[\"", "a = '''", "a\t", "a=\"\\", "a: (", "var a ", "a.b-", "a: <a<", "a|b: c|", "a = b ", "a=b+", "<a>b", "<a>b</", "a = b + ", "b = a\n"])
def test_secret_lexer_is_linear(piece):
    def seconds(n):
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            list(secret_scan.assignments(piece * n + "="))
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(16000) < max(0.05, 16 * seconds(2000))
