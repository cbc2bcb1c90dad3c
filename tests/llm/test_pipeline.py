"""The pipeline, and the models that have no SQL, against plain versions; edge cases of the stages as a chain."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import all_pairs
from wayfold.llm import ordinal, quality, secret_scan, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(21)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
ITEMS = [(i, " ".join(RNG.choice(WORDS, 24))) for i in range(4)] + [(9, None), (None, "no item at all here")]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def corpus():
    rows = []
    for i in range(160):
        text = prose(int(RNG.integers(30, 90)))
        rows.append((i, text + (" vilewort grimscorn" * int(RNG.integers(1, 4)) if i % 4 == 0 else "") + (" @@ zzqq ##" if i % 5 == 0 else "")))
    base = prose(120)
    rows += [(200, base), (201, base), (202, base + " extra"), (203, base.replace(" ", "  ", 3))]
    rows += [(210, prose(20) + " " + ITEMS[0][1] + " " + prose(20)), (211, " ".join(w if k % 4 else "xx" for k, w in enumerate(ITEMS[1][1].split())) + " " + prose(30))]
    rows += [(220, prose(20) + ' password = "hunter2Secret99" ' + prose(5)), (221, "signing_key = LATE\n" + prose(15) + '\nLATE = "qW8zR5tY7uI1o"')]
    return rows + [(230, None), (231, ""), (232, "é ☃ \U0001f600"), (None, prose(40)), (240, prose(9000)), (250, rows[1][1]), (1, rows[1][1])]


def write(spark, d, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).withColumn("score", F.lit("x")).withColumn("root", F.lit(1)).withColumn("_k", F.lit(2))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def plain_tails(model, text):
    score = sum(model.weights.get(int(s), 0.0) for s in ordinal.features(text))
    return [1 / (1 + np.exp(t - score)) for t in model.thresholds]


def plain_groups(texts):
    prints = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def test_pipeline_equals_plain(spark, tmp_path):
    rows, d = corpus(), str(tmp_path)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(100)] + [(1, 1, None), (None, 1, 1), (2, 0, 0)]
    docs, graded = write(spark, d, rows, labels)
    model = toxicity.train(docs, graded)
    left = [(i, t) for i, t in rows if plain_tails(model, t)[0] <= 0.5]
    assert 30 <= len(rows) - len(left) <= 50
    best = {}
    for (i, t), g in zip(left, plain_groups([t for _, t in left]), strict=True):
        mine = (i is None, i or 0, t or "")
        best[g] = min(best.get(g, mine), mine)
    deduped = sorted((None if no else i, t) for no, i, t in best.values() if not no) + [(None, t) for no, _, t in best.values() if no]
    leaks = {(i, t) for i, t in deduped for x in all_pairs([(i, t)], ITEMS) if x}
    clean = [x for x in deduped if x not in leaks]
    assert {i for i, _ in leaks} == {210, 211} and {201, 202, 250} & {i for i, _ in clean} == set()
    masked = [(i, t and secret_scan.masked(t, "[SECRET]")) for i, t in clean]
    assert sum("[SECRET]" in t for _, t in masked) == 2
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in masked for ids in [full.encode(t, add_special_tokens=False).ids + [2]]), key=repr)
    got = corpus_pipeline.run(spark, d).toPandas()
    whole = got[got.length == got.doc_tokens]
    assert sorted(((None if np.isnan(r.doc_id) else int(r.doc_id), r.doc_tokens) for r in got.drop_duplicates(["doc_id", "doc_tokens"]).itertuples()), key=repr) == sorted(((i, n) for i, n, _ in want), key=repr)
    assert {(None if np.isnan(r.doc_id) else int(r.doc_id), r.length, r.ids_crc32) for r in whole.itertuples()} <= set(want) and len(whole) > 0.8 * len(want)
    assert got.length.sum() == sum(n for _, n, _ in want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("operator", [toxicity.rate, quality.grade])
def test_models_equal_plain_scores(spark, tmp_path, operator):
    rows = corpus()
    labels = [(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(120)] + [(5, None, None), (6, 0, 1), (6, 1, 1), (999, 1, 1)]
    docs, graded = write(spark, str(tmp_path), rows, labels)
    model = (toxicity if operator is toxicity.rate else quality).train(docs, graded)
    assert (np.diff(model.thresholds) > 0).all() and len(model.weights) > 0
    got = sorted(((r[0], round(r[1], 6), round(r[2], 6), r[3]) for r in operator(docs, graded).collect()), key=repr)
    want = []
    for i, t in rows:
        tails = plain_tails(model, t)
        want.append((i, round(float(sum(tails)), 6), round(float(tails[0]), 6), bool(tails[0] > 0.5)))
    assert got == sorted(want, key=repr)


def test_models_without_labels_ties_or_documents(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (1, "a c"), (None, None), (2, "")])
    assert {r.is_toxic for r in toxicity.rate(docs, none).collect()} == {False} and len(quality.grade(docs, none).collect()) == 4
    same = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")  # one label only
    assert len({r.p_toxic for r in toxicity.rate(docs, same).collect()}) == 1
    assert toxicity.drop_toxic(docs, none).columns == docs.columns
    assert toxicity.severities([(np.array([1]), 1)] * 3 + [(np.array([2]), 0)], [2.0, 2.0, 2.0])[0][1] == 1
    assert toxicity.markers([]).tolist() == [] and toxicity.severities([], []) == []
    chosen, rows = ordinal.sample_rows(docs, spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, grade int"), 2, 1)
    assert chosen.count() == 2 and [g for _, g in rows] == [0, 1]  # a repeated id takes no other row's place
