import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import toxicity as tox
from vectorloom.llm.encode import PATTERN, SPARK_PATTERN, TOKENIZERS, decode_ids, encode_texts, vocabulary, word_table
from vectorloom.llm.mixture import deal, draw, mix_documents, mix_report, plan

need = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no tokenizer files")
TEXTS = [
    "Hello world, it's 3 o'clock.", "", None, "   ", "\n\n  a\t\tb  ", "naïve Ærø — 東京タワー 🚀👩‍👩‍👧", "<|endoftext|> is text", "x" * 20_000, "don't'll 've  's", "  wide　blanks\u0085", "é कि ١٢٣ Ⅷ ½", "\x00\x1f�", "Hello world, it's 3 o'clock.", f"{'-' * 70} ruler {'-' * 70}", f"{'-' * 70}\n{'=' * 99}",
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i else None, t, "w", 1, "k", "o", 1) for i, t in enumerate(texts)], "doc_id int, text string, word string, n int, key string, out string, row int")


@need
@pytest.mark.parametrize("frequent", [1 << 17, 5, 0])
def test_encoding_equals_the_tokenizer(spark, frequent):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = {i if i else None: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    got = {r.doc_id: list(r.ids) for r in encode_texts(docs(spark), frequent=frequent).collect()}
    assert got == want
    counts = {r.doc_id: r.n for r in encode_texts(docs(spark), out="n", counts=True, frequent=frequent).collect()}
    assert counts == {i: len(x) for i, x in want.items()}
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(docs(spark), frequent=frequent)).collect()}
    assert back == {i if i else None: x or "" for i, x in enumerate(TEXTS)}


def test_the_shorter_pattern_cuts_the_same_words(spark):
    rng = np.random.default_rng(21)
    signs = list("  \t\n\u00a0\u3000'’sStTrevmlLd aé1٣Ⅷ½.,-_*\u200b̈🚀東ー") + ["'ll", "'ve", "'re", "  "]
    texts = TEXTS + ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert d.where(~F.regexp_extract_all("t", F.lit(SPARK_PATTERN), F.lit(0)).eqNullSafe(F.regexp_extract_all("t", F.lit("(?U)" + PATTERN), F.lit(0)))).count() == 0


@need
def test_encoding_repeated_rows_and_empty_tables(spark):
    twice = docs(spark).unionByName(docs(spark))
    assert encode_texts(twice, frequent=3).count() == 2 * len(TEXTS)
    assert encode_texts(docs(spark).limit(0)).count() == 0 and encode_texts(docs(spark, [None, ""])).count() == 2
    table = word_table(docs(spark))
    assert table.count() == table.select("word").distinct().count() and len(vocabulary()) == 50_256


def test_deal_is_exact():
    counts = np.array([1000, 10, 0, 333])
    got = deal(counts, 13, 1)
    assert (got.sum(axis=0) == counts).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    assert abs(np.mean([deal(counts, 2, i)[0, 0] for i in range(200)]) - 500) < 5  # the mean of the distribution
    assert deal(np.array([0, 0]), 1, 1).tolist() == [[0, 0]]


def sizes(spark, n=3000):
    rng = np.random.default_rng(1)
    source = rng.choice(["a", "b", "c"], n, p=[0.6, 0.39, 0.01])
    return spark.createDataFrame([(i, str(s), int(t)) for i, (s, t) in enumerate(zip(source, rng.integers(1, 400, n), strict=True))], "doc_id int, source string, tokens bigint")


TARGETS = "mix string, source string, weight double, max_repeats int, tokens int, copy int"


def test_mixture_meets_weights(spark):
    t = [("m", "A ", 1.0, 1), ("m", "a", 1.0, 1), ("m", "b", 1.0, 2), ("m", "c", 0.5, 5), ("m", "absent", 3.0, 1), ("z", "a", 0.0, 1), ("z", "b", None, 1), ("w", "c", 2.0, None), ("w", "b", float("nan"), 1), (None, "a", 1.0, 1), ("m", None, 1.0, 1)]
    targets = spark.createDataFrame([(*r, 1, 1) for r in t], TARGETS)
    s = sizes(spark)
    p = plan(s, targets).cache()
    d = draw(s, p, block_docs=16, shard_blocks=8).cache()
    r = {(x.mix, x.source): x for x in mix_report(d, p).collect()}
    assert abs(r["m", "a"].actual_share - 0.4) < 0.005 and abs(r["m", "b"].actual_share - 0.4) < 0.005 and abs(r["m", "c"].actual_share - 0.2) < 0.005
    assert all(x.most_uses <= x.max_repeats for x in r.values()) and r["m", "c"].most_uses == 5 and r["m", "absent"].tokens == 0 == r["z", "a"].tokens
    assert r["w", "c"].tokens == r["w", "c"].available  # all of it, once
    assert d.count() == d.select("mix", "doc_id", "copy").distinct().count()
    assert d.groupBy("mix", "shard").agg(F.max("position").alias("p"), F.count("*").alias("n")).where("p != n").count() == 0
    assert d.where("mix = 'm'").select("shard").distinct().count() > 5
    again = draw(s.repartition(7), p, block_docs=16, shard_blocks=8)
    assert again.exceptAll(d).count() == 0  # the same whatever the partitions
    assert draw(s, p, block_docs=16, shard_blocks=8, range_blocks=5).exceptAll(d).count() == 0  # nor in how many ranges the blocks are put in order
    small = plan(s, targets, total_tokens=1000.0)
    assert abs(small.where("mix = 'm'").agg(F.sum("wanted")).first()[0] - 1000) < 1e-6


@need
def test_mixture_of_texts_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c", " X", 1), (2, "a b c d", "x", 1), (3, None, "x", 1), (4, "q", None, 1), (5, "y y", "y", 1)], "doc_id int, text string, source string, shard int")
    targets = spark.createDataFrame([("m", "x", 1.0, 2, 1, 1)], TARGETS)
    drawn, planned = mix_documents(d, targets)
    assert sorted((r.doc_id, r.copy, r.tokens) for r in drawn.collect()) == [(1, 1, 3), (1, 2, 3), (2, 1, 4), (2, 2, 4)]
    for a, b in ((d.limit(0), targets), (d, targets.limit(0))):
        drawn, planned = mix_documents(a, b)
        assert drawn.count() == 0 and mix_report(drawn, planned).where("tokens > 0").count() == 0


def test_skeletons():
    for words in (("moron", "MORON", "m0r0n", "mооrоn", "moooron"), ("wall", "wa11", "wаll"), ("nipples", "nippl3s", "níppIes"), ("сдохни", "СДОХНИИИ")):
        assert len({tox.skeleton(w)[0] for w in words}) == 1, words
    w = tox._Words({})
    numbers, size = w.of(["you stupid thing"] * 3 + ["such words"] * 4 + [None, "", "St#pid s*up_d, wo*ds"])
    masked = tox.unmasking(numbers, size, w)
    assert masked[tox.fold("s*up_d")] == tox.fold("stupid") and masked[tox.fold("wo*ds")] == tox.fold("words") and tox.unmasking(numbers[:0], size[:0], w) == {}
    hashes = lambda x: w.rows[w.cut(x)[0]][:2]
    assert hashes("St#pid") != hashes("stupid")
    w.complete(masked)
    assert hashes("St#pid") == hashes("s*up_d,") == hashes("stupid") == hashes("-Stupid!")
    assert tox.repair("Je ne tÃ©moigne pas") == "Je ne témoigne pas" and tox.repair("é ok") == "é ok"


def test_sentences_over_two_lines():
    w = tox._Words({})
    doc, line, _ = tox.features(*w.of(["Go away,\r\nYou fool.\nThe boat left.", None, "A b\n1\n00:01 --> 00:02\n...C d", "One.|Two."]), w)
    assert doc.tolist() == [0, 0, 0, 2, 2, 3, 3, 0, 2] and set(line.tolist()) == set(range(9))


def test_no_label_of_a_held_out_document_reaches_its_score():
    """Flipping the labels of one fold changes nothing in that fold's own out-of-fold scores: neither weights nor the choice of features saw them."""
    texts, y = corpus(120, 3)
    w = tox._Words({})
    doc, line, feat = tox.features(*w.of(texts), w)
    data, none = tox._Data(doc, line, feat, len(texts)), np.zeros((len(doc), 0))
    held = np.arange(len(texts)) % 5 == 2
    a, b = (data.out_of_fold(t.astype(float), none, 4, 5) for t in (y, np.where(held, 1 - y, y)))
    assert np.array_equal(a[held[doc]], b[held[doc]]) and not np.array_equal(a[~held[doc]], b[~held[doc]])


def test_operating_point():
    y, s = np.array([0.0] * 50 + [1.0] * 5 + [0.5]), np.r_[np.linspace(-5, -1, 50), np.linspace(0, 2, 5), 9]
    assert -1 < tox.operating_point(s, y) < 0 and tox.operating_point(s[:50], y[:50]) == 0


def test_labelled_texts_within_bytes(spark):
    d = spark.createDataFrame([(i, "x" * 1000, "s", 1, 2, 3) for i in range(20)], "doc_id int, text string, source string, bytes int, votes int, toxic int")
    labels = spark.createDataFrame([(i, r, 1) for i in range(20) for r in "ab"], "doc_id int, rater string, toxic int")
    assert len(tox.labelled_texts(d, labels)[0]) == 20 and len(tox.labelled_texts(d, labels, limit_bytes=5500)[0]) == 5 and len(tox.labelled_texts(d, labels, limit=3)[0]) == 3
    assert tox.labelled_texts(d, labels, limit_bytes=10)[0] == []


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    places, good = ["harbour", "mill", "tower", "chapel", "depot"], ["Tell %s the boat leaves at noon.", "I left the lamp by the %s.", "Put the worm on the hook, %s.", "The hollow tree at the %s fell."]
    bad = ["You worthless worm, %s.", "Shut your mouth, %s, you lying worm.", "They should all be driven from the %s like vermin."]
    hide = [lambda s: s, str.upper, lambda s: s.replace("o", "0"), lambda s: " ".join(w[:2] + "​" + w[2:] for w in s.split()), lambda s: s.replace("rr", "r").replace("m", "mm")]
    texts, y = [], []
    for _ in range(n):
        lines = [rng.choice(good) % rng.choice(places) for _ in range(8)]
        toxic = rng.random() < 0.25
        if toxic:
            lines[rng.integers(8)] = hide[rng.integers(len(hide))](rng.choice(bad) % rng.choice(places))
        texts.append("\r\n".join(lines))
        y.append(int(toxic))
    return texts, np.array(y)


def test_classifier_on_held_out_documents(spark):
    texts, y = corpus(500, 1)
    rng = np.random.default_rng(2)
    rows = [(i, f"r{j}", int(y[i] ^ (rng.random() < 0.05)) if rng.random() > 0.02 else None, None) for i in range(350) for j in range(rng.integers(1, 4))]
    labels = spark.createDataFrame(rows + rows[:20] + [(9999, "r0", 1, None), (None, "r0", 1, None)], "doc_id int, rater string, toxic int, labelled_at timestamp")
    d = spark.createDataFrame([(i, t, [" A", "a", None][i % 3], 1.0) for i, t in enumerate(texts)] + [(-1, None, "b", 1.0), (-2, "", "b", 1.0), (-3, " \n ", "b", 1.0), (-4, "word " * 50_000, "b", 1.0)], "doc_id int, text string, source string, p_toxic double")
    s = tox.toxicity_scores(d, labels).cache()
    p = {r.doc_id: r.p_toxic for r in s.collect()}
    hit = np.array([p[i] >= tox.THRESHOLD for i in range(350, 500)])
    assert (hit & (y[350:] == 1)).sum() / (y[350:] == 1).sum() > 0.9 and (hit & (y[350:] == 0)).sum() <= 2
    assert p[-1] == p[-2] == p[-3] == 0 and len(p) == 504
    rates = {r.source: r for r in tox.source_rates(s).collect()}
    assert set(rates) == {"a", "b", None} and rates["b"].toxic == 0 and 0.1 < rates["a"].rate < 0.4
    assert max(r.p_toxic for r in tox.toxicity_scores(d, labels.limit(0)).collect()) < 0.01
    assert tox.toxicity_scores(d.limit(0), labels).count() == 0


def test_true_labels():
    p = tox.true_labels(np.array([0.0] * 80 + [3.0] * 15 + [1.0] * 5), np.array([3.0] * 100))
    assert p[0] < 0.01 and p[85] > 0.99 and p[99] < 0.5 and len(tox.true_labels(np.empty(0), np.empty(0))) == 0
