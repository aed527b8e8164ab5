"""Toxicity, quality, quality rules and language-model scores: held-out accuracy, plain versions, odd inputs."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql.functions import spark_partition_id

from geoledger.llm import gru_lm, quality_gam, quality_rules, toxicity
from geoledger.llm.labelled import fit_logistic, remainder

from .conftest import spoken

LABELS = "doc_id long, quality int, toxic int"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (5, "x" * 50_000), (6, " ".join(spoken(1, 30_000))), (None, "no id"), (7, "é ü 漢字 👍 \x00"),
       (8, "%%% ### &&&"), (9, "same line\nsame line\n\nsame line")]


@pytest.fixture(scope="module")
def odd(documents):
    """Rows of every awkward kind, with extra columns named like those that the operators make."""
    return documents(ODD).selectExpr("*", "source AS score", "lang AS label", "n_chars AS features", "source AS predicted", "lang AS k1", "n_chars AS row")


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.01"
    return tuple(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))


def _accuracy(scored, labels, column):
    """Right answers and positives found among held-out documents."""
    rows = scored.join(labels, "doc_id").where(remainder(3) == 1).select(column, "predicted").collect()
    return (np.mean([r[0] == r[1] for r in rows]), np.mean([r[1] for r in rows if r[0] == 1]), len(rows))


def test_toxicity_separates_held_out_documents(given):
    docs, labels = given
    trained = toxicity.train(docs, labels)
    right, found, n = _accuracy(toxicity.score_toxicity(docs, trained), labels, "toxic")
    assert n > 100 and right > 0.9 and found > 0.3  # 30 toxic documents to learn from
    kept = toxicity.drop_toxic(docs, trained)
    assert kept.columns == docs.columns
    rejected = {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()}
    assert rejected == {r.doc_id for r in toxicity.score_toxicity(docs, trained).where("predicted = 1").collect()}


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 0, 1), (5, None, None), (6, 1, 0), (99, 1, 1)], LABELS)
    for known in (labels, labels.limit(0)):
        trained = toxicity.train(odd, known)
        rows = toxicity.score_toxicity(odd, trained).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.drop_toxic(odd, trained).columns == odd.columns
    assert toxicity.score_toxicity(odd.limit(0), toxicity.train(odd.limit(0), labels)).count() == 0


def test_only_telling_counts_are_kept_apart():
    counts = np.array([[50.0, 1, 0, 0], [48, 0, 30, 3]])
    assert toxicity.telling(counts, np.array([100, 100])).tolist() == [False, False, True, False]


def test_quality_separates_held_out_documents(given):
    docs, labels = given
    measured = quality_gam.measure(docs)
    right, found, n = _accuracy(quality_gam.score_quality(measured, quality_gam.train(measured, labels)), labels, "quality")
    assert n > 100 and right > 0.95 and found > 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 0, 1), (5, None, None), (6, 1, 0)], LABELS)
    measured = quality_gam.measure(odd)
    for known in (labels, labels.limit(0)):
        rows = quality_gam.score_quality(measured, quality_gam.train(measured, known)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(v == 0 for r in measured.where("doc_id in (1, 2)").collect() for v in r.features)
    assert quality_gam.measure(odd.limit(0)).count() == 0


def test_additive_model_learns_an_interaction():
    random = np.random.default_rng(2)
    x = random.uniform(size=(4000, 16))
    y = ((x[:, 2] > 0.5) ^ (x[:, 9] > 0.5)).astype(float)
    model = quality_gam.AdditiveModel(x[:3000], y[:3000])
    assert any({i, j} == {2, 9} for i, j, _ in model.pairs)
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9


def test_logistic_fit_recovers_a_boundary():
    x = np.linspace(-2, 2, 400)[:, None]
    weights = fit_logistic(x, (x[:, 0] > 0.5).astype(float))
    assert weights[0] > 0 and abs(-weights[1] / weights[0] - 0.5) < 0.1
    assert fit_logistic(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]


def _plain_figures(text):
    words = (text or "").encode().split()
    triples = list(zip(words, words[1:], words[2:]))
    n = collections.Counter(triples)
    covered = {p + k for p, t in enumerate(triples) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rule_figures_of_odd_rows(odd):
    rows = quality_rules.apply_rules(odd).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=key)
    assert got == sorted(((i, *_plain_figures(t)) for i, t in ODD), key=key)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (None, 1, 2, 3, 4, 5, 7, 8, 9))
    assert quality_rules.apply_rules(odd.limit(0)).count() == 0


def test_rules_keep_language_and_drop_divergent_texts(documents):
    plain = "the of and to in a is that it for on was be with as this by at are from".split()
    text = lambda seed: " ".join(w if k % 3 else plain[k % 20] for k, w in enumerate(f"stone{x}y" .replace("w", "") for x in spoken(seed, 300, 5000)))
    rows = [(k, text(k)) for k in range(30)] + [(100, " ".join(w + "$$$***" for w in spoken(77, 300, 5000)))]
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(documents(rows)).collect()}
    assert kept == {k: k < 100 for k in kept}
    unknown = quality_rules.apply_rules(documents(rows, lang=None)).collect()
    assert all(r.kept and r.class_distance is None for r in unknown)


def _plain_base(texts, training):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(t or "").encode().translate(lower).split() + [None] for t in texts]
    c = collections.Counter(w for t, use in zip(tokens, training) if use for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in tokens]


@pytest.mark.parametrize("kept", [1 << 17, 40])
def test_language_model_base_figures(spark, sf_dir, monkeypatch, kept):
    monkeypatch.setattr(gru_lm, "KEPT", kept)
    monkeypatch.setattr(gru_lm, "EPOCHS", 1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    training = [zlib.crc32(str(r.doc_id).encode()) % 10 != 0 for r in rows]
    got = gru_lm.language_model_scores(docs, remainder(10) != 0).orderBy("doc_id").collect()
    for r, want in zip(got, _plain_base([r.text for r in rows], training)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
        assert r.score < 0


def test_language_model_beats_word_counts_on_held_out_documents(given):
    docs, _ = given
    got = gru_lm.language_model_scores(docs, remainder(10) != 0).where(remainder(10) == 0).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and np.mean([r.score > r.base_score for r in got]) > 0.9


def test_language_model_of_odd_rows(odd):
    got = gru_lm.language_model_scores(odd, remainder(10) != 0).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    none = gru_lm.language_model_scores(odd.where("doc_id < 6"), remainder(10) > 99).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert gru_lm.language_model_scores(odd.limit(0), remainder(10) != 0).count() == 0


def test_network_gradients_and_windows(monkeypatch):
    network = gru_lm.GatedNetwork(np.full(50, 0.02), 3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    random = np.random.default_rng(0)
    tokens, goal = random.integers(0, 50, (4, 6)), random.integers(0, 50, 24)
    begin = np.zeros((4, gru_lm.HIDDEN))

    def loss():
        return -network.log_probabilities(network.states(tokens, begin)[0].reshape(24, -1).astype(float), goal)[0].sum()

    out, _, steps = network.states(tokens, begin, keep=True)
    gradient = {k: np.zeros_like(v) for k, v in network.p.items()}
    _, back = network.log_probabilities(out.reshape(24, -1).astype(float), goal, gradient)
    network._backward(tokens, steps, back.reshape(out.shape), gradient)
    for name, values in network.p.items():
        at = np.unravel_index(np.abs(gradient[name]).argmax(), values.shape)
        old = values[at]
        values[at] = old + 1e-3
        more = loss()
        values[at] = old - 1e-3
        assert (more - loss()) / 2e-3 == pytest.approx(gradient[name][at], rel=0.02)
        values[at] = old
    documents = [np.append(random.integers(4, 50, n), 3).astype(np.int32) for n in (0, 5, 31, 32, 33, 200)]
    whole = network.score(documents)
    monkeypatch.setattr(gru_lm, "WINDOW", 7)
    monkeypatch.setattr(gru_lm, "BATCH", 2)
    assert np.allclose(whole, network.score(documents), rtol=1e-4)


def test_every_training_document_reaches_the_network(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARE", 64)
    docs = spark.createDataFrame([(k, f"one two three {k % 3} four") for k in range(300)], "doc_id long, text string")
    vocabulary = gru_lm.read_vocabulary(gru_lm.count_words(docs))
    seen, real = [], gru_lm._next_weights
    def counted(learning, *rest):
        seen.append(learning.count())
        return real(learning, *rest)
    monkeypatch.setattr(gru_lm, "_next_weights", counted)
    before = gru_lm.GatedNetwork(vocabulary.shares, vocabulary.end).weights()
    network = gru_lm.train_network(docs, vocabulary)
    assert len(seen) == gru_lm.ROUNDS and sum(seen) == 300
    assert np.isfinite(network.weights()).all() and np.abs(network.weights() - before).max() > 1e-4


def test_every_trainer_of_a_round_has_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARE", 64)
    docs = spark.createDataFrame([(k, f"one two three {k % 3} four") for k in range(600)], "doc_id long, text string")
    vocabulary = gru_lm.read_vocabulary(gru_lm.count_words(docs))
    tasks = []

    def watched(learning, network, number, trainers):
        frame = type(learning)
        shuffled = frame.repartition

        def counted(self, n, *keys):
            out = shuffled(self, n, *keys)
            tasks.append((trainers, out.select(spark_partition_id().alias("p"), "trainer").distinct().groupBy("p").count().collect()))
            return out

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(frame, "repartition", counted)
            return real_next(learning, network, number, trainers)

    real_next = gru_lm._next_weights
    monkeypatch.setattr(gru_lm, "_next_weights", watched)
    gru_lm.train_network(docs, vocabulary)
    assert len(tasks) == gru_lm.ROUNDS
    for trainers, rows in tasks:
        assert trainers > 8 and len(rows) == trainers and all(r["count"] == 1 for r in rows)
