"""Quality classifier and LM scores: parts against brute force, held-out accuracy, odd inputs."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexigrove.llm import lm_score as L
from lexigrove.llm import quality as Q
from lexigrove.llm.textwords import pieces


def test_measures_equal_brute_force():
    texts = ["Ab ab ab | 12 x.", "", None, "É éa É", "%%% a%% \n"]
    for _, data, at in pieces(pa.array(texts)):
        got = Q.measures(data, at)[0]
    low = [(t or "").split() for t in texts]
    assert got[:, 8].tolist() == [len(x) for x in low]
    assert got[0, 0] == 1 / 16 and got[0, 1] == 1 / 7 and got[0, 3] == 2 / 6 and got[0, 9] == 1 / 6
    assert np.isclose(got[3, 1], 2 / 7)  # of bytes: second bytes of capitals
    assert Q.votes(got)[1, 8] == 2


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.8
    right = np.linspace(0.7, 0.95, len(Q.LABELLERS))
    vote = np.where(r.random((len(truth), len(right))) < right, truth[:, None], ~truth[:, None])
    vote = np.where(r.random(vote.shape) < 0.2, 0, np.where(vote, 1, 2))
    pattern, back, count = np.unique(Q.patterns(vote), return_inverse=True, return_counts=True)
    p = Q.posteriors(pattern, count.astype(float))[back]
    assert ((p > 0.5) == truth).mean() > 0.97


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("score", F.lit("x"))
    got = Q.classify(docs).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "A plain sentence of words, which is fine. And another one here."), (1, None), (2, ""), (3, "x" * 200_000), (3, "x")]
    got = Q.classify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(spark.createDataFrame([], schema)).count() == 0


def network(seed=2):
    r = np.random.default_rng(seed)
    unit, log_share, mass = L.units_of(r.integers(0, 50, 1 << L.BIN_BITS).astype(float))
    return L.new_network(unit, log_share, mass, L.clustered(r.random((L.WORDS, 2 * L.NEAR)), mass))


def test_network_gradients():
    r = np.random.default_rng(2)
    trainer = L.Trainer(network())
    trainer.vectors = trainer.vectors.astype(np.float64)
    trainer.dense = [x.astype(np.float64) for x in trainer.dense]
    context, target = r.integers(0, L.UNITS + 1, (5, 2 * L.REACH)), r.integers(0, L.CLASSES, 5)

    def loss():
        net = L.Network(*([None] * 4), trainer.vectors, *trainer.dense)
        return -net.log_class(context)[2][np.arange(5), target].mean()

    each, (places, hidden, output, bias) = trainer.gradients(context, target)
    wanted = [
        (trainer.vectors, each[7], (context[1, 3], 4)), (trainer.dense[0], places, (2, 5)), (trainer.dense[1], hidden, (4,)),
        (trainer.dense[2], output, (3, 7)), (trainer.dense[3], bias, (7,)),
    ]
    for x, g, i in wanted:
        before = loss()
        x[i] += 1e-5
        assert np.isclose((loss() - before) / 1e-5, g[i[-1]] if x is trainer.vectors else g[i], atol=1e-5)
        x[i] -= 1e-5


def blobs(texts, shards):
    rows = [L.bins(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes() for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(rows, pa.binary())], ["shard", "words"])


def test_every_place_of_every_text_is_trained_on_whatever_the_batches(monkeypatch):
    texts = ["one", "", "two words", " ".join("w%d" % (i % 90) for i in range(1001)), "a b c", " ".join("v%d" % i for i in range(3000))]
    shards = [0, 0, 0, 1, 1, 1]
    net, steps = network(3), []
    monkeypatch.setattr(
        L.Trainer, "step",
        lambda self, context, target: steps.append((context.tolist(), target.tolist())) or setattr(self, "places", self.places + len(target)),
    )
    whole = blobs(texts, shards)
    for cut in ([0, 6], [0, 1, 3, 4, 6]):
        steps.clear()
        list(L._learn(SimpleNamespace(value=net))([whole.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:])]))
        first = first_steps = steps.copy() if cut == [0, 6] else first_steps
        assert steps == first
    got = Counter((*map(tuple, [c]), t) for context, target in steps for c, t in zip(context, target))
    want = Counter()
    for text in texts:
        word, of = L.bins(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        unit = net.unit[word]
        for i, u in enumerate(unit):
            around = [int(unit[j]) if 0 <= j < len(unit) else L.BORDER for j in (i - 2, i - 1, i + 1, i + 2)]
            want[(tuple(around), int(net.classes[u]))] += 1
    assert Counter({(tuple(c), t): n for (c, t), n in got.items()}) == want


def test_probabilities_sum_to_one_and_hang_on_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = L.dealt(docs)
    net = L.fit(texts)
    r = np.random.default_rng(1)
    common = np.argsort(-net.share * (net.share < 1))[:50]
    every = np.arange(L.UNITS)

    def probabilities(context):
        return np.exp(net.log_unit(every, np.repeat(context, L.UNITS, 0))) * np.exp(net.log_class(context)[2])[0, net.classes[: L.UNITS]]

    for _ in range(3):
        context = r.choice(common, (1, 2 * L.REACH))
        assert np.isclose(probabilities(context).sum(), 1, atol=1e-3)
        for side in range(2 * L.REACH):  # another word on any place changes them
            other = context.copy()
            other[0, side] = r.choice(np.setdiff1d(common, context[0, side]))
            assert not np.allclose(probabilities(context), probabilities(other), rtol=1e-4, atol=0)
    assert np.isclose(np.bincount(net.unit, np.exp(net.log_share.astype(float)), L.UNITS)[net.unit[0]], 1, atol=1e-3)


def test_contexts_of_other_texts_equal_brute_force(spark):
    r = np.random.default_rng(8)
    texts = [" ".join(r.choice(list("abcde"), int(n))) for n in r.integers(0, 40, 30)] + ["one two three four five six"] * 2 + [None, "alone"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    cut = L.dealt(docs)
    got = {x.id: x for x in L.by_other_texts(cut, 1).join(cut.select("id", "h"), "h").collect()}
    places = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        places += [(i, (w[k - 1] if k else None, w[k + 1] if k + 1 < len(w) else None), w[k]) for k in range(len(w))]
    for i in range(len(texts)):
        own = [(c, w) for j, c, w in places if j == i]
        if not own:
            assert i not in got
            continue
        p = [(sum(j != i and (c, w) == x for j, *x in [(j, c2, w2) for j, c2, w2 in places] for x in [tuple(x)]) + 2.0**-L.BIN_BITS) / (sum(j != i and c2 == c for j, c2, _ in places) + 1) for c, w in own]
        assert got[i].n_contexts == len(own) and np.isclose(got[i].context_log_likelihood, np.mean(np.log(p)))
    assert got[30].context_log_likelihood > -1 > got[len(texts) - 1].context_log_likelihood


def test_scores_are_the_same_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_BYTES", 100_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = []
    for n in (1, 4, 16):
        monkeypatch.setattr(L, "width", lambda _, n=n: n)
        got.append(np.array([r.pseudo_log_likelihood for r in L.scored(docs.repartition(n)).orderBy("doc_id").collect()]))
    assert np.allclose(got[0], got[1], rtol=1e-5) and np.allclose(got[0], got[2], rtol=1e-5)


def test_scores_sum_over_all_words_and_prefer_the_language(spark):
    schema = "doc_id long, text string"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(90_001, " ".join("qzx%d" % i for i in range(50))), (90_002, None), (90_002, ""), (None, "x " * 200_000)], schema)
    texts = L.dealt(docs.union(odd).withColumn("words", F.lit(1)))
    net = L.fit(texts)
    got = {}
    for r in L.score(texts, net).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.limit(20).collect():
        for _, data, at in pieces(pa.array([r.text])):
            word, of = L.bins(data, at)
        unit, want = net.unit[word], 0.0
        for i in range(len(word)):
            context = np.array([[unit[j] if 0 <= j < len(unit) else L.BORDER for j in (i - 2, i - 1, i + 1, i + 2)]])
            want += net.log_class(context)[2][0, net.classes[unit[i]]] + net.log_unit(unit[i : i + 1], context)[0] + net.log_share[word[i]]
        own = got[r.doc_id][0]
        assert own.n_tokens == len(r.text.split()) and np.isclose(own.pseudo_log_likelihood, want, rtol=1e-4)
    assert [r.pseudo_log_likelihood for r in got[90_002]] == [0, 0] and got[None][0].n_tokens == 200_000
    assert got[90_001][0].mean_log_likelihood < np.mean([x[0].mean_log_likelihood for i, x in got.items() if i is not None and i < 90_000])
    empty = docs.limit(0)
    assert L.scored(empty).count() == 0


def test_every_place_counts_between_its_neighbours_however_dealt(spark, monkeypatch):
    """Frequent neighbours, frequent words between them, places of one text in several parts, and repeated rows."""
    r = np.random.default_rng(9)
    texts = [" ".join(r.choice(["a", "b", "c", "hot", "d%d" % (i % 7)], 40, p=[0.1, 0.1, 0.1, 0.6, 0.1])) for i in range(40)] + ["hot " * 30] * 2 + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").repartition(5)
    cut = L.dealt(docs)
    bins = {x.id: np.frombuffer(x.words, np.int32).tolist() for x in cut.collect()}
    places = [(i, (w[k - 1] if k else -1, w[k + 1] if k + 1 < len(w) else -1), w[k]) for i in [*range(len(texts)), 3.5] for w in [bins[int(i)]] for k in range(len(w))]
    contexts, words = Counter(c for _, c, _ in places), Counter((c, w) for _, c, w in places)
    own_contexts, own_words = Counter((i, c) for i, c, _ in places), Counter(places)
    want = {}
    for i in range(len(texts)):
        p = [np.log((words[c, w] - own_words[i, c, w] + 2.0**-L.BIN_BITS) / (contexts[c] - own_contexts[i, c] + 1)) for j, c, w in places if j == i]
        want[i] = (len(p), np.mean(p) if p else None)
    for parts, group in ((1, 1 << 21), (3, 100), (70, 1)):
        monkeypatch.setattr(L, "GROUP", group)
        rows = L.by_other_texts(cut, parts).join(cut.select("id", "h").distinct(), "h").collect()
        got = {x.id: (x.n_contexts, x.context_log_likelihood) for x in rows}
        assert len(rows) == len(got) and set(got) == {i for i in want if want[i][0]}
        assert all(got[i][0] == want[i][0] and np.isclose(got[i][1], want[i][1], atol=1e-7) for i in got)
    scored = L.scored(docs).collect()
    assert len(scored) == docs.count() and all(x.n_contexts == x.n_tokens == len(bins[x.doc_id]) for x in scored)
    assert L.by_other_texts(cut.limit(0)).count() == 0
