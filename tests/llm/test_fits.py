"""What the fits bring to the driver is bounded in rows, however often an id is repeated; and the models' mathematics by plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.queries")

from tidemark.llm import language, pii, quality, toxicity  # noqa: E402
from tidemark.llm.common import bucket_of, sampled, texts_of  # noqa: E402


@pytest.fixture(scope="module")
def repeated(spark):
    """2,000 rows of one doc_id among 60 others, and its label as often."""
    docs = spark.range(2060).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id") % 50, F.lit(" a@b.com")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    labels = spark.range(2060).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    return docs.persist(), labels.persist()


def test_samples_are_bounded_in_rows(spark, repeated):
    docs, labels = repeated
    assert texts_of(docs, sampled(docs, 10)).count() == 10 and texts_of(docs, sampled(docs, 100)).count() == 61
    chosen = sampled(labels, 100, "quality")
    rows = texts_of(docs, chosen).collect()
    assert len(rows) == 61 and next(r for r in rows if r.doc_id == 7).quality == 0
    both = sampled(labels.where("toxic = 1"), 5).withColumn("toxic", F.lit(True)).union(sampled(docs, 5).withColumn("toxic", F.lit(False)))
    assert texts_of(docs, both).count() == 10


def test_fits_collect_no_more_than_their_bound(spark, repeated, monkeypatch):
    docs, labels = repeated
    seen = {}
    for module, name in ((quality, "quality"), (toxicity, "toxicity"), (pii, "pii")):
        def train(*args, module=module, name=name, old=module.train):
            seen[name] = sum(len(a) for a in args if isinstance(a, list))
            return old(*args)
        monkeypatch.setattr(module, "train", train)
    yes = bucket_of(F.col("doc_id"), 3) != 99
    quality.fit(docs, labels, yes)
    toxicity.fit(docs, labels, yes)
    pii.fit(docs)
    assert seen["quality"] == 61 and seen["pii"] == 61 and seen["toxicity"] <= 2 * 61
    langs, table = language.fit(docs)
    assert langs == ["de", "en"] and np.allclose(np.exp(table).sum(1), 1)


def test_marginals_of_trees_equal_enumeration():
    """Loopy messages are exact where there is no loop."""
    rng = np.random.default_rng(3)
    for case in range(12):
        n, k = 5, len(pii.KINDS) + 1
        shapes = rng.integers(0, 2, (n, 10)).astype(float)
        model = pii.Model(rng.normal(0, 1, (10, k)), 0.8, 2.5)
        observed = np.array([1 if case % 3 == 0 else -1, -1, -1, -1, 2 if case % 2 else -1])
        chain, skip = np.array([[0, 1], [1, 2]]), np.array([[1, 3], [3, 4]])
        of = np.array([[0, i] for i in range(n)])  # a key for each node, so base nodes vote for themselves only
        got = model.marginals(shapes, observed, chain, skip, of)
        unary = shapes @ model.unary
        skips = [e for e in skip.tolist() if observed[e[0]] < 0 and observed[e[1]] < 0]
        total = np.zeros((n, k))
        for labels in itertools.product(range(k), repeat=n):
            if any(o >= 0 and x != o for x, o in zip(labels, observed, strict=True)):
                continue
            z = sum(unary[i, x] for i, x in enumerate(labels) if observed[i] < 0)
            z += sum(model.chain for a, b in chain if labels[a] == labels[b]) + sum(model.skip for a, b in skips if labels[a] == labels[b])
            for i, x in enumerate(labels):
                total[i, x] += np.exp(z)
        assert np.allclose(got, total / total.sum(1, keepdims=True), atol=2e-3)


def test_the_network_scores_like_plain_loops():
    rng = np.random.default_rng(1)
    F_, W, S = quality.FILTERS, quality.WIDTH, quality.STEP
    net = quality.Network(rng.normal(0, 0.3, (W, 256, F_)).astype(np.float32), rng.normal(0, 0.1, F_).astype(np.float32), rng.normal(0, 0.5, F_), 0.2)
    texts = [b"", b"a", bytes(rng.integers(0, 256, 100, np.uint8)), bytes(rng.integers(0, 256, S, np.uint8)), bytes(rng.integers(0, 256, 3 * S + 5, np.uint8)), b"xyz" * 400]

    def plain(t):
        steps = max(1, -(-len(t) // S))
        own = np.zeros(steps * S + W, int)
        own[: len(t)] = list(t)
        top = [[max(sum(float(net.taps[j, own[s * S + i + j], f]) for j in range(W)) for i in range(S)) for f in range(F_)] for s in range(steps)]
        chunks = [np.maximum(top[s], top[s + 1]) for s in range(steps - 1)] or [np.array(top[0])]
        mean = np.mean([np.maximum(c + net.bias, 0) for c in chunks], 0)
        return 1 / (1 + np.exp(-(mean @ net.weight + net.shift)))

    # Each text by itself and all together, so that no text's bytes reach into the next one's.
    for group in ([t] for t in texts):
        off = np.array([0, len(group[0])])
        assert net.score(np.frombuffer(group[0], np.uint8), off, net.pairs())[0] == pytest.approx(plain(group[0]), rel=1e-4)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert np.allclose(net.score(np.frombuffer(b"".join(texts), np.uint8), off, net.pairs()), [plain(t) for t in texts], rtol=1e-4)


@pytest.mark.parametrize("prior", [0.05, 0.5])
def test_learning_from_positives_follows_the_stated_risk(monkeypatch, prior):
    """The steps of a small run equal those of plain Adam on numerical derivatives of the risk, in both of its branches."""
    monkeypatch.setattr(toxicity, "CHOOSING", 2)
    monkeypatch.setattr(toxicity, "FITTING", 4)
    pos, rest = [b"bad words here"] * 4 + [b"bad stuff"] * 3, [b"good words here"] * 5 + [b"fine text", b"bad stuff"] * 3
    weight, shift = toxicity.train(pos, rest, prior)
    both = pos + rest
    own = [set(toxicity.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist()) for t in both]
    names = sorted(f for f in set().union(*own) if sum(f in o for o in own) >= 3)
    x = np.array([[f in o for f in names] for o in own], float)
    y, p = np.arange(len(both)) < len(pos), len(pos)
    loss = lambda z, good: np.log1p(np.exp(-z if good else z))

    def parts(theta):
        z = x @ theta[:-1] + theta[-1]
        return prior * loss(z[y], True).mean(), loss(z[~y], False).mean() - prior * loss(z[y], False).mean()

    theta, m, v, chosen = np.append(np.zeros(len(names)), np.log(prior / (1 - prior))), 0.0, 0.0, None
    seen = set()
    for t in range(1, 7):
        negative = parts(theta)[1] < 0
        seen.add(negative)
        target = (lambda q: -parts(q)[1]) if negative else (lambda q: sum(parts(q)))
        g = np.array([(target(theta + e) - target(theta - e)) / 2e-5 for e in np.eye(len(theta)) * 1e-5])
        m, v = (m * 0.9 + 0.1 * g), (v * 0.99 + 0.01 * g * g)
        step = 0.08 / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        theta = theta - step * m / (1 - 0.9**t)
        if t <= 2:
            theta[:-1] = np.sign(theta[:-1]) * np.maximum(0, np.abs(theta[:-1]) - toxicity.L1 * step[:-1])
        if t == 2:
            chosen = np.append(theta[:-1] != 0, True)
        if t >= 2:
            theta = theta * chosen
    assert np.allclose(weight[names], theta[:-1], atol=2e-3) and shift == pytest.approx(theta[-1], abs=2e-3)
    assert not weight[np.setdiff1d(np.arange(len(weight)), names)].any()
