"""The scoring network against plain loops: probabilities, their sum, one training step, a document's score, and a held-out text."""

import math

import numpy as np
import pytest

pytest.importorskip("gridlark.llm")

from gridlark.llm import lmscore  # noqa: E402

SIDE_CLASSES = 5


def weights(seed):
    r = np.random.default_rng(seed)
    return {k: r.standard_normal(s) * 0.7 for k, s in lmscore.shapes(SIDE_CLASSES).items()}


def stream(seed, n=40):
    """Tokens 0 .. 24, 25 for a word outside, padding on both sides."""
    r = np.random.default_rng(seed)
    ids = np.full(n + 2 * lmscore.SIDE, lmscore.PAD, np.int64)
    at = np.arange(lmscore.SIDE, lmscore.SIDE + n)
    ids[at] = r.integers(0, SIDE_CLASSES**2 + 1, n)
    return ids, at


def plain_probability(w, ids, place, token):
    """P(token | two words on either side), by loops."""
    offsets = [j for j in range(-lmscore.SIDE, lmscore.SIDE + 1) if j]
    h = [math.tanh(float(w["hidden"][d]) + sum(float(w["embed"][k][ids[place + j]][d]) for k, j in enumerate(offsets))) for d in range(len(w["hidden"]))]

    def share(matrix, bias, column):
        z = [float(bias[c]) + sum(x * float(matrix[d][c]) for d, x in enumerate(h)) for c in range(len(bias))]
        return math.exp(z[column] - max(z)) / sum(math.exp(v - max(z)) for v in z)

    c, member = divmod(token, SIDE_CLASSES)
    p = share(w["class_w"], w["class_b"], c)
    return p if c == SIDE_CLASSES else p * share(w["token_w"][c], w["token_b"][c], member)


@pytest.mark.parametrize("seed", range(3))
def test_log_probabilities_by_plain_loops(seed):
    w, (ids, at) = weights(seed), stream(seed)
    got = lmscore.log_probs(w, ids, at)
    want = [math.log(plain_probability(w, ids, p, int(ids[p]))) for p in at]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_probabilities_of_all_words_at_a_place_sum_to_one(scale):
    """Also where scores are so large that the row maximum has to be taken off."""
    w, (ids, at) = weights(4), stream(4)
    w["class_w"], w["token_w"] = w["class_w"] * scale, w["token_w"] * scale
    for place in at[:8]:
        total = 0.0
        for token in range(SIDE_CLASSES**2 + 1):
            told = ids.copy()
            told[place] = token  # the place itself is masked, so only what is asked for changes
            total += math.exp(float(lmscore.log_probs(w, told, np.array([place]))[0]))
        assert math.isclose(total, 1.0, rel_tol=1e-6)


def test_one_step_follows_the_gradient():
    w, (ids, at) = weights(5), stream(5, 12)
    trainer = lmscore.Trainer(w, 0.1)
    trainer.learn(ids, at)
    loss = lambda v: -float(lmscore.log_probs(v, ids, at).astype(np.float64).mean())
    r = np.random.default_rng(6)
    for key, value in w.items():
        for _ in range(12):
            spot = tuple(int(r.integers(0, s)) for s in value.shape)
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[key][spot] += 1e-4
            down[key][spot] -= 1e-4
            g = (loss(up) - loss(down)) / 2e-4
            moved = float(trainer.w[key][spot] - value[spot])
            assert math.isclose(moved, -0.1 * g / math.sqrt(1e-3 + g * g), rel_tol=0.03, abs_tol=2e-4), (key, spot)


def test_score_is_the_sum_over_all_places(spark):
    """Documents of a small corpus, by the weights and plain loops; words outside the vocabulary cost their spelling as well."""
    texts = ["ka den ras tol ka den", "x", "", None, "ras ras tol zzz ka"] + ["ka den ras tol mun pik"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lmscore.gather(docs, "text")
    encoded = lmscore.token_ids(docs, model, "doc_id")
    trained = lmscore.train(encoded, model.counts, model.side)
    w = lmscore.unflatten(trained, model.side)
    rows = {x.doc_id: x for x in encoded.collect()}
    for x in lmscore.score(encoded, trained, model.side).collect():
        ids = np.frombuffer(rows[x.doc_id].ids, np.uint16).astype(np.int64)
        padded = np.concatenate([np.full(lmscore.SIDE, lmscore.PAD), ids, np.full(lmscore.SIDE, lmscore.PAD)])
        want = sum(float(lmscore.log_probs(w, padded, np.array([lmscore.SIDE + k]))[0]) for k in range(len(ids))) + rows[x.doc_id].spelled
        assert x.n_tokens == len(ids) and math.isclose(x.log_likelihood, want, abs_tol=2e-3)


def test_held_out_text_is_told_better_than_by_single_words(spark):
    """A corpus with word order: perplexity of unseen documents under the network and under counts of single words."""
    r = np.random.default_rng(9)
    names = [f"{a}{b}" for a in "ka lo mi ru te so na vi".split() for b in "den ras tol mun pik".split()]

    def text():
        k, out = int(r.integers(0, 40)), []
        for _ in range(120):
            out.append(names[k])
            k = (3 * k + int(r.integers(0, 3))) % 40
        return " ".join(out)

    train = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    held = spark.createDataFrame([(i, text()) for i in range(20)], "doc_id long, text string")
    model = lmscore.gather(train, "text")
    encoded = lmscore.token_ids(held, model, "doc_id")
    trained = lmscore.train(lmscore.token_ids(train, model, "doc_id"), model.counts, model.side, rounds=4, batch=32)
    scored = lmscore.score(encoded, trained, model.side).collect()
    n = sum(x.n_tokens for x in scored)
    network = math.exp(-sum(x.log_likelihood for x in scored) / n)
    share = model.counts / model.counts.sum()
    single = 0.0
    for x in encoded.collect():
        single += float(np.log(share[np.frombuffer(x.ids, np.uint16)]).sum()) + x.spelled
    assert network < 0.6 * math.exp(-single / n)
