"""The factorization machine keeps every feature that tells the classes apart."""

import numpy as np

from roadloom.llm import fm


def test_keeps_all_features():
    # 700 words, each in 20 positive rows and no negative one; 20 words a row
    words = np.arange(700)
    row, feature = np.repeat(np.arange(700), 20), np.concatenate([(words[k] + np.arange(20) * 35) % 700 for k in range(700)])
    order = np.lexsort((feature, row))
    model = fm.train(np.concatenate([np.ones(700), np.zeros(700)]), row[order], feature[order], epochs=2)
    assert (model.keep >= 0).sum() == 700
    weight = model.weight[model.keep[words]]
    assert (weight > 0).all()


def rows_of(pairs):
    """(row, feature) arrays of lists of features."""
    row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    return row, np.concatenate([np.sort(np.array(p, np.int64)) for p in pairs])


def test_learns_pairs_without_effects_alone():
    """Class 1 where exactly one of two words stands, among other words: neither tells anything alone."""
    rng = np.random.default_rng(0)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    texts = [[*([11] if x else []), *([22] if y else []), *(100 + rng.choice(3000, 20, replace=False))] for x, y in zip(a, b)]
    row, feature = rows_of(texts)
    learn = row < 1000
    model = fm.train((a ^ b)[:1000].astype(float), row[learn], feature[learn])
    known = model.keep[feature] >= 0
    margin = model.margin(row[known], model.keep[feature[known]], 2000)
    assert ((margin > 0) == (a ^ b))[1000:].mean() > 0.95


def test_score_against_plain_sums():
    """Scores of whole texts equal w0 + the weights + all pairs of factors, added one by one."""
    rng = np.random.default_rng(1)
    texts = [b"you are a fine person", b"", b"spam SPAM spam 1,000 !!!\nline\nline\n", " ".join(f"w{i % 40}" for i in range(3000)).encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, feature = fm.features(data, offsets)
    chosen = np.unique(feature)[::2]
    keep = np.full(fm.FEATURES, -1, np.int64)
    keep[chosen] = np.arange(len(chosen))
    model = fm.Model(-0.3, keep, rng.normal(0, 0.1, len(chosen)), rng.normal(0, 0.1, (len(chosen), 8)))
    got = model.score(data, offsets)
    for i in range(len(texts)):
        own = [keep[f] for f in feature[row == i] if keep[f] >= 0]
        margin = -0.3 + sum(model.weight[k] for k in own)
        for x in range(len(own)):
            for y in range(x):
                margin += float(model.factor[own[x]] @ model.factor[own[y]])
        assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-9
