"""The toxicity scores of every document against a dense non-negative PU fit written out plainly."""

import math
import zlib
from collections import Counter

import numpy as np
from tests.conftest import SF

from quillstack.llm import toxicity as t
from quillstack.llm.common import table
from quillstack.llm.decontamination import words


def features(text):
    """1 + count over features that words have, doubled where a feature comes twice or more."""
    count = Counter(k for w in words(text.encode()) for k in t.word_features(w))
    return {*count, *(k + 1 for k, n in count.items() if n > 1)}


def dense(rows, names):
    out = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        out[i, [names[f] for f in r if f in names]] = 1
    return out


def plain_fit(p, u, prior):
    """Adam on prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]), l the logistic loss; below 0 the second part alone goes back up."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    w, b = np.zeros(p.shape[1]), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, t.STEPS + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        dp, du = prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)  # of the negative part: du - dp
        gp, gu = (-prior * (1 - sigmoid(zp)) / len(p) - dp, du) if negative >= 0 else (dp, -du)
        g = np.append(gp @ p + gu @ u + t.RIDGE * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        move = t.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    low, high = -30.0, 30.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if sigmoid(u @ w + b).mean() < prior else (low, b)
    return w, b


def test_scores_by_definition(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    own = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    known = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None and not held(r.doc_id)}
    prior = sum(known.values()) / len(known)
    learn = sorted({(d, x) for d, x in own if not held(d)})
    p = [features(x) for d, x in learn if known.get(d) == 1]
    u = [features(x) for _, x in learn]
    in_p, in_u = Counter(f for r in p for f in r), Counter(f for r in u for f in r)
    least = min(max(t.LEAST_DOCS, t.LEAST_SHARE * len(p)), len(p))

    def tells(f):
        a, c = in_p[f] / len(p), max(in_u[f], 1) / len(u)
        return in_p[f] >= least and a >= t.LIFT * c and a - c >= t.SIGNIFICANT * math.sqrt(c * max(1 - c, 1e-9) / len(p))

    names = {f: i for i, f in enumerate(sorted(filter(tells, in_p)))}
    assert len(p) >= 3 and len(names) > 3
    w, b = plain_fit(dense(p, names), dense(u, names), prior)
    w = np.where(np.abs(w) > 1e-3, w, 0.0)
    want = {d: 1 / (1 + math.exp(-float(dense([features(x)], names)[0] @ w + b))) for d, x in own}
    got = {r.doc_id: r for r in t.score(docs, labels).collect()}
    assert got.keys() == want.keys()
    worst = max(abs(got[d].score - s) for d, s in want.items())
    assert worst < 1e-4, worst
    assert all(got[d].predicted == (got[d].score >= 0.3) and got[d].held_out == held(d) for d in want)
    assert len({r.predicted for r in got.values()}) == 2
