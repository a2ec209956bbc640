"""Every word, document or token takes part."""

import random

from quillstack.llm import lm_scoring, secret_scan


def test_words_by_their_neighbours(spark):
    """Words of one spelling bucket, each seen a few times, go to the classes of what stands beside them."""
    frequent = {"a": [f"aa{i:04d}q" for i in range(384)], "b": [f"bb{i:04d}z" for i in range(384)]}
    # rare words have one ending and one shape; those of kind a stand where a's words stand
    rare = {k: [f"{k}{i:05d}xx" for i in range(30)] for k in "ab"}
    draw, own = random.Random(0), []
    for _ in range(6000):
        own.append(" ".join(draw.choice(frequent[k]) for k in "abab"))
    for i in range(30):
        own += [f"{rare['a'][i]} {frequent['b'][j]} {frequent['a'][j]} {rare['b'][i]}" for j in range(4)]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    model = lm_scoring.Model(df)
    types = {r.h: (r.k, r.c) for r in lm_scoring.word_rows(model.counts).collect()}
    kind = lambda w: types[lm_scoring.word_hash(w.encode())][0]
    assert len({lm_scoring.ending(w.encode()) for w in rare["a"] + rare["b"]}) == 1
    assert all(types[lm_scoring.word_hash(w.encode())][1] == 4 for w in rare["a"] + rare["b"])
    assert not {kind(w) for w in rare["a"]} & {kind(w) for w in rare["b"]}


def test_best_class_is_the_greatest_likelihood():
    import numpy as np

    rng = np.random.default_rng(1)
    k = lm_scoring.CLASSES
    into, out = (rng.integers(0, 400, (k, k)).astype(float) for _ in range(2))
    before, after = (np.array([rng.multinomial(6, rng.dirichlet(np.full(k, 0.05))) for _ in range(20)], float) for _ in range(2))
    f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
    likelihood = lambda w, c: sum(f(t[c] + x[w]) - f(t[c]) - f(t[c].sum() + x[w].sum()) + f(t[c].sum()) for t,
        x in ((into, before), (out, after)))
    found = lm_scoring.best_class(before, after, np.ones(20, int), into, out)
    assert [max(range(1, k), key=lambda c: likelihood(w, c)) for w in range(20)] == found.tolist()


def test_secret_scan_recall_by_encoding(spark):
    """Random tokens of every encoding and length, a tenth of the candidates of their length; names and words are no discoveries."""
    draw = random.Random(5)
    symbols = {name: a for name, _, a in secret_scan.ALPHABETS if name != "base64"}
    words = "chapter reading library children teacher morning garden river winter summer mountain village station market".split()
    join = (lambda w: "-".join(w), lambda w: "".join(x.title() for x in w), lambda w: "".join(w).upper(), lambda w: "".join(w))
    data = []
    for n in (20, 32, 40, 64):
        for name, a in symbols.items():
            data += [(name, n, "".join(draw.choice(a) for _ in range(n))) for _ in range(60)]
        for i in range(60 * len(symbols) * 9):
            data.append(("prose", n, join[i % 4]([draw.choice(words) for _ in range(12)])[:n].rstrip("-")))
    df = spark.createDataFrame([(i, x[2]) for i, x in enumerate(data)], "doc_id long, text string")
    got, of = {}, {}
    for r in secret_scan.scan(df).collect():
        key = data[r.doc_id][:2]
        of[key] = of.get(key, 0) + 1
        got[key] = got.get(key, 0) + bool(r.extra or any(b.kind == 2 for b in r.base))
    recall = {k: round(got[k] / of[k], 3) for k in of}
    print(recall)
    assert all(v <= 0.002 if k[0] == "prose" else v >= (0.9 if k[0] in ("hex", "HEX") else 0.35 if k[1] == 20 else 0.8) for k,
        v in recall.items()), recall
