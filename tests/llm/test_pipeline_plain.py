"""The whole pipeline, from what the classifier keeps, against one plain version of all its stages."""

import re
from collections import defaultdict

import pytest
from tests.conftest import SF
from tests.llm.test_operators import brute_classes, rows, sha

from quillstack.llm import toxicity
from quillstack.llm.common import table
from quillstack.llm.queries import word_bpe

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def without_repeated_lines(own):
    """(doc_id, text) with what lines stay; documents that lose lines and have no word left go."""
    keys = defaultdict(set)
    for d, t in own:
        for line in t.split("\n"):
            keys[lower(line.strip(BLANKS))].add(d)
    out = []
    for d, t in own:
        lines = t.split("\n")
        gone = [len(k) >= 20 and len(keys[k]) >= 3 and max(keys[k]) != d for k in (lower(x.strip(BLANKS)) for x in lines)]
        left = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        if not any(gone) or left.strip(BLANKS):
            out.append((d, left))
    return out


def without_near_copies(own):
    head = brute_classes(own)
    least = {}
    for d, t in own:
        if t in head:
            least[head[t]] = min(d, least.get(head[t], d))
    return [(d, t) for d, t in own if t not in head or least[head[t]] == d]


def without_contaminated(own, items):
    windows = set()
    for t in items:
        w = WORD.findall(lower(t))
        windows |= {tuple(w[i : i + min(13, len(w))]) for i in range(len(w) - min(13, len(w)) + 1)} if w else set()
    out = []
    for d, t in own:
        w, hit = WORD.findall(lower(t)), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= {*range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            out.append((d, t))
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


def test_whole_pipeline(spark, documents):
    from tokenizers import Tokenizer

    import corpus_pipeline

    labels = table(spark, SF, "labels")
    toxic = {r.doc_id for r in toxicity.score(documents, labels).where("predicted = 1").collect()}
    own = [(r.doc_id, r.text or "") for r in documents.collect() if r.doc_id not in toxic]
    steps = [len(own)]
    own = without_repeated_lines(own)
    steps.append(len(own))
    own = without_near_copies(own)
    steps.append(len(own))
    own = without_contaminated(own, [r.text or "" for r in table(spark, SF, "benchmark").collect()])
    steps.append(len(own))
    assert len(toxic) > 0 and steps[1] > steps[2] > steps[3], steps  # each of these stages has something to do
    tok = Tokenizer.from_file(word_bpe())
    tok.no_padding()
    tok.no_truncation()
    want = []
    for d, t in own:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert rows(corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(want, key=repr)
