"""LM scoring with Brown class-based bigrams: P(word | before) = P(class | class before) * P(word | class).

While words are clustered every word has a type: each of the ``WORDS`` most frequent words its own, any other word the
bucket of its ending, length and kind of characters. Exchange clustering assigns the types to classes: each type is moved
to the class that raises the likelihood of the class bigrams most, until nothing moves. Then every other training word,
however rare, joins the class of greatest gain by its own counts of classes before and after it, summed over all training
tokens; only words that training never saw have the class of their bucket. Class bigrams are then counted anew over all
training tokens with the classes of the words.

Two passes over the training texts count: words, then what stands beside them (and type bigrams). The sums are stored, so
that clustering and classes read no text. What comes to the driver is bounded by TYPES squared; words stay distributed.
Between stages words travel packed: a task sends one row of arrays to each bucket of words (a word's bucket is its hash
modulo their number), never a row a word; a bucket is of the size of its share of the vocabulary. Transitions are smoothed by absolute discounting towards class frequencies; emissions by a discount per
class, whose mass stands for an unseen word.

For scoring, words of a share of 1 / ``SENT`` of all tokens or more, so ``SENT`` of them at most, go to every worker with
class and count. Other words' are joined to the documents bucket by bucket: a bucket of documents (``BUCKET_BYTES`` of
text) asks once for each of them (by 64-bit hash) and is scored with the answers. Words are lower-cased (A-Z) runs of
non-blanks, every text has one end token.

Null and empty texts are the end token alone. Null doc_ids count as the empty string for the fold. Equal rows are all
returned and all counted. With no training rows everything is unseen; no documents give no rows. A very long text is
scored whole, in one task. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import byte_texts, discard, doc_crc, pieces, stored

FOLDS, CLASSES, WORDS, ENDINGS = 10, 64, 768, 255
TYPES = WORDS + ENDINGS + 1  # type 0 is the end token, 1 to ENDINGS are buckets, then come words
#: Words that are sent to every worker are at most so many: each is at least this part of all tokens.
SENT = 1 << 18
#: Bytes of text of a bucket of documents that is scored at once.
BUCKET_BYTES = 16 << 20
#: Distinct words, and tokens, that a task counts before it hands them on.
FLUSH_WORDS, FLUSH_TOKENS = 400_000, 3_000_000
#: Words that are given their classes at once, and entries whose gains are summed at once.
PART, GAIN_ROWS = 4096, 20_000


def held_out(doc_id: Column) -> Column:
    return doc_crc(doc_id) % FOLDS == 0


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_hashes(words) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">i8").astype(np.int64)


def word_hash(word: bytes) -> int:
    return int(word_hashes([word])[0])


def ending(word: bytes) -> int:
    """1 to ENDINGS."""
    kind = min(len(word), 15) // 2 * 8 + word.isalpha() * 4 + word.isascii() * 2 + word.isdigit()
    return 1 + zlib.crc32(word[-2:], kind) % ENDINGS


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _arrays(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The arrays of all rows one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts words of a bucket together, by hash within, and where each bucket begins and ends."""
    own = h % buckets  # of the sign of the divisor, as NumPy has it
    order = np.lexsort((h, own))
    return order, np.searchsorted(own[order], np.arange(buckets + 1))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def most_frequent(docs: DataFrame, buckets: int) -> list:
    """h, c of the ``WORDS`` most frequent words in texts (one column); of equals those of lesser hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            h, n = word_hashes(found), np.fromiter(found.values(), np.int64, len(found))
            order, at = by_bucket(h, buckets)
            h, n = _bytes(h[order], "<i8"), _bytes(n[order], "<u4")
            full = np.flatnonzero(np.diff(at))
            rows = [(h[8 * at[b] : 8 * at[b + 1]], n[4 * at[b] : 4 * at[b + 1]]) for b in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([x for x, _ in rows], pa.binary()),
                pa.array([x for _, x in rows], pa.binary())], ["w", "h", "n"])

        for batch in pieces(batches):
            for text in byte_texts(batch.column(0)):
                found.update(tokens(text))
            if len(found) >= FLUSH_WORDS:
                yield out()
                found.clear()
        if found:
            yield out()

    def top(rows: pa.Table) -> pa.Table:
        h, c = summed(_arrays(rows.column("h"), "<i8"), _arrays(rows.column("n"), "<u4").astype(np.int64))
        best = np.lexsort((h, -c))[:WORDS]
        return pa.table({"h": h[best], "c": c[best]})

    return docs.mapInArrow(count, "w int, h binary, n binary").groupBy("w").applyInArrow(top, "h long, c long").orderBy(F.desc("c"),
        "h").limit(WORDS).collect()


class Index(dict):
    """word -> number, from 1 on, in the order they are first asked for; ``fresh``: those not yet taken."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1
        self.fresh.append(word)
        return found

    def numbers(self, text: bytes) -> np.ndarray:
        ws = tokens(text)
        return np.fromiter(map(self.__getitem__, ws), np.int32, len(ws))

    def take(self) -> list[bytes]:
        out, self.fresh = self.fresh, []
        return out


def looked_up(keys: np.ndarray, table: tuple[np.ndarray, ...], missing: int = 0) -> list[np.ndarray]:
    """The table's columns at the keys; its first column holds the keys, in order."""
    known, *columns = table
    if not len(known):
        return [np.full(len(keys), missing, c.dtype) for c in columns]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return [np.where(hit, c[at], missing) for c in columns]


def contexts(docs: DataFrame, top: dict[int, int], buckets: int) -> DataFrame:
    """A row a bucket of words (w): h, the words without a type in order, ``size``, how many entries each has, and their
    ``k`` and ``n``: a type beside the word (TYPES more if it is after it) and how often. Beside them a part of the type
    bigrams: ``code`` (type * TYPES + next) and ``many``.

    The end token stands before the first and after the last word of a text.
    """
    hashes = np.array(sorted(top), np.int64)
    numbers = np.array([top[h] for h in hashes.tolist()], np.int64)
    names = ["w", "h", "size", "k", "n", "code", "many"]
    schema = "w int, h binary, size binary, k binary, n binary, code binary, many binary"

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
            *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 7))], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bigrams = Index(), np.zeros(TYPES * TYPES, np.int64)
        own, held = [np.zeros(0, np.int64)], 0
        types, hashed = np.zeros(2 * FLUSH_WORDS, np.int64), np.zeros(2 * FLUSH_WORDS, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            rare = 1 + np.flatnonzero((types[1 : len(index) + 1] > 0) & (types[1 : len(index) + 1] <= ENDINGS))
            order, at = by_bucket(hashed[rare], buckets)
            words = rare[order]
            place = np.zeros(len(index) + 1, np.int64)
            place[words] = np.arange(len(words))
            code = np.concatenate(own)
            code = place[code // (2 * TYPES)] * (2 * TYPES) + code % (2 * TYPES)
            code, n = np.unique(code, return_counts=True)
            word, k = code // (2 * TYPES), code % (2 * TYPES)
            size = np.bincount(word, minlength=len(words))
            ends = np.searchsorted(word, at)
            h, size, k, n = _bytes(hashed[words], "<i8"), _bytes(size, "<u4"), _bytes(k, "<u2"), _bytes(n, "<u4")
            part = lambda x, width, lo, hi: x[width * lo : width * hi]
            full = np.flatnonzero(np.diff(at)).tolist()
            if full:
                yield packed([(b, part(h, 8, at[b], at[b + 1]), part(size, 4, at[b], at[b + 1]), part(k, 2, ends[b], ends[b + 1]),
                    part(n, 4, ends[b], ends[b + 1]), b"", b"") for b in full])

        for batch in pieces(batches):
            path = [np.zeros(1, np.int32)]
            for text in byte_texts(batch.column(0)):
                path += [index.numbers(text), path[0]]
            fresh = index.take()
            if fresh:
                lo, hi = len(index) - len(fresh) + 1, len(index) + 1
                if hi > len(types):
                    types, hashed = (np.concatenate([x, np.zeros(hi, np.int64)]) for x in (types, hashed))
                hashed[lo:hi] = word_hashes(fresh)
                found = looked_up(hashed[lo:hi], (hashes, numbers))[0]
                rare = np.flatnonzero(found == 0)
                found[rare] = [ending(fresh[i]) for i in rare.tolist()]
                types[lo:hi] = found
            path = np.concatenate(path)
            kind = types[path]
            bigrams += np.bincount(kind[:-1] * TYPES + kind[1:], minlength=len(bigrams))
            at = np.flatnonzero((kind > 0) & (kind <= ENDINGS))
            word = path[at].astype(np.int64) * (2 * TYPES)
            own += [word + kind[at - 1], word + TYPES + kind[at + 1]]
            held += len(path)
            if len(index) >= FLUSH_WORDS or held >= FLUSH_TOKENS:
                yield from out()
                index.clear()
                own, held = [np.zeros(0, np.int64)], 0
        yield from out()
        code = np.flatnonzero(bigrams)
        bucket = code % buckets
        yield packed([(b, b"", b"", b"", b"", _bytes(code[bucket == b], "<i4"), _bytes(bigrams[code[bucket == b]], "<i8")) for b in np.unique(bucket)
            .tolist()])

    def add(rows: pa.Table) -> pa.Table:
        h, size = _arrays(rows.column("h"), "<i8"), _arrays(rows.column("size"), "<u4").astype(np.int64)
        words, which = np.unique(h, return_inverse=True)
        code = np.repeat(which.astype(np.int64), size) * (2 * TYPES) + _arrays(rows.column("k"), "<u2")
        code, n = summed(code, _arrays(rows.column("n"), "<u4").astype(np.int64))
        size = np.bincount(code // (2 * TYPES), minlength=len(words))
        pair, many = summed(_arrays(rows.column("code"), "<i4"), _arrays(rows.column("many"), "<i8"))
        return pa.Table.from_batches([packed([(rows.column("w")[0].as_py(), _bytes(words, "<i8"), _bytes(size, "<u4"),
            _bytes(code % (2 * TYPES), "<u2"), _bytes(n, "<u4"), _bytes(pair, "<i4"), _bytes(many, "<i8"))])])

    return docs.mapInArrow(count, schema).groupBy("w").applyInArrow(add, schema)


def type_bigrams(found: DataFrame) -> np.ndarray:
    """Counts of (type, next type): TYPES squared numbers whatever the corpus."""
    out = np.zeros(TYPES * TYPES, np.int64)
    for code, many in found.select("code", "many").toLocalIterator():
        out[np.frombuffer(bytes(code), "<i4")] += np.frombuffer(bytes(many), "<i8")
    return out.reshape(TYPES, TYPES)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each type. The end token is class 0 for itself; the others start anywhere.

    Ends when a round moves nothing. Every move raises the likelihood, by more than its sums' rounding errors.
    """
    n = len(bigrams)
    full = bigrams.astype(np.float64)
    by = np.argsort(-full.sum(axis=1)[1:], kind="stable") + 1
    own = np.zeros(n, np.int64)
    own[by] = np.random.default_rng(0).integers(1, classes, n - 1)  # an even deal can be a saddle that no move leaves
    member = np.eye(classes)[own]
    between = member.T @ full @ member
    to_class, from_class = full @ member, full.T @ member  # per type: counts to, and from, each class
    least, moved = 1e-9 + 1e-12 * _xlogx(full.sum()), 1
    while moved:
        moved = 0
        for t in by:
            out, into, self_ = to_class[t].copy(), from_class[t].copy(), full[t, t]
            if not out.sum() and not into.sum():
                continue
            old = own[t]
            # without t: t's pairs with itself are in both its row and its column
            out[old] -= self_
            into[old] -= self_
            between[old, :] -= out
            between[:, old] -= into
            between[old, old] -= self_
            left, right = between.sum(axis=1) + into, between.sum(axis=0) + out  # t's neighbours keep their own totals
            gain = (_xlogx(between + out) - _xlogx(between)).sum(axis=1) + (_xlogx(between.T + into) - _xlogx(between.T)).sum(axis=1)
            diagonal = np.diagonal(between)
            gain += _xlogx(diagonal + out + into + self_) - _xlogx(diagonal + out) - _xlogx(diagonal + into) + _xlogx(diagonal)
            gain -= _xlogx(left + out.sum() + self_) - _xlogx(left) + _xlogx(right + into.sum() + self_) - _xlogx(right)
            new = 1 + int(np.argmax(gain[1:]))
            if gain[new] <= gain[old] + least:
                new = old
            between[new, :] += out
            between[:, new] += into
            between[new, new] += self_
            if new != old:
                moved += 1
                own[t] = new
                to_class[:, old] -= full[:, t]
                to_class[:, new] += full[:, t]
                from_class[:, old] -= full[t]
                from_class[:, new] += full[t]
    return own


def best_class(before: np.ndarray, after: np.ndarray, old: np.ndarray, into: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The class of greatest gain of each word; before, after: its counts of classes beside it, rows of CLASSES.

    into, out: counts of classes before and after the words that have a type of their own, a row per class of theirs.
    """
    gain = np.zeros((len(old), CLASSES))
    n = after.sum(axis=1, keepdims=True)
    # few different counts: the gain of each class and count is worked out once
    for beside, table in ((before, into), (after, out)):
        row, k = np.nonzero(beside)
        pairs, which = np.unique(np.stack([k, beside[row, k].astype(np.int64)]), axis=1, return_inverse=True)
        each = _xlogx(table.T[pairs[0]] + pairs[1][:, None]) - _xlogx(table.T[pairs[0]])
        for at in range(0, len(row), GAIN_ROWS):
            part = row[at : at + GAIN_ROWS]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            gain[part[first]] += np.add.reduceat(each[which.ravel()[at : at + GAIN_ROWS]], first, axis=0)
        gain -= _xlogx(table.sum(axis=1) + n) - _xlogx(table.sum(axis=1))
    full = out.sum(axis=1) > 0
    full[0] = False
    return np.argmax(np.where(full, gain, -np.inf), axis=1) if full.any() else old


def assigned(found: DataFrame, class_of: np.ndarray, into: np.ndarray, out: np.ndarray) -> DataFrame:
    """A row a bucket: w, and h, k (class), c of its words; ``stats``: per class its tokens, words, words seen once and twice."""
    which = class_of[:TYPES]
    # words seen once differ only in the classes before and after them
    pair = np.eye(CLASSES)
    once = np.concatenate([best_class(np.repeat(pair[i : i + 1], CLASSES, 0), pair, np.full(CLASSES, 1), into,
        out) for i in range(CLASSES)]).reshape(CLASSES, CLASSES)

    def classes(size: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(size)), size) * (2 * CLASSES) + k // TYPES * CLASSES + which[k % TYPES]
        beside = np.bincount(at, n, len(size) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
        before, after = beside[:, :CLASSES], beside[:, CLASSES:]
        c = before.sum(axis=1).astype(np.int64)
        kind = once[before.argmax(axis=1), after.argmax(axis=1)]
        often = np.flatnonzero(c > 1)
        kind[often] = best_class(before[often], after[often], np.ones(len(often), np.int64), into, out)
        return kind, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                w, h, size, k, n = (batch.column(i)[row].as_py() for i in range(5))
                size, k, n = np.frombuffer(size, "<u4").astype(np.int64), np.frombuffer(k, "<u2").astype(np.int64), np.frombuffer(n, "<u4")
                ends = np.concatenate([[0], np.cumsum(size)])
                parts = [classes(size[a : a + PART], k[ends[a] : ends[min(a + PART, len(size))]],
                    n[ends[a] : ends[min(a + PART, len(size))]]) for a in range(0, len(size), PART)]
                kind, c = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
                count = lambda weight=None: np.bincount(kind, weight, CLASSES).astype(np.int64)  # noqa: B023, E731
                stats = np.stack([count(c), count(), count(c == 1), count(c == 2)], axis=1)
                cells = [[h], [_bytes(kind, "u1")], [_bytes(c, "<i8")], [_bytes(stats, "<i8")]]
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), *(pa.array(x, pa.binary()) for x in cells)],
                    ["w", "h", "k", "c", "stats"])

    return found.select("w", "h", "size", "k", "n").mapInArrow(run, "w int, h binary, k binary, c binary, stats binary")


def word_rows(counts: DataFrame, least: int = 1) -> DataFrame:
    """h, k, c of the words seen ``least`` times or more, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, k, c = (np.frombuffer(batch.column(i)[row].as_py(), kind) for i, kind in enumerate(("<i8", "u1", "<i8")))
                at = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(k[at].astype(np.int32)), pa.array(c[at])], ["h", "k", "c"])

    return counts.select("h", "k", "c").mapInArrow(run, "h long, k int, c long")


def class_bigrams(paths: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in pieces(batches):
            own = np.frombuffer(b"\0" + b"\0".join(batch.column(0).to_pylist()) + b"\0", np.uint8).astype(np.int64)
            total += np.bincount(own[:-1] * CLASSES + own[1:], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["code", "n"])

    found = paths.select("path").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES)


class Model:
    """What the workers need: bounded by TYPES, CLASSES and SENT. Beside it the tables of words and of documents' classes."""

    def __init__(self, docs: DataFrame, rows: DataFrame | None = None):
        """docs: doc_id, text of the training side; rows: doc_id, text, held_out of all, docs if there are no others."""
        rows = docs.withColumn("held_out", F.lit(False)) if rows is None else rows
        texts = docs.select(F.col("text").cast("string"))
        self.n_docs = docs.count()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        most = most_frequent(texts, self.buckets)
        top = {r.h: 1 + ENDINGS + i for i, r in enumerate(most)}
        found = stored(contexts(texts, top, self.buckets), "contexts")
        bigrams = type_bigrams(found)
        self.class_of = exchange(bigrams)
        member = np.eye(CLASSES)[self.class_of]
        single = member * (np.arange(TYPES) > ENDINGS)[:, None]
        self.counts = stored(assigned(found, self.class_of, single.T @ bigrams.T @ member, single.T @ bigrams @ member), "word-counts")
        discard(found)
        # class statistics of the words: tokens, types, types seen once and twice
        stats = np.zeros((CLASSES, 4))
        stats[0] = (self.n_docs, 1, 0, 0)
        for (own,) in self.counts.select("stats").toLocalIterator():
            stats += np.frombuffer(bytes(own), "<i8").reshape(CLASSES, 4)
        for r in most:
            stats[self.class_of[top[r.h]]] += (r.c, 1, r.c == 1, r.c == 2)
        self.N = int(stats[:, 0].sum())
        self.V = int(stats[:, 1].sum()) - (self.n_docs == 0)
        tokens_, types_, once_, twice_ = stats.T
        self.discount = np.clip((once_ + 0.5) / (once_ + 2 * twice_ + 1), 0.05, 0.95)
        self.class_tokens = np.maximum(tokens_, 0)
        # an unseen word of a class without words at all has the whole class
        self.log_unseen = np.log10(np.where(tokens_ > 0, np.maximum(self.discount * types_, 0.5) / np.maximum(tokens_, 1), 1.0))
        # counts add up to N, so no more than SENT words can have N / SENT or more; the words with types are among those sent
        sent = word_rows(self.counts, -(-self.N // SENT)).toArrow()
        extra = ([r.h for r in most], [int(self.class_of[top[r.h]]) for r in most], [r.c for r in most])
        h, k, c = (np.concatenate([sent.column(x).to_numpy(), np.array(y, np.int64)]) for x, y in zip(("h", "k", "c"), extra, strict=True))
        self.sent = tuple(x[np.argsort(h)] for x in (h, k, c))
        self.paths = stored(walked(rows, self.counts, self.state()), "class-paths")
        between = class_bigrams(self.paths.where("not held_out"))
        before, after = between.sum(axis=1, keepdims=True), between.sum(axis=0)
        plain = (after + 0.5) / (after.sum() + 0.5 * CLASSES)
        kept = np.maximum(between - 0.5, 0)
        self.log_next = np.log10(np.where(before > 0, (kept + (before - kept.sum(axis=1, keepdims=True)) * plain) / np.maximum(before, 1), plain))

    def state(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("counts", "paths")}


def word_scores(words: list[bytes], answers: tuple[np.ndarray, ...], model: dict) -> tuple[np.ndarray, ...]:
    """Count, class, base and emission of each word."""
    hashes = word_hashes(words)
    (k, c), (k2, c2) = looked_up(hashes, model["sent"], -1), looked_up(hashes, answers, -1)
    k, c = np.where(k >= 0, k, k2).astype(np.int64), np.maximum(np.maximum(c, c2), 0)
    for i in np.flatnonzero(k < 0).tolist():
        k[i] = model["class_of"][ending(words[i])]
    seen = np.log10(np.maximum(c - model["discount"][k], 1e-3) / np.maximum(model["class_tokens"][k], 1))
    base = np.log10((c + 0.1) / (model["N"] + 0.1 * (model["V"] + 1)))
    return c, k, base, np.where(c > 0, seen, model["log_unseen"][k])


def score_bucket(docs: pa.Table, answers: pa.Table, model: dict) -> pa.Table:
    """The documents of one bucket with the counts of their words."""
    told = [_arrays(answers.column(x), kind) for x, kind in (("h", "<i8"), ("k", "u1"), ("c", "<i8"))]
    held = np.argsort(told[0], kind="stable")
    index = Index()
    per_doc = [index.numbers(text) - 1 for text in byte_texts(docs.column("text").combine_chunks())]
    c, own, base, emit = word_scores(index.take(), tuple(x[held].astype(np.int64) for x in told), model)
    total = model["N"] + 0.1 * (model["V"] + 1)
    end_base = float(np.log10((model["n_docs"] + 0.1) / total))
    end = 0.0 if model["n_docs"] else float(model["log_unseen"][0])
    rows = []
    for ids in per_doc:
        path = own[ids].astype(np.uint8).tobytes()
        rows.append((len(ids) + 1, int((c[ids] > 0).sum()) + (model["n_docs"] > 0), model["N"], float(base[ids].sum()) + end_base,
            float(emit[ids].sum()) + end, path))
    types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary()]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "emitted", "path"]
    return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), *columns], names)


def walked(rows: DataFrame, counts: DataFrame, state: dict) -> DataFrame:
    """Every document with the score of its words in their classes, and the classes as bytes."""
    buckets, sent = state["buckets"], rows.sparkSession.sparkContext.broadcast(state)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out")
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")).repartition(buckets, "b")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, set[bytes]] = {}
        known = sent.value["sent"]

        def out() -> Iterator[pa.RecordBatch]:
            for b, ws in asked.items():
                h = word_hashes(ws)
                h = h[looked_up(h, known[:2], -1)[0] < 0]
                order, at = by_bucket(h, buckets)
                h, full = _bytes(h[order], "<i8"), np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([b] * len(full), pa.int32()),
                    pa.array([h[8 * at[w] : 8 * at[w + 1]] for w in full], pa.binary())], ["w", "b", "h"])
            asked.clear()

        for batch in pieces(batches):
            for b, text in zip(batch.column(3).to_pylist(), byte_texts(batch.column(1)), strict=True):
                asked.setdefault(b, set()).update(tokens(text))
            if sum(map(len, asked.values())) >= FLUSH_WORDS:
                yield from out()
        yield from out()

    def answer(asks: pa.Table, words: pa.Table) -> pa.Table:
        known = [_arrays(words.column(x), kind) for x, kind in (("h", "<i8"), ("k", "u1"), ("c", "<i8"))]
        rows = []
        for b, h in zip(asks.column("b").to_pylist(), asks.column("h").to_pylist(), strict=True):
            own = np.frombuffer(h, "<i8")
            k, c = looked_up(own, (known[0], known[1], known[2]))
            hit = c > 0
            rows.append((b, _bytes(own[hit], "<i8"), _bytes(k[hit], "u1"), _bytes(c[hit], "<i8")))
        return pa.table({"b": pa.array([r[0] for r in rows], pa.int32())} | {x: pa.array([r[i] for r in rows], pa.binary()) for i,
            x in ((1, "h"), (2, "k"), (3, "c"))})

    # all columns, so that both sides read one shuffle of the texts
    asks = dealt.mapInArrow(ask, "w int, b int, h binary").groupBy("w")
    answers = asks.cogroup(counts.select("w", "h", "k", "c").groupBy("w")).applyInArrow(answer, "b int, h binary, k binary, c binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, emitted double, path binary"
    return dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(lambda d, a: score_bucket(d, a, sent.value), schema)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    model = Model(rows.where("not held_out"), rows)
    log_next = model.log_next

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            value = []
            for emitted, path in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                own = np.frombuffer(b"\0" + path + b"\0", np.uint8)
                value.append(emitted + float(log_next[own[:-1], own[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(value, pa.float64())], [*batch.schema.names[:6], "score"])

    scored = model.paths.mapInArrow(run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, n_tokens, base and model perplexity of both sides."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), of("base_score").alias("base"), of("score").alias("model"))
