"""Quality rules: zstandard ratios of whole documents and of fixed chunks against limits by length.

Text that compresses far better than prose of its length repeats itself; text that hardly compresses is noise or coded
data. Short texts compress worse, so every length band has limits of its own, for documents and chunks alike. Chunks have
``CHUNK`` bytes; a rest of less than ``TAIL`` bytes belongs to the chunk before it, so every byte is judged. Under 128
bytes a frame's own bytes hide noise: there only repetition counts, and under 32 bytes nothing can be told.

Null and empty texts have no words and fail the base rules. Equal rows are all returned, each judged by itself. No
documents give no rows. A very long text is one row of one task, compressed chunk by chunk beside the whole. Other columns
are never read.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import byte_texts, pieces

#: (bytes from, least ratio, greatest ratio).
BANDS = ((0, 0.0, 99.0), (32, 0.80, 99.0), (64, 0.65, 99.0), (128, 0.57, 0.97), (256, 0.50, 0.86), (512, 0.48, 0.80), (1024, 0.455, 0.74),
    (2048, 0.44, 0.68), (4096, 0.42, 0.66), (8192, 0.405, 0.65), (16384, 0.385, 0.65))
CHUNK, TAIL, LEVEL = 2048, 256, 3
#: A document goes if so great a share of its chunks is out of bounds.
CHUNK_SHARE = 0.25
_SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    twice = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def base_measures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    blanks = len(text) - sum(map(len, words))
    points = len(text.decode("utf-8")) if not text.isascii() else len(text)
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        filled = [x for x in lines if x.strip()]
        dup = len(filled) - len(set(filled))
    return len(words), points - blanks, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated_words(words)


def out_of_bounds(size: int, ratio: float, bands=BANDS) -> bool:
    _, least, most = bands[bisect.bisect_right([b[0] for b in bands], size) - 1]
    return not least <= ratio <= most


def chunks(text: bytes, size: int = CHUNK, tail: int = TAIL) -> list[bytes]:
    out = [text[i : i + size] for i in range(0, len(text), size)]
    return [*out[:-2], out[-2] + out[-1]] if len(out) > 1 and len(out[-1]) < tail else out


def measure(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """One row a document: the base measures, the whole ratio, chunks out of bounds and the verdict ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level).compress
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in pieces(batches):
            rows = []
            for text in byte_texts(batch.column(1)):
                n, chars, symbols, dup, repeat = base_measures(text)
                failed = n < 50 or 100 * repeat > 50 * n
                ratio = len(squeeze(text)) / len(text) if text else 1.0
                parts = chunks(text, chunk)
                bad = sum(out_of_bounds(len(x), len(squeeze(x)) / len(x), bands) for x in parts)
                rejected = out_of_bounds(len(text), ratio, bands) or bool(parts) and bad >= chunk_share * len(parts)
                rows.append((n, chars, symbols, dup, repeat, failed, not failed and not rejected, ratio, bad, len(parts)))
            columns = [batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
