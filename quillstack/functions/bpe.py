"""Token ids from the tokenizers library, as packed little-endian bytes.

A word-BPE file whose normalizer is NFC, white space to one blank, lower case and whose splitting drops white space
gives every blank-separated word the same ids in any text, so a word is encoded once per worker and then looked up.
Any other tokenizer file is handed whole texts.
"""

from __future__ import annotations

import json
import re
import struct
from pathlib import Path

import numpy as np

#: What a tokenizer file must hold for its words to be independent of one another.
WORD_NORMALIZER = {"type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Printable ASCII but the apostrophe (contractions) and < (special tokens), and the Latin-1 letters: NFC leaves them be.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_ENDED = re.compile(rb"(.*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([.,])", re.S)
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_alphabet() -> dict[int, int]:
    """str.translate table from bytes (read as Latin-1) to the printable alphabet of byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


def words_are_local(spec: dict) -> bool:
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    return (
        spec.get("normalizer") == WORD_NORMALIZER
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and first.get("pattern") == {"Regex": WORD_PATTERN}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and not steps[1].get("use_regex")
        and not steps[1].get("add_prefix_space")
        and not spec["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    )


#: Bytes of a word that is kept at most, so that a limit of words is one of bytes.
LONGEST = 256
#: Words that a worker keeps unless told otherwise, some 300 MB. 160 MB of texts can hold a million different ones, and all are lost when it is full.
KEPT = 1_500_000


class Encoder(dict):
    """word -> its ids as bytes; ``ids(text)`` joins them. At most ``limit`` words of ``LONGEST`` bytes stay in memory.

    content: the tokenizer file's text, if it was sent.
    """

    def __init__(self, path: str | None, limit: int = KEPT, content: str | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        if content is None:
            content = Path(path).read_text(encoding="utf-8")
        self.tok = Tokenizer.from_str(content)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.limit = limit
        self.strings = {i: s for s, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.dtype = np.dtype("<u2" if max(self.strings, default=0) < 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.packed = {i: self.pack([i]) for i in self.strings}
        spec = json.loads(content)
        self.local = words_are_local(spec)
        self.plain_decoder = spec.get("decoder") is None
        self.alphabet = _byte_alphabet()

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def tokens(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.packed[t.id] for t in self.tok.model.tokenize(mapped)])

    def __missing__(self, word: bytes) -> bytes:
        if word.endswith((b".", b",")) and (ended := _ENDED.fullmatch(word)):  # a letter, then one mark: two pieces in every text
            base, mark = ended.groups()
            known = base in self
            found = self[base] + self[mark]
            if not known:
                return found  # kept once the bare word comes again
        elif word.isalpha():
            found = self.tokens(word.lower().decode())
        elif _PLAIN.fullmatch(text := word.decode("utf-8")):
            found = b"".join(self.tokens(x) if len(x) == len(text) else self[x.encode()] for x in _PIECE.findall(text.lower()))
        else:
            found = self.whole(text)
        if len(word) > LONGEST:
            return found
        if len(self) >= self.limit:
            self.clear()
        self[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        if self.local:
            if b"<|" not in text:  # else a special token may be there, which is matched before lower-casing
                text = text.lower()
            return b"".join(map(self.__getitem__, text.split()))
        return self.whole(text.decode("utf-8"))

    def decoded(self, ids: list[int]) -> str:
        """decode(ids, skip_special_tokens=False); a file without a decoder joins the token strings by blanks."""
        if self.plain_decoder:
            return " ".join(map(self.strings.__getitem__, ids))
        return self.tok.decode(ids, skip_special_tokens=False)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = KEPT) -> Encoder:
    """One per Python worker, file and limit of words."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = Encoder(path, limit)
    return _ENCODERS[path, limit]
