"""Token ids from the tokenizers library: the encoder that lengths and chunks share."""

from quillstack.functions.bpe import LONGEST, Encoder, encoder, words_are_local

__all__ = ["LONGEST", "Encoder", "encoder", "words_are_local"]
