"""The tokenizers library behind a bounded memory of pre-tokens, one a Python worker."""

from __future__ import annotations

from functools import lru_cache

from tokenizers import Tokenizer

from .bpe import TextEncoder


@lru_cache(maxsize=2)
def memory(path: str) -> TextEncoder:
    """Words are cut and looked up many texts at a time; the library gives the ids of each pre-token new to the memory."""
    library = Tokenizer.from_file(path)
    model = library.model
    return TextEncoder(library, lambda word: [t.id for t in model.tokenize(word)])
