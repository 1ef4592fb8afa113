"""Public tokenizers inside tasks: each worker loads its files once.

The files' folder is a parameter; None means the installed ``public_tokenizers``.
"""

from __future__ import annotations

import base64
import os

import numpy as np

_loaded: dict[tuple, object] = {}


def vocabulary_path(name: str, folder: str | None = None) -> str:
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokens:
    """Ids of the byte-level vocabulary of 50 k pieces.

    Its ranks are read by the faster of the two libraries that know it; a text that
    holds a special token's string goes to the one that knows special tokens.
    """

    def __init__(self, folder: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary_path("byte_bpe_50k.tiktoken", folder), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self._plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json", folder))
        self.is_part = np.zeros(max(ranks.values()) + 2, bool)  # pieces that are no whole characters
        for piece, rank in ranks.items():
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.is_part[rank] = True

    def ids(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if "<|" in text:
            return np.array(self._special.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self._plain.encode_ordinary(text), "<u4")


class PieceTokens:
    """Ids of the vocabulary of 32 k pieces with byte fallback."""

    def __init__(self, folder: str | None = None) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model", folder))
        self.is_byte = np.array([self._model.is_byte(i) for i in range(self._model.vocab_size())])

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of all words, encoded as one text; no piece spans a space, so they are the ids of each word on its own."""
        return np.array(self._model.encode(b" ".join(words).decode(), num_threads=1), "<u4")


def byte_tokens(folder: str | None = None) -> ByteTokens:
    return _loaded.setdefault(("byte", folder), None) or _load(("byte", folder), ByteTokens)


def piece_tokens(folder: str | None = None) -> PieceTokens:
    return _loaded.setdefault(("piece", folder), None) or _load(("piece", folder), PieceTokens)


def _load(key: tuple, kind: type):
    _loaded[key] = kind(key[1])
    return _loaded[key]
