"""Two kinds of tokenizer files, read as ids and the bytes that each id stands for."""

from __future__ import annotations

import functools
import os


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable Latin-1 as itself,
    the others in order from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevelTokenizer:
    """A byte-level BPE file of the ``tokenizers`` library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self._tokenizer.id_to_token(k) or "" for k in range(size)]
        self.bytes = [
            bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
            for name in names
        ]

    def encode(self, spaced: list[str]) -> list[list[int]]:
        """Ids of texts, each of which starts with a space."""
        found = self._tokenizer.encode_batch_fast(spaced, add_special_tokens=False)
        return [one.ids for one in found]


class PieceTokenizer:
    """A ``sentencepiece`` model, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(k) for k in range(self._processor.get_piece_size())]

    def _bytes(self, k: int) -> bytes:
        piece = self._processor.id_to_piece(k)
        if self._processor.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, spaced: list[str]) -> list[list[int]]:
        """Ids of texts, each of which starts with a space."""
        return self._processor.encode([one[1:] for one in spaced], num_threads=1)


@functools.cache
def tokenizer(path: str) -> ByteLevelTokenizer | PieceTokenizer:
    """The tokenizer of a file, read once by each Python worker."""
    return ByteLevelTokenizer(path) if path.endswith(".json") else PieceTokenizer(path)
