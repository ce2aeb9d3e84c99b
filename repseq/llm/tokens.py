"""Token ids by a public word BPE vocabulary, with a word cache that gives the library's ids."""

from __future__ import annotations

import os
import re
from array import array

#: Fixed by the vocabulary file: how it cuts lower-cased text, here for texts of ASCII and Latin-1 letters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿßªµº]+|[0-9²³¹¼-¾]|[^\sa-zà-öø-ÿßªµº0-9²³¹¼-¾]+")
#: Texts in which normalisation is lower-casing alone; others, and those with special tokens' marks, go to the library whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Maps a normalised word to its ids as little-endian unsigned 32-bit bytes; forgets all when it grows too large."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.word = Tokenizer.from_file(path)
        self.word.normalizer = Sequence([])
        self.limit = limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = array("I", self.word.encode(word, add_special_tokens=False).ids).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
