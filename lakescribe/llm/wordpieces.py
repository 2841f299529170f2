"""Token ids of a tokenizers file, word by word, with a bounded store of words already encoded.

A tokenizer whose pre-tokenizer never joins two matches encodes each match alone, so its ids for a text are the ids of
the matches in a row. For texts of plain Latin characters the matches are found here and looked up; the library encodes
what is not in the store, and every text that has other characters.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Characters for which lower-casing, NFC and the classes of the pattern are the same here as in the library.
OTHER_CHARACTERS = re.compile("[^\t\n\r -~¡-įı-ſ]")
_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
#: The pre-tokenizer's matches in a lower-cased text without OTHER_CHARACTERS.
LATIN_MATCHES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: What the file must hold for the above to be true of it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STORED_WORDS = 600_000


class WordPieces(dict):
    """word -> its ids as little-endian unsigned 32-bit integers. Emptied when it holds STORED_WORDS, so memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN
            and [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        #: Added tokens are found in the text before anything else.
        self.added = [x["content"] for x in spec.get("added_tokens", [])]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= STORED_WORDS:
            self.clear()
        ids = np.asarray(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, 4 bytes each."""
        if not self.by_word or OTHER_CHARACTERS.search(text) or ("<|" in text and any(x in text for x in self.added)):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, LATIN_MATCHES.findall(text.lower())))


@functools.lru_cache(maxsize=4)
def word_pieces(path: str) -> WordPieces:
    """One store a worker process and file."""
    return WordPieces(path)
