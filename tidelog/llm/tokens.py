"""Token ids as the tokenizers library gives them, remembered by stretches between white space.

Neither the library's normalisers, its word splitters nor its special strings reach
across a space, tab or line end of the vocabularies whose words drop white space, so a
text's ids are those of its stretches joined. Stretches repeat a lot; texts don't.
"""
from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from tidelog.llm.common import Memo

#: Longer stretches are encoded without being remembered.
REMEMBERED_CHARS = 64
SIMPLE = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
# Fixed value: the word pattern of the vocabulary, for the characters of SIMPLE in lower case.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


STAND_IN = {b: c for c, b in byte_alphabet().items()}


def vocabulary(name_or_path: str) -> str:
    """A path as it is; a bare name is looked up in the installed public vocabularies, on whichever machine asks."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


@lru_cache(maxsize=4)
def tokenizer(name_or_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name_or_path))
    t.no_truncation()
    t.no_padding()
    return t


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, for vocabularies that drop white space.

    Stretches of printable ASCII and Latin-1 letters need no normalising beyond lower
    case, so they are cut into words here and the model's merges of each word are
    remembered; anything else goes through the whole tokenizer.
    """

    def __init__(self, name_or_path: str):
        self._tokenizer = tokenizer(name_or_path)
        self._model = self._tokenizer.model
        self._stand_ins = {ord(c): "".join(STAND_IN[b] for b in c.encode()) for c in map(chr, range(0xDF, 0x100))}
        self._words = Memo(self._word, 1 << 17)
        self._stretches = Memo(self._stretch, 1 << 18)

    def _whole(self, stretch: str) -> bytes:
        return array("I", self._tokenizer.encode(stretch, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(word.translate(self._stand_ins))]).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        if SIMPLE.fullmatch(stretch) and "<|" not in stretch:
            words = self._words
            return b"".join([words[w] for w in WORDS.findall(stretch.lower())])
        return self._whole(stretch)

    def __call__(self, text: str) -> bytes:
        stretches = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        memo, whole = self._stretches, self._whole
        return b"".join([memo[s] if len(s) <= REMEMBERED_CHARS else whole(s) for s in stretches])


@lru_cache(maxsize=4)
def word_encoder(name_or_path: str) -> WordEncoder:
    return WordEncoder(name_or_path)
