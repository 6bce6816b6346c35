"""Token ids of whole texts with a public tokenizer, one call per different word.

White space separates tokens in the word-level vocabulary, so a text's ids are those of its words in
order.  Ids of words are kept in a table of bounded size; clearing it costs time, never results.
"""

from __future__ import annotations

import re


_KEEP = 400_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?]*)")


class WordIds(dict):
    """Word (bytes without white space) to its ids as little-endian 32-bit numbers.

    Words of Latin letters with punctuation behind them go straight to the tokenizer's model, lower
    case and byte by byte as its own pre-tokenizer would hand them over; all others through the
    whole tokenizer.  With ``special`` the vocabulary's own markers, such as <|endoftext|>, are one
    id each where a text quotes them, as the tokenizer has it by default; else they are cut up.
    """

    def __init__(self, path: str, special: bool = False):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = not special
        self._whole.no_padding()
        self._whole.no_truncation()
        self._model = self._whole.model
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = self._bytes.pre_tokenize_str(piece)[0][0]
        return [t.id for t in self._model.tokenize(piece)]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain:
            ids = self._piece(plain[1].lower())
            if plain[2]:
                ids = ids + self._piece(plain[2])
        else:
            ids = self._whole.encode(text, add_special_tokens=False).ids
        if len(self) >= _KEEP:
            self.clear()
        out = self[word] = b"".join(i.to_bytes(4, "little") for i in ids)
        return out

    def of(self, text: bytes | None) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split())) if text else b""


_LOADED: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, special: bool = False) -> WordIds:
    """One table per worker process, vocabulary file and reading of its markers."""
    if (path, special) not in _LOADED:
        _LOADED[path, special] = WordIds(path, special)
    return _LOADED[path, special]


def vocabulary(name: str) -> str:
    """The file of a public tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
