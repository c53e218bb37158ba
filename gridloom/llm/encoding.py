"""Token ids of whole texts as bytes, by the tokenizers library."""

import re

import public_tokenizers
from tokenizers import Tokenizer

# Characters on whose classes the libraries' regular expressions surely agree, with their letters and numbers spelled out.
_LETTER, _NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧]*")
_SPLIT = re.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]"))
KEPT = 400_000  # pre-tokens remembered by a worker; beyond, the memory starts anew


def _byte_letters():
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class TokenBytes(dict):
    """Encoder of texts into little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of
    its pre-tokens in turn; each is encoded by the library when first met.  Texts
    with other characters, or that hold the text of an added token, go to the
    library whole.
    """

    def __init__(self, path):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.tokenize = self.tokenizer.model.tokenize
        self.words = [i.to_bytes(4, "little") for i in range(self.vocabulary)]

    def __missing__(self, piece):
        if piece.isascii() and piece.isprintable():  # of these only the space is written otherwise
            letters = piece.replace(" ", _LETTERS[32])
        else:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
        words = self.words
        ids = b"".join([words[t.id] for t in self.tokenize(letters)])
        if len(piece) <= 40:
            self[piece] = ids
        return ids

    def encode(self, text):
        if not text:
            return b""
        if not (text.isascii() and text.isprintable() or _PLAIN.fullmatch(text)) or any(a in text for a in self.added):
            ids = self.tokenizer.encode(text.encode("utf-8", "replace").decode("utf-8"), add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) > KEPT:
            self.clear()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))
