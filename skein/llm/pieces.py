"""Byte-level BPE of the 50k vocabulary.

A text whose characters are all below U+0180, whose classes no Unicode version disputes, is encoded by tiktoken, which
has the same vocabulary as ranks and takes half the time; for counts any other text, and any that holds a special
string, goes to the library of the tokenizer's file. Very long texts are encoded in chunks that end where a piece of the
vocabulary's own pattern does, so that the ids of a chunk are those of its pieces.
"""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np

LIMIT = 0x180
#: Characters encoded at once.
CHUNK = 500_000
SPECIAL = "<|endoftext|>"


def _classes() -> tuple[str, str, str]:
    space = {0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0}
    kinds = {"L": [], "N": []}
    for c in range(LIMIT):
        kind = unicodedata.category(chr(c))[0]
        if kind in kinds:
            kinds[kind].append(c)
    return tuple("".join(f"\\x{c:02x}" if c < 256 else f"\\u{c:04x}" for c in sorted(x)) for x in (kinds["L"], kinds["N"], space))


def piece_pattern() -> re.Pattern:
    let, num, sp = _classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{let}]+| ?[{num}]+| ?[^{sp}{let}{num}]+|[{sp}]+(?![^{sp}])|[{sp}]+")


def tiktoken_encoding(path: str, specials: dict[str, int] | None = None):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials or {})


def chunks(text: str, pattern: re.Pattern):
    """A plain text in parts of about CHUNK characters, cut between pieces, but not after white space: where a run of it
    ends depends on what follows."""
    if len(text) <= CHUNK:
        yield text
        return
    begin = 0
    for m in pattern.finditer(text):
        if m.end() - begin >= CHUNK and not text[m.end() - 1].isspace():
            yield text[begin : m.end()]
            begin = m.end()
    if begin < len(text):
        yield text[begin:]


def plain(text: str) -> bool:
    """All characters below LIMIT."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < chr(LIMIT)
    return True


class Counter:
    """Token counts of texts as the library for a tokenizer file gives them.

    byte_bpe_50k.json has the fast path; other files and texts go to tokenizers (.json) or sentencepiece (.model). No special tokens are added; special
    strings inside a text count as the library's default has them.
    """

    def __init__(self, name: str):
        import public_tokenizers

        self.name, self.path = name, public_tokenizers.path(name)
        self.library = None
        self.encode = None
        if name == "byte_bpe_50k.json":
            self.encode = tiktoken_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
            self.pattern = piece_pattern()

    def by_library(self, text: str) -> int:
        if self.library is None:
            if self.name.endswith(".model"):
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_file=self.path)
                self.library = lambda t: len(model.encode(t, num_threads=1))
            else:
                from tokenizers import Tokenizer

                model = Tokenizer.from_file(self.path)
                model.no_padding()
                model.no_truncation()
                self.library = lambda t: len(model.encode(t, add_special_tokens=False).ids)
        return self.library(text)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.encode is None or SPECIAL in text or not plain(text):
            return self.by_library(text)
        return sum(len(self.encode(part)) for part in chunks(text, self.pattern))


class Encoder:
    """Token ids of a text as little-endian uint16 (50k vocabulary, special strings as ordinary text)."""

    def __init__(self):
        import public_tokenizers

        self.encode = tiktoken_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
        self.pattern = piece_pattern()

    def __call__(self, text: str) -> bytes:
        parts = chunks(text, self.pattern) if plain(text) else [text]
        return b"".join(np.asarray(self.encode(part), dtype="<u2").tobytes() for part in parts)
