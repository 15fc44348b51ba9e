"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import functools
import json
import os
import struct
from collections.abc import Iterable

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


#: ASCII but white space and the apostrophe (which the tokenizer cuts specially), and Latin letters that no
#: normalisation composes or takes apart: all but U+0130, whose lower case is two characters.
_PLAIN = regex.compile(r"[!-&(-~\u00C0-\u012F\u0131-\u024F]*")
_PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + n) for n, b in enumerate(others)}


_CHARACTERS = _characters()
#: Plain characters in lower case and that alphabet.
_SPELLED = {c: "".join(_CHARACTERS.get(b, chr(b)) for b in c.lower().encode()) for c in map(chr, range(0x21, 0x250)) if _PLAIN.fullmatch(c)}
_FORMATS = [struct.Struct(f"<{n}I") for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    n = len(ids)
    return _FORMATS[n].pack(*ids) if n < 32 else struct.pack(f"<{n}I", *ids)


#: What `Encoder` does word by word is right for tokenizers that say this of themselves.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _by_word(path: str) -> bool:
    """Whether the tokenizer in this file takes just the steps that `Encoder` takes for it."""
    with open(path, encoding="utf-8") as f:
        of = json.load(f)
    steps = lambda key, inner: (of.get(key) or {}).get(inner)
    whole = steps("normalizer", "normalizers") == _NORMALIZERS and steps("pre_tokenizer", "pretokenizers") == _PRETOKENIZERS
    special = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in of.get("added_tokens", []))
    return whole and special and of["model"]["type"] == "BPE" and not of["model"].get("dropout") and not (of.get("truncation") or of.get("padding"))


class _Words(dict):
    """Ids by word; a word that isn't there is learnt."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        self[word] = known = self.learn(word)
        return known


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    A tokenizer that cuts at white space before anything else (word_bpe_49k.json does) gives a text the ids of
    its words in order, a word being what bytes.split() gives. Words are remembered in two generations: when
    the younger has `most` words it becomes the older, whose words are forgotten unless they are met again.
    That bounds the memory and keeps whatever is frequent. Any other tokenizer encodes whole texts itself.
    """

    def __init__(self, path: str, most: int = 550_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _by_word(path)
        self.merge = self.tokenizer.model.tokenize
        self.most = most
        self.marks = {ord(m): self._whole(m) for m in ".,"}
        self.young, self.old = _Words(self._learn), {}

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _spelled(self, stem: bytes) -> bytes:
        """The stem's ids.

        Stems of plain characters take the library's steps one by one (cut into letters, digits and others,
        bytes to characters, merges by its model), which saves what an Encoding holds besides ids; all
        others are encoded as texts.
        """
        if stem.isalpha():  # ASCII letters, in lower case by now
            return _packed([t.id for t in self.merge(stem.decode())])
        word = stem.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self._whole(word)
        parts = (word,) if word.isalpha() else _PARTS.findall(word)
        if len(parts) > 1:
            return b"".join([self.young[part.encode()] for part in parts])
        return _packed([t.id for t in self.merge("".join(map(_SPELLED.__getitem__, word)))])

    def _learn(self, word: bytes) -> bytes:
        """A new word's ids, from those it is made of where they are known.

        It is looked up without its last full stop or comma, and in lower case if it is all ASCII, where the
        ids are the same: after an ASCII letter or digit that character is a token of its own, and such a word
        is lower-cased before all else. Nothing is changed in what might be a special token.
        """
        known = self.old.get(word)
        if known is not None:
            return known
        mark = self.marks[word[-1]] if word[-1] in b".," and word[-2:-1].isalnum() else None
        stem = word if mark is None else word[:-1]
        if stem.isascii() and b"<|" not in stem:
            stem = stem.lower()
        if stem == word:
            return self._spelled(word)
        return self.young[stem] if mark is None else self.young[stem] + mark

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """For each text (null: empty) its ids' bytes. Special tokens in a text are found, none are added."""
        if not self.by_word:
            found = self.tokenizer.encode_batch([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [_packed(f.ids) for f in found]
        ids = self.young.__getitem__
        out = [b"".join(map(ids, t.split())) if t else b"" for t in texts]
        if len(self.young) > self.most:
            self.young, self.old = _Words(self._learn), self.young
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it stays for the tasks that follow."""
    return Encoder(path)


def forget() -> None:
    """Give up the worker's encoder, whose words take some hundred MB: for tasks of other operators in the same worker."""
    encoder.cache_clear()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
