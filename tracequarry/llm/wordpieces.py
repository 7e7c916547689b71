"""Ids of a word-end BPE tokenizer, exactly as the tokenizers library gives them, word by word.

The tokenizer drops white space, so a text's ids are its words' ids in a row, and
each distinct word is worked out once. Plain words (Latin letters, digits and
punctuation) go to tiktoken, whose merging by rank gives the same pieces: a byte
that no UTF-8 text has stands for the word end. All other words, and
texts with separators that Python and the tokenizer split differently, go to
the tokenizers library itself.
"""

import json
import re
import sys
import types

import numpy as np

#: Fixed value: the tokenizer file's own pattern of pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[!-~¡-ɏ]+")
_ODD = re.compile("[\x1c-\x1f]")
_END = b"\xff"
MOST_WORDS = 150_000
SLICE = 1 << 20


def per_worker(key, make):
    """What make() gives, made once for a Python worker."""
    held = sys.modules.setdefault("_tracequarry_worker", types.ModuleType("_tracequarry_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def _byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones are themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Word to ids, as little-endian 32-bit bytes; keeps the last MOST_WORDS to 2 MOST_WORDS used."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path) as f:
            model = json.load(f)["model"]
        chars, vocab = _byte_chars(), model["vocab"]
        ranks: dict[bytes, int] = {}
        ids = []
        for end, suffix in ((b"", ""), (_END, "</w>")):
            for c, b in sorted(chars.items(), key=lambda x: x[1]):
                ranks[bytes([b]) + end] = len(ids)
                ids.append(vocab[c + suffix])
        if _END not in ranks:
            raise ValueError("every byte needs an id")
        for merge in model["merges"]:
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            body, end = (token[:-4], _END) if token.endswith("</w>") else (token, b"")
            piece = bytes(chars[c] for c in body) + end
            if piece not in ranks:
                ranks[piece] = len(ids)
                ids.append(vocab[token])
        self.ids = [np.array([i], "<u4").tobytes() for i in ids]
        self.older: dict[str, bytes] = {}
        self.fast = tiktoken.Encoding("word-end", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pre_tokens = regex.compile(PRE_TOKEN).findall

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            if not _PLAIN.fullmatch(word):
                out = self.whole(word)
            else:
                low = word.lower()
                parts = [low] if low.isalpha() else self.pre_tokens(low)
                out = b"".join([self.ids[i] for part in parts for i in self.fast.encode_single_piece(part.encode() + _END)])
        if len(self) >= MOST_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; empty for null."""
        if not text:
            return b""
        if _ODD.search(text):
            return self.whole(text)
        if len(text) <= SLICE:
            return b"".join(map(self.__getitem__, text.split()))
        out, at = [], 0
        space = re.compile(r"\s")
        while at < len(text):  # slices end at white space
            cut = space.search(text, min(len(text), at + SLICE))
            end = cut.end() if cut else len(text)
            out += map(self.__getitem__, text[at:end].split())
            at = end
        return b"".join(out)
