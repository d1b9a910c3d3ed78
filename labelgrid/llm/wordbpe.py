"""Ids of the word-end BPE vocabulary, equal to the tokenizers library's, from a cache of chunks.

The library drops white space and never merges across it, so a text's ids are
those of its blank-separated chunks.  Chunks of common characters are split
here and only new words go to the library's model, many at a time; all other
chunks, those with a special token's text among them, go through the whole
library, whose plain call turns that text into the special token's id.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Entries of the two caches; beyond that, words are encoded again.
CHUNKS, WORDS = 600_000, 400_000

# Letters, numbers and contractions as the vocabulary's file splits them, for U+0021-U+017F.
LETTERS = "a-zªµºß-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")
COMMON = re.compile("[!-~¡-ſ]+")


def byte_letters() -> dict[int, str]:
    """The usual table from bytes to visible characters: printable Latin-1 stays, the rest follows from U+0100."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return {b: chr(b) if b in stay else chr(next(moved)) for b in range(256)}


class WordBpe:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        #: Tokens that the library finds before all else, as written; a chunk with one is left to it.
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.mark = os.path.commonprefix(self.special)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words without blanks; each word's last id is one that ends a word."""
        out = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            shown = " ".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in part)
            ids = np.array(self.bare.encode(shown, add_special_tokens=False).ids, "<u4")
            raw, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):
                raise ValueError("the vocabulary doesn't end each word once")
            for w, a, b in zip(part, [0, *stops], stops):
                out[w] = raw[a:b]
        return out

    def _chunks(self, new: list[str]) -> dict[str, bytes]:
        out, plain, split = {}, {}, {}
        for c in new:
            if c.isascii() and c.isalpha():
                plain[c] = c.lower()
                continue
            low = c.lower()
            if COMMON.fullmatch(low) and not (self.mark in c and any(t in c for t in self.special)):
                split[c] = SPLIT.findall(low)
            else:
                out[c] = np.array(self.whole.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.words
        wanted = {w for w in plain.values() if w not in known}
        wanted.update(w for ws in split.values() for w in ws if w not in known)
        fresh = self._words(list(wanted))
        if len(known) + len(fresh) <= WORDS:
            known.update(fresh)
        else:
            used = {*plain.values(), *(w for ws in split.values() for w in ws)}
            known = {w: fresh[w] if w in fresh else known[w] for w in used}
        for c, w in plain.items():
            out[c] = known[w]
        for c, ws in split.items():
            out[c] = b"".join([known[w] for w in ws])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.chunks, []
        for at in range(0, len(texts), 500):
            split = [t.replace("\n", " ").split(" ") for t in texts[at : at + 500]]
            new = self._chunks(list({c for cs in split for c in cs if c not in known}))
            if len(known) + len(new) <= CHUNKS:
                known.update(new)
                out += [b"".join(map(known.__getitem__, cs)) for cs in split]
            else:
                out += [b"".join([known[c] if c in known else new[c] for c in cs]) for cs in split]
        return out
