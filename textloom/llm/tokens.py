"""Token ids by the tokenizers library, with a bounded memo of words.

A tokenizer whose file is of the kind WORDS drops white space and never joins
anything across it, so a text's ids are those of its pieces between spaces and
newlines, one after another. Each worker keeps the ids of the short pieces it has
seen and asks the library for new ones only. Texts with a special token's string,
in whatever case, and all texts of any other kind of tokenizer are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np

#: Pieces that a worker remembers, and the code points of the longest; others are encoded again in each batch. 100 MB at the worst.
MEMO, LONGEST = 300_000, 32
#: The parts of a tokenizer's file for which the split at spaces is exact. NFC composes nothing with a
#: space or newline, lower-casing is by character, and no match of the pattern has white space in it.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
#: Below U+0250 lower-casing a letter never depends on its neighbours, so it can be done before the split.
BEYOND = re.compile("[^\x00-ɏ]")
#: Words on which asking the BPE model directly must agree with the whole tokenizer, else it isn't done.
PROBES = ["the", "a", "thtionst", "ing", "ciónosta", "über", "ßtz", "êelleque", "straße", "xqzjv"]
_encoders: dict[int, Encoder] = {}


class Encoder:
    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.by_words = all(spec.get(k) == v for k, v in WORDS.items()) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.specials = [t.content for t in added]
        self.memo: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)  # where each piece's ids start
        self.size = np.zeros(1 << 16, np.int64)
        self.n, self.used = 1, 0

        self.bytes_to_text = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        self.bytes_to_text |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.bytes_to_text)}
        self.plain = self.by_words and all([t.id for t in self.tokenizer.model.tokenize(self.spelled(w))] == self.whole(w) for w in PROBES)

    def spelled(self, word: str) -> str:
        """A word as byte-level BPE spells it: each UTF-8 byte one printable character (a fixed public table)."""
        return word if word.isascii() else "".join(map(self.bytes_to_text.__getitem__, word.encode()))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def letters(self, word: str) -> bool:
        """Lower-case letters below U+0250 alone: one piece for the pre-tokenizer, so the BPE model can be asked directly."""
        return self.plain and word.isalpha() and word.islower() and not BEYOND.search(word)

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """Numbers of new pieces; the pool grows by their ids."""
        known: dict[str, list[int]] = {}
        asked = []
        model = self.tokenizer.model
        for p in pieces:
            word, end = (p[:-1], p[-1]) if len(p) > 1 and p[-1] in ",." else (p, "")
            if self.letters(word) and (not end or end in self.memo):
                known[p] = [t.id for t in model.tokenize(self.spelled(word))]
                if end:
                    k = self.memo[end]
                    known[p] += self.flat[self.at[k] : self.at[k] + self.size[k]].tolist()
            else:
                asked.append(p)
        encoded = iter(self.tokenizer.encode_batch_fast(asked, add_special_tokens=False))
        got = [known[p] if p in known else next(encoded).ids for p in pieces]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(got) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
        self.at[self.n : self.n + len(got)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(got)] = sizes
        numbers = dict(zip(pieces, range(self.n, self.n + len(got)), strict=True))
        self.n, self.used = self.n + len(got), self.used + total
        return numbers

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order."""
        if not self.by_words:
            yield from (np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
            return
        kept = self.n, self.used
        if len(self.memo) == 1:
            self.memo |= self.learn([",", "."])
            kept = self.n, self.used
        odd: dict[int, np.ndarray] = {}
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            low = text.lower() if text.isascii() or not BEYOND.search(text) else text
            if any(s in text or s in low for s in self.specials):  # lower-casing must not make a special token
                odd[k] = np.array(self.whole(text), np.uint32)
                continue
            text = low
            pieces = text.replace("\n", " ").split(" ")
            counts[k] = len(pieces)
            words += pieces
        idx = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(idx < 0)):
            unknown = [words[i] for i in new.tolist()]
            distinct = [*dict.fromkeys(unknown)]
            numbers = self.learn([p for p in distinct if len(p) <= LONGEST])
            if len(self.memo) + len(numbers) <= MEMO:
                self.memo.update(numbers)
                kept = self.n, self.used
            numbers |= self.learn([p for p in distinct if len(p) > LONGEST])
            idx[new] = np.fromiter(map(numbers.__getitem__, unknown), np.int64, len(new))
        sizes = self.size[idx]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.at[idx] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.n, self.used = kept
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield odd[k] if k in odd else flat[a:b]


def encoder(tokenizer_json: str) -> Encoder:
    """One encoder for each worker and tokenizer; the worker keeps it for later tasks."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def batches(texts: Iterable[str | None], size: int = 2_000_000) -> Iterator[list[str]]:
    """Lists of texts (null: empty) of about `size` characters, so that a batch's lists stay small."""
    out, n = [], 0
    for text in texts:
        out.append(text or "")
        n += len(out[-1])
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out
