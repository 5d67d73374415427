"""Word-memoised encoding with a public tokenizer file."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .common import CACHES, task_started

#: Distinct words whose ids a Python worker keeps; about 250 bytes each.
MEMO_WORDS = 1_200_000
#: Marks after a word that the tokenizer splits from it, with nothing but the marks in one piece.
TAILS = ",.;:?!()[]{}<>#$%&*|+=/\\\"-"
#: Python's str.split() takes these for white space; the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")

#: What a tokenizer file must do before merging so that its words can be encoded apart.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters below this code point are surely letters to the tokenizer too; words with others are encoded whole.
KNOWN_LETTERS = 0x530

_LOADED: dict[str, WordMemo] = {}


def only_letters(core: str) -> bool:
    """Whether the tokenizer sees nothing but letters in ``core``, once it is composed and lower-cased."""
    if core.isascii():
        return core.isalpha()
    low = unicodedata.normalize("NFC", core).lower()
    return low.isalpha() and ord(max(low)) < KNOWN_LETTERS


class WordMemo:
    """Encodes whole texts word by word.

    The tokenizer file splits at white space before anything else and looks at no context
    beyond it, so that a text's ids are those of its words in turn. Ids of frequent words are
    kept as little-endian unsigned 32-bit bytes. Texts of a file that has other steps than ``STEPS`` are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        found = json.loads(self.tokenizer.to_str())
        self.by_word = all(found[k] == v for k, v in STEPS.items()) and found["model"]["end_of_word_suffix"] == "</w>"
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: each is one word to the tokenizer, so many go in one text."""
        out: list[bytes] = []
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(part):
                out += self._encode(part)
                continue
            raw, start = ids.tobytes(), 0
            for end in ends:
                out.append(raw[4 * start : 4 * end])
                start = end
        return out

    def learn(self, split: list[list[str]]) -> dict[str, bytes] | _Both:
        """Ids of all words in ``split``; keeps those that are new while there is room."""
        memo = self.memo
        new = set().union(*split).difference(memo)
        tailed, letters, odd = [], set(), []
        for w in new:
            core = w if w.isalpha() else w.rstrip(TAILS)
            if not only_letters(core):
                odd.append(w)
                continue
            tail, low = w[len(core) :], core.lower()  # the tokenizer lower-cases letter by letter
            if low != core and low.isalpha() and "\u03a3" not in core:
                core = low
            letters.add(core)
            if len(core) != len(w) or core != w:
                tailed.append((w, core, tail))
        odd += {t for _, _, t in tailed if t and t not in memo}.difference(odd)
        letters = [w for w in letters if w not in memo]
        found = dict(zip(odd, self._encode(odd), strict=True))
        found.update(zip(letters, self._encode_words(letters), strict=True))
        known = _Both(found, memo)
        for w, core, tail in tailed:
            found[w] = known[core] + known[tail] if tail else known[core]
        room = MEMO_WORDS - len(memo)
        if len(found) <= room:
            memo.update(found)
            return memo
        if room > 0:
            for w in list(found)[:room]:
                memo[w] = found[w]
        return known

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        if not self.by_word:
            return self._encode(texts)
        odd = [i for i, t in enumerate(texts) if SEPARATORS.search(t)]
        plain = texts if not odd else ["" if SEPARATORS.search(t) else t for t in texts]
        split = [t.split() for t in plain]
        known = self.learn(split)
        out = [b"".join([known[w] for w in words]) for words in split]
        for i, ids in zip(odd, self._encode([texts[i] for i in odd]), strict=True) if odd else ():
            out[i] = ids
        return out


def _empty() -> None:
    for memo in _LOADED.values():
        memo.memo.clear()


CACHES.append(_empty)


class _Both:
    def __init__(self, a: dict, b: dict):
        self.a, self.b = a, b

    def __getitem__(self, k):
        found = self.b.get(k)
        return self.a[k] if found is None else found


def word_memo(path: str) -> WordMemo:
    """The memo of this Python worker for a tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    task_started()
    if path not in _LOADED:
        _LOADED[path] = WordMemo(path)
    return _LOADED[path]
