"""Token ids of texts by a BPE whose tokens never cross a blank: words are looked up, and the
new words of a batch are encoded together."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

MOST_WORDS = 1 << 17  # in each half of a worker's memory
BATCH_WORDS = 1 << 16


class Memory:
    """Ids of words as little-endian unsigned 32-bit numbers, remembered in two halves.

    When the young half is full it becomes the old one, and what was old goes. A word of the
    old half that comes again is young again, so words that do not come back leave.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: Sequence[Sequence[str]]) -> list[bytes]:
        """The joined ids of each text, given as its words."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = set().union(*texts).difference(young)
        if new:
            known = [w for w in new if w in old]
            young.update(zip(known, map(old.__getitem__, known)))
            rest = list(new.difference(known))
            for at in range(0, len(rest), BATCH_WORDS):
                part = rest[at:at + BATCH_WORDS]
                young.update(zip(part, self.encode(part)))
        return [b"".join(map(young.__getitem__, words)) for words in texts]


def cut_at(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of the ids before each place of `ends`, without what stands there."""
    data, stops = ids.astype("<u4").tobytes(), ends.tolist()
    return [data[4 * a:4 * b] for a, b in zip([0, *(e + 1 for e in stops[:-1])], stops)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEndIds:
    """Ids by a tokenizer file of the kind "BPE with word ends; lower case, white space dropped".

    Words of Latin letters below U+0250 go to the faster library as ranks of the same
    vocabulary, where a zero byte stands for the word's end; its pairs come first among the
    merges. Any other word goes to the tokenizer itself, and so does a whole text that holds
    a control character or what may be the text of a special token.
    """

    # The zero byte, and what Python splits words at but the tokenizer does not.
    whole = ("<|", "\x00", "\x1c", "\x1d", "\x1e", "\x1f")
    latin = re.compile("[\x01-\u024f]*")
    # Fixed value: what the tokenizer file splits words into.
    parts = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    end = "</w>"

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, ranks = byte_letters(), {}
        for token, rank in model["vocab"].items():
            if len(token) > len(self.end) and token.endswith(self.end):
                stem, mark = token[:-len(self.end)], b"\0"
            else:
                stem, mark = token, b""
            if all(c in letters for c in stem) and not token.startswith("<|"):
                ranks[bytes(letters[c] for c in stem) + mark] = rank
        self.split = regex.compile(self.parts)
        self.ranks = tiktoken.Encoding(
            "words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={}
        )
        self.line = ranks[b"\n"]
        self.memory = Memory(self.words)

    def words(self, words: list[str]) -> list[bytes]:
        text = "\n".join(words)
        if self.latin.fullmatch(text):
            marked = self.split.sub("\\g<0>\0", text.lower()) + "\n"
            ids = np.array(self.ranks.encode_ordinary(marked), "<u4")
            return cut_at(ids, np.flatnonzero(ids == self.line))
        plain = [w for w in words if self.latin.fullmatch(w)]
        other = [w for w in words if not self.latin.fullmatch(w)]
        out = dict(zip(other, self.slow(other)))
        if plain:
            out |= zip(plain, self.words(plain))
        return [out[w] for w in words]

    def slow(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.whole)]
        words = [t.split() for t in texts]
        for i in odd:
            words[i] = []
        out = self.memory(words)
        for i in odd:
            out[i], = self.slow([texts[i]])
        return out


@lru_cache(maxsize=2)
def word_end_ids(vocabulary: str) -> WordEndIds:
    return WordEndIds(vocabulary)
