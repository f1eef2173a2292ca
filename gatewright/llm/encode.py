"""Byte-level BPE ids of whole texts, with a bounded memo of words.

The ids are those of ``byte_bpe_50k.json`` in the ``tokenizers`` library, its added token included; they are made from the same
vocabulary as ranks (``byte_bpe_50k.tiktoken``), which is twice as fast. Tests hold both against each other.

The pre-tokenizer never joins what stands on both sides of a single space between visible characters. So a text whose spaces
are all of that kind is encoded word by word, each word with its space, and repeated words come from the memo; any other
text is encoded whole, and so are all texts once more than one word in ``NEW_SHARE`` was new: a memo that is missed costs more than it
saves. Either way the ids are those of the whole text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of that vocabulary and its id: a text is split at it first.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Words of a worker's memo before it starts a new generation.
MEMO_WORDS = 200_000
#: A worker drops its memo if, of the first ``MEMO_WORDS`` words or more, more than one in so many was not in it.
NEW_SHARE = 20
#: White space other than the space, as the pre-tokenizer sees it.
OTHER_SPACE = "\t\n\x0b\x0c\r\x85\xa0                　"


def default_vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def single_spaced(text: str) -> bool:
    """Whether every space stands alone between two visible characters."""
    if not text or text[0] == " " or text[-1] == " " or "  " in text:
        return False
    return not any(c in text and (" " + c in text or c + " " in text) for c in OTHER_SPACE)


class Encoder:
    """Ids and character spans of the tokens of texts. One per worker process; see :func:`encoder`."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ADDED_ID, *ranks.values()) + 1, np.int64)
        self.spaced = np.zeros(len(self.sizes), bool)
        for token, rank in ranks.items():
            self.sizes[rank], self.spaced[rank] = len(token), token[:1] == b" "
        self.sizes[ADDED_ID] = len(ADDED)
        # two generations: words still in use move to the new one, the others go with the old one
        self.memo: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.seen = self.new = 0
        self.remembers = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def _learn(self, words: set[str]) -> None:
        """Take words into the memo: from the last generation if they are there, else encoded together."""
        new = []
        for word in words:
            if (got := self.last.get(word)) is None:
                new.append(word)
            else:
                self.memo[word] = got
        self.new += len(new)
        if new:
            ids = self._whole(" " + " ".join(new))
            at = [*(np.flatnonzero(self.spaced[ids]) * 4).tolist(), 4 * len(ids)]
            if len(at) != len(new) + 1:
                raise AssertionError("a space inside a word")
            raw = ids.tobytes()
            self.memo.update((w, raw[a:b]) for w, a, b in zip(new, at, at[1:]))

    def ids(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if ADDED in text:
            parts = [self._between(part) for part in text.split(ADDED)]
            return np.concatenate([x for part in parts for x in (np.array([ADDED_ID], np.uint32), part)][1:])
        return self._between(text)

    def _between(self, text: str) -> np.ndarray:
        """Ids of a text without the added token."""
        if not self.remembers or not single_spaced(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        self.seen += len(rest)
        entries = list(map(self.memo.get, rest))
        if None in entries:
            if len(self.memo) > MEMO_WORDS:
                self.memo, self.last = {}, self.memo
            self._learn({w for w in rest if w not in self.memo})
            entries = list(map(self.memo.__getitem__, rest))
        if self.seen >= MEMO_WORDS and self.new * NEW_SHARE > self.seen:
            self.remembers, self.memo, self.last = False, {}, {}
        return np.frombuffer(self._whole(first).tobytes() + b"".join(entries), np.uint32)

    def tokens(self, text: str) -> np.ndarray:
        """Code points [start, end) that each token touches, a row each."""
        sizes = self.sizes[self.ids(text)]
        end = np.cumsum(sizes)
        spans = np.stack([end - sizes, end - 1], 1)
        if not text.isascii():
            starts = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
            spans = (np.cumsum(starts) - 1)[spans]
        return spans + np.array([0, 1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The process's encoder: workers are reused, so its memo serves many tasks."""
    return Encoder(path)
