"""Token ids of whole texts from a public tokenizer file, one distinct word at a time.

The word-level BPE files handled here drop white space and never join words across it, so a text's ids
are its words' ids in order. Each Python worker keeps the ids of words it has met. New words go to the
library many at a time, joined by spaces: an id stands for a fixed number of bytes of the normalised
text, so the ids of a joined text are cut where the words' bytes end. Where a cut does not fall between
two ids (a word that the normaliser splits), the words of that text are encoded one by one.

Null or empty text: no ids. Very long texts: their words are looked up together, whatever their number.
Words are told apart by 64-bit hashes: among n distinct words two share one with probability n^2 / 2^65.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from lociq.llm.text import span_hash, word_spans


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes runs of texts; keeps the ids of up to `most` distinct words.

    The cache forgets words met in one run only once it is full, so frequent words are learned once.
    """

    _shared: dict[str, WordEncoder] = {}

    def __init__(self, path: str, most: int = 1 << 19, joined: int = 1000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core; the library's own threads would only contend
        self.tokenizer, self.most, self.joined = Tokenizer.from_file(path), most, joined
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        sizes = {i: len(t.removesuffix("</w>")) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | added
        self.id_bytes = np.zeros(max(sizes) + 1, np.int64)
        self.id_bytes[list(sizes)] = list(sizes.values())
        self.keys, self.at, self.size, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _forget(self) -> None:
        """Drop the words met in one run only, and if need be all but the `most` / 2 met most often."""
        least = 2
        if len(self.met) > self.most // 2:
            least = max(least, int(np.partition(self.met, -(self.most // 2))[-(self.most // 2)]) + 1)
        stay = self.met >= least
        size = self.size[stay].astype(np.int64)
        before = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.at[stay] - before, size) + np.arange(int(size.sum()))]
        self.keys, self.at, self.size, self.met = self.keys[stay], before, self.size[stay], self.met[stay] >> 1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _encode_words(self, raw: bytes, ends: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of raw, which end at `ends` before a space each, and how many each has."""
        text = raw.decode("utf-8", "replace")
        ids = np.array(self._ids([text])[0], np.uint32)
        if not plain:
            normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
            normal = np.frombuffer(normal.encode(), np.uint8)
            ends = np.append(np.flatnonzero(normal == 0x20), len(normal)) if (normal == 0x20).sum() == len(ends) - 1 else np.zeros(0, np.int64)
        if len(ends):
            reach = np.cumsum(self.id_bytes[ids])
            want = ends - np.arange(len(ends))  # spaces have no ids
            last = np.searchsorted(reach, want)
            if len(reach) and last[-1] == len(reach) - 1 and (reach[last] == want).all() and (np.diff(want, prepend=0) > 0).all():
                return ids, np.diff(last, prepend=-1)
        each = self._ids(text.split(" "))
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        plain = np.concatenate([[0], np.cumsum(data >= 128)])
        plain = plain[ends] == plain[starts]
        flat, sizes = [], np.empty(len(keys), np.int64)
        order = np.argsort(~plain, kind="stable")
        for part, ascii_ in ((order[: plain.sum()], True), (order[plain.sum() :], False)):
            for lo in range(0, len(part), self.joined):
                pick = part[lo : lo + self.joined]
                size = ends[pick] - starts[pick]
                to = np.cumsum(size + 1)
                out = np.full(int(to[-1]) - 1, 0x20, np.uint8)
                inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                out[np.repeat(to - size - 1, size) + inner] = data[np.repeat(starts[pick], size) + inner]
                ids, n = self._encode_words(out.tobytes(), to - 1, ascii_)
                flat.append(ids)
                sizes[pick] = n
        at = np.empty(len(keys), np.int64)
        at[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size, self.met = (np.insert(x, place, y) for x, y in ((self.keys, keys), (self.at, at), (self.size, sizes), (self.met, 0)))
        self.flat = np.concatenate([self.flat, *flat])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        return place, known

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row's text, each row closed by the id `end` if given, and the rows' offsets into them."""
        starts, ends, row = word_spans(data, offs)
        keys, first, which = np.unique(span_hash(data, starts, ends - starts), return_index=True, return_inverse=True)
        place, known = self._find(keys)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                self._forget()
                place, known = self._find(keys)
            new = first[~known]
            self._learn(keys[~known], data, starts[new], ends[new])
            place = np.searchsorted(self.keys, keys)
        self.met[place] += 1
        at, size = self.at[place][which], self.size[place][which].astype(np.int64)
        rows = len(offs) - 1
        per_row = np.bincount(row, weights=size, minlength=rows).astype(np.int64) + (end is not None)
        row_at = np.concatenate([[0], np.cumsum(per_row)])
        # A word's ids start after those of all words before it and the ends of the rows before its own.
        to = np.cumsum(size) - size + (row if end is not None else 0)
        total = int(size.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        ids = np.empty(int(row_at[-1]), np.uint32)
        ids[np.repeat(to, size) + inner] = self.flat[np.repeat(at, size) + inner]
        if end is not None:
            ids[row_at[1:] - 1] = end
        return ids, row_at
