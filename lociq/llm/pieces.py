"""SentencePiece encoding and decoding in numpy batches.

Texts are cut into units that no piece crosses (a run of spaces and the word after it; control
characters stand alone), and each worker encodes a distinct unit once. Units of equal length advance
together: substring hashes of all of them probe the sorted piece keys, and maxima over the possible last
pieces store backpointers (Viterbi, best sum of scores).

A model trained by merges (BPE) has scores that rank merges, and its library's ids are not the
best-scoring segmentation: few merges of high rank against many of low rank. For such a model the ids come from the same batches and probes, with the
vectorised maximum choosing the next merge of each unit; the Viterbi segmentation stays available.
A character without a piece becomes its bytes' pieces.

Null or empty text: no ids. Very long texts and units: units of more than LONG characters are merged one by
one. Ties: the leftmost merge; in Viterbi the longer last piece. Null and repeated doc_ids: see by_key. Empty
table: empty result. Other columns of the input are not touched. Units are told apart by 64-bit hashes: among n
distinct units two share one with probability n^2 / 2^65.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lociq.llm.session import by_key
from lociq.llm.text import U64, mix, pieces, span_hash, table

_P = U64(0x9E3779B97F4A7C15 | 1)
_SPACE = "▁"
UNRANKED = -1e6
LONG = 128  # units of more characters are merged one by one


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Piece keys, scores and bytes of a model file, and the batched algorithms over them."""

    _shared: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.longest = max(len(names[i]) for i in plain)
        keys = np.concatenate([self.keys_of([names[i] for i in plain if len(names[i]) == m]) for m in range(1, self.longest + 1)])
        ids = np.array([i for m in range(1, self.longest + 1) for i in plain if len(names[i]) == m], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids])
        self.score_of = {names[i]: sp.get_score(i) for i in plain}
        # Pieces that training appended without a rank have scores of about -1e9; merges may use them, but as summands they would
        # drown all others. For Viterbi, scores end ten below the lowest rank, and a character without a piece has that score too.
        self.unknown = float(self.scores[self.scores > UNRANKED].min()) - 10.0
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.bytes_of = [names[i].replace(_SPACE, " ").encode() for i in range(n)]
        for i in range(n):
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(names[i][3:5], 16)])
            elif sp.is_control(i):
                self.bytes_of[i] = b""
        size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.raw, self.raw_at, self.raw_size = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(size) - size, size

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    @staticmethod
    def _prefix(chars: np.ndarray) -> np.ndarray:
        """Prefix hashes of rows of characters."""
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), U64)
        value = mix(chars.astype(U64) + U64(1))
        for j in range(chars.shape[1]):
            out[:, j + 1] = out[:, j] * _P + value[:, j]
        return out

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([[U64(1)], np.full(n, _P)]), dtype=U64)

    def keys_of(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, U64)
        chars = np.array([[ord(c) for c in w] for w in words], np.uint32)
        return mix(self._prefix(chars)[:, -1] + U64(chars.shape[1]))

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the piece keys, and whether it is one."""
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys

    def substrings(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece id (-1: none) and score (-inf) of every substring [row, start, length - 1] of rows of equally many characters."""
        rows, n = chars.shape
        most = min(n, self.longest)
        h, power = self._prefix(chars), self._powers(most)
        ids, scores = np.full((rows, n, most), -1, np.int64), np.full((rows, n, most), -np.inf)
        for m in range(1, most + 1):
            keys = mix(h[:, m:] - h[:, : n - m + 1] * power[m] + U64(m))
            place, hit = self._probe(keys)
            ids[:, : n - m + 1, m - 1] = np.where(hit, self.ids[place], -1)
            scores[:, : n - m + 1, m - 1] = np.where(hit, self.scores[place], -np.inf)
        return ids, scores

    def viterbi(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best total score of each row, and where the symbols of that segmentation start. Ties: the longer last piece."""
        rows, n, most = scores.shape
        best, back = np.zeros((rows, n + 1)), np.zeros((rows, n + 1), np.int64)
        at = np.arange(rows)
        for j in range(1, n + 1):
            m = np.arange(min(j, most), 0, -1)
            last = scores[:, j - m, m - 1]
            last = np.where(np.isneginf(last), last, np.maximum(last, self.unknown))
            last[:, -1] = np.where(np.isneginf(last[:, -1]), self.unknown, last[:, -1])
            cand = best[:, j - m] + last
            pick = cand.argmax(1)
            best[:, j], back[:, j] = cand[at, pick], m[pick]
        starts, place = np.zeros((rows, n), bool), np.full(rows, n)
        while at.size:
            place[at] -= back[at, place[at]]
            starts[at, place[at]] = True
            at = at[place[at] > 0]
        return best[:, -1], starts

    def merged(self, scores: np.ndarray) -> np.ndarray:
        """Where the symbols of each row start after all merges, best score first, leftmost on ties."""
        rows, n, most = scores.shape
        starts = np.zeros((rows, n), bool)
        active, ends = np.arange(rows), np.tile(np.arange(n + 1), (rows, 1))
        while len(active):
            if ends.shape[1] > 2:
                lo, size = ends[:, :-2], ends[:, 2:] - ends[:, :-2]
                score = np.where(size <= most, scores[active[:, None], lo, np.minimum(size, most) - 1], -np.inf)
                pick = score.argmax(1)
                more = np.isfinite(score[np.arange(len(active)), pick])
            else:
                more = np.zeros(len(active), bool)
            done = np.flatnonzero(~more)
            if len(done):
                starts[active[done][:, None], ends[done, :-1]] = True
            if not more.any():
                break
            active, ends, pick = active[more], ends[more], pick[more]
            left = np.ones(ends.shape, bool)
            left[np.arange(len(active)), pick + 1] = False
            ends = ends[left].reshape(len(active), -1)
        return starts

    def merged_long(self, text: str) -> np.ndarray:
        """The same for one long unit, by a heap of pairs."""
        n = len(text)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and after[j] - i <= self.longest and (score := self.score_of.get(text[i : after[j]])) is not None:
                heapq.heappush(heap, (-score, i, after[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            alive[after[i]] = False
            after[i] = end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([i for i in range(n) if alive[i]] + [n])

    def symbol_ids(self, chars: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows' symbols in order, characters without a piece as bytes, and how many each row has."""
        row, start = np.nonzero(starts)
        end = np.concatenate([np.where(row[1:] == row[:-1], start[1:], chars.shape[1]), [chars.shape[1]]])
        found = ids[row, start, end - start - 1]
        lost = np.flatnonzero(found < 0)
        if len(lost):
            code = chars[row[lost], start[lost]]
            size = np.ones(len(found), np.int64)
            size[lost] = 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)
            row = np.repeat(row, size)
            found = np.repeat(found, size)
            spread = np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)
            found[found < 0] = self.byte_ids[spread]
        return found, np.bincount(row, minlength=len(chars))

    def encode_units(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of all units in order by merges and by Viterbi, how many each unit has, and the Viterbi scores."""
        score = np.zeros(len(units))
        size = np.array([len(u) for u in units], np.int64)
        found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            n = int(size[order[lo]])
            for first in range(lo, hi, step := max(1, 100_000 // n)):
                part = order[first : min(first + step, hi)]
                chars = np.frombuffer("".join([units[i] for i in part.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(part), n)
                ids, scores = self.substrings(chars)
                if n <= LONG:
                    merged = self.merged(scores)
                else:
                    merged = np.zeros((len(part), n), bool)
                    for k, i in enumerate(part.tolist()):
                        merged[k, self.merged_long(units[i])[:-1]] = True
                score[part], chosen = self.viterbi(scores)
                for kind, starts in enumerate((merged, chosen)):
                    found[kind].append((part, *self.symbol_ids(chars, ids, starts)))
        flats, sizes = [], []
        for groups in found:
            count = np.zeros(len(units), np.int64)
            for part, _, per in groups:
                count[part] = per
            at = np.cumsum(count) - count
            flat = np.empty(int(count.sum()), np.int64)
            for part, ids, per in groups:
                flat[np.repeat(at[part] - (np.cumsum(per) - per), per) + np.arange(len(ids))] = ids
            flats.append(flat)
            sizes.append(count)
        return flats, sizes, score

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of rows of ids: pieces' bytes in order, less the leading space that encoding adds."""
        size = self.raw_size[ids]
        total = int(size.sum())
        first = np.cumsum(size) - size
        raw = self.raw[np.repeat(self.raw_at[ids], size) + np.arange(total) - np.repeat(first, size)].tobytes()
        edge = np.concatenate([first, [total]])[at].tolist()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(edge[:-1], edge[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def unit_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every unit, and whether it opens its row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    space, control = data == 0x20, (data >= 0x09) & (data <= 0x0D)
    first = control.copy()
    first[1:] |= (space[1:] & ~space[:-1]) | control[:-1]
    opens = np.zeros(n, bool)
    opens[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(first | opens)
    return starts, np.concatenate([starts[1:], [n]]), np.searchsorted(offs, starts, "right") - 1, opens[starts]


class PieceEncoder:
    """Encodes runs of texts with a model; keeps the ids of up to `most` distinct units."""

    _shared: dict[str, PieceEncoder] = {}

    def __init__(self, path: str, most: int = 1 << 19):
        self.model, self.most = PieceModel.of(path), most
        self._clear()

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _clear(self) -> None:
        self.keys, self.score = np.zeros(0, U64), np.zeros(0)
        self.at, self.size, self.flat = ([np.zeros(0, np.int64)] * 2 for _ in range(3))

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        flats, sizes, score = self.model.encode_units(units)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.score = np.insert(self.keys, place, keys), np.insert(self.score, place, score)
        for kind, (flat, size) in enumerate(zip(flats, sizes)):
            at = len(self.flat[kind]) + np.cumsum(size) - size
            self.at[kind], self.size[kind] = np.insert(self.at[kind], place, at), np.insert(self.size[kind], place, size)
            self.flat[kind] = np.concatenate([self.flat[kind], flat])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids and row offsets, by merges and by Viterbi, and each row's Viterbi score."""
        starts, ends, row, opens = unit_spans(data, offs)
        keys = span_hash(data, starts, ends - starts)
        keys = np.where(opens, mix(keys + U64(1)), keys)
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                self._clear()
                known[:] = False
            raw, new = data.tobytes(), first[~known]
            units = [(_SPACE if o else "") + raw[s:e].decode("utf-8", "replace").replace(" ", _SPACE) for s, e, o in zip(starts[new].tolist(), ends[new].tolist(), opens[new].tolist())]
            self._learn(keys[~known], units)
            place = np.searchsorted(self.keys, keys)
        rows, all_ids, all_at = len(offs) - 1, [], []
        for kind in (0, 1):
            at, size = self.at[kind][place][which], self.size[kind][place][which]
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            all_ids.append(self.flat[kind][np.repeat(at, size) + inner] if len(size) else np.zeros(0, np.int64))
            all_at.append(np.concatenate([[0], np.cumsum(np.bincount(row, size, rows).astype(np.int64))]))
        return all_ids, all_at, np.bincount(row, self.score[place][which], rows) if len(row) else np.zeros(rows)


def encode(docs: DataFrame, path: str | None = None, method: str = "merges") -> DataFrame:
    """doc_id and ids of each text: the library's ids (merges), or those of the best-scoring segmentation (viterbi)."""
    path, kind = path or default_path(), ("merges", "viterbi").index(method)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch, data, offs in pieces(batches, most=1 << 20):
            ids, at, _ = encoder.encode(data, offs)
            yield table(key=batch.column("key"), ids=pa.ListArray.from_arrays(pa.array(at[kind].astype(np.int32)), pa.array(ids[kind].astype(np.int32))))

    return by_key(docs, lambda keyed: keyed.select("key", "text").mapInArrow(work, "key long, ids array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids are empty."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(path)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            at = lists.offsets.to_numpy()
            yield table(doc_id=batch.column("doc_id"), text=pa.array(model.decode(lists.flatten().to_numpy().astype(np.int64), at - at[0]), pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_ids, ids_crc32, n_viterbi, viterbi_crc32, viterbi_score, round_trip (decoding both gives the text again)."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch, data, offs in pieces(batches, most=1 << 20):
            ids, at, score = encoder.encode(data, offs)
            raw = data.tobytes()
            texts = [raw[s:e].decode("utf-8", "replace").replace(_SPACE, " ") for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            back = [encoder.model.decode(i, a) for i, a in zip(ids, at)]
            crc = []
            for i, a in zip(ids, at):
                four = memoryview(i.astype("<u4").tobytes())
                crc.append(np.fromiter((zlib.crc32(four[4 * s : 4 * e]) for s, e in zip(a[:-1].tolist(), a[1:].tolist())), np.int64, len(a) - 1))
            yield table(key=batch.column("key"), n_ids=np.diff(at[0]), ids_crc32=crc[0], n_viterbi=np.diff(at[1]), viterbi_crc32=crc[1], viterbi_score=score, round_trip=np.array([x == y == z for x, y, z in zip(texts, *back)], bool))

    return by_key(docs, lambda keyed: keyed.select("key", "text").mapInArrow(work, "key long, n_ids long, ids_crc32 long, n_viterbi long, viterbi_crc32 long, viterbi_score double, round_trip boolean"))
