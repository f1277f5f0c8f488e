"""SentencePiece (BPE) encoding with seeded merge-dropout, and decoding.

The agenda holds candidate merges by score, then position. A candidate that
comes up is skipped when a hash of its place in the word, keyed by seed, document
and the word's position, falls below the dropout rate; no random state is kept,
so a text's segmentation depends on seed, row and rate alone, not on partitions,
retries or order. Every occurrence of every word draws anew for each candidate.

As a draw depends on the candidate alone, it is made when the candidate enters
the agenda, and one that is skipped never enters. The agendas of many words (of
all texts of a batch) are worked on at once, as the rows of a table of symbols:
each step takes the head of every agenda that isn't empty. Nothing is kept from
one word to the next, so memory is that of a batch.

Decoding joins pieces and gives back the very text for any seed and rate.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import whole_ids

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose agendas are worked on at once, and characters of the texts they are taken from.
AT_ONCE, CHARACTERS = 1 << 14, 1 << 20
#: No piece joins another character to a following space mark, so words can be taken one by one.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words up to so many characters have rows in a table, those of like lengths in one; longer ones have a heap.
SHORT = 48
LENGTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, SHORT)
NEVER, UNKNOWN = 1 << 30, (1 << 20) - 1
_M = (1 << 64) - 1


def _skipped(base: int, start: int, end: int, bar: int) -> bool:
    """Whether the merge into [start, end) of the word hashed to ``base`` drops out."""
    h = ((base ^ (start << 32 | end)) * 0x9E3779B97F4A7C15) & _M
    return (((h ^ h >> 32) * 0xBF58476D1CE4E5B9) >> 24 & 0xFFFFFFFF) < bar


_codecs: dict = {}


class Codec:
    """Vocabulary of a model file (its bytes), encoder and decoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.ids: dict[str, int] = {}
        self.bytes_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: b for b, i in enumerate(self.bytes_id)}
        self.raw: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if i in byte_of:
                self.raw.append(bytes([byte_of[i]]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                self.ids[piece] = i
        # Rank of every merge of two known pieces, from the order of scores; equal scores keep the order of ids.
        ranked = sorted(self.ids.values(), key=lambda i: (-sp.get_score(i), i))
        self.id_of_rank = ranked
        rank = {i: r for r, i in enumerate(ranked)}
        self.merges: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    self.merges[a << 20 | b] = rank[i]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.of_char = np.full(0x11_0000, UNKNOWN, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.of_rank = np.array(ranked, np.int32)
        # The merges as a hash table with linear probing; 0 is no merge (ids of pieces are larger).
        self.bits = max(4, (8 * len(self.merges)).bit_length())
        self.slots, self.ranks = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NEVER, np.int32)
        keys = np.fromiter(self.merges, np.uint64, len(self.merges))
        for at, key, r in zip(self._slot(keys).tolist(), self.merges, self.merges.values(), strict=True):
            while self.slots[at]:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slots[at], self.ranks[at] = key, r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of symbols ``a`` with ``b``; NEVER if there is none."""
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        at = self._slot(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.ranks[at], NEVER)
        left = np.flatnonzero((held != keys) & (held != 0))
        while left.size:
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def table(self, symbols: np.ndarray, lengths: np.ndarray, bases: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Agendas of many words at once: (symbols left, ends of their pieces, their number) of every row.

        ``symbols`` has a word a row, ``lengths`` symbols each. Candidates whose
        hash under the word's base falls below ``bar`` are left out.
        """
        rows, width = symbols.shape
        out, out_ends, out_n = symbols.copy(), np.empty((rows, width), np.int32), lengths.copy()
        sym, n, of = symbols.copy(), lengths.copy(), np.arange(rows)
        ends = np.tile(np.arange(1, width + 1, dtype=np.int32), (rows, 1))
        rank = np.full((rows, width), NEVER, np.int32)
        column = np.arange(width - 1, dtype=np.int64)[None, :]

        def offer(r, i, starts, stops) -> None:
            found = self._ranked(sym[r, i], sym[r, i + 1])
            if bar:
                some = np.flatnonzero(found != NEVER)
                spans = (starts[some].astype(np.uint64) << np.uint64(32)) | stops[some].astype(np.uint64)
                found[some[_below(bases[r[some]], spans, bar)]] = NEVER
            rank[r, i] = found

        r, i = np.nonzero(np.arange(1, width)[None, :] < n[:, None])
        offer(r, i, i, i + 2)
        while True:
            i = rank.argmin(axis=1)
            best = rank[np.arange(len(i)), i]
            done = best == NEVER
            if done.any():
                out[of[done]], out_ends[of[done]], out_n[of[done]] = sym[done], ends[done], n[done]
                live = ~done
                sym, ends, rank, n, of, bases, i, best = (x[live] for x in (sym, ends, rank, n, of, bases, i, best))
                if not len(i):
                    return out, out_ends, out_n
            r, at = np.arange(len(i)), i[:, None]
            # What stands behind the merged pair moves up by one.
            behind = column > at
            sym[:, :-1] = np.where(behind, sym[:, 1:], sym[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            ends[:, :-1] = np.where(behind | (column == at), ends[:, 1:], ends[:, :-1])
            rank[:, -1] = NEVER
            sym[r, i] = self.of_rank[best]
            rank[r, i] = NEVER
            n -= 1
            before = np.where(i > 0, ends[r, i - 1], 0)
            right = np.flatnonzero(i + 1 < n)
            offer(right, i[right], before[right], ends[right, i[right] + 1])
            left = np.flatnonzero(i > 0)
            offer(left, i[left] - 1, np.where(i[left] > 1, ends[left, i[left] - 2], 0), ends[left, i[left]])

    def word(self, word: str, bar: int, base: int) -> array:
        """Ids of one word. A candidate merge is skipped if its hash under ``base`` falls below ``bar``."""
        return self._ids(word, self._long(word, bar, base) if len(word) > SHORT else self._short(word, bar, base))

    def _ids(self, word: str, ends: list[int]) -> array:
        out, i, ids = array("i"), 0, self.ids
        for end in ends:
            known = ids.get(word[i:end])
            if known is None:
                out.extend([self.bytes_id[b] for b in word[i:end].encode("utf-8", "surrogatepass")])
            else:
                out.append(known)
            i = end
        return out

    def _short(self, word: str, bar: int, base: int) -> list[int]:
        """Ends of the pieces of one word; the agenda is a list of ranks, its head found by scanning."""
        merges, id_of_rank = self.merges, self.id_of_rank
        symbols = [self.ids.get(c, UNKNOWN) for c in word]
        ends = list(range(1, len(word) + 1))
        agenda = [merges.get(a << 20 | b, NEVER) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while agenda:
            rank = min(agenda)
            if rank == NEVER:
                break
            i = agenda.index(rank)
            if bar and _skipped(base, ends[i - 1] if i else 0, ends[i + 1], bar):
                agenda[i] = NEVER
                continue
            symbols[i : i + 2] = [id_of_rank[rank]]
            del ends[i], agenda[i]
            if i:
                agenda[i - 1] = merges.get(symbols[i - 1] << 20 | symbols[i], NEVER)
            if i < len(agenda):
                agenda[i] = merges.get(symbols[i] << 20 | symbols[i + 1], NEVER)
        return ends

    def _long(self, word: str, bar: int, base: int) -> list[int]:
        """The same with a heap, for words of any length."""
        merges, id_of_rank, n = self.merges, self.id_of_rank, len(word)
        symbols = [self.ids.get(c, UNKNOWN) for c in word]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple] = []

        def offer(i: int, mid: int) -> None:
            rank = merges.get(symbols[i] << 20 | symbols[mid])
            if rank is not None:
                heapq.heappush(agenda, (rank, i, mid, right[mid]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            rank, i, mid, end = heapq.heappop(agenda)
            if symbols[i] is None or right[i] != mid or symbols[mid] is None or right[mid] != end:
                continue
            if bar and _skipped(base, i, end, bar):
                continue
            symbols[i], symbols[mid], right[i] = id_of_rank[rank], None, end
            if end < n:
                left[end] = i
                offer(i, end)
            if left[i] >= 0:
                offer(left[i], i)
        return [right[i] for i in range(n) if symbols[i] is not None]

    def decode(self, ids) -> str:
        """Text of ids: bytes joined, the space that encoding puts first taken away."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes texts under one seed and rate.

    ``variants`` has no effect: there is no fixed number of segmentations.
    """

    def __init__(self, codec: Codec, rate: float, seed: int, variants: int | None = None):
        self.codec, self.bar = codec, int(rate * (1 << 32))
        self.salt = xxhash.xxh3_64_intdigest(f"{seed}".encode())
        self.mark = array("i", [codec.bytes_id[b] for b in SPACE.encode()]).tobytes()

    def encode(self, text: str | None, row_key: int) -> np.ndarray:
        """Ids of a whole text; empty for null and empty."""
        return self.encode_many([text], [row_key])[0]

    def encode_many(self, texts: list[str | None], row_keys: list[int]) -> list[np.ndarray]:
        """Ids of each text under its key, the words of all of them worked on together."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        some, size = [], 0
        for k, text in enumerate(texts):
            if text and SPACE in text:
                out[k] = self._with_marks(text, row_keys[k])
            elif text:
                some.append(k)
                size += len(text)
            if some and (size >= CHARACTERS or k == len(texts) - 1):
                self._together([texts[j] for j in some], [row_keys[j] for j in some], some, out)
                some, size = [], 0
        if some:
            self._together([texts[j] for j in some], [row_keys[j] for j in some], some, out)
        return out

    def _key(self, row_key: int) -> int:
        return (row_key ^ self.salt) & _M

    def _together(self, texts: list[str], row_keys: list[int], to: list[int], out: list[np.ndarray]) -> None:
        """Sets ``out`` at the places ``to``; texts without space marks of their own."""
        joined = (SPACE + SPACE.join(texts)).replace(" ", SPACE)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])  # where each text's leading mark stands
        space = chars == ord(SPACE)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first[:-1]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(chars))
        owner = np.searchsorted(starts, first)  # number of the first word of each text
        bases = np.concatenate([_bases(b - a, self._key(k), 0) for a, b, k in zip(owner.tolist(), owner[1:].tolist(), row_keys, strict=False)])
        ids, n = self._words(chars, starts, stops - starts, bases)
        upto = np.concatenate([[0], np.cumsum(n)])[owner]
        for j, k in enumerate(to):
            out[k] = ids[upto[j] : upto[j + 1]]

    def _words(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has) of words given as runs of ``chars``."""
        codec = self.codec
        symbols = np.append(codec.of_char[chars], np.full(SHORT, UNKNOWN, np.int32))
        n = np.empty(len(starts), np.int64)
        parts: list[tuple] = []
        least = 0
        for width in LENGTHS:
            mine = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            for lo in range(0, len(mine), AT_ONCE):
                w = mine[lo : lo + AT_ONCE]
                rows = symbols[starts[w][:, None] + np.arange(width)]
                left, ends, count = codec.table(rows, lengths[w].astype(np.int64), bases[w], self.bar)
                row, col = np.nonzero(np.arange(width)[None, :] < count[:, None])
                piece = left[row, col]
                size = np.ones(len(piece), np.int64)
                bytes_of = {}
                for j in np.flatnonzero(piece == UNKNOWN).tolist():  # a character without a piece goes out as its bytes
                    char = chr(chars[starts[w[row[j]]] + ends[row[j], col[j]] - 1])
                    bytes_of[j] = [codec.bytes_id[b] for b in char.encode("utf-8", "surrogatepass")]
                    size[j] = len(bytes_of[j])
                n[w] = np.bincount(row, size, len(w)).astype(np.int64)
                flat = np.repeat(piece, size)
                if bytes_of:
                    at = np.cumsum(size) - size
                    for j, own in bytes_of.items():
                        flat[at[j] : at[j] + len(own)] = own
                parts.append((w, flat))
        for w in np.flatnonzero(lengths > SHORT).tolist():
            word = chars[starts[w] : starts[w] + lengths[w]].tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.frombuffer(codec.word(word, self.bar, int(bases[w])), np.int32)
            n[w] = len(ids)
            parts.append((np.array([w]), ids))
        out = np.empty(int(n.sum()), np.int32)
        offset = np.cumsum(n) - n
        for w, flat in parts:
            own = n[w]
            out[np.repeat(offset[w] - (np.cumsum(own) - own), own) + np.arange(len(flat))] = flat
        return out, n

    def _drawn(self, words: list[str], bases: np.ndarray) -> list[bytes]:
        """Ids of each word under its base."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        ids, n = self._words(chars, np.cumsum(lengths) - lengths, lengths, bases)
        to = np.cumsum(n).tolist()
        return [ids[b - k : b].tobytes() for b, k in zip(to, n.tolist(), strict=True)]

    def _with_marks(self, text: str, row_key: int) -> np.ndarray:
        """A text with space marks of its own: these go out as bytes, between what stands before and after them."""
        first, *rest = text.split(SPACE)
        words = WORD.findall(SPACE + first.replace(" ", SPACE))
        bounds = [len(words)]
        for part in rest:
            words += WORD.findall(part.replace(" ", SPACE))
            bounds.append(len(words))
        drawn = self._drawn(words, _bases(len(words), self._key(row_key), 0)) if words else []
        return np.frombuffer(self.mark.join(b"".join(drawn[a:b]) for a, b in zip([0, *bounds], bounds, strict=False)), np.int32)


def _bases(n: int, key: int, at: int) -> np.ndarray:
    """One 64-bit key for each of ``n`` positions from ``at``."""
    with np.errstate(over="ignore"):
        x = np.arange(at + 1, at + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _below(bases: np.ndarray, spans: np.ndarray, bar: int) -> np.ndarray:
    """:func:`_skipped` for many at once."""
    with np.errstate(over="ignore"):
        h = (bases ^ spans) * np.uint64(0x9E3779B97F4A7C15)
        return (((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24)) & np.uint64(0xFFFFFFFF) < np.uint64(bar)


def load(model: bytes) -> Codec:
    key = zlib.crc32(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def row_key(seed: int, doc_id: int | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}".encode())


_encoders: dict = {}


def _encoder(model: bytes, rate: float, seed: int) -> Encoder:
    """One encoder for a worker's life."""
    key = (zlib.crc32(model), rate, seed)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(load(model), rate, seed)
    return _encoders[key]


def _encode(model: bytes, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, rate, seed)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                ids = encoder.encode_many(part.column(1).to_pylist(), [row_key(seed, d) for d in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _check(model: bytes, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, rate, seed)
        decode = encoder.codec.decode
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = part.column(1).to_pylist()
                every = encoder.encode_many(texts, [row_key(seed, d) for d in part.column(0).to_pylist()])
                same = [decode(ids.tolist()) == (text or "") for ids, text in zip(every, texts, strict=True)]
                columns = [pa.array([len(x) for x in every], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in every], pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_tokens", "ids_crc32", "lossless"])

    return run


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, rate: float = 0.1, seed: int = 0, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's piece ids; an empty list for null and empty texts.

    ``rate`` 0 gives the model's own best merges. Repeated rows are encoded
    alike, null ids like an id of their own; other columns are not read; an
    empty table gives no rows. Texts of any length are encoded whole, the agenda
    of a long word being a heap. The model (of fixed size) travels with the plan.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_encode(_model(model_path), rate, seed), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null, no ids an empty text.

    Repeated rows are decoded each; lists of any length are decoded whole; other
    columns are not read; an empty table gives no rows.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_model(model_path)), "doc_id long, text string")


def encode_and_check(docs: DataFrame, rate: float = 0.1, seed: int = 0, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), lossless (they decode to the very text; null as empty).

    Rows are encoded as by :func:`encode`, repeated ones and those with null ids each;
    texts of any length whole; an empty table gives no rows.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_check(_model(model_path), rate, seed), "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
