"""Token ids of whole texts by a public tokenizer file, with a bounded table of words already encoded.

A byte-level BPE splits a text at every blank that stands before a non-blank, and a final full stop or comma from
the letter before it, so the ids of a text whose white space is single blanks and single line feeds are those of
its pieces, one after another. numpy finds the pieces of a batch, looks their 64-bit hashes up in a direct-mapped
table, and gathers the ids; only pieces that aren't in the table reach the tokenizer. Any other text goes to the
tokenizer whole, as does one that holds the literal of an added token. The table saves work: a newer word takes a
slot, a full table is emptied. Two pieces count as equal by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from crossgauge.llm.common import _SPACE, CHUNK, chunks, prefix_hash, span_hash, string_bytes, word_spans

TOKENIZER = "byte_bpe_50k.json"
#: Slots of a worker's table are 2**SLOT_BITS, 14 bytes each; it also holds KEPT_IDS ids.
SLOT_BITS = 21
KEPT_IDS = 8 << 20
_WHOLE = 0xFFFF  # size of a piece whose text must go whole

_TAIL = np.isin(np.arange(256), list(b".,"))
_ASCII = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def tokenizer_path(name_or_path: str) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_symbols() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for every byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    def __init__(self, path: str, slot_bits: int = SLOT_BITS, kept_ids: int = KEPT_IDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.model, self.symbols = self.tokenizer.model, _byte_symbols()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.shift = np.uint64(64 - slot_bits)
        self.keys, self.at, self.size = np.zeros(1 << slot_bits, np.uint64), np.zeros(1 << slot_bits, np.int32), np.zeros(1 << slot_bits, np.uint16)
        self.flat, self.used = np.zeros(kept_ids, self.dtype), 0
        self.tails = np.zeros(256, self.dtype)
        for c in b".,":
            (self.tails[c],) = self.pretoken(bytes([c]))
        self.line_feed = self.pretoken(b"\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def pretoken(self, raw: bytes) -> list[int]:
        """A text that the pre-tokenizer would not split: straight to the model."""
        return [t.id for t in self.model.tokenize(raw.decode("latin1").translate(self.symbols))]

    def piece(self, raw: bytes) -> list[int] | None:
        """Ids of a separator and word; None if the word has white space of another kind inside, or is huge."""
        text = raw.decode()
        sep, word = (text[0], text[1:]) if text[0] in " \n" else ("", text)
        if word.split() != [word] or len(raw) > 4096:
            return None
        own = raw[1:] if sep == "\n" else raw
        out = self.pretoken(own) if word.isalpha() else self.tokenizer.encode(own.decode(), add_special_tokens=False).ids
        return self.line_feed + out if sep == "\n" else out

    def look_up(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, number of ids) of every piece; what the table lacks is encoded and kept."""
        hashes = np.maximum(hashes, np.uint64(1))
        slot = (hashes >> self.shift).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero(self.keys[slot] != hashes)
        if len(missing):
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            ids = [self.piece(raw[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            sizes = np.array([_WHOLE if x is None else len(x) for x in ids], np.uint16)
            flat = np.fromiter(chain.from_iterable(x for x in ids if x), self.dtype)
            if self.used + len(flat) > len(self.flat):
                if self.used:
                    self.keys[:] = 0
                    self.used = 0
                    return self.look_up(hashes, raw, start, end)
                self.flat = np.zeros(2 * len(flat), self.dtype)
            self.flat[self.used : self.used + len(flat)] = flat
            real = np.where(sizes == _WHOLE, 0, sizes).astype(np.int64)
            places = (self.used + np.cumsum(real) - real).astype(np.int32)
            self.used += len(flat)
            own = (new >> self.shift).astype(np.int64)
            self.keys[own], self.at[own], self.size[own] = new, places, sizes
            winner = self.keys[own] == new  # of two new pieces in a slot one stays
            self.at[own[winner]], self.size[own[winner]] = places[winner], sizes[winner]
            at[missing], size[missing] = places[inverse], sizes[inverse]
        return at, size

    def batch(self, column) -> list[np.ndarray]:
        """Ids of every text of an Arrow string column; null counts as empty."""
        data, off = string_bytes(column)
        n = len(off) - 1
        out: list = [np.zeros(0, self.dtype)] * n
        doc, start, end = word_spans(data, off)
        space = _SPACE[data]
        odd = np.zeros(n, bool)
        bad = space.copy()  # white space that isn't one blank or line feed between two words
        bad[:-1] &= space[1:]
        if len(bad):
            bad[-1] = space[-1]
        bad |= space & (data != 32) & (data != 10)
        full = off[1:] > off[:-1]
        ends = off[1:][full] - 1
        bad[ends] |= space[ends]
        bad[off[:-1][full]] |= space[off[:-1][full]]
        odd[np.searchsorted(off, np.flatnonzero(bad), side="right") - 1] = True
        raw = data.tobytes()
        for literal in self.special:  # a text that holds an added token's literal goes whole
            at = raw.find(literal)
            while at >= 0:
                odd[np.searchsorted(off, at, side="right") - 1] = True
                at = raw.find(literal, at + 1)
        use = ~odd[doc]
        doc, start, end = doc[use], start[use], end[use]
        if len(start):
            tail = np.where((end - start > 1) & _TAIL[data[end - 1]] & self._letter(data, end - 2), data[end - 1], 0)
            start = start - (start > off[doc])  # with the separator before it
            stem = end - (tail > 0)
            at, size = self.look_up(span_hash(prefix_hash(data), start, stem), raw, start, stem)
            if (large := size == _WHOLE).any():
                odd[doc[large]] = True
                size[large] = 0
            each = size.astype(np.int64) + (tail > 0)
            stop = np.cumsum(each)
            take = np.repeat(at - (stop - each), each) + np.arange(int(stop[-1]))
            ids = self.flat[np.minimum(take, len(self.flat) - 1)]
            ids[stop[tail > 0] - 1] = self.tails[tail[tail > 0]]
            total = np.bincount(doc, each, n).astype(np.int64)
            begin = np.cumsum(total) - total
            for k in np.flatnonzero(total).tolist():
                out[k] = ids[begin[k] : begin[k] + total[k]]
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.frombuffer(self.whole(bytes(data[off[k] : off[k + 1]]).decode()), self.dtype)
        return out

    @staticmethod
    def _letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the byte there ends an ASCII or Latin-1 letter."""
        b = data[at]
        return _ASCII[b] | (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7) & (data[np.maximum(at - 1, 0)] == 0xC3)

    def batches(self, column, limit: int = CHUNK):
        """(row index, ids) of every text of a column, about `limit` bytes at a time."""
        for i, j in chunks(column, limit):
            yield from zip(range(i, j), self.batch(column.slice(i, j - i)), strict=True)

    def encode(self, text: str | None) -> np.ndarray:
        import pyarrow as pa

        return self.batch(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=2)
def encoder(name_or_path: str = TOKENIZER, slot_bits: int = SLOT_BITS) -> Encoder:
    """One for each worker process."""
    return Encoder(tokenizer_path(name_or_path), slot_bits)
