"""Token ids of batches of texts, segment by segment, with a bounded table of segments already encoded.

A segment is a stretch of bytes whose ids don't depend on what stands around it; each encoder below says where its
tokenizer allows a cut. numpy cuts a batch and looks the segments' 64-bit hashes up in a direct-mapped table; only new
segments reach the tokenizer. A text that can't be cut safely goes to the tokenizer whole. The table saves work: a newer
segment takes a slot, a full table is emptied. Two segments count as equal by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from crossgauge.llm.common import _LOWER, _SPACE, prefix_hash, span_hash, word_spans
from crossgauge.llm.tokens import _byte_symbols, tokenizer_path

#: Slots of a worker's table are 2**SLOT_BITS, 16 bytes each; it also holds KEPT_IDS ids.
SLOT_BITS = 20
KEPT_IDS = 4 << 20
#: Bytes of the longest segment that the table holds; a text with a longer one goes whole.
LONGEST = 1024
#: Bytes whose segments are hashed at once.
STEP = 1 << 20

_TAIL = np.isin(np.arange(256), list(b".,"))
_ASCII = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte there ends an ASCII or Latin-1 letter."""
    b = data[at]
    return _ASCII[b] | (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7) & (data[np.maximum(at - 1, 0)] == 0xC3)


def _doc_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, at, side="right") - 1


def _encoded(texts: list[bytes], plain: list[str | None], tokenizer) -> list[list[int]]:
    """Ids of texts: those with a plain form, one piece of letters in the model's symbols, go straight to the model."""
    model = tokenizer.model
    out = [None if p is None else [t.id for t in model.tokenize(p)] for p in plain]
    rest = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(rest, tokenizer.encode_batch([texts[i].decode() for i in rest], add_special_tokens=False) if rest else (), strict=True):
        out[i] = e.ids
    return out


def _finds(data: np.ndarray, literal: bytes) -> list[int]:
    raw, out = data.tobytes(), []
    at = raw.find(literal)
    while at >= 0:
        out.append(at)
        at = raw.find(literal, at + 1)
    return out


class Segments:
    """cut() and encode() are what a tokenizer needs; fold maps bytes that its segments don't tell apart."""

    fold: np.ndarray | None = None

    def __init__(self, size: int, slot_bits: int = SLOT_BITS, kept_ids: int = KEPT_IDS):
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.shift = np.uint64(64 - slot_bits)
        self.keys, self.at, self.size = np.zeros(1 << slot_bits, np.uint64), np.zeros(1 << slot_bits, np.int32), np.zeros(1 << slot_bits, np.int32)
        self.flat, self.used = np.zeros(kept_ids, self.dtype), 0

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of every segment in order, and which documents must go whole."""
        raise NotImplementedError

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _look_up(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, number of ids) of every segment; what the table lacks is encoded and kept."""
        hashes = np.maximum(hashes, np.uint64(1))
        slot = (hashes >> self.shift).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero(self.keys[slot] != hashes)
        if not len(missing):
            return at, size
        new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
        first = missing[first]
        ids = self.encode([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum()))
        if self.used + len(flat) > len(self.flat):
            if self.used:
                self.keys[:] = 0
                self.used = 0
                return self._look_up(hashes, raw, start, end)
            self.flat = np.zeros(2 * len(flat), self.dtype)
        self.flat[self.used : self.used + len(flat)] = flat
        places = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        self.used += len(flat)
        own = (new >> self.shift).astype(np.int64)
        self.keys[own] = new
        winner = self.keys[own] == new  # of two new segments in a slot one stays
        self.at[own[winner]], self.size[own[winner]] = places[winner], sizes[winner]
        at[missing], size[missing] = places[inverse], sizes[inverse]
        return at, size

    def batch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each) of the texts data[off[i]:off[i + 1]]."""
        n = len(off) - 1
        doc, start, end, odd = self.cut(data, off)
        odd[doc[end - start > LONGEST]] = True
        if odd.any():
            use = ~odd[doc]
            doc, start, end = doc[use], start[use], end[use]
        count, ids = np.zeros(n, np.int64), np.zeros(0, self.dtype)
        if len(start):
            parts, sizes, i = [], [], 0
            while i < len(start):  # a very long text goes step by step
                j = max(i + 1, int(np.searchsorted(end, start[i] + STEP, side="right")))
                base, rows = int(start[i]), slice(i, j)
                own = data[base : int(end[j - 1])]
                a, b = start[rows] - base, end[rows] - base
                at, size = self._look_up(span_hash(prefix_hash(own if self.fold is None else self.fold[own]), a, b), own.tobytes(), a, b)
                stop = np.cumsum(size, dtype=np.int64)
                parts.append(self.flat[np.repeat(at - (stop - size), size) + np.arange(int(stop[-1]))])
                sizes.append(size)
                i = j
            ids = np.concatenate(parts)
            count = np.bincount(doc, np.concatenate(sizes), n).astype(np.int64)
        if odd.any():
            begin = np.cumsum(count) - count
            parts = [ids[b : b + c] for b, c in zip(begin.tolist(), count.tolist(), strict=True)]
            where = np.flatnonzero(odd).tolist()
            for k, x in zip(where, self.encode([data[off[k] : off[k + 1]].tobytes() for k in where]), strict=True):
                parts[k] = np.array(x, self.dtype)
                count[k] = len(x)
            ids = np.concatenate(parts) if parts else ids
        return ids, count


class Folded(Segments):
    """A tokenizer that drops white space, lower-cases and treats letters, digits and signs apart: cut at white space and before a final stop or comma.

    No composition of characters and no special token spans white space, and case doesn't matter to it.
    """

    fold = _LOWER

    def __init__(self, path: str, **sizes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        super().__init__(self.tokenizer.get_vocab_size(), **sizes)

    def cut(self, data, off):
        doc, start, end = word_spans(data, off)
        odd = np.zeros(len(off) - 1, bool)
        for literal in self.special:  # it counts in its own case only, which the folded table doesn't tell
            odd[_doc_of(off, np.array(_finds(data, literal), np.int64))] = True
        if not len(start):
            return doc, start, end, odd
        tail = (end - start > 1) & _TAIL[data[end - 1]] & _letter(data, end - 2)
        at = np.flatnonzero(tail)
        cut = end - tail
        return np.insert(doc, at + 1, doc[at]), np.insert(start, at + 1, cut[at]), np.insert(cut, at + 1, end[at]), odd

    def encode(self, texts):
        return _encoded(texts, [t.lower().decode() if t.isalpha() else None for t in texts], self.tokenizer)  # of bytes: ASCII letters


class ByteLevel(Segments):
    """Byte-level BPE whose pattern keeps one blank with the word behind it.

    A run of white space ends before its last character, which goes with the word if it is a blank; a final stop or comma
    stands apart from the letter before it. Special tokens are plain text. Other white space inside a word: whole.
    """

    def __init__(self, path: str, **sizes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        super().__init__(self.tokenizer.get_vocab_size(), **sizes)
        self.blank = _byte_symbols()[32]
        byte = {c: b for b, c in _byte_symbols().items()}
        vocab = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.bytes = [bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode() for token, _ in vocab]

    def cut(self, data, off):
        n, space = len(off) - 1, _SPACE[data]
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(n, bool)
        full = off[1:] > off[:-1]
        first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
        first[off[:-1][full]] = True
        last[off[1:][full] - 1] = True
        before, after = np.concatenate(([False], space[:-1])) & ~first, np.concatenate((space[1:], [False])) | last
        begin = first | space & ~before | space & ~after  # of a run of white space: its start and its last character
        # a line feed or tab before a word is a segment of its own by the pattern, but its ids are those of both together
        word_end = ~space & (last | np.concatenate((space[1:], [False])))
        tail = np.flatnonzero(word_end & _TAIL[data] & ~first)
        begin[tail[_letter(data, tail - 1)]] = True
        odd = np.zeros(n, bool)
        # white space that isn't ASCII's, or control characters which Python and the pattern may take differently
        other = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | (data >= 0x1C) & (data < 0x20))
        for k in np.unique(_doc_of(off, other)).tolist() if len(other) else ():
            text = data[off[k] : off[k + 1]].tobytes().decode()
            odd[k] = any(c.isspace() and c not in " \t\n\v\f\r" for c in set(text))
        start = np.flatnonzero(begin)
        return _doc_of(off, start), start, np.append(start[1:], len(data)), odd

    def encode(self, texts):
        return _encoded(texts, [self.blank + t[1:].decode() if t[:1] == b" " and t[1:].isalpha() else None for t in texts], self.tokenizer)


class Pieces(Segments):
    """A sentencepiece model that adds a blank in front and whose pieces hold blanks at their start only: cut before every run of blanks.

    Texts come with that blank in front of them.
    """

    def __init__(self, path: str, **sizes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        super().__init__(n, **sizes)
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank behind other characters")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def cut(self, data, off):
        n, blank = len(off) - 1, data == 32
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(n, bool)
        full = off[1:] > off[:-1]
        first = np.zeros(len(data), bool)
        first[off[:-1][full]] = True
        odd = np.zeros(n, bool)
        odd[np.flatnonzero(full)[blank[off[1:][full] - 1]]] = True  # blanks at the end
        start = np.flatnonzero(first | blank & np.concatenate(([True], ~blank[:-1])))
        return _doc_of(off, start), start, np.append(start[1:], len(data)), odd

    def encode(self, texts):
        return self.model.encode([t[1:].decode() for t in texts], num_threads=1)


@lru_cache(maxsize=4)
def segments(kind: type, name_or_path: str) -> Segments:
    """One of a kind and file for each worker process."""
    return kind(tokenizer_path(name_or_path))
