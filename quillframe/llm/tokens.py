"""Byte-level BPE ids of whole texts, from a public vocabulary file that the caller names.

Texts are cut into pieces (words with their leading space, numbers, signs, white space)
by one vectorised pass over the bytes of a whole batch; each distinct piece is merged once
by the tokenizer.  Texts with characters outside ASCII and U+00C0..U+00FF letters go to
the tokenizer whole: the ids are the same, only slower.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Classes of bytes.  Bytes from 0x80 occur in plain texts only as two-byte letters.
_LETTER, _NUMBER, _BLANK, _SIGN, _EDGE = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 255)]] = _LETTER
_CLASS[48:58] = _NUMBER
_CLASS[[*range(9, 14), 32]] = _BLANK
_CLASS[255] = _EDGE  # never in UTF-8: stands between texts

#: Texts that the vectorised pass may cut.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts joined, begun and ended by the byte 0xFF (a piece each).

    A run of letters, of numbers or of other signs is a piece and takes one space before
    it; white space before the last of its run is one piece; an apostrophe at the start of
    a piece takes the endings s t re ve m ll d.
    """
    kind = _CLASS[data]
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    first = kind != before
    blank = kind == _BLANK
    start = first & (blank | (np.roll(data, 1) != 32))
    start |= blank & (after != _BLANK) & (after != _EDGE)
    start[0] = True
    start |= kind == _EDGE
    at = np.flatnonzero((data == 39) & first & start & (after == _LETTER))
    if len(at):
        one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        ends = at + np.where(long, 3, 2)
        hit = long | short
        start[at[hit] + 1] = False
        more = ends[hit]
        start[more[kind[more] == _LETTER]] = True
    return np.flatnonzero(start)


def _ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """The vocabulary by bytes.  Bytes that print stand for themselves, the others, in order, for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(map(byte.__getitem__, token)): k for token, k in vocabulary.items() if token not in special}


class Encoder:
    """Texts to arrays of uint32 ids.

    Pieces recur, so their ids are kept; beyond ``most`` of them the memory is emptied,
    which changes speed alone.  A string that spells a special token is ordinary text.
    A byte-level vocabulary is numbered in the order of its merges, so distinct pieces are
    merged by rank (tests hold this against the tokenizer itself).
    """

    def __init__(self, path: str, most: int = 600_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = _ranks(self.tokenizer.get_vocab(with_added_tokens=False), special)
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most, self.known = most, {}

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        missing = [p for p in pieces if p not in known]
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = pieces
            known.update((p, array("I", self.merge(p.decode())).tobytes()) for p in missing)
        return [known[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if PLAIN.fullmatch(text):
                plain.append(k)
            else:
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if plain:
            joined = b"\xff".join([b"", *(texts[k].encode() for k in plain), b""])
            starts = piece_starts(np.frombuffer(joined, np.uint8))
            edges = np.append(starts, len(joined)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(joined)]).dictionary_encode()
            kinds, names = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
            edge = names.index(b"\xff")
            ids = self._pieces([b" " if k == edge else p for k, p in enumerate(names)])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            sizes[edge] = 0
            flat = np.frombuffer(b"".join(ids), np.uint32)
            full = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begins = np.cumsum(full) - full
            n = sizes[kinds]
            ends = np.cumsum(n)
            take = np.repeat(begins[kinds] - (ends - n), n) + np.arange(ends[-1])
            all_ids = flat[take]
            cuts = ends[kinds == edge]
            for k, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True):
                out[k] = all_ids[a:b]
        return out
