"""The byte-level pre-tokenizer's pattern, for many texts at once.

``split`` gives the matches of ``public_tokenizers.PATTERN`` over whole texts
with array operations, and the different pieces among them, so that a merge
procedure runs once for each different piece of a batch.  The same pattern
serves operators 4, 8 and 9.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import regex

from .common import U64, ranges, sequence_hash

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
CHUNK = 1 << 20  # characters handled at once; a longer text is a chunk of its own


@functools.cache
def char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for m in regex.finditer(f"{pattern}+", every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    return table


@functools.cache
def char_codes() -> np.ndarray:
    """A random odd number for every character."""
    return (np.random.default_rng(7).integers(0, 1 << 63, 0x110000, dtype=np.int64).astype(U64) << U64(1)) | U64(1)


class Split:
    """The pieces of some texts.

    chars: all characters, an end mark after each text; start, end: of each
    piece in chars; text: its text; kind: which different piece it is; sample:
    for each kind one piece; marks: where each text begins in chars.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        joined = "\0".join(texts) + "\0"
        self.chars = chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        self.marks = ends - sizes
        c = char_classes()[chars]
        c[ends] = END
        n = len(c)
        after = np.concatenate([c[1:], [END]]).astype(np.uint8)
        start = np.ones(n + 1, bool)
        start[1:n] = c[1:] != c[:-1]
        start[ends] = True
        # the last blank of a run that something follows stands alone, or before what follows if it is U+0020
        lone = (c == SPACE) & (after != SPACE) & (after != END)
        start[:n] |= lone
        joins = np.flatnonzero(lone & (chars == 32))
        start[joins + 1] = False
        # contractions: an apostrophe alone before letters, not after a joined blank
        apostrophe = np.flatnonzero((chars[:-1] == 39) & start[: n - 1] & (c[:-1] == OTHER) & (after[:-1] == LETTER))
        if len(apostrophe):
            padded = np.concatenate([chars, np.zeros(2, np.uint32)])
            one, two = padded[apostrophe + 1], padded[apostrophe + 2]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for which, size in ((short, 1), (long, 2)):
                at = apostrophe[which]
                start[at + 1] = False
                start[at + 1 + size] = True
        begin = np.flatnonzero(start[:n] & (c != END))
        stop = np.flatnonzero(start)
        self.start = begin
        self.end = stop[np.searchsorted(stop, begin, side="right")] if len(begin) else begin
        self.text = np.searchsorted(ends, begin, side="right")
        self.size = self.end - self.start
        codes = char_codes()[chars]
        for seed in itertools.count():
            self.hash = sequence_hash(codes, self.start, self.size, seed)
            _, self.sample, self.kind = np.unique(self.hash, return_index=True, return_inverse=True)
            if self._exact():
                break

    def _exact(self) -> bool:
        """Whether pieces of one hash are one piece, character by character."""
        twin = self.sample[self.kind]
        other = np.flatnonzero(twin != np.arange(len(twin)))
        twin = twin[other]
        if not np.array_equal(self.size[other], self.size[twin]):
            return False
        size = self.size[other]
        step = ranges(size)
        return np.array_equal(self.chars[np.repeat(self.start[other], size) + step], self.chars[np.repeat(self.start[twin], size) + step])

    def flat(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters of the pieces of some kinds, one after another, and their lengths."""
        sample = self.sample[kinds]
        size = self.size[sample]
        return self.chars[np.repeat(self.start[sample], size) + ranges(size)], size

    def different(self, kinds: np.ndarray | None = None) -> list[str]:
        """The different pieces, in the order of kind, or those asked for."""
        flat, size = self.flat(np.arange(len(self.sample)) if kinds is None else kinds)
        whole = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def bounds(self) -> np.ndarray:
        """Where each text's pieces begin, and the end."""
        return np.searchsorted(self.text, np.arange(len(self.texts) + 1))


def chunks(texts: list[str], limit: int = CHUNK, most: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """Whole texts, about ``limit`` characters and ``most`` of them together, with the number of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > limit or i - at == most):
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def read_ranks(path: str) -> dict[bytes, int]:
    """bytes -> rank, of a .tiktoken file or of a byte-level BPE .json file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    return {bytes(byte_of[ch] for ch in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


@functools.cache
def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


@functools.cache
def merger(path: str):
    """The merge procedure over one vocabulary, for single pieces."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})._core_bpe


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merged:
    """What a merge procedure made of the pieces seen so far: by hash, a stretch of ids.

    A known hash counts only if the piece itself is the known one.  Bounded:
    past ``keep`` pieces it starts afresh.
    """

    def __init__(self, merge, keep: int = 400_000):
        self.merge, self.keep = merge, keep
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, U64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.char_first = np.zeros(0, np.int64)
        self.char_size = np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.uint32)

    def _known(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the tables, whether the hash is there)"""
        if not len(self.hash):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(self.hash, want), len(self.hash) - 1)
        return at, self.hash[at] == want

    def made(self, split: Split, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of some kinds, one after another, and how many each has."""
        ids = self.merge(split.different(new))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def of(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in ``flat`` for each kind of piece; merges those not seen yet."""
        if len(self.hash) > self.keep:
            self.clear()
        want = split.hash[split.sample]
        at, have = self._known(want)
        old = np.flatnonzero(have)
        chars, sizes = split.flat(old)
        where = at[old]
        if not np.array_equal(sizes, self.char_size[where]) or not np.array_equal(chars, self.chars[np.repeat(self.char_first[where], sizes) + ranges(sizes)]):
            self.clear()  # another piece has the hash of a known one
            have = np.zeros(len(want), bool)
        new = np.flatnonzero(~have)
        if len(new):
            flat, size = self.made(split, new)
            chars, char_size = split.flat(new)
            first, char_first = np.cumsum(size) - size + len(self.flat), np.cumsum(char_size) - char_size + len(self.chars)
            self.flat, self.chars = np.concatenate([self.flat, flat]), np.concatenate([self.chars, chars])
            hashes = np.concatenate([self.hash, want[new]])
            order = np.argsort(hashes, kind="stable")  # two sorted runs
            self.hash = hashes[order]
            for name, more in (("first", first), ("size", size), ("char_first", char_first), ("char_size", char_size)):
                setattr(self, name, np.concatenate([getattr(self, name), more])[order])
        at, _ = self._known(want)
        return self.first[at], self.size[at]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, each different piece merged once."""

    def __init__(self, path: str):
        self.path = path
        self.special = special_tokens(path)
        one = merger(path).encode_single_piece
        self.merged = Merged(lambda pieces: [one(p.encode("utf-8", "surrogatepass")) for p in pieces])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, where each text's ids begin and the end), chunk by chunk."""
        for at, part in chunks(texts):
            split = Split(part)
            first, size = self.merged.of(split)
            per_piece = size[split.kind]
            out = self.merged.flat[np.repeat(first[split.kind], per_piece) + ranges(per_piece)]
            cut = np.concatenate([[0], np.cumsum(per_piece)])[split.bounds()]
            odd = [i for i, t in enumerate(part) if any(s in t for s in self.special)]
            if odd:  # special tokens inside a text are the library's matter
                pieces = [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                for i in odd:
                    pieces[i] = np.array(library(self.path).encode(part[i], add_special_tokens=False).ids, np.uint32)
                out = np.concatenate(pieces)
                cut = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            yield at, out, cut


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
