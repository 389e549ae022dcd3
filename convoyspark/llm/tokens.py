"""Token ids of whole texts by the ``tokenizers`` library.

A tokenizer's pre-tokens repeat a lot, so each worker keeps a bounded memo from the 64-bit hash of a
pre-token to its ids; only pre-tokens that are not in it go through the library's model. Texts are cut into
pre-tokens with array operations where the tokenizer file has one of two known splitting patterns and the
text is Latin-1 without the characters on whose class Unicode versions or regex engines differ. All other
texts go through the library whole.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np
from tokenizers import Tokenizer
from tokenizers.models import BPE

from . import ragged
from .shared import release

BLOCK_CHARS = 1 << 18
MEMO_SLOTS = 1 << 21
LETTER, NUMBER, OTHER, WHITE, BAD = range(5)
# The splitting patterns of the two public tokenizer files that can be followed with array operations.
BYTE_RULE = ("None", "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)")
WORD_RULE = (
    'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])',
    """Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), """
    "behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])",
)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for i in range(256):
        major = unicodedata.category(chr(i))[0]
        out[i] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    out[[0x20, 0xA0, *range(0x09, 0x0E)]] = WHITE
    out[[0x85, *range(0x1C, 0x20)]] = BAD
    return out


CLASS = _classes()
LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level models use, for the UTF-8 bytes of each Latin-1 character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(rest)}
    return {i: "".join(letter[b] for b in chr(i).encode()) for i in range(256)}


class Memo:
    """Open-addressed table from hashes to id lists; emptied when three quarters full, so its size is bounded."""

    def __init__(self, slots: int = MEMO_SLOTS):
        self.mask, self.most = np.uint64(slots - 1), slots * 3 // 4
        self.keys = np.zeros(slots, np.uint64)
        self.at = np.zeros(slots, np.uint32)
        self.length = np.zeros(slots, np.uint32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.flat, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash (or the free slot where it would go), and whether it is there."""
        slot = h & self.mask
        key = self.keys[slot]
        found = key == h
        left = np.flatnonzero(~found & (key != 0))
        while left.size:
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            key = self.keys[slot[left]]
            found[left] = key == h[left]
            left = left[(key != h[left]) & (key != 0)]
        return slot, found

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """``h`` holds distinct hashes that are not in the table."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.count += len(h)
        left = np.arange(len(h))
        while left.size:
            slot, _ = self.find(h[left])
            self.keys[slot] = h[left]  # of several for one slot the last stays
            won = self.keys[slot] == h[left]
            self.at[slot[won]], self.length[slot[won]] = at[left[won]], lengths[left[won]]
            left = left[~won]


class Encoder:
    """``encode(texts)`` gives all ids in one array and the number of ids of each text."""

    def __init__(self, path: str, memo_slots: int = MEMO_SLOTS):
        self.library = Tokenizer.from_file(path)
        release()  # what reading the file took
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.rule = _rule(self.library)
        self.letters = _byte_letters()
        self.memo = Memo(memo_slots)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        flats, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for start, stop in ragged.blocks(texts, BLOCK_CHARS):
            flat, counts[start:stop] = self._block([t or "" for t in texts[start:stop]])
            flats.append(flat)
        return np.concatenate(flats), counts

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, whole = [], {}
        for i, t in enumerate(texts):
            part = b""
            if self.rule is None or any(s in t for s in self.special):
                whole[i] = t
            else:
                try:
                    part = t.encode("latin-1")
                except UnicodeEncodeError:
                    whole[i] = t
            parts.append(part)
        bounds = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=bounds[1:])
        data = np.frombuffer(b"".join(parts), np.uint8)
        data = LOWER[data] if self.rule == "word" else data
        kind = CLASS[data]
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(kind == BAD), "right") - 1)
        whole |= {int(i): texts[i] for i in odd}
        starts, ends = _pretokens(data, kind, bounds, self.rule or "byte")
        flat, lengths = self._ids(data, starts, ends, ragged.hashes(data, starts, ends))
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, bounds)]
        counts = np.diff(upto)
        if not whole:
            return flat, counts
        pieces, last = [], 0
        for i in sorted(whole):
            ids = self.library.encode(whole[i], add_special_tokens=False).ids
            pieces += [flat[last : upto[i]], np.array(ids, np.uint32)]
            last, counts[i] = upto[i + 1], len(ids)
        return np.concatenate([*pieces, flat[last:]]), counts

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens with hashes ``h`` and the number of ids of each; in parts where they are too many for the memo."""
        memo = self.memo
        slot, found = memo.find(h)
        if not found.all():
            if memo.count + np.count_nonzero(~found) > memo.most:
                memo.clear()
                found[:] = False
            new, first = np.unique(h[~found], return_index=True)
            if len(new) > memo.most:  # so are the pre-tokens; one part holds no more of them than the memo
                parts = [slice(i, i + memo.most) for i in range(0, len(h), memo.most)]
                flats, lengths = zip(*(self._ids(data, starts[p], ends[p], h[p]) for p in parts))
                return np.concatenate(flats), np.concatenate(lengths)
            at = np.flatnonzero(~found)[first]
            raw, cut, letters = data.tobytes().decode("latin-1"), self.library.model.tokenize, self.letters
            words = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            memo.add(new, [[x.id for x in cut(w if w.isascii() and w.isalnum() else w.translate(letters))] for w in words])
            slot, _ = memo.find(h)
        lengths = memo.length[slot].astype(np.int64)
        return ragged.gather(memo.flat, memo.at[slot].astype(np.int64), lengths), lengths


def _rule(library: Tokenizer) -> str | None:
    """Which of the known ways to cut texts a tokenizer has, if any."""
    if not isinstance(library.model, BPE) or library.model.dropout or library.model.ignore_merges:
        return None
    steps = (repr(library.normalizer), repr(library.pre_tokenizer))
    return {BYTE_RULE: "byte", WORD_RULE: "word"}.get(steps)


def _pretokens(data: np.ndarray, kind: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens. ``byte``: runs of one class, each with the space before it; ``word``: runs of
    letters or others and single digits, without white space. English endings after an apostrophe stand alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last_white = np.zeros(n, bool)  # of several, before something else in the same text
    if rule == "byte":
        last_white[1:-1] = white[:-2] & white[1:-1] & ~white[2:] & ~first[2:] & ~first[1:-1]
        after_space = np.zeros(n, bool)
        after_space[1:] = (data[:-1] == 0x20) & ~white[1:] & ~first[1:]
        cut = (cut | last_white) & ~after_space
    else:
        cut |= kind == NUMBER
    _endings(data, kind, first, cut)
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    if rule == "word":
        keep = ~white[starts]
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def _endings(data: np.ndarray, kind: np.ndarray, first: np.ndarray, cut: np.ndarray) -> None:
    """Moves the cuts around ``'s`` and its like: an apostrophe that starts a pre-token takes the ending along."""
    n = len(data)
    quote = np.flatnonzero((data == 0x27) & cut)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    done = np.zeros(len(quote), bool)
    for ending in ENDINGS:
        size = len(ending)
        at = quote[~done & (quote + size < n)]
        fits = np.ones(len(at), bool)
        for j, c in enumerate(ending.encode(), 1):
            fits &= (data[at + j] == c) & ~first[at + j]
        at = at[fits]
        done[np.searchsorted(quote, at)] = True
        cut[at + 1] = False
        after = at + size + 1
        after = after[after < n]
        cut[after[(kind[after] == LETTER) & ~first[after]]] = True


@functools.cache
def encoder(path: str, memo_slots: int = MEMO_SLOTS) -> Encoder:
    """One per worker process, so that its memo serves all of the worker's tasks."""
    return Encoder(path, memo_slots)
