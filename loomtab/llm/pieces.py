"""Token ids of whole texts from cached atoms.

A text is cut at each single space that stands between two other characters, around each single line feed, and before
the punctuation that ends such a piece behind a letter.  No pre-token of the tokenizers used here crosses such a cut, so the ids of the text are those of
its atoms in order.  The atoms of a slice are spans of its Arrow buffer; they are numbered by dictionary encoding, and
each distinct one is encoded once per worker.  A text with any other white space at a cut is encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa

from .runtime import text_bytes

_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


#: Leads of characters that never compose with the one before: ASCII, U+00C0 to U+00FF, U+0400 to U+047F.
_STARTER = np.zeros(256, bool)
_STARTER[:128] = True
_STARTER[[0xC3, 0xD0, 0xD1]] = True


def fold_case(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the capitals of U+00C0 to U+00DE in lower case, but those that the next character may compose with."""
    if not len(data):
        return data
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)
    upper = (data >= 65) & (data < 91) | latin
    upper[:-1] &= _STARTER[data[1:]]
    return data + (upper.view(np.uint8) << 5)


def _letter_ends(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends with byte ``last`` is a letter: of ASCII, or of U+00C0 to U+00FF or U+0400 to U+047F."""
    byte, lead = data[last], data[np.maximum(last - 1, 0)]
    latin = (lead == 0xC3) & (byte >= 0x80) & (byte < 0xC0) & (byte != 0x97) & (byte != 0xB7)
    cyrillic = ((lead == 0xD0) | (lead == 0xD1)) & (byte >= 0x80) & (byte < 0xC0)
    return _ASCII_LETTER[byte] | ((last > 0) & (latin | cyrillic))


def _line_feeds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the line feeds between two characters of a text that are known not to be white space."""
    at = np.flatnonzero(data == 0x0A)
    if not len(at):
        return at
    edge = np.zeros(len(data) + 2, bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    before, after = data[at - 1], data[at + 1]
    follows = _GRAPH[after] | (after == 0xC3) | (after == 0xD0) | (after == 0xD1)
    return at[(_GRAPH[before] | _letter_ends(data, at - 1)) & follows]


def atom_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, counts): the atoms lie between neighbouring cuts; counts are those of each text.  An empty text has none."""
    size = np.diff(offsets)
    full = size > 0
    # a piece starts with its text or with a space; a text that starts with a space has an empty first piece
    feeds = _line_feeds(data, offsets)
    begin = np.concatenate([offsets[:-1][full], np.flatnonzero(data == 0x20), feeds, feeds + 1])
    begin.sort()
    end = np.append(begin[1:], len(data))
    plain = np.arange(len(data))
    plain[_MARK[data]] = -1
    body = np.maximum.accumulate(plain)[end - 1] + 1 if len(data) else end  # where a piece's closing marks begin
    split = (body > begin) & (body < end)
    split[split] = _letter_ends(data, body[split] - 1)
    starts = np.concatenate([begin, body[split]])
    starts.sort()
    # an empty first piece and the space behind it start at one byte
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    counts[~full] = 0
    return np.append(starts, len(data)), counts


class PieceCache:
    """Maps a string column, or a list of strings, to the ids of all its texts.

    ``encode`` maps a list of strings to their id lists, ``joined`` to (flat ids, lengths).
    ``spaced``: the tokenizer keeps white space, and a space belongs to the word that follows it.
    ``folded``: the tokenizer composes and lower-cases, so that atoms may be told apart by their lower case.
    ``limit`` bounds the atoms held: beyond it those go that were not met again since the last time, then all.
    That costs time only.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], spaced: bool, limit: int = 150_000, joined: Callable | None = None, folded: bool = False):
        self.encode, self.spaced, self.limit, self.folded = encode, spaced, limit, folded
        self.joined = joined or (lambda pieces: _flatten(encode(pieces)))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.bad = np.zeros(0, bool)
        self.met = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        keep = self.met > 1
        if 2 * int(keep.sum()) > self.limit:
            self.clear()
            return
        self.known = {a: i for i, a in enumerate(a for a, k in zip(self.known, keep.tolist(), strict=True) if k)}
        starts, self.lens, self.bad = self.starts[keep], self.lens[keep], self.bad[keep]
        ends = np.cumsum(self.lens)
        self.ids = self.ids[np.arange(int(self.lens.sum())) + np.repeat(starts - (ends - self.lens), self.lens)]
        self.starts, self.met = ends - self.lens, np.zeros(len(self.known), np.int32)

    def _numbers(self, atoms: list[str]) -> np.ndarray:
        """Each atom's number; new ones are encoded and get the next."""
        known = self.known
        found = np.fromiter(map(known.get, atoms, repeat(-1)), np.int64, len(atoms))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [atoms[i] for i in new.tolist()]
            found[new] = np.arange(len(known), len(known) + len(fresh))
            flat, lens = self.joined(fresh)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.ids = np.concatenate([self.ids, flat])
            bodies = [a[1:] if a[:1] == " " else a for a in fresh]
            self.bad = np.concatenate([self.bad, np.array([self.spaced and b != "\n" and (not b or b != b.strip()) for b in bodies], bool)])
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int32)])
        self.met[found] += 1
        return found

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets); None counts as empty."""
        if len(self.known) > self.limit:
            self._shrink()
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        data, offsets = text_bytes(texts)
        if self.folded:
            data = fold_case(data)
        cuts, counts = atom_spans(data, offsets)
        spans = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))
        coded = spans.dictionary_encode()
        n = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        lens = self.lens[n]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[n] - (ends - lens), lens)]
        offsets = np.concatenate([[0], ends])[at]
        if self.spaced and self.bad[n].any():
            per_text = np.add.reduceat(np.append(self.bad[n], 0), at[:-1]) * (np.diff(at) > 0)
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(counts))]
            odd = np.flatnonzero(per_text)
            for i, got in zip(odd, self.encode([texts[int(i)].as_py() for i in odd]), strict=True):
                parts[i] = np.array(got, np.uint32)
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        return ids, offsets


def _flatten(found: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for x in found for i in x), np.uint32, int(lens.sum())), lens


#: Stands between pieces that are encoded together where the tokenizer drops spaces.
_BAR = "|"


#: A word that a composing and lower-casing tokenizer takes as it is, as one pre-token.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u044f]+").fullmatch
#: What the tokenizers name by which _plain_words goes.
_LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORDS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte but the space in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256) if b != 32}


def _plain_words(said: dict) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None:
    """(flat ids, lengths) of words that ``_PLAIN`` matches, past normalizer and pre-tokenizer, which leave them as they are.

    None if the vocabulary's description is not one for which that holds.
    """
    from tokenizers import Tokenizer

    model = said["model"]
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("dropout") or said["normalizer"] != _LOWERED or said["pre_tokenizer"] != _WORDS or not all(a["special"] for a in said["added_tokens"]):
        return None
    own = {"pre_tokenizer": {"type": "WhitespaceSplit"}, "normalizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
    tokenizer, names = Tokenizer.from_str(json.dumps(said | own)), _byte_names()
    closes = np.zeros(max(model["vocab"].values()) + 1, bool)
    closes[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def words(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = " ".join(pieces)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(names)
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(closes[ids]), prepend=-1)

    return words


_held: dict[tuple, PieceCache] = {}


def worker_cache(path: str, spaced: bool, limit: int = 150_000) -> PieceCache:
    """The cache of this worker process for a vocabulary, alive between its tasks; one at a time."""
    key = path, spaced, limit
    if key not in _held:
        _held.clear()
        _held[key] = library_cache(path, spaced, limit)
    return _held[key]


def library_cache(path: str, spaced: bool, limit: int = 150_000) -> PieceCache:
    """Pieces encoded by the tokenizers library from a vocabulary file, special strings as ordinary text.

    New pieces are encoded 200 at a time, as one text: a tokenizer that keeps spaces begins each with a token
    that starts with one, and for the other a bar is put between them.  Pieces for which that is no sign
    (they hold a bar, or white space) are encoded on their own.  A tokenizer that lower-cases gets words of plain letters,
    200 at a time, without its normalizer, which would take most of the time and leave them as they are.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    if spaced:
        opens = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        opens[[i for t, i in tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
    else:
        bar = tokenizer.encode(_BAR, add_special_tokens=False).ids[0]
    with open(path, encoding="utf-8") as f:
        words = None if spaced else _plain_words(json.load(f))

    def encode(pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def fits(piece: str) -> bool:
        if spaced:
            return len(piece) > 1 and piece[0] == " " and piece[1:].isprintable() and " " not in piece[1:]
        return bool(piece) and piece.isprintable() and _BAR not in piece

    def joined(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.zeros(len(pieces), np.int64)
        order: list[int] = []
        flats: list[np.ndarray] = []
        if words:
            bare = [p[1:] if p[:1] == " " else p for p in pieces]
            order = [i for i, p in enumerate(bare) if _PLAIN(p)]
            for k in range(0, len(order), 200):
                own = order[k : k + 200]
                ids, size = words([bare[i] for i in own])
                if len(size) != len(own):
                    raise AssertionError("words are not as many as their last tokens")
                flats.append(ids)
                lens[own] = size
        left = range(len(pieces)) if not order else sorted(set(range(len(pieces))) - set(order))
        good = [i for i in left if fits(pieces[i])]
        for k in range(0, len(good), 200):
            own = good[k : k + 200]
            text = ("" if spaced else f" {_BAR} ").join(pieces[i] for i in own)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            if spaced:
                begin = np.flatnonzero(opens[ids])
                size = np.diff(np.append(begin, len(ids)))
            else:
                at = np.flatnonzero(ids == bar)
                size = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
                ids = np.delete(ids, at)
            if len(size) != len(own):
                raise AssertionError("pieces are not as many as their signs")
            flats.append(ids)
            lens[own] = size
            order += own
        rest = sorted(set(left) - set(good))
        if rest:
            ids, size = _flatten(encode([pieces[i] for i in rest]))
            flats.append(ids)
            lens[rest] = size
            order += rest
        # back into the order of the pieces
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        at = np.array(order, np.int64)
        ends = np.cumsum(lens[at])
        begin = np.zeros(len(pieces), np.int64)
        begin[at] = ends - lens[at]
        total = np.cumsum(lens)
        take = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - lens), lens)
        return flat[take], lens

    return PieceCache(encode, spaced, limit, joined, folded=words is not None)


def vocabulary(path: str | None, name: str) -> str:
    """A vocabulary file: the given path, else the public file of that name on the machine that runs this."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
