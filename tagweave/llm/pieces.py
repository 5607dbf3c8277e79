"""Tokenising whole texts by their distinct space-separated pieces; every piece is encoded once per worker and remembered."""

from __future__ import annotations

import gc
import re
from collections.abc import Sequence

import numpy as np

from tagweave.llm.common import SLICE_CHARS, byte_table, kept_in_worker, ranges, word_hashes

# Remembered pieces of one worker; beyond it the memory starts anew, which costs time only.
MEMO_PIECES = 3_000_000
_TWO_SPACES = re.compile(r"\s\s")
_BEGINS = np.uint64(0x5851F42D4C957F2D)


class PieceEncoder:
    """Token ids of texts. Subclasses say how single pieces and whole texts are encoded.

    A tokenizer that never merges across a space gives the same ids piece by piece. ``keeps_spaces`` means that a space
    belongs to the piece behind it (byte-level vocabularies); texts with two white-space characters in a row, a space
    at an end or a NUL are then encoded whole. Pieces are told apart by 64-bit hashes with their length mixed in.
    """

    keeps_spaces = True
    separators = b" "

    def __init__(self) -> None:
        self._forget()
        self._table = byte_table(self.separators)

    def _forget(self) -> None:
        self._keys, self._codes = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._start, self._size, self._flat, self._used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.int32), 0

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids per piece)."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> Sequence[int]:
        raise NotImplementedError

    def _pieces(self, text: str) -> bytes | None:
        """The text's bytes with pieces between single spaces, None if it has to be encoded whole."""
        if not self.keeps_spaces:
            return text.encode("utf-8", "surrogatepass").translate(self._table)
        if _TWO_SPACES.search(text) or text[-1:] == " " or "\0" in text:
            return None
        return text.encode("utf-8", "surrogatepass").replace(b"\n", b" \n")

    def _hash(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
        """Distinct keys, which of them each piece has, pieces per text, and the bytes of one piece for each new key."""
        keys, counts = word_hashes(texts)
        raw = b" ".join(texts) + b" "
        inside = np.frombuffer(raw, np.uint8) != 32
        change = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        starts, ends = change[::2], change[1::2]
        begins = np.zeros(len(starts), bool)
        if self.keeps_spaces:
            limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
            first = np.flatnonzero(counts > 0)
            at = (np.cumsum(counts) - counts)[first]
            begins[at] = starts[at] == (limits[first] - np.fromiter((len(texts[i]) + 1 for i in first), np.int64, len(first)))
            keys = np.where(begins, keys ^ _BEGINS, keys)
        order = np.argsort(keys)
        keys = keys[order]
        fresh = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        unique, where = keys[fresh], order[fresh]
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(fresh) - 1
        new = unique != self._at(unique)[1]
        found = {}
        for key, i in zip(unique[new].tolist(), where[new].tolist(), strict=True):
            piece = raw[starts[i] : ends[i]]
            lead = b" " if self.keeps_spaces and not begins[i] and piece[:1] != b"\n" else b""
            found[key] = lead + piece
        return unique, which, counts, found

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the memory and the key remembered there."""
        if not len(self._keys):
            return np.zeros(len(keys), np.int64), ~keys
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return at, self._keys[at]

    def _remember(self, found: dict[int, bytes]) -> None:
        if not found:
            return
        gc.disable()  # millions of small lists without cycles
        try:
            flat, size = self.encode_pieces(list(found.values()))
        finally:
            gc.enable()
        total = len(flat)
        while self._used + total > len(self._flat):
            self._flat = np.concatenate((self._flat, np.empty_like(self._flat)))
        self._flat[self._used : self._used + total] = flat
        codes = np.arange(len(size)) + len(self._start)
        self._start = np.concatenate((self._start, self._used + np.cumsum(size) - size))
        self._size = np.concatenate((self._size, size))
        self._used += total
        keys = np.fromiter(found, np.uint64, len(found))
        order = np.argsort(keys)
        at = np.searchsorted(self._keys, keys[order])
        self._keys, self._codes = np.insert(self._keys, at, keys[order]), np.insert(self._codes, at, codes[order])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        if len(self._keys) > MEMO_PIECES:
            self._forget()
        raw = [self._pieces(t) for t in texts]
        parts, counts, missing = [], [], {}
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to] or b"") <= SLICE_CHARS):
                size += len(raw[to] or b"")
                to += 1
            unique, which, n, found = self._hash([x or b"" for x in raw[at:to]])
            parts.append((unique, which))
            counts.append(n)
            missing |= found
            at = to
        self._remember(missing)
        pieces = np.concatenate(counts) if counts else np.empty(0, np.int64)
        codes = [self._codes[self._at(unique)[0]][which] for unique, which in parts if len(unique)]
        codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        size = self._size[codes]
        ids = self._flat[np.repeat(self._start[codes], size) + ranges(size)]
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(pieces)))]
        per_text = np.diff(ends)
        whole = [i for i, x in enumerate(raw) if x is None]
        if whole:
            out = np.split(ids, ends[1:-1])
            for i in whole:
                out[i] = np.asarray(self.encode_whole(texts[i]), np.int32)
                per_text[i] = len(out[i])
            ids = np.concatenate(out)
        return ids, per_text


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class LibraryEncoder(PieceEncoder):
    """A vocabulary file of the tokenizers library, without special tokens; their strings in a text are ordinary text.

    Pieces pass through the library's normaliser, the file's own split pattern and the library's merge model.
    """

    def __init__(self, file: str, pattern: str, keeps_spaces: bool):
        from tokenizers import Tokenizer

        import regex

        self.keeps_spaces = keeps_spaces
        self.separators = b" " if keeps_spaces else b" \t\n\v\f\r"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self._model, self._normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self._find = regex.compile(pattern).findall
        self._letters = dict(enumerate(byte_letters()))

    def encode_whole(self, text: str) -> Sequence[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _split(self, text: str) -> list[str]:
        """The pattern's matches; letters with at most a few marks behind them need no pattern."""
        lead = 1 if self.keeps_spaces and text[:1] == " " else 0
        letters = text.rstrip(".,;:!?")
        if letters[lead:].isalpha():
            return [letters] if len(letters) == len(text) else [letters, text[len(letters) :]]
        return self._find(text)

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes, words = [], [], {}
        normalize = self._normalizer.normalize_str if self._normalizer is not None else None
        tokenize, letters = self._model.tokenize, self._letters
        space = letters[32]
        for piece in pieces:
            text = piece.decode("utf-8", "surrogatepass")
            if normalize is not None:
                # For ASCII without white space the normaliser only makes lower case.
                text = text.lower() if text.isascii() else normalize(text)
            before = len(flat)
            for word in self._split(text):
                got = words.get(word)
                if got is None:
                    if word.isascii() and word.isalpha():
                        shown = word
                    elif word[:1] == " " and word.isascii() and word[1:].isalpha():
                        shown = space + word[1:]
                    else:
                        shown = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)
                    got = words[word] = [t.id for t in tokenize(shown)]
                flat += got
            sizes.append(len(flat) - before)
        return np.array(flat, np.int32), np.array(sizes, np.int64)


# Fixed value: the split pattern written in the word vocabulary file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_encoder(file: str, pattern: str) -> LibraryEncoder:
    return kept_in_worker(("byte", file, pattern), lambda: LibraryEncoder(file, pattern, True))


def word_encoder(file: str) -> LibraryEncoder:
    return kept_in_worker(("word", file), lambda: LibraryEncoder(file, WORD_PATTERN, False))
