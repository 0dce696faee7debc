"""Token ids of whole texts by the ``tokenizers`` library, with a memory of chunks.

Both tokenizer files split a text at certain spaces before any merge happens, so a text's ids are the
ids of its chunks in a row. Chunks repeat a lot; each worker remembers their ids. A new chunk that is a
word with marks behind it takes the word's ids from there too. The ids of a text are returned as
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Chunks that a worker remembers in each of two generations (about 150 bytes each).
CHUNK_CACHE = 450_000
#: Bytes of text whose chunks are looked up together, each different one once.
TOGETHER = 6_000_000
#: New chunks that are encoded in a row.
ROW = 60
#: Longer chunks are not remembered.
CHUNK_BYTES = 48
#: After letters these always begin a token of their own; a run of them stays whole up to the next white space.
ENDS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes that the byte-level vocabularies write as another character than Latin-1 does.
SHIFTED = {b: chr(0x121 + b - 0x7F) for b in range(0x7F, 0xA1)} | {0xAD: "\u0143"}

#: Letters that no normaliser changes but for their case, and that any Unicode version calls letters.
_letters = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_cut = re.compile(r"(?= \S)")
#: White space as Python has it, for Arrow's pattern search; texts with it behind a space are cut by ``_cut``.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f" {_SPACE}|{_SPACE} $"
_made: dict[str, Encoder] = {}


def _latin(word: bytes) -> bool:
    return word.isalpha() or bool(_letters.fullmatch(word.decode("utf-8", "replace")))


class Encoder:
    """Two kinds of vocabulary: one joins a leading space to the word (byte-level, no normaliser), the other drops
    white space and marks the end of a word.

    A chunk not seen before is encoded in a row with others where the ids themselves show the borders: each
    all-letter word ends in one end-of-word id, each chunk with one leading space begins with one such id.
    Words of Latin letters are the same before and after the normaliser and are never split, so they go to the
    vocabulary's merges directly.

    Chunks are remembered as bytes. With a leading-space vocabulary ``x`` stands for a space and x, and a space and x for
    x without one, as at the beginning of a text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = self.tokenizer.normalizer is None
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):  # chunks come here once; the library's own memory is of no use
            model._resize_cache(0)
            self.tokenizer.model = model
        self.merges = Tokenizer(model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.border[i] = token.startswith("\u0120") if self.spaced else token.endswith("</w>")
        self.known: dict = {}
        self.older: dict = {}

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, and where each text's chunks begin (one more entry: the end)."""
        # The normaliser lowers case anyway; ASCII white space is never part of a token.
        lists = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(pc.ascii_lower(texts))
        return lists.values, lists.offsets.to_numpy()

    def _split_odd(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The same for texts in which white space stands beside a space: a cut is at a space before another character."""
        chunks, starts = [], [0]
        for text in texts.view(pa.large_binary()).to_pylist():
            first, *rest = _cut.split(text.decode("utf-8", "replace"))
            chunks += [first.encode(), *[x[1:].encode() for x in rest]]
            starts.append(len(chunks))
        return pa.array(chunks, pa.large_binary()).view(pa.large_string()), np.array(starts)

    def _text(self, chunk: bytes) -> str:
        if self.spaced:
            chunk = chunk[1:] if chunk[:1] == b" " else b" " + chunk
        return chunk.decode("utf-8", "replace")

    def _parts(self, chunk: bytes) -> tuple[bytes, ...]:
        """Chunks whose ids in a row are those of ``chunk``: Latin words, the marks behind them, single line ends."""
        if not self.spaced:
            base = chunk.rstrip(ENDS)
            return (base, chunk[len(base) :]) if len(base) < len(chunk) and _latin(base) else (chunk,)
        start, parts = chunk[:1] == b" ", []
        if not start and b"\n" not in chunk:
            base = chunk.rstrip(ENDS)
            return (base, b" " + chunk[len(base) :]) if len(base) < len(chunk) and _latin(base) else (chunk,)
        lines = chunk[start:].split(b"\n")
        for i, line in enumerate(lines):
            base = line.rstrip(ENDS)
            if _latin(base):
                parts.append(b" " + base if start or i else base)
                if len(base) < len(line):
                    parts.append(b" " + line[len(base) :])
            elif line or not i or i + 1 < len(lines):
                return (chunk,)
            if i + 1 < len(lines):
                parts.append(b" \n")
        return tuple(parts)

    def _direct(self, words: list[bytes]) -> str:
        """A row of Latin words as the merges see it."""
        row = b" ".join(words)
        string = row.decode() if row.isascii() else row.decode("latin-1").translate(SHIFTED)
        return "\u0120" + string.replace(" ", " \u0120") if self.spaced else string

    def _rows(self, tokenizer, chunks: list, text: Callable[[list], str], out: dict) -> list:
        """Encode ``chunks`` in rows, and return those whose borders the ids do not show."""
        left = []
        for at in range(0, len(chunks), 500 * ROW):
            group = chunks[at : at + 500 * ROW]
            texts = [text(group[i : i + ROW]) for i in range(0, len(group), ROW)]
            found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([x.ids for x in found]), "<u4")
            marks, raw = np.flatnonzero(self.border[ids]), ids.tobytes()
            if len(marks) == len(group) and (not self.spaced or marks[0] == 0):
                cuts = [*(4 * marks).tolist(), len(raw)] if self.spaced else [0, *(4 * marks + 4).tolist()]
                out.update((x, raw[i:j]) for x, (i, j) in zip(group, pairwise(cuts), strict=True))
            else:
                left += group
        return left

    def _fresh(self, chunks: set) -> dict:
        out, alone, row, direct, made, single = {}, [], [], [], [], set()
        for x in chunks:
            if x.isalpha() or len(parts := self._parts(x)) == 1:
                single.add(x)
            else:
                made.append((x, parts))
        for x in {part for _, parts in made for part in parts}.difference(chunks):
            if (ids := self._remembered(x)) is None:
                single.add(x)
            else:
                out[x] = ids
        for x in single:
            if x.isalpha():  # of bytes: ASCII letters only
                direct.append(x)
                continue
            word = x.decode("utf-8", "replace")
            if _letters.fullmatch(word) and (self.spaced or word.islower()):
                direct.append(x)
            elif self.spaced:
                (alone if not word or word[0].isspace() or " " in word else row).append(x)
            else:  # a letter's lower case can hold a mark
                (row if word.lower().isalpha() else alone).append(x)
        direct.sort(key=bytes.isascii)
        alone += self._rows(self.merges, direct, self._direct, out)
        alone += self._rows(self.tokenizer, row, lambda part: ("" if self.spaced else " ").join(map(self._text, part)), out)
        for at in range(0, len(alone), 5000):
            part = alone[at : at + 5000]
            for x, e in zip(part, self.tokenizer.encode_batch_fast(list(map(self._text, part)), add_special_tokens=False), strict=True):
                out[x] = np.asarray(e.ids, "<u4").tobytes()
        out.update((x, b"".join([out[part] for part in parts])) for x, parts in made)
        return out

    def _remembered(self, chunk) -> bytes | None:
        return self.known.get(chunk, self.older.get(chunk))

    def clear(self) -> None:
        self.known, self.older = {}, {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        common.settle(self)
        if len(self.known) > CHUNK_CACHE:
            self.known, self.older = {}, self.known
        whole = pa.array(texts, pa.large_binary()).view(pa.large_string())
        odd = pc.match_substring_regex(whole, _ODD).to_numpy(zero_copy_only=False) if self.spaced else np.zeros(len(texts), bool)
        if not odd.any():
            return self._ids(*self._split(whole))
        out = np.empty(len(texts), object)
        out[odd] = self._ids(*self._split_odd(whole.filter(pa.array(odd))))
        out[~odd] = self._ids(*self._split(whole.filter(pa.array(~odd))))
        return out.tolist()

    def _ids(self, chunks: pa.Array, starts: np.ndarray) -> list[bytes]:
        """The ids of texts by their chunks."""
        coded = chunks.dictionary_encode()
        different, codes = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices
        if self.spaced:
            codes = codes.to_numpy().copy()
            first = [b" " + different[i] for i in codes[starts[:-1]]]
            codes[starts[:-1]] = np.arange(len(different), len(different) + len(first))
            different += first
            codes = pa.array(codes)
        ids = pa.array(self._look_up(different), pa.large_binary()).take(codes)
        _, ends, raw = ids.buffers()
        if raw is None or not len(ids):
            return [b""] * (len(starts) - 1)
        places = np.frombuffer(ends, np.int64)[starts].tolist()
        raw = memoryview(raw)
        return [bytes(raw[i:j]) for i, j in pairwise(places)]

    def _look_up(self, chunks: list) -> list[bytes]:
        """The ids of different chunks."""
        known, older = self.known, self.older
        found = list(map(known.get, chunks))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            missing = {chunks[i] for i in gaps}
            again = {x: older[x] for x in missing if x in older}
            known.update(again)
            extra = {}
            for x, ids in self._fresh(missing.difference(again)).items():
                (known if len(x) <= CHUNK_BYTES else extra)[x] = ids
            for i in gaps:
                x = chunks[i]
                found[i] = extra[x] if x in extra else known[x]
        return found


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
        common.remember(_made[path])
    return _made[path]
