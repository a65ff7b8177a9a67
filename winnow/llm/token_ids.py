"""Token ids of the public `tokenizers` files, whole texts, inside tasks.

The library spends most of its time on regular expressions and offsets, and
texts repeat words. So a text made of plain Latin characters is split here by
the file's own pattern, each distinct pre-token goes once to the library's model
and is remembered (up to ``REMEMBERED`` pre-tokens a worker; then the memory
starts anew), and the ids are joined. A text with any other character, or with
what may be a special token, goes to the library whole. Both ways give the same
ids.

``WordIds`` does this for the word-level file on many texts at once: bytes are
classed, words cut and repeats found by array operations, so that only distinct
words are looked up, and those not met lately go to the library together.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pandas as pd

REMEMBERED = 400_000
# Plain characters: classes, lower case and normal form are the same in every
# Unicode version, and none is a combining mark.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ž"
_ODD = re.compile(f"[^\t\n\r -~{_LETTERS}]")
# The pre-token patterns of the two public files, for these letters.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = rf" ?[{_LETTERS}]+|{_SUFFIXES}| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
WORD_LEVEL = rf"[{_LETTERS}]+|{_SUFFIXES}|[0-9]|[^\s0-9{_LETTERS}]+"
_WORKER: dict = {}


def _byte_symbols() -> str:
    """Byte -> printable symbol, as byte-level files write bytes: printable
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


class IdEncoder:
    """``ids(text)``: little-endian unsigned 32-bit ids of a text, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.lower = self.library.normalizer is not None
        self.split = re.compile(WORD_LEVEL if self.lower else BYTE_LEVEL).findall
        self.symbols = _byte_symbols()
        self.known: dict[str, bytes] = {}

    def _model_ids(self, word: str) -> bytes:
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def ids(self, text: str) -> bytes:
        if "<|" in text or _ODD.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = self.split(text.lower() if self.lower else text)
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, found in enumerate(out):
                if found is None:
                    word = words[i]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = self._model_ids(word)
                    out[i] = found
        return b"".join(out)

    def many(self, texts: list[str]) -> list[bytes]:
        return list(map(self.ids, texts))


# Classes of bytes in lowered plain texts. ALONE: a word of its own.
_BLANK, _LETTER, _ALONE, _MARK = range(4)
_CLASSES = bytes(_LETTER if b >= 128 or chr(b).isalpha() else _ALONE if b == 0 or chr(b).isdigit()
                 else _BLANK if chr(b).isspace() else _MARK for b in range(256))
# The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX, _MIX_LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Bytes of plain texts, and what else sends a text to the library.
_PLAIN = bytes(b for b in range(256) if chr(b) in "\t\n\r" or 32 <= b < 127 or 128 <= b < 192 or 0xC3 <= b <= 0xC5)
_NOT_PLAIN = ["×".encode(), "÷".encode(), "İ".encode(), "ŉ".encode(), "ſ".encode(), b"<|"]
# Words of more bytes are looked up one by one.
_LONG = 64
# Words met lately that a worker remembers.
_MET = 1_000_000
# Words the library gets at once.
_TOGETHER = 30


def _cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word of lowered plain texts, as WORD_LEVEL cuts them; \\0 is a word."""
    byte = np.frombuffer(data, np.uint8)
    kind = np.frombuffer(data.translate(_CLASSES), np.uint8)
    edge = np.ones(len(byte) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[:-1] |= kind == _ALONE
    # 's 't 'm 'd 're 've 'll are words where the mark begins one.
    mark = np.flatnonzero(edge[:-1] & (byte == ord("'")))
    one, two = (byte.take(mark + k, mode="clip") for k in (1, 2))
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    edge[mark[short | pair] + 1] = False
    edge[mark[short] + 2] = True
    edge[mark[pair] + 3] = True
    bounds = np.flatnonzero(edge)
    word = np.flatnonzero(kind.take(bounds[:-1]) != _BLANK)
    starts = bounds.take(word)
    return starts, bounds.take(word + 1) - starts


def _codes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A number for each word, equal words alike, and one place of each number;
    None in the rare case that different words have the same hash."""
    eight = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    hashed, parts = lengths.astype(np.uint64) * _MIX_LENGTH, []
    which = np.arange(len(starts))
    for at in range(0, _LONG, 8):
        if at:
            which = which[lengths.take(which) > at]
            if not len(which):
                break
        part = eight[starts.take(which) + at] & _FIRST.take(np.minimum(lengths.take(which) - at, 8))
        mixed = (hashed.take(which) ^ part) * _MIX
        hashed[which] = mixed ^ mixed >> np.uint64(29)
        parts.append((which, part))
    long = np.flatnonzero(lengths > _LONG)
    if len(long):
        tails = {}
        names = [tails.setdefault(data[a:b], len(tails)) for a, b in
                 zip((starts[long] + _LONG).tolist(), (starts + lengths)[long].tolist())]
        part = np.array(names, np.uint64)
        hashed[long] = (hashed[long] ^ part) * _MIX
        parts.append((long, part))
    codes, distinct = pd.factorize(hashed)
    place = np.empty(len(distinct), np.int64)
    place[codes] = np.arange(len(codes))
    like = place.take(codes)
    if (lengths.take(like) != lengths).any():
        return None
    for which, part in parts:
        whole = np.zeros(len(starts), np.uint64) if len(which) < len(starts) else part
        if whole is not part:
            whole[which] = part
        if (whole.take(like.take(which)) != part).any():
            return None
    return codes, place


class WordIds(IdEncoder):
    """``many(texts)``: ids of each text by the word-level file, as bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        if not self.lower:
            raise ValueError("not the word-level file")
        # The same model for symbols that are cut already.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        names = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.spelled: dict[bytes, bytes] = {b"\0": b""}

    def _learn(self, words: list[bytes]):
        groups = [b" ".join(words[i:i + _TOGETHER]).decode("latin-1").translate(self.symbols).replace(self.symbols[32], " ")
                  for i in range(0, len(words), _TOGETHER)]
        ids = array("I")
        for got in self.words.encode_batch_fast(groups, add_special_tokens=False):
            ids.extend(got.ids)
        raw, ends = ids.tobytes(), (np.flatnonzero(self.ends.take(np.array(ids))) + 1) * 4
        if len(ends) != len(words):
            raise ValueError("words and ids do not match")
        for word, a, b in zip(words, [0, *ends.tolist()], ends.tolist()):
            self.spelled[word] = raw[a:b]

    def many(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # Each text ends with \0, which no plain text holds.
        raw = ("\0".join(texts) + "\0").encode()
        left = raw.translate(None, _PLAIN)
        if left == bytes(len(texts)) and not any(pair in raw for pair in _NOT_PLAIN):
            return self._plain(texts)
        plain = [i for i, text in enumerate(texts) if "<|" not in text and not _ODD.search(text)]
        out: list[bytes | None] = [None] * len(texts)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
                out[i] = ids
        return [self.ids(text) if ids is None else ids for text, ids in zip(texts, out)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        data = ("\0".join([text.lower() for text in texts]) + "\0").encode()
        starts, lengths = _cut(data)
        coded = _codes(data, starts, lengths)
        if coded is None:
            return [self.ids(text) for text in texts]
        codes, place = coded
        first = starts.take(place)
        words = [data[a:b] for a, b in zip(first.tolist(), (first + lengths.take(place)).tolist())]
        if len(self.spelled) > _MET:
            self.spelled = {b"\0": b""}
        new = [word for word in words if word not in self.spelled]
        if new:
            self._learn(new)
        spelled = list(map(self.spelled.__getitem__, words))
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) >> 2
        begins = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(spelled), np.uint32)
        size = sizes.take(codes)
        ends = np.cumsum(size)
        total = int(ends[-1])
        raw = ids.take(np.repeat(begins.take(codes) - (ends - size), size) + np.arange(total)).tobytes()
        bounds = (ends[codes == codes[-1]] * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *bounds], bounds)]


def encoder(path: str) -> IdEncoder:
    """One encoder per worker process and file."""
    if path not in _WORKER:
        _WORKER[path] = IdEncoder(path)
    return _WORKER[path]


def word_encoder(path: str) -> IdEncoder:
    """The same with ``many``; files other than the word-level one go text by text."""
    if ("words", path) not in _WORKER:
        _WORKER["words", path] = WordIds(path) if encoder(path).lower else encoder(path)
    return _WORKER["words", path]
