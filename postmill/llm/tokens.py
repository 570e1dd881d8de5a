"""Token ids of whole texts with the tokenizers library, remembered per piece.

The library is asked once for each distinct piece of text between safe cuts; a document's ids are the pieces' ids
joined. Arrow cuts the texts and finds the distinct pieces of a batch. A cut is safe where the tokenizer itself
always parts its input:

* ``solo space`` (byte-level BPE whose pattern takes one leading space): before a single space between two characters
  that are not white space, and between a line feed that stands alone and a letter;
* ``white`` (a pattern that drops white space, each match without any): at every ASCII white space;
* both: between a letter or digit and a mark such as a comma, on either side;
* otherwise, and where a text holds a special token or an odd run of white space, there are fewer cuts or none.

The most frequent pieces, letters alone, go straight to the library's model, without normaliser and pre-tokenizer.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

#: Pieces remembered per generation in a worker process (some 80 MB); of two generations the older goes.
REMEMBERED = 450_000

#: A space within a run of white space that goes on after it.
_IN_RUN = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}] (?:[\s\x{1c}-\x{1f}\x{85}\p{Z}]|$)"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Stands between pieces.
MARK = "\x01"
#: Places between a letter or digit and a mark, and after a line feed alone.
_CUTS = {
    "white": [r"([\p{L}\p{N}])([.,;:!?|%#$&*()])", r"([.,;:!?|%#$&*()])([\p{L}\p{N}])"],
    "solo space": [r"([\p{L}\p{N}])([.,;:!?|%#$&*()\n])", r"([.,;:!?|%#$&*()])([\p{L}\p{N}])", r"([\p{L}\p{N}.,;:!?|%#$&*()]\n)([\p{L}\p{N}])"],
}


def _byte_level() -> dict[int, int]:
    """Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()


class _Ids(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, piece):
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def cut_style(spec: dict) -> str:
    """spec: the tokenizer's JSON."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "solo space"
    first = (pre.get("pretokenizers") or [{}])[0]
    if pre.get("type") == "Sequence" and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed":
        return "white"
    return "whole"


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.style = cut_style(spec)
        tokenizer = Tokenizer.from_file(path)
        self.encode_whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.model, self.lower = tokenizer.model, self.style == "white"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.words = _Ids(self.encode_word)

    def encode_word(self, word: str) -> bytes:
        """Letters up to U+00FF, with or without a space before them, are one pre-token: the model can take them at once."""
        if self.style != "whole" and word.lstrip(" ").isalpha() and max(word) < "\u0100" and word.rfind(" ") < 1:
            plain = word.lower() if self.lower else word
            ids = [t.id for t in self.model.tokenize(plain.encode().decode("latin-1").translate(_BYTE_LEVEL))]
        else:
            ids = self.encode_whole(word)
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def one(self, text: str) -> bytes:
        """The ids of one text, as bytes of little-endian unsigned 32-bit numbers."""
        if self.style == "whole":
            return np.array(self.encode_whole(text), dtype="<u4").tobytes()
        if self.style == "white":
            return b"".join(map(self.words.__getitem__, (p.decode() for p in text.encode().split())))
        return b"".join(map(self.words.__getitem__, _CUT.split(text)))

    def batch(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of every text. Arrow splits the texts and finds the distinct pieces; ids are gathered for all at once."""
        texts = pc.fill_null(texts, "")
        if self.style == "whole":
            return [np.array(self.encode_whole(t), "<u4") for t in texts.to_pylist()]
        odd = pc.match_substring(texts, MARK)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        if self.style == "solo space":
            odd = pc.or_(odd, pc.match_substring_regex(texts, _IN_RUN))
        cut = pc.if_else(odd, "", texts)
        for pattern in _CUTS[self.style]:
            cut = pc.replace_substring_regex(cut, pattern, rf"\1{MARK}\2")
        cut = pc.replace_substring_regex(cut, r"[ \t\n\v\f\r]+", MARK) if self.style == "white" else pc.replace_substring(cut, " ", MARK + " ")
        lists = pc.split_pattern(cut, MARK)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        table = list(map(self.words.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        counts = sizes[codes]
        ends = np.cumsum(counts)
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - counts), counts) + np.arange(int(counts.sum()))
        ids = flat[at]
        edges = np.concatenate([[0], ends])[offsets]
        out = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.frombuffer(self.one(texts[i].as_py()), "<u4")
        return out


def slices(texts: pa.StringArray, most: int = 6_000_000) -> Iterator[slice]:
    """Consecutive rows of about so many bytes, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The last one asked for is kept in the worker process, with its pieces until the task ends."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _forget() -> None:
    for e in _encoders.values():
        e.words.clear()
        e.words.older = {}


CACHES.append(_forget)
