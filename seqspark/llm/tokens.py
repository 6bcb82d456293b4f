"""Token ids of whole texts by two public vocabularies, for the packing and output operators.

Both give the ids that the ``tokenizers`` library gives (special tokens not added), yet through ``tiktoken``'s
merges of distinct runs of text (a word with its punctuation, say), which are learned together.
That is exact: a trained vocabulary reaches each of its pieces by one pair only, so ranks of joined pieces and
listed merges choose alike (tests compare both on all test texts, odd white space and pieces of the
vocabularies). Texts that hold the string of a special token, or the marker byte, go through ``tokenizers``."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import text_buffer

#: Slices of hashing.text_slices that are cut together: more of their runs repeat.
MANY = 4
#: The pattern of byte-level vocabularies, and the same with runs that end in a zero byte.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACED_RUNS = r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?![^\s\x00])|\s+"
_PATTERN_49K = r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A space between two white spaces: nowhere else does a word of the first pattern reach over the place
#: before a space. Words of the second hold no white space.
_WITHIN = re.compile(r"\s \s").search
#: What Python's str.split takes for white space and Unicode doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def id_type(path: str) -> np.dtype:
    """The narrowest unsigned type that holds every id of a vocabulary file."""
    return np.dtype("<u2" if max(_vocabulary(path)[0].values(), default=0) < 1 << 16 else "<u4")


def _vocabulary(path: str) -> tuple[dict[str, int], list[str]]:
    """(piece -> id, special tokens' strings)"""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec["added_tokens"]]
    return spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}, special


class Runs:
    """ids(column): the ids of each text of an Arrow column, as bytes of ``kind``. Subclasses cut texts into
    runs, and give the ids of many runs at once with the number of ids up to each run's end; texts that are
    ``odd`` go alone. Arrow tells the distinct runs of a column, which are learned together: no run is a Python
    object or outlives the column, so columns of some MB of text (``MANY`` slices) are best."""

    kind: np.dtype

    def ids(self, column: pa.Array) -> list[bytes]:
        texts = [x or "" for x in column.to_pylist()]
        odd = list(map(self.odd, texts))
        runs = self.cut(["" if o else t for o, t in zip(odd, texts)])
        flat = runs.flatten().dictionary_encode()
        many, ends = self.learned(flat.dictionary)
        first = np.append(0, ends)
        run = flat.indices.to_numpy(zero_copy_only=False)
        n, at = np.diff(first)[run], first[run]
        ends = np.append(0, np.cumsum(n))
        data = many.astype(self.kind)[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (ends[runs.offsets.to_numpy() - runs.offsets[0].as_py()] * self.kind.itemsize).tolist()
        return [np.array(self.alone(t), self.kind).tobytes() if o else data[a:b] for t, o, a, b in zip(texts, odd, cuts, cuts[1:])]


def joined(runs: pa.Array, end: str) -> str:
    """All runs, each with this end."""
    each = pc.binary_join_element_wise(runs, pa.scalar("", runs.type), pa.scalar(end, runs.type))
    return text_buffer(each)[0].tobytes().decode()


def cut_at_spaces(text: str) -> list[str]:
    """Runs that ``SPACED`` cuts alike alone and in the text, which holds no zero byte."""
    return _spaced(text).split("\0")


def all_cut_at_spaces(texts: list[str]) -> pa.Array:
    return pc.split_pattern(pa.array(map(_spaced, texts), pa.large_string()), "\0")


def _spaced(text: str) -> str:
    return text if _WITHIN(text) else text.replace(" ", "\0 ")


class Encoder(Runs):
    """Of a vocabulary file of ``tokenizers``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.vocab, self.special = _vocabulary(path)
        self.kind = id_type(path)

    def odd(self, text: str) -> bool:
        return "\0" in text or any(s in text for s in self.special)

    def alone(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids


class ByteEncoder(Encoder):
    """For a byte-level vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        byte = _byte_chars()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in self.vocab.items() if piece not in self.special}
        self.fast, self.mark = tiktoken.Encoding("own", pat_str=SPACED_RUNS, mergeable_ranks=ranks, special_tokens={}), ranks[b"\0"]

    def cut(self, texts: list[str]) -> pa.Array:
        return all_cut_at_spaces(texts)

    def learned(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.fast.encode_to_numpy(joined(runs, "\0"), disallowed_special=())
        mark = ids == self.mark
        return ids[~mark], np.flatnonzero(mark) - np.arange(len(runs))


class WordEncoder(Encoder):
    """For a vocabulary file with word ends, which drops white space and case. The end of each word is a zero
    byte here; a piece with a word end ends in it."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        super().__init__(path)
        byte, ranks = _byte_chars(), {}
        for piece, i in self.vocab.items():
            if piece not in self.special:
                stem = piece.removesuffix("</w>")
                ranks.setdefault(bytes(byte[c] for c in stem) + b"\0" * (stem != piece), i)
        self.find = regex.compile(_PATTERN_49K).findall
        self.fast = tiktoken.Encoding("own", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[b"\n\0"]  # runs hold no line end

    def odd(self, text: str) -> bool:
        return super().odd(text) or bool(_SEPARATORS(text))

    def cut(self, texts: list[str]) -> pa.Array:
        plain = (t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ") for t in texts)  # no final form: letters lose case one by one
        return pc.utf8_split_whitespace(pa.array((t.lower() for t in plain), pa.large_string()))

    def learned(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = self.find(joined(runs, "\n"))
        ids = self.fast.encode_to_numpy("\0".join([*words, ""]), disallowed_special=())
        mark = ids == self.mark
        return ids[~mark], np.flatnonzero(mark) - np.arange(len(runs))


_encoders: dict[tuple, Encoder] = {}


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One for each worker process, so that its tasks read the vocabulary once."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
