"""Encoding by unit: token ids of a text as the concatenation of the ids of its units, each looked up in a memo.

A unit is a run of white space and the run of other characters after it; where such a run is Latin letters and then one
full stop or comma, the mark is a unit of its own. No pre-token of the two vocabularies crosses the end of a unit (a
pre-token holds white space only before its other characters, the look-ahead for white space looks no further than the
next character, and letters and marks never share one), so the units' ids, end to end, are the ids of the text.

The library encodes each unit that the memo lacks. Most of these are Latin letters only, one pre-token each; they go
many at a time through the vocabulary's model alone, in the byte-to-character form that it is written in. Tests hold
the results against the library's encoding of whole texts."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: White space as the tokenizers' own patterns see it, and the part of it that units are cut at.
SPACES = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = r"[ \n]+"
EDGES = rf"([^{SPACES}])([ \n])"
MARKS = rf"([{LETTERS}])([.,])([ \n]|$)"
ENDS = rf"([{LETTERS}])([.,])(\x00|$)"
WHOLE = r"\x00|<\|"
ONE = re.compile(rf" ?[{LETTERS}]+").fullmatch
MEMO = 900_000


def byte_letters(space: bool) -> dict[int, int]:
    """The characters that byte-level vocabularies write bytes as, for those bytes that are not written as themselves;
    line ends stay, as what separates words here; \\x01 stands for the line end of the text."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    line_end = table.pop(10)
    return (table if space else {k: v for k, v in table.items() if k != 32}) | {1: line_end}


class MemoEncoder:
    """encode_many(texts): bytes of little-endian ids of `width` bytes. drop_space: a vocabulary that lower-cases, drops
    white space and marks the ends of words. The memo is bounded and starts anew when it is full."""

    def __init__(self, path: str, drop_space: bool, width: int = 2):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.drop_space, self.dtype = drop_space, np.dtype(f"<u{width}")
        vocab = self.tok.get_vocab()
        if max(vocab.values()) >= 2 ** (8 * width):
            raise ValueError("ids need more bytes")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            self.ends[i] = word.endswith("</w>")
        self.table = byte_letters(space=not drop_space)
        self.line_end = vocab.get(chr(self.table[1]))
        self.memo: dict[str, bytes] = {}

    def learn(self, lacking: list[str]) -> None:
        easy, rest = [], []
        for u in lacking:
            (easy if ONE(u) else rest).append(u)
        for k in range(0, len(easy), 200):
            part = easy[k : k + 200]
            line = "\n".join(part).lower() if self.drop_space else "\n\x01\n".join(part)
            line = line.encode().decode("latin-1").translate(self.table)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype)
            if self.drop_space:
                last = np.flatnonzero(self.ends[ids]) + 1
                first = np.concatenate([[0], last[:-1]])
            else:
                cut = np.flatnonzero(ids == self.line_end)
                first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(ids)]])
            if len(first) != len(part):
                raise ValueError("words and their ids do not match")
            raw, w = ids.tobytes(), self.dtype.itemsize
            self.memo.update((u, raw[a * w : b * w]) for u, a, b in zip(part, first.tolist(), last.tolist()))
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for u, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.memo[u] = np.array(e.ids, self.dtype).tobytes()

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The units of each text."""
        if self.drop_space:
            # lower case early, for fewer units, where it is plain: in other texts it may depend on composed characters
            texts = pc.if_else(pc.match_substring_regex(texts, r"[^\x{00}-\x{ff}]"), texts, pc.utf8_lower(texts))
            return pc.split_pattern_regex(pc.replace_substring_regex(texts, MARKS, r"\1 \2\3"), BLANKS)
        return pc.split_pattern(pc.replace_substring_regex(pc.replace_substring_regex(texts, EDGES, "\\1\x00\\2"), ENDS, "\\1\x00\\2\\3"), "\x00")

    def unit_ids(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """The units of each text (white space may be missing where it yields no ids); of each distinct unit the number
        of ids; and of each unit its number among these."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        texts = texts.cast(pa.large_string())
        # the separator itself can't be in a text that is split at it; \x01 is encoded like it, as one symbol of its kind
        units = self.split(pc.replace_substring(texts, "\x00", "\x01") if pc.any(pc.match_substring(texts, "\x00")).as_py() else texts)
        coded = units.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn([u for u in names if u not in self.memo])
        size = np.fromiter((len(self.memo[u]) for u in names), np.int64, len(names)) // self.dtype.itemsize
        return units, size, np.asarray(coded.indices)

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of an Arrow string column; null counts as empty."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # a text with the string of a special token, or with the separator, is encoded whole, as the library reads it
        whole = pc.match_substring_regex(texts, WHOLE)
        own = np.flatnonzero(np.asarray(whole)).tolist()
        units = self.split(pc.if_else(whole, pa.scalar("", pa.large_string()), texts) if own else texts)
        coded = units.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn([u for u in names if u not in self.memo])
        blobs = list(map(self.memo.__getitem__, names))
        flat = np.frombuffer(b"".join(blobs), self.dtype)
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        at = np.asarray(coded.indices)
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = (ends[np.asarray(units.offsets) - units.offsets[0].as_py()] * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in own:
            out[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, self.dtype).tobytes()
        return out


@lru_cache(maxsize=4)
def encoder(path: str, drop_space: bool) -> MemoEncoder:
    return MemoEncoder(path, drop_space)
