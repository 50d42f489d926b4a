"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizers used here never join characters across a single blank between two visible
characters, so a text is cut there and every distinct piece is encoded once per worker. Texts with other
white space are cut less often, never wrongly.
"""

import json
import os
import re
import unicodedata
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logloom.llm import worker_memory

CACHE_WORDS = 550_000
#: marks the piece at the start of a text, which has no blank before it; no other piece starts with it
FIRST = "\0"
#: marks that never join with a letter before them (an apostrophe may)
PUNCTUATION = ".,;:!?#$%&*|)]}>\"/+=@^~-_"
_IRREGULAR = re.compile(r"^\s|\s\s|\s$")
#: the same for Arrow, whose own \s is ASCII only
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ARROW_IRREGULAR = f"^{_BLANK}|{_BLANK}{{2}}|{_BLANK}$|^$|\\x00"


class WordTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Strings of special tokens inside a text are ordinary text. New pieces are encoded many at a time with a special
    token between them, which no piece contains, and cut apart there. Marks behind a letter are tokens of their own, so a word
    is encoded once with and without them; for a tokenizer that lower-cases, so are its capital forms. The cache
    holds two generations of at most about ``cache_words`` pieces each, so that common ones stay; results do not depend on it.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        self._joined = Tokenizer.from_file(path)
        tokens = self._joined.get_added_tokens_decoder()
        self._mark_id, self._mark = max((i, t.content) for i, t in tokens.items())
        self._marks = [t.content for t in tokens.values()]
        kinds = [x["type"] for x in (json.loads(self._plain.to_str())["normalizer"] or {}).get("normalizers", [])]
        #: the pieces are normalized here, and white space makes no tokens
        self._lower = kinds == ["NFC", "Replace", "Lowercase"]
        if self._lower:
            self._joined.normalizer = normalizers.Sequence([])
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._limit = cache_words

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text in pieces; the blank before a piece is left out, and the first starts with ``FIRST`` instead."""
        if not text:
            return []
        if FIRST in text:
            return [FIRST + text]
        if _IRREGULAR.search(text):
            # blanks beside other white space stay where they are
            cut = re.split(r"(?<=\S)(?= \S)", text)
            return [FIRST + cut[0], *[p[1:] for p in cut[1:]]]
        return (FIRST + text).replace("\n", " \n").split(" ")

    def _whole(self, piece: str) -> str:
        """The text of a piece with its blank."""
        return piece[1:] if piece[:1] == FIRST else piece if piece[:1] == "\n" else " " + piece

    def _normal(self, piece: str) -> str | None:
        """The normalized piece for a tokenizer that lower-cases; None if it must be encoded as it stands."""
        if piece.isascii():
            low = piece.lower()
            if low.isalnum():
                return low
            low = low[1:] if low[:1] in (FIRST, "\n") else low
            return None if FIRST in low or low.split() != [low] else low
        found = unicodedata.normalize("NFC", piece[1:] if piece[:1] in (FIRST, "\n") else piece)
        low = found.lower()
        odd = FIRST in low or "\u03a3" in found or low.split() != [low] or not unicodedata.is_normalized("NFC", low)
        return None if odd else low

    def _encode_joined(self, pieces: list[str]) -> None:
        whole = pieces if self._lower else [self._whole(p) for p in pieces]
        joined = [self._mark.join(whole[i : i + 100]) for i in range(0, len(whole), 100)]
        found: list[bytes] = []
        for e in self._joined.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, cut = ids.tobytes(), (np.flatnonzero(ids == self._mark_id) * 4).tolist()
            found += [data[x:y] for x, y in zip([0, *[c + 4 for c in cut]], [*cut, len(data)])]
        self._new.update(zip(pieces, found))

    def _encode_new(self, pieces: list[str]) -> None:
        joined = "\n".join(pieces)
        mark = any(m in joined for m in self._marks)
        keys = [self._normal(p) for p in pieces] if self._lower else pieces
        whole, composed = {}, []
        for piece, key in zip(pieces, keys):
            if key is None or (mark and any(m in piece for m in self._marks)):
                ids = self._plain.encode(self._whole(piece), add_special_tokens=False).ids
                self._new[piece] = np.array(ids, "<u4").tobytes()
                continue
            if key[-1:] in PUNCTUATION:
                stem = key.rstrip(PUNCTUATION)
                if stem and stem[-1].isalpha() and len(stem) < len(key):
                    tail = key[len(stem) :]
                    composed.append((piece, stem, tail if self._lower else FIRST + tail))
                    continue
            whole[piece] = key
        wanted = set(whole.values()).union(*[x[1:] for x in composed])
        self._encode_joined(self._unknown(wanted))
        if self._lower:
            self._new.update({p: self._new[key] for p, key in whole.items()})
        self._new.update({piece: self._new[stem] + self._new[tail] for piece, stem, tail in composed})

    def limit(self, cache_words: int) -> None:
        self._limit = cache_words

    def _unknown(self, wanted: Collection[str]) -> list[str]:
        """Those that no generation of the cache holds; those in the old one move to the new one."""
        missing = [p for p in wanted if p not in self._new]
        found = list(map(self._old.get, missing))
        self._new.update((p, ids) for p, ids in zip(missing, found) if ids is not None)
        return [p for p, ids in zip(missing, found) if ids is None]

    def _learn(self, wanted: Collection[str]) -> None:
        """Have the ids of all these pieces, which are distinct, at hand."""
        missing = [p for p in wanted if p not in self._new]
        if len(self._new) + len(missing) > self._limit:
            self._old, self._new = self._new, {}
            missing = wanted
        new = self._unknown(missing)
        for i in range(0, len(new), 20_000):
            self._encode_new(new[i : i + 20_000])

    def encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        irregular = pc.match_substring_regex(column, _ARROW_IRREGULAR)
        cut = {i: self.pieces(texts[i]) for i in np.flatnonzero(irregular.to_numpy(zero_copy_only=False)).tolist()}
        regular = [i for i in range(len(texts)) if i not in cut]
        # what ``pieces`` gives for regular texts, cut and numbered by Arrow: Python sees each distinct piece of the group once
        marked = pa.array([FIRST + texts[i] for i in regular], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        numbered = split.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist()
        self._learn(set(distinct).union(*cut.values()) if cut else distinct)
        get = self._new.__getitem__
        out = [b""] * len(texts)
        for i, pieces in cut.items():
            out[i] = b"".join(map(get, pieces))
        if regular:
            found = list(map(get, distinct))
            ids = np.frombuffer(b"".join(found), "<u4")
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            piece = numbered.indices.to_numpy()
            n = size[piece]
            end = np.cumsum(n)
            first = (np.cumsum(size) - size)[piece]
            data = ids[np.arange(end[-1]) + np.repeat(first - (end - n), n)].tobytes()
            at = (4 * np.append(0, end)[split.offsets.to_numpy()]).tolist()
            for i, a, b in zip(regular, at[:-1], at[1:]):
                out[i] = data[a:b]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    """One tokenizer per worker process, until the process works on something else; a later call may ask for another size of its cache."""
    worker_memory.only("tokens")
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
        worker_memory.keep("tokens", _tokenizers.clear)
    _tokenizers[path].limit(cache_words)
    return _tokenizers[path]


def text_groups(texts: list[str | None], chars: int = 4_000_000):
    """(first index, texts) in groups of about ``chars`` characters; a null is an empty text."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        group.append(text or "")
        size += len(text or "")
        if size >= chars:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group
