"""Exact tokenisation with the ``tokenizers`` library, sped up by encoding each distinct chunk once.

The byte-level vocabularies split a text before any merge. Such a split always falls where a run
of white space begins, before the last character of such a run if more text follows, and where a run
of letters and digits ends before another character. A chunk between two such places therefore encodes
to the same ids wherever it stands, and the ids of a text are those of its chunks, one after another.
Texts whose white space is spaces and line ends, at most two together, are taken in groups of bounded
length: Arrow cuts a group at its spaces and numbers its distinct chunks, Python looks each of those up
once, and numpy puts the ids together. Other texts are cut by a pattern. Two generations of dictionaries,
each of bounded bytes, keep the chunks seen lately; no id depends on what they hold.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from criterium.llm.common import claim

CHUNK = re.compile(r"\s*[^\W_]+|\s*\S+|\s+")
#: What may follow a word, and is a chunk of its own.
MARKS = (".", ",", ";", ":", "!", "?")
#: Characters whose class Python and the tokenizer may see differently: texts that hold them are encoded whole.
CONTROLS = "\x1c\x1d\x1e\x1f"
ODD = re.compile(f"[{CONTROLS}\U00010000-\U0010ffff]")
#: Those and white space other than spaces and line ends.
UNUSUAL = re.compile(rf"[^\S \n]|{ODD.pattern}")
#: Three characters of white space together.
RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]
#: Bytes of a generation of chunks, and what an entry takes besides its letters and ids; longer chunks are not kept.
KEPT, ENTRY, LONGEST = 64 << 20, 190, 64
#: Characters of a group of texts (a longer text is a group of its own), and what marks a text's first chunk, which has no space before it.
GROUP, FIRST = 4 << 20, "\x1f"


#: Letters below are letters in every version of Unicode that a splitter may follow.
SETTLED = "\u0250"
#: Byte-level vocabularies write printable bytes as the characters with their numbers, and the others, in order, as those from 256.
BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
SPACE = chr(BYTES[32])


def written(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder != "little":
        found.byteswap()
    return found.tobytes()


class _Chunks(dict):
    """Ids by chunk; a missing chunk is looked up among the older ones, put together from smaller chunks, or encoded.

    ``lead`` stands before each key. ``bare`` holds chunks with nothing before them; keys that begin with ``FIRST``
    or a line end are among those.
    """

    def __init__(self, tokenizer, lead: str, old: dict, bare: _Chunks | None = None, word=None):
        self.encode, self.lead, self.old, self.bare, self.bytes = tokenizer.encode, lead, old, self if bare is None else bare, 0
        self.word = word

    def __missing__(self, key: str) -> bytes:
        if key[:1] == FIRST:
            return self.bare[key[1:]]
        if self.word and key[:1] == "\n" and key[1:] and not key[1].isspace():
            return self.bare["\n"] + self.bare[key[1:]]
        if self.word and key[-1:] in MARKS and key[:-1].isalpha():  # put together each time: the room is for words
            return self[key[:-1]] + self.bare[key[-1]]
        if self.lead and key[:1] == "\n":
            return self.bare[key]
        ids = self.old.get(key)
        if ids is None and self.word and key.isalpha() and (key.isascii() or max(key) < SETTLED):
            ids = packed([t.id for t in self.word((SPACE if self.lead else "") + written(key))])
        elif ids is None:
            parts = CHUNK.findall(self.lead + key)
            if len(parts) > 1:
                ids = b"".join([self[parts[0][len(self.lead) :]], *map(self.bare.__getitem__, parts[1:])])
            else:
                ids = packed(self.encode(self.lead + key, add_special_tokens=False).ids)
        if len(key) <= LONGEST:
            self[key] = ids
            self.bytes += ENTRY + len(ids)
        return ids


class ChunkEncoder:
    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are found before any split, and a chunk's border could cut one: texts that hold one are encoded whole, too.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: Letters, after a space or not, are one piece for the byte-level splitter: the merges alone encode them. So is a line end before anything but white space.
        plain = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and type(self.tokenizer.model).__name__ == "BPE"
        self.word = self.tokenizer.model.tokenize if plain else None
        self.kept = kept
        self._turn({}, {})

    def _turn(self, bare: dict, spaced: dict) -> None:
        self.bare = _Chunks(self.tokenizer, "", bare, None, self.word)
        self.spaced = _Chunks(self.tokenizer, " ", spaced, self.bare, self.word)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        ids = self._irregular(text)
        if ids is None:
            found, bare, spaced = [], self.bare, self.spaced.__getitem__
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                found.extend((bare["\n"], bare[first]) if k and self.word else (bare["\n" + first if k else first],))
                found.extend(map(spaced, rest))
            ids = b"".join(found)
        self._renew()
        return ids

    def encode_all(self, texts: Iterable[str], most: int = GROUP) -> Iterator[bytes]:
        """:meth:`encode` of each text, in order; faster, and takes the memory of a group of ``most`` characters besides."""
        group, held = [], 0
        for text in texts:
            if group and held + len(text) > most:
                yield from self._group(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        slow = [self._irregular(text) for text in texts]
        regular = iter(self._joined([text for text, ids in zip(texts, slow) if ids is None]))
        yield from (next(regular) if ids is None else ids for ids in slow)
        self._renew()

    def _renew(self) -> None:
        if self.bare.bytes + self.spaced.bytes > self.kept:
            self.bare.old, self.spaced.old = {}, {}
            self._turn(self.bare, self.spaced)

    def _irregular(self, text: str) -> bytes | None:
        """The ids of a text that cannot be cut at its spaces."""
        unusual = any(c in text for c in "\t\r\x0b\x0c" + CONTROLS) if text.isascii() else UNUSUAL.search(text)
        if (unusual and ODD.search(text)) or any(t in text for t in self.added):
            return self.whole(text)
        if unusual or any(r in text for r in RUNS) or text[-2:].isspace():
            return b"".join(map(self.bare.__getitem__, CHUNK.findall(text)))
        return None

    def _joined(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = pc.split_pattern(pa.array([FIRST + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        found = list(map(self.spaced.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, index = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(at[index] - ends + n, n) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[cut.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=1)
def _encoder(path: str, kept: int) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, kept)


def encoder(path: str | None = None, kept: int = KEPT) -> ChunkEncoder:
    """One encoder for each Python worker, kept from task to task."""
    claim("tokens", _encoder.cache_clear)
    return _encoder(path or default_path(), kept)
