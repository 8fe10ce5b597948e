"""Whole texts to token ids, batch by batch, with each distinct word encoded once per worker.

The tokenizers' pre-tokenizers never join two words across white space, so a text's ids are its
pieces' ids one after the other. Pieces are cut before a space that stands alone between two
non-space characters; a text with any other white space next to a space is cut by the slower
pattern, which keeps every white-space run whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space as the tokenizers' patterns see it, and letters and marks that are surely
#: letters or ASCII punctuation to them (the apostrophe is left out: it opens contractions).
SPACE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
MARK = r".,!?%#&$*|:;"
PART = re.compile(f"[{SPACE}]*[{LETTER}]+(?=[{MARK}{SPACE}])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
PLAIN = re.compile(f" ?[{LETTER}]+")
ODD = f"^ | $| [{SPACE}]|[{SPACE}] "
#: Bytes of words and ids that a generation of a worker's memory holds; two generations are kept.
KEPT = 80 << 20
#: What a remembered word takes besides its letters and ids.
ENTRY = 200


class Memory:
    """Ids by word. Full, the young generation becomes the old one; words met again move back."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def look(self, words: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of each word, and the places of the unknown ones."""
        found = list(map(self.young.get, words))
        missing = []
        if None in found:
            old = self.old
            for at in [n for n, value in enumerate(found) if value is None]:
                value = found[at] = old.get(words[at])
                if value is None:
                    missing.append(at)
                else:
                    self.keep(words[at], value)
        return found, missing

    def learn(self, words: list[str], values: list[bytes]) -> None:
        """``keep`` for many words that are not known."""
        for word, value in zip(words, values):
            self.held += len(word) + len(value) + ENTRY
            if self.held > KEPT:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[word] = value

    def keep(self, word: str, value: bytes) -> None:
        if word in self.young:
            return
        self.held += len(word) + len(value) + ENTRY
        if self.held > KEPT:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[word] = value


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stay, the rest follow 255."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (byte for byte in range(256) if byte not in kept)
    return {byte: chr(byte) for byte in kept} | {byte: chr(256 + n) for n, byte in enumerate(others)}


class Encoder:
    """Ids of texts. One per worker and file; ``of`` hands out the one already loaded."""

    loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.parts = Memory(), Memory()  # words behind a space; other pieces
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that hold an added token's string go through the library whole.
        self.added = "(?i)" + "|".join(map(re.escape, added)) if added else None
        self.letters = byte_letters()
        self.lower = self.tokenizer.normalizer is not None  # this vocabulary drops spaces and case

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _plain(self, words: list[str], space: str = "") -> list[bytes]:
        """Ids of words of letters, each one pre-token: straight to the library's model, ``space`` before each."""
        tokenize, letters, lower = self.tokenizer.model.tokenize, self.letters, self.lower
        before = "" if lower else space.replace(" ", letters[32])
        ids: list[int] = []
        bounds = [0]
        for word in words:
            if lower:
                word = word.lower()
            if not word.isascii():
                word = "".join([letters[byte] for byte in word.encode()])
            ids += [token.id for token in tokenize(before + word)]
            bounds.append(len(ids) * 4)
        held = np.array(ids, np.uint32).tobytes()
        return [held[begin:end] for begin, end in zip(bounds, bounds[1:])]

    def _encode(self, names: list[str]) -> list[bytes]:
        """Ids of pieces that the pre-tokenizer does not join with others; each is looked at once."""
        found: list[bytes | None] = [None] * len(names)
        plain = PLAIN.fullmatch
        kinds: dict[str, list[int]] = {" ": [], "": [], "rest": []}
        for at, name in enumerate(names):
            kinds["rest" if not plain(name) else " " if name[0] == " " else ""].append(at)
        for space in (" ", ""):
            for at, value in zip(kinds[space], self._plain([names[at][len(space):] for at in kinds[space]], space)):
                found[at] = value
        if kinds["rest"]:
            made = self.tokenizer.encode_batch_fast([names[at] for at in kinds["rest"]], add_special_tokens=False)
            for at, one in zip(kinds["rest"], made):
                found[at] = array("I", one.ids).tobytes()
        return found

    def _pieces(self, names: list[str]) -> list[bytes]:
        """Ids of each piece, put together from its parts."""
        plain = PLAIN.fullmatch
        split = [[name] if plain(name) else PART.findall(name) for name in names]
        parts = dict.fromkeys(part for some in split for part in some)
        behind = [part for part in parts if part[0] == " " and " " not in part[1:]]
        known: dict[str, bytes] = {}
        apart = set(behind)
        rest = [part for part in parts if part not in apart]
        for memory, wanted, keys in ((self.spaced, behind, [part[1:] for part in behind]), (self.parts, rest, rest)):
            found, missing = memory.look(keys)
            for at, value in zip(missing, self._encode([wanted[at] for at in missing])):
                found[at] = value
                memory.keep(keys[at], value)
            known.update(zip(wanted, found))
        return [known[some[0]] if len(some) == 1 else b"".join([known[part] for part in some]) for some in split]

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end``; where each text's ids begin, and the total."""
        collects = gc.isenabled()
        gc.disable()  # hundreds of thousands of short lists of words, none in a cycle
        try:
            return self._batch(texts, end)
        finally:
            if collects:
                gc.enable()

    def _batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        apart = pc.match_substring_regex(texts, ODD)
        own: dict[int, np.ndarray] = {}
        if self.added is not None:
            special = pc.match_substring_regex(texts, self.added)
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
                whole = self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0]
                own[i] = np.array(whole.ids, np.uint32)
            apart = pc.or_(apart, special)
        for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            if i not in own:
                own[i] = np.frombuffer(self._pieces([texts[i].as_py()])[0], np.uint32)
        if own:
            texts = pc.if_else(apart, "", texts)
        split = pc.split_pattern(texts, " ")
        flat, bounds = split.flatten(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        first = bounds[:-1].astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [words[c] for c in codes[first].tolist()]  # no space before these
        found, missing = self.spaced.look(words)
        letters = pc.match_substring_regex(coded.dictionary.take(pa.array(missing, pa.int64())), f"^[{LETTER}]+$").to_pylist()
        whole = list(compress(missing, letters))
        new = [words[at] for at in whole]
        values = self._plain(new, " ")
        self.spaced.learn(new, values)  # before the other words: these are often parts of them
        for at, value in zip(whole, values):
            found[at] = value
        mixed = [at for at in missing if found[at] is None]
        for at, value in zip(mixed, self._pieces([" " + words[at] for at in mixed])):
            found[at] = value
            self.spaced.keep(words[at], value)
        codes[first] = len(words) + np.arange(len(first))
        found += self._pieces(heads)
        vocabulary = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        took = sizes[codes]
        before = np.concatenate([[0], np.cumsum(took)])
        small = np.int32 if before[-1] < 2**31 and len(vocabulary) < 2**31 else np.int64
        index = np.arange(before[-1], dtype=small) + np.repeat((starts[codes] - before[:-1]).astype(small), took)
        ids = vocabulary[index]
        lengths = before[bounds[1:]] - before[bounds[:-1]]
        if own:
            for i, more in own.items():
                lengths[i] = len(more)
            stretches, at = [], before[bounds]
            for i in range(len(first)):
                stretches.append(own[i] if i in own else ids[at[i]:at[i + 1]])
            ids = np.concatenate(stretches) if stretches else ids
        where = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(where[-1], end, np.uint32)
        keep = np.ones(where[-1], bool)
        keep[where[1:] - 1] = False
        out[keep] = ids
        return out, where
