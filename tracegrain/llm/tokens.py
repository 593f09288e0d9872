"""Ids of whole texts by the tokenizers library, each different chunk of them encoded once.

Texts are cut only where no token can reach across, so a text's ids are those of its chunks laid end to end. Chunks repeat
as words do; Arrow finds the different ones of a batch and a worker keeps what the library gave for the latest.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker knows at most while it is at work, and while it waits.
KEPT, RESTING = 1 << 20, 1 << 17
SLICE = 4 << 20
MARK = "\x1f"
JOINED, GATHERED = 1000, 1 << 14
#: White space beyond space and line feed; texts that hold any are encoded whole.
OTHER_SPACE = r"[\t\r\v\f\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: How word tokenizers find pieces and write their bytes, and the chunks in which Python finds the same: of ASCII and Latin letters, folded.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
FOLDS, BYTE_LEVEL = {"NFC", "Lowercase", "Replace"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, ``sizes[i]`` of them."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library is another, it keeps what was freed
        ctypes.CDLL(None).malloc_trim(0)


class WordCut:
    """For tokenizers that drop white space and fold case: chunks are what lies between spaces and line feeds.

    A-Z are folded before chunks are compared. Marks that could join a letter before it into one sign might then meet the
    wrong case, so texts with such marks are encoded whole.
    """

    whole = rf"{OTHER_SPACE}|[\x{{300}}-\x{{36f}}]"

    glue = " "

    def single(self, chunk: str) -> bool:
        return chunk.isalpha()

    def lists(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")


class SpaceCut:
    """For byte-level tokenizers whose tokens may begin with one space: a chunk begins at each space and around each line feed.

    Of three or more white spaces in a row, or two at the end, the first ones make one token: such texts are encoded whole.
    """

    whole = rf"{OTHER_SPACE}|[ \n]{{3}}|[ \n]{{2}}$"

    glue = ""

    def single(self, chunk: str) -> bool:
        return chunk[:1] == " " and chunk[1:].isalpha()

    def lists(self, texts: pa.Array) -> pa.Array:
        lines = pc.replace_substring(texts, "\n", f"{MARK}\n{MARK}")
        return pc.split_pattern(pc.replace_substring(lines, " ", f"{MARK} "), MARK)


class Encoder:
    """The ids that the tokenizer file ``path`` gives, special tokens' strings included as the library reads them. ``fresh``
    texts of each batch are encoded whole too and compared; a difference is an error."""

    def __init__(self, path: str, cut: WordCut | SpaceCut, fresh: int = 1):
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.fresh = Tokenizer.from_file(path), cut, fresh
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.by_words = isinstance(cut, WordCut) and self._finds_words()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _finds_words(self) -> bool:
        """Whether the file folds and parts texts by WORDS, so that its model can be asked for pieces, past all that
        comes before it."""
        fold, part = (x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        folds = {x["type"]: x for x in (fold or {}).get("normalizers", [])}
        split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        space = folds.get("Replace", {})
        return folds.keys() == FOLDS and (space["pattern"], space["content"]) == ({"Regex": r"\s+"}, " ") and (part or {}).get("pretokenizers") == [split, BYTE_LEVEL]

    def _learn_pieces(self, pieces: list[str]) -> None:
        ask, ids, sizes = self.tokenizer.model.tokenize, [], []
        for p in pieces:
            found = ask(p if p.isascii() else p.lower().encode().decode("latin-1").translate(LETTERS))
            ids += [t.id for t in found]
            sizes.append(len(found))
        self._keep(pieces, np.array(ids, np.int32), np.array(sizes, np.int64))

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.sizes, self.pool, self.filled = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0

    def rest(self) -> None:
        """Before the worker waits for its next task: keep only the chunks met first, which are mostly the frequent ones."""
        if len(self.known) > RESTING:
            self.known = dict(itertools.islice(self.known.items(), RESTING))
            self.starts, self.sizes = self.starts[:RESTING].copy(), self.sizes[:RESTING].copy()
            self.filled = int(self.starts[-1] + self.sizes[-1])
            self.pool = self.pool[: self.filled].copy()
        trim()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """``ids`` end to end are those of the new ``chunks``, ``sizes`` of them each."""
        at, n, end = len(self.known), len(chunks), self.filled + len(ids)
        while at + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : end] = ids
        self.sizes[at : at + n] = sizes
        self.starts[at : at + n] = end - np.cumsum(sizes[::-1])[::-1]
        self.filled = end
        self.known.update(zip(chunks, range(at, at + n), strict=True))

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks. Such as should be one piece for the library go JOINED in one text, of which it tells the pieces;
        if it finds more of these, they go one by one, as all others do."""
        alone = [c for c in chunks if not self.cut.single(c)]
        single = [c for c in chunks if self.cut.single(c)]
        for i in range(0, len(single), JOINED):
            some = single[i : i + JOINED]
            e = self.tokenizer.encode_batch([self.cut.glue.join(some)], add_special_tokens=False)[0]
            sizes = np.bincount(e.word_ids)
            if len(sizes) == len(some):
                self._keep(some, np.array(e.ids, np.int32), sizes)
            else:
                alone += some
        if alone:
            ids = self._whole(alone)
            self._keep(alone, np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids]))

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Where what is known of each chunk is. A stop or comma after a-z is a token of its own, so such a chunk is made
        of two that are looked up."""
        if len(self.known) > KEPT:
            self._forget()
        known = self.known
        places = list(map(known.get, chunks))
        new = [c for c, p in zip(chunks, places, strict=True) if p is None]
        if self.by_words and new:
            self._by_words([c for c in new if PLAIN.fullmatch(c)])
            new = [c for c in new if c not in known]
        if new:
            ended = [c for c in new if c[-1] in ".," and "a" <= c[-2:-1] <= "z"]
            parts = dict.fromkeys(c for c in new if not (c[-1] in ".," and "a" <= c[-2:-1] <= "z"))
            parts |= dict.fromkeys(p for c in ended for p in (c[:-1], c[-1]) if p not in known)
            self._learn(list(parts))
            if ended:
                both = np.array([known[p] for c in ended for p in (c[:-1], c[-1])])
                sizes = self.sizes[both]
                self._keep(ended, self.pool[spread(self.starts[both], sizes)], sizes[::2] + sizes[1::2])
        if None in places:
            places = list(map(known.__getitem__, chunks))
        return np.array(places, np.int64)

    def _by_words(self, chunks: list[str]) -> None:
        """Learn different plain ``chunks``, none of them known: those of letters as they are, others by their pieces."""
        known = self.known
        self._learn_pieces([c for c in chunks if c.isalpha()])
        parts = {c: PIECES.findall(c.lower()) for c in chunks if c not in known}
        self._learn_pieces([p for p in dict.fromkeys(itertools.chain.from_iterable(parts.values())) if p not in known])
        rest = [c for c in parts if c not in known]
        if rest:
            at = np.array([known[p] for c in rest for p in parts[c]])
            sizes = self.sizes[at]
            first = np.cumsum([0, *(len(parts[c]) for c in rest[:-1])])
            self._keep(rest, self.pool[spread(self.starts[at], sizes)], np.add.reduceat(sizes, first))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all ``texts`` end to end, and how many each has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.cut.whole)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        lists = self.cut.lists(pc.if_else(odd, "", texts))
        coded = lists.flatten().dictionary_encode()
        place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        start, size, pool = self.starts[place], self.sizes[place], self.pool[: self.filled]
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        if len(rare := np.flatnonzero(odd.to_numpy(zero_copy_only=False))):
            ids = self._whole([texts[i].as_py() for i in rare.tolist()])
            at = first[rare]  # such a text's only chunk
            size[at] = [len(x) for x in ids]
            start[at] = len(pool) + np.concatenate([[0], np.cumsum(size[at])[:-1]])
            pool = np.concatenate([pool, *[np.array(x, np.int32) for x in ids]])
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(ends[-1], np.int32)
        for a in range(0, len(size), GATHERED):
            b = min(len(size), a + GATHERED)
            out[ends[a] : ends[b]] = pool[spread(start[a:b], size[a:b])]
        bounds = ends[np.append(first, len(size))]
        for i in np.flatnonzero(~odd.to_numpy(zero_copy_only=False))[: self.fresh].tolist():
            if self._whole([texts[i].as_py()])[0] != out[bounds[i] : bounds[i + 1]].tolist():
                raise ValueError("the tokenizer has tokens that reach across chunks")
        return out, np.diff(bounds)


_loaded: dict = {}


def encoder(path: str, cut: type) -> Encoder:
    """The worker's own encoder of a file, with what it has met so far."""
    if (path, cut) not in _loaded:
        _loaded[path, cut] = Encoder(path, cut())
    return _loaded[path, cut]


def unload() -> None:
    """A worker that turns to other work gives back its encoders."""
    if _loaded:
        _loaded.clear()
        trim()


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE):
    """Runs of a batch's rows whose text has about ``most`` bytes; a longer text is a run by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b
