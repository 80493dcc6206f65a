"""Batch encoders over public vocabularies: whole texts in, flat token ids out.

A text falls into chunks, each a run of blanks or line ends and the other characters up to the
next such run. Where a vocabulary's splitting pattern never matches across the start of a chunk,
the chunks' ids joined are the text's ids; each distinct chunk of a block of texts is then encoded
once by the tokenizer's own library, and what was met before is remembered. ``parts_at_blanks``
checks that of every vocabulary as its encoder is built; others encode their texts whole, and so
are texts with other white space. Distinct chunks are found, and looked up, by Arrow.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphweave.llm import common

CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Texts that need more care than parting at single blanks and line ends: other white space, NUL, blanks in a row or at an end.
UNUSUAL = r"^$|^[ \n]|[ \n]\z|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bound on the chunks that an encoder remembers; when it is reached, those met once are forgotten.
REMEMBERED = 500_000
#: Texts are taken apart in blocks of about so many bytes: the larger, the fewer distinct chunks each byte has.
BLOCK_BYTES = 6 << 20
#: Of ASCII, but for the apostrophe, which the patterns keep with some letters.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
Flat = tuple[np.ndarray, np.ndarray]  # ids one after another, and how many belong to each
Library = Callable[[list[str]], Flat]


def _keys(text: str) -> list[str]:
    """The chunks of any text: without their blank if they begin with one, after NUL if with neither blank nor line end."""
    if not text:
        return []
    chunks = CHUNK.findall(text) if not OTHER_SPACE.search(text) else [text]
    return [c[1:] if len(c) > 1 and c[0] == " " and c[1] not in " \n\0" else c if c[0] == "\n" else "\0" + c for c in chunks]


def chunk(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def _large(text: str) -> pa.LargeStringScalar:
    return pa.scalar(text, pa.large_string())


def _keys_of_block(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """The keys of all texts, and where each text's begin and end."""
    odd = pc.match_substring_regex(texts, UNUSUAL)
    usual = texts.filter(pc.invert(odd))
    lists = pc.split_pattern(pc.binary_join_element_wise(_large("\0"), pc.replace_substring(usual, "\n", " \n"), _large("")), " ")
    keys, limits = lists.values, lists.offsets.to_numpy()
    if len(usual) == len(texts):
        return keys, limits
    own = [_keys(t) for t in texts.filter(odd).to_pylist()]
    keys = pa.concat_arrays([keys, pa.array([k for x in own for k in x], pa.large_string())])
    # both kinds of texts in the order in which they came
    sizes, begins, where = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), odd.to_numpy(zero_copy_only=False)
    sizes[~where], begins[~where] = np.diff(limits), limits[:-1]
    sizes[where] = [len(x) for x in own]
    begins[where] = limits[-1] + np.cumsum(sizes[where]) - sizes[where]
    return keys.take(pa.array(common.ranges(begins, sizes))), np.concatenate(([0], np.cumsum(sizes)))


def stays_letter(letter: str) -> bool:
    """One letter still under NFC and lower case; others leave a mark at the end, which the patterns keep with punctuation."""
    normal = unicodedata.normalize("NFC", letter).lower()
    return letter.isalpha() and len(normal) == 1 and normal.isalpha()


def flat(lists: Sequence[Sequence[int]]) -> Flat:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


def _sliced(encode: Callable[[list[str]], list[list[int]]], chars: int = 100_000) -> Library:
    """``encode`` for a few texts at a time: what libraries return takes many times the room of the ids."""

    def run(texts: list[str]) -> Flat:
        parts = [flat(encode(texts[a:b])) for a, b in common.by_size(texts, chars)]
        ids, counts = zip(*parts) if parts else ([np.zeros(0, np.int32)], [np.zeros(0, np.int64)])
        return np.concatenate(ids), np.concatenate(counts)

    return run


def spelling() -> list[str]:
    """A printable character for each byte: its own where Latin-1 has one, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def _unspelled(name: str) -> bytes:
    return b"".join(_byte_of[c] if c in _byte_of else c.encode() for c in name)


_byte_of = {c: bytes([b]) for b, c in enumerate(spelling())} | {"▁": b" "}


def parts_at_blanks(whole: Library, entries: Iterable[bytes]) -> bool:
    """Whether a text's ids are those of its chunks: no entry has a blank or line end after what isn't white space, and probes give the same ids either way."""
    if any(re.search(r"\S[ \n]", e.decode("utf-8", "replace")) for e in entries):
        return False
    words, between = ["a", "Ab", "1", "é", "!", "...", "don't", "x.", "(", '"', "中", "s"], [" ", "\n", "  ", " \n", "\n\n", "\n "]
    probes = ["".join(p) for p in product(words, between, words)]
    parts = [[chunk(k) for k in _keys(p)] for p in probes]
    ids, counts = whole([c for own in parts for c in own])
    found, sizes = whole(probes)
    sums = np.add.reduceat(counts, np.cumsum([0] + [len(own) for own in parts[:-1]]))
    return np.array_equal(ids, found) and np.array_equal(sums, sizes)


class Together:
    """Encodes distinct keys many at a time: they are joined to one text, whose ids a table parts again.

    ``marks`` flags, for each id, an entry that begins with a blank or line end (``at_start``), of
    which a chunk has just one, or an entry that ends a word, of which letters have one and letters
    with punctuation two. Keys of other kinds, and groups whose marks don't add up, go to ``slow``.
    """

    SIZE = 256

    def __init__(self, library: Library, marks: np.ndarray, at_start: bool, slow: Callable[[list[str]], Flat]):
        self._library, self._marks, self._at_start, self._slow = library, marks, at_start, slow
        if at_start:
            self._one, self._two = r"^\n?[^\x00 \n][^ \n]*\z", None
        else:
            letters = "".join(c for c in map(chr, range(0x250)) if stays_letter(c))
            self._one = rf"^\n?[{letters}]+\z"
            self._two = rf"^\n?[{letters}]+[{re.escape(PUNCTUATION)}]+\z"

    def __call__(self, keys: pa.Array) -> Flat:
        marks = np.zeros(len(keys), np.int64)
        for k, pattern in enumerate((self._one, self._two), 1):
            if pattern:
                marks[pc.match_substring_regex(keys, pattern).to_numpy(zero_copy_only=False)] = k
        own = keys.to_pylist()
        fast = np.flatnonzero(marks)
        ids, counts = self._joined([own[k] for k in fast.tolist()], marks[fast])
        if len(fast) == len(own):
            return ids, counts
        rest = np.flatnonzero(marks == 0)
        more, sizes = self._slow([chunk(own[k]) for k in rest.tolist()])
        every = np.zeros(len(own), np.int64)
        every[fast], every[rest] = counts, sizes
        begins = np.zeros(len(own), np.int64)
        begins[fast], begins[rest] = np.cumsum(counts) - counts, len(ids) + np.cumsum(sizes) - sizes
        return np.concatenate([ids, more])[common.ranges(begins, every)], every

    def _joined(self, keys: list[str], marks: np.ndarray) -> Flat:
        if not keys:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        begins = np.arange(0, len(keys), self.SIZE)
        ids, sizes = self._library([(" " + " ".join(keys[k : k + self.SIZE])).replace(" \n", "\n") for k in begins.tolist()])
        marked = self._marks[ids]
        upto = np.concatenate(([0], np.cumsum(marked)))
        limits = np.concatenate(([0], np.cumsum(sizes)))
        if not sizes.all() or (np.diff(upto[limits]) != np.add.reduceat(marks, begins)).any() or not marked[limits[:-1] if self._at_start else limits[1:] - 1].all():
            return self._slow([chunk(k) for k in keys])
        at = np.flatnonzero(marked)
        ends = np.append(at[1:], len(ids)) if self._at_start else at[np.cumsum(marks) - 1] + 1
        return ids, np.diff(ends, prepend=0)


class Memo:
    """Encodes texts by distinct chunks: ``encode`` gives the ids of keys, ``whole`` those of texts if there are to be no chunks."""

    def __init__(self, encode: Callable[[pa.Array], Flat], whole: Callable[[list[str]], Flat] | None = None, remembered: int = REMEMBERED):
        self.encode, self._whole, self._limit = encode, whole, remembered
        self._clear(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _clear(self, keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self._keys, self._count, self._ids = keys, counts, ids
        self._start, self._met = np.cumsum(counts) - counts, np.ones(len(keys), np.uint8)

    def _forget(self) -> None:
        """What was met once goes, or everything if that frees too little."""
        kept = np.flatnonzero(self._met > 1)
        if len(kept) > self._limit // 2:
            kept = kept[:0]
        self._clear(self._keys.take(pa.array(kept)), self._count[kept], self._ids[common.ranges(self._start[kept], self._count[kept])])

    def _known(self, keys: pa.Array) -> np.ndarray:
        """The places of distinct keys; those that are new are learned."""
        found = pc.index_in(keys, value_set=self._keys)
        which = found.fill_null(-1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(which < 0)
        if len(unknown):
            new = keys.take(pa.array(unknown))
            ids, counts = self.encode(new)
            which[unknown] = len(self._keys) + np.arange(len(unknown))
            self._start = np.concatenate([self._start, len(self._ids) + np.cumsum(counts) - counts])
            self._count, self._ids = np.concatenate([self._count, counts]), np.concatenate([self._ids, ids])
            self._met = np.concatenate([self._met, np.zeros(len(unknown), np.uint8)])
            self._keys = pa.concat_arrays([self._keys, new])
        self._met[which] = np.minimum(self._met[which], 1) + 1
        return which

    def __call__(self, texts: Sequence[str | None] | pa.Array) -> Flat:
        """All ids, one text after another, and the number of ids of each text; null texts have none."""
        array = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for block in _blocks(array):
            if self._whole:
                parts.append(self._whole(block.to_pylist()))
                continue
            if len(self._keys) > self._limit:
                self._forget()
            keys, limits = _keys_of_block(block)
            coded = keys.dictionary_encode()
            which = self._known(coded.dictionary)[coded.indices.to_numpy()]
            count = self._count[which]
            parts.append((self._ids[common.ranges(self._start[which], count)], np.diff(np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[limits])))
        ids, counts = zip(*parts)
        return np.concatenate(ids), np.concatenate(counts)


def _blocks(texts: pa.LargeStringArray) -> Iterator[pa.Array]:
    """Consecutive texts of about ``BLOCK_BYTES`` together, one at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def library_encoder(path: str) -> Memo:
    """A vocabulary file of the tokenizers library, without added special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    names = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
    special = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}
    between = next(iter(special), None)

    library = _sliced(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def slow(chunks: list[str]) -> Flat:
        """Many at a time with a special token between: the library takes a text apart at these before all else."""
        if between is None or any(s in c for c in chunks if "<" in c for s in special):
            return library(chunks)
        groups = [between.join(chunks[k : k + Together.SIZE]) + between for k in range(0, len(chunks), Together.SIZE)]
        ids, _ = library(groups)
        ends = np.flatnonzero(ids == special[between])
        if len(ends) != len(chunks):
            return library(chunks)
        return ids[ids != special[between]], np.diff(ends, prepend=-1) - 1

    if not parts_at_blanks(library, (_unspelled(n) for n in names if n not in special)):
        return Memo(no_chunks, whole=library)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    marks = np.array([n.endswith(suffix) if suffix else n[:1] in ("Ġ", "Ċ") for n in names])
    return Memo(Together(library, marks, not suffix, slow) if marks.any() else lambda keys: slow([chunk(k) for k in keys.to_pylist()]))


def no_chunks(keys: pa.Array) -> Flat:
    raise ValueError("this vocabulary has no chunks")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_encoder(path: str, pattern: str) -> Memo:
    """A rank file by the tiktoken library, without special tokens."""
    import tiktoken

    ranks = read_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    library = _sliced(lambda texts: [encoding.encode_ordinary(t) for t in texts])
    if not parts_at_blanks(library, ranks):
        return Memo(no_chunks, whole=library)
    marks = np.zeros(max(ranks.values()) + 1, bool)
    marks[[rank for entry, rank in ranks.items() if entry[:1] in (b" ", b"\n")]] = True
    return Memo(Together(library, marks, True, library))


def splits(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
