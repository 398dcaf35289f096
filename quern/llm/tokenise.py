"""Token ids of texts by a byte-level BPE file of the tokenizers library.

Such a tokenizer cuts a text into pieces before it merges bytes, and a piece never goes on over a blank: "a bc" is "a" and
" bc". So a text may be cut before each blank and the parts encoded by themselves, and each distinct part of a batch is
encoded once. This does not hold for a blank within a longer run of white space; such texts are encoded whole. The first
use in a process compares both ways on texts of many kinds and takes only the plain one if they ever differ.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm._shared import give_back, string_parts

_SPACE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A blank that has white space on both sides, or before it and the text's end after it.
_INNER = f"{_SPACE} ({_SPACE}|$)"
#: White space that str.split() does not know alike.
_ODD = set("\x1c\x1d\x1e\x1f\x85")
_PROBES = ["", " ", "a", " a", "a b", "it's 12 o'clock, isn't it?", "x\ny z\n w", "Größe éà 漢字 1234 5", "a\tb c\t d", "tab \tq", "nl \nq", "<|endoftext|> a <|endoftext|>", "a.b, (c) d-e_f #1! ''s 's", " a  b", "q  r", "trailing ", "\ttab", "!! ?? A1b2 3c4"]
#: Signs that, at the end of a part and after a letter or digit, are pieces of their own.
_SIGNS, _BEFORE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "[\\p{L}\\p{N}]$"
#: Parts whose ids are kept from batch to batch, at most, to bound memory; a process grows by about 90 MB with them.
CACHE_PARTS = 1_000_000


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), pa.array(flat))


class Kept:
    """Parts and their ids, found by hash and then compared, in a few arrays: a dict of strings takes more than twice as much."""

    def __init__(self):
        self.hashes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.parts, self.lists = pa.array([], pa.large_string()), _lists(np.zeros(0, np.int64), np.zeros(0, np.uint16))

    def find(self, parts: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each of the parts, -1 if it is not kept."""
        if not len(self.hashes):
            return np.full(len(parts), -1, np.int64)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = self.places[near].astype(np.int64)
        same = pc.equal(self.parts.take(pa.array(at)), parts).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)

    def add(self, parts: pa.Array, hashes: np.ndarray, lists: pa.ListArray) -> None:
        """Keep parts that are not there; of those that share a hash one is found."""
        order = np.argsort(hashes, kind="stable")
        into = np.searchsorted(self.hashes, hashes[order])
        self.places = np.insert(self.places, into, (len(self.parts) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, into, hashes[order])
        self.parts, self.lists = pa.concat_arrays([self.parts, parts]), pa.concat_arrays([self.lists, lists])


class BatchTokenizer:
    """Encodes arrays of texts; ids are below 65,536."""

    def __init__(self, path: str, kept: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        if self.inner.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has more than 65,536 ids")
        self.kept = kept
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.seen: dict[str, Kept] = {}
        ends = self.inner.encode("\n", add_special_tokens=False).ids
        self.line_end = ends[0] if len(ends) == 1 else -1
        self.by_parts = True
        probes = pa.array(_PROBES, pa.large_string())
        counts, ids = self.encode(probes)
        plain, plain_ids = self.plain(_PROBES)
        self.by_parts = np.array_equal(ids, plain_ids) and np.array_equal(counts, plain)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each text and all ids."""
        sizes, flat = [], []
        for start in range(0, len(texts), 20_000):
            lists = [e.ids for e in self.inner.encode_batch_fast(texts[start : start + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int32, len(lists)))
            flat.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint16, int(sizes[-1].sum())))
        return np.concatenate([np.zeros(0, np.int32), *sizes]), np.concatenate([np.zeros(0, np.uint16), *flat])

    def after_blank(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """plain() of a blank and each part. Parts without white space are encoded many at a time with line ends between them, which are pieces of their own."""
        inner = [bool(p) and len(p.split()) == 1 and p == p.strip() and not set(p) & _ODD for p in parts]
        easy = [p for p, ok in zip(parts, inner, strict=True) if ok]
        runs = ["\n ".join(easy[i : i + 1000]) for i in range(0, len(easy), 1000)]
        encoded = [np.array(e.ids, np.uint16) for e in self.inner.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)]
        sizes = np.zeros(len(parts), np.int32)
        cuts = [np.diff(np.flatnonzero(np.concatenate([[True], ids == self.line_end, [True]]))) - 1 for ids in encoded]
        found = np.concatenate([np.zeros(0, np.int64), *cuts])
        if len(found) != len(easy) or self.line_end < 0:
            return self.plain([" " + p for p in parts])
        flat = np.concatenate([np.zeros(0, np.uint16), *[ids[ids != self.line_end] for ids in encoded]])
        ok = np.array(inner, bool)
        hard, hard_flat = self.plain([" " + p for p, easy_ in zip(parts, inner, strict=True) if not easy_])
        if not len(hard):
            return found.astype(np.int32), flat
        sizes[ok], sizes[~ok] = found, hard
        out, owner = np.empty(int(sizes.sum()), np.uint16), np.repeat(ok, sizes)
        out[owner], out[~owner] = flat, hard_flat
        return sizes, out

    def _known(self, parts: pa.Array, prefix: str) -> pa.ListArray:
        """The ids of `prefix` and each of the distinct parts; those seen before are looked up."""
        seen, names = self.seen.setdefault(prefix, Kept()), parts.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(hash, names), np.int64, len(names))
        at = seen.find(parts, hashes)
        new = np.flatnonzero(at < 0)
        fresh = [names[i] for i in new.tolist()]
        at[new] = len(seen.parts) + np.arange(len(new))
        found = _lists(*(self.after_blank(fresh) if prefix else self.plain(fresh)))
        out = pa.concat_arrays([seen.lists, found]).take(pa.array(at))
        if len(new) and (room := max(0, self.kept - len(seen.parts))):
            seen.add(parts.take(pa.array(new[:room])), hashes[new[:room]], found.slice(0, room))
        return out

    def words(self, words: pa.Array) -> pa.ListArray:
        """The ids of a blank and each of a large_string array's words, by way of the words without the signs at their end."""
        heads = pc.ascii_rtrim(words, characters=_SIGNS)
        cut = pc.and_(pc.less(pc.binary_length(heads), pc.binary_length(words)), pc.match_substring_regex(heads, _BEFORE))
        for token in self.special:
            cut = pc.and_not(cut, pc.match_substring(words, token))
        heads = pc.if_else(cut, heads, words)
        raw, ends = string_parts(words)
        size = np.diff(ends) - pc.binary_length(heads).to_numpy(zero_copy_only=False)
        data = np.frombuffer(raw, np.uint8)[np.repeat(ends[1:] - np.cumsum(size), size) + np.arange(size.sum())]
        tails = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data))
        heads, tails = heads.dictionary_encode(), tails.dictionary_encode()
        known = pa.concat_arrays([self._known(heads.dictionary, " "), self._known(tails.dictionary, "")])
        both = np.stack([heads.indices.to_numpy().astype(np.int64), tails.indices.to_numpy() + len(heads.dictionary)], axis=1).ravel()
        joined = known.take(pa.array(both))
        return pa.ListArray.from_arrays(pa.array(joined.offsets.to_numpy()[::2], pa.int32()), joined.values)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each text of a large_string array without nulls, and all ids."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        if not self.by_parts:
            sizes, ids = self.plain(texts.to_pylist())
            return sizes.astype(np.int64), ids
        whole = pc.match_substring_regex(texts, _INNER)
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # a text's first part has no blank before it
        first = offsets[:-1]
        starts, of_first = np.unique(codes[first], return_inverse=True)
        codes = codes.copy()
        codes[first] = len(words) + of_first.ravel()
        sizes, ids = self.plain(words.take(pa.array(starts)).to_pylist())
        at_whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        codes[first[at_whole]] = len(words) + len(starts) + np.arange(len(at_whole))
        more, more_ids = self.plain(texts.take(pa.array(at_whole)).to_pylist())
        known = pa.concat_arrays([self.words(words), _lists(np.concatenate([sizes, more]), np.concatenate([ids, more_ids]))])
        out = known.take(pa.array(codes))
        ends = out.offsets.to_numpy().astype(np.int64)
        return ends[offsets[1:]] - ends[offsets[:-1]], out.values.to_numpy()


_LOADED: dict[tuple[str, int], BatchTokenizer] = {}


def tokenizer(path: str, kept: int = CACHE_PARTS) -> BatchTokenizer:
    """The tokenizer of a file that keeps the ids of so many parts, loaded once a process."""
    if (path, kept) not in _LOADED:
        _LOADED[path, kept] = BatchTokenizer(path, kept)
    return _LOADED[path, kept]


def forget() -> None:
    """Give up the loaded tokenizers and what they keep, in a worker that lives on for tasks that encode nothing."""
    _LOADED.clear()
    give_back()


def byte_bpe_path() -> str:
    """Where the public byte-level BPE of 50,257 ids is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
