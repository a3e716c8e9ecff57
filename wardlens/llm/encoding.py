"""Tokenizing whole texts with a tokenizers file, remembering the ids of pieces that come again.

A text's ids are the concatenation of its pieces' ids wherever the tokenizer's own pre-tokenizer is sure to cut, so each
distinct piece is encoded by the library once and the rest is numpy. Two kinds of file are known; any other is
encoded text by text:

* white space is dropped (normalizer NFC, white space to a space, lower case; words matched by a pattern without white
  space): a cut at every run of ASCII white space is safe;
* byte-level with the usual pattern, in which a word takes one space before it: a cut before a single space that a
  non-space follows is safe.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_slices, resident, split_words

#: A space that another white-space character, or the end, follows: such texts are cut by a Python pattern instead.
_ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
_CUT = re.compile(r"(?= \S)")


class _Pieces:
    """Distinct pieces with their ids end to end."""

    def __init__(self):
        self.keys, self.chars = pa.array([], pa.large_string()), 0
        self.starts, self.lens, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, pieces: pa.Array, lens: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Their codes."""
        n = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(lens) - lens])
        self.lens, self.store = np.concatenate([self.lens, lens]), np.concatenate([self.store, ids])
        self.keys = pa.concat_arrays([self.keys, pieces])
        self.chars += pc.sum(pc.binary_length(pieces)).as_py() or 0
        return np.arange(n, len(self.starts))

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Their codes; -1 for unknown ones."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its length says, end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def _cutting(spec: dict) -> str | None:
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if spec.get("post_processor") not in (None,) and (spec["post_processor"] or {}).get("type") != "ByteLevel":
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "space"
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    steps = pre.get("pretokenizers", [])
    if kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"]:
        split = steps[0]
        if split.get("behavior") == "Removed" and split.get("invert") and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex"):
            if split["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+"):
                return "drop"
    return None


#: Between a Latin letter or digit and one of these a pre-token always ends, with both patterns. Not after U+0130, whose lower
#: case ends in a mark.
_EDGE = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,;:!?])"


def encoder(path: str, end_id: int | None = 1) -> "Encoder":
    """The encoder of this Python worker: what it remembers serves all tasks that the worker runs."""
    return resident(("encoder", path, end_id), lambda: Encoder(path, end_id))


class Encoder:
    """ids of many texts at once. At most about ``max_pieces`` pieces of ``max_chars`` characters in all are remembered:
    in two generations, of which the older is dropped when the younger is half full, and its pieces move when used."""

    def __init__(self, path: str, end_id: int | None = 1, max_pieces: int = 600_000, max_chars: int = 9_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size()
        # Texts that spell an added token, in any case, go to the library whole: it looks for those before it cuts.
        added = [re.escape(t.content.lower()) for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(sorted(added)) or None
        self.cut = _cutting(json.loads(self.tok.to_str()))
        # A line's end before a piece stays a token by itself; where white space is dropped, a nought between spaces does.
        self.mark, self.plain = ("\n", r"^ ?[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+$") if self.cut == "space" else (" 0 ", r"^[^\s0\x0b\x1c-\x1f\x{85}\p{Z}]+$")
        if self.cut:
            (only,) = self.tok.encode(self.mark, add_special_tokens=False).ids
            self.mark = self.mark, only
        self.end_id, self.max_pieces, self.max_chars = end_id, max_pieces, max_chars
        self.old = _Pieces()
        self.new = _Pieces()

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) straight from the library."""
        lens, ids = [], []
        for i in range(0, len(texts), 20_000):
            for e in self.tok.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False):
                x = e.ids
                lens.append(len(x))
                ids.extend(x)
        return np.array(lens, np.int64), np.array(ids, np.uint32)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_raw`` of distinct pieces, many to a text: with a mark between them that is a pre-token of its own and has an id that no
        piece without it has, so the ids are cut apart again. Pieces in which the mark or other white space stands go by themselves."""
        mark, id_ = self.mark
        plain = pc.match_substring_regex(pieces, self.plain).to_numpy(zero_copy_only=False)
        lens, ids = np.zeros(len(pieces), np.int64), []
        one = np.flatnonzero(plain)
        for i in range(0, len(one), 20_000):
            got = np.array(self.tok.encode_batch_fast([mark.join(pieces.take(pa.array(one[i : i + 20_000])).to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(got == id_)
            lens[one[i : i + 20_000]] = np.diff(cuts, prepend=-1, append=len(got)) - 1
            ids.append(np.delete(got, cuts))
        own, rest = self._raw(pieces.filter(pa.array(~plain)).to_pylist())
        lens[~plain] = own
        out, from_plain = np.empty(lens.sum(), np.uint32), np.repeat(plain, lens)
        out[from_plain], out[~from_plain] = np.concatenate([*ids, np.zeros(0, np.uint32)]), rest
        return lens, out

    def _lookup(self, pieces: pa.Array) -> np.ndarray:
        """Codes in ``new`` of distinct pieces."""
        codes = self.new.find(pieces)
        open_ = np.flatnonzero(codes < 0)
        if len(open_):
            asked = pieces.take(pa.array(open_))
            before = self.old.find(asked)
            fresh, known = np.flatnonzero(before < 0), np.flatnonzero(before >= 0)
            if len(fresh):
                own = asked.take(pa.array(fresh))
                codes[open_[fresh]] = self.new.add(own, *self._joined(own))
            if len(known):
                at = before[known]
                n = self.old.lens[at]
                codes[open_[known]] = self.new.add(asked.take(pa.array(known)), n, self.old.store[_runs(self.old.starts[at], n)])
        return codes

    def _by_pieces(self, flat: pa.Array, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(flat):
            return np.zeros(0, np.uint32), off
        enc = flat.dictionary_encode()
        codes = self._lookup(enc.dictionary)[enc.indices.to_numpy()]
        n = self.new.lens[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.new.store[_runs(self.new.starts[codes], n)], ends[off]

    def _cut_before_spaces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if pc.any(pc.match_substring(texts, "\x01")).as_py():  # the mark itself occurs
            lists = pa.array([_CUT.split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            marked = pc.replace_substring(pc.replace_substring_regex(texts, _EDGE, "\\1\x01\\2"), " ", "\x01 ")
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            if odd.any():
                even = iter(pc.split_pattern(marked.filter(pa.array(~odd)), "\x01").to_pylist())
                rows = [_CUT.split(t) if o else next(even) for t, o in zip(texts.to_pylist(), odd.tolist())]
                lists = pa.array(rows, pa.large_list(pa.large_string()))
            else:
                lists = pc.split_pattern(marked, "\x01")
        off = lists.offsets.to_numpy().astype(np.int64)
        return lists.flatten(), off - off[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts, each with the end id, and the texts' offsets among them. Null is an empty text."""
        texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        if len(self.new.starts) > self.max_pieces // 2 or self.new.chars > self.max_chars // 2:
            self.old, self.new = self.new, _Pieces()
        whole = None
        if self.cut and self.added:
            spelt = pc.match_substring_regex(texts, self.added, ignore_case=True)
            if pc.any(spelt).as_py():
                whole = spelt.to_numpy(zero_copy_only=False)
                lens_w, ids_w = self._raw(texts.filter(spelt).to_pylist())
                texts = pc.if_else(spelt, pa.scalar("", texts.type), texts)
        if self.cut == "drop":
            flat, off = split_words(pc.replace_substring_regex(texts, _EDGE, r"\1 \2"), lower=True)
            ids, off = self._by_pieces(flat, off)
        elif self.cut == "space":
            ids, off = self._by_pieces(*self._cut_before_spaces(texts))
        else:
            lens, ids = self._raw(texts.to_pylist())
            off = np.concatenate([[0], np.cumsum(lens)])
        if whole is not None:
            lens = np.diff(off)
            lens[whole] = lens_w
            merged = np.empty(lens.sum(), np.uint32)
            from_raw = np.repeat(whole, lens)
            merged[from_raw], merged[~from_raw] = ids_w, ids
            ids, off = merged, np.concatenate([[0], np.cumsum(lens)])
        if self.end_id is None:
            return ids, off
        n = len(off) - 1
        out = np.full(len(ids) + n, self.end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
        return out, off + np.arange(n + 1)

    def slices(self, texts: pa.Array, limit: int = 4_000_000):
        """(first row, ids, offsets) for runs of rows of about ``limit`` bytes of text."""
        for a, b in byte_slices(texts, limit):
            ids, off = self.encode(texts.slice(a, b - a))
            yield a, ids, off
