"""Token ids of many texts, with the work for repeated words done once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words whose ids a task remembers; it starts anew beyond that.
KNOWN_WORDS = 1_000_000
WORDS_TOGETHER = 10_000
# White space at either side of a space: there a run of white space reaches across the space.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Marks that, at the end of a word and after a letter, are encoded apart from it.
_MARKS = ".,;:!?"
_ACROSS = f"{_SPACE} {_SPACE}"
_ODD_END = f"^$|^{_SPACE}|{_SPACE}$"
# A line break with no other white space beside it is encoded apart from both its sides.
_ONE_BREAK = r"^[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\n[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"
# Codes of a word: the part before a line break and the marks behind it, the break, and the same after it.
_PARTS = 5
# Words of these letters are one unit for the tokenizer, also behind a space.
_LETTERS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"


def _letter_of_bytes() -> np.ndarray:
    """The letter by which a byte-level vocabulary writes each byte: the byte's own if it is a
    visible Latin-1 character, else one from 256 on, in order."""
    own = np.zeros(256, dtype=bool)
    for first, last in ((33, 126), (161, 172), (174, 255)):
        own[first : last + 1] = True
    return np.where(own, np.arange(256), 255 + np.cumsum(~own)).astype("<u4")


class TextEncoder:
    """Encodes with a byte-level tokenizer of the tokenizers library, without special tokens.

    Such a tokenizer never merges across a space that follows something else, unless white
    space is on both sides of it. So a text is cut before its spaces, each different piece
    is encoded once and remembered, and the ids are put together. Texts with white space on
    both sides of a space, or with what may be a special token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _letter_of_bytes()
        self.by_unit = self._takes_units()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.forget()

    def _takes_units(self) -> bool:
        """Whether words of letters can be given to the model one by one."""
        from tokenizers import models, pre_tokenizers

        own = self.tokenizer
        if own.normalizer is not None or not isinstance(own.model, models.BPE) or not isinstance(own.pre_tokenizer, pre_tokenizers.ByteLevel):
            return False
        return [unit for unit, _ in own.pre_tokenizer.pre_tokenize_str(" ab Cd")] == ["\u0120ab", "\u0120Cd"]

    def forget(self) -> None:
        # Words at a start, and words after a space: the words, and the code of each (0 at the end).
        self.known = {spaced: (pa.array([], pa.large_string()), np.zeros(1, dtype=np.int32)) for spaced in (False, True)}
        # Code 0 has no ids.
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.sizes = np.zeros(1, dtype=np.int64)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        first = len(self.sizes)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, ids))
        return first

    def _add_each(self, texts: list[str]) -> int:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.array([i for ids in found for i in ids], dtype=np.uint32)
        return self._add(flat, np.array([len(ids) for ids in found], dtype=np.int64))

    def _add_together(self, words: list[str]) -> int:
        """Words without white space at their ends, each after a space: some thousands make one text."""
        first = len(self.sizes)
        parts, sizes = [], []
        for start in range(0, len(words), WORDS_TOGETHER):
            some = words[start : start + WORDS_TOGETHER]
            found = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype=np.uint32)
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            places = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="right")
            parts.append(ids)
            sizes.append(np.diff(places, prepend=0))
        self._add(np.concatenate(parts), np.concatenate(sizes))
        return first

    def _add_units(self, words: pa.Array, spaced: bool) -> int:
        """Words of letters, each after a space if `spaced`, straight to the tokenizer's model."""
        joined = " ".join(words.to_pylist())
        written = self.letters[np.frombuffer(joined.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
        space, tokenize = chr(self.letters[32]), self.tokenizer.model.tokenize
        ids, sizes = [], []
        before = space if spaced else ""
        for word in written.split(space):
            found = tokenize(before + word)
            sizes.append(len(found))
            ids += [t.id for t in found]
        return self._add(np.array(ids, dtype=np.uint32), np.array(sizes, dtype=np.int64))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[codes]
        before = np.cumsum(sizes) - sizes
        places = np.repeat((self.starts[codes] - before).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.flat[places], sizes

    def _learn(self, new: pa.Array, spaced: bool) -> np.ndarray:
        """Codes of words that are not known yet."""
        codes = np.zeros(len(new), dtype=np.int32)
        rest = np.ones(len(new), dtype=bool)
        if self.by_unit:
            unit = pc.match_substring_regex(new, _LETTERS)
            rest = ~unit.to_numpy(zero_copy_only=False)
            if not rest.all():
                first = self._add_units(new.filter(unit), spaced)
                codes[~rest] = np.arange(first, first + int((~rest).sum()))
        left = new.filter(pa.array(rest))
        odd = np.ones(len(left), dtype=bool)
        if spaced:
            odd = pc.match_substring_regex(left, _ODD_END).to_numpy(zero_copy_only=False)
        found = np.zeros(len(left), dtype=np.int32)
        if not odd.all():
            plain = left.filter(pa.array(~odd)).to_pylist()
            found[~odd] = self._add_together(plain) + np.arange(len(plain))
        if odd.any():
            apart = left.filter(pa.array(odd)).to_pylist()
            found[odd] = self._add_each([" " + w for w in apart] if spaced else apart) + np.arange(len(apart))
        codes[rest] = found
        return codes

    def _codes(self, words: pa.Array, spaced: bool) -> np.ndarray:
        """Places of the ids of each word; each different one is looked up once."""
        coded = words.dictionary_encode()
        known, code_of = self.known[spaced]
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy()
        codes = code_of[at]
        new = at < 0
        if new.any():
            unknown = coded.dictionary.filter(pa.array(new))
            codes[new] = learnt = self._learn(unknown, spaced)
            self.known[spaced] = pa.concat_arrays([known, unknown]), np.concatenate((code_of[:-1], learnt, code_of[-1:]))
        return codes[coded.indices.to_numpy()]

    def _marked(self, units: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, and of the marks behind them (0: none)."""
        cores = pc.utf8_rtrim(units, characters=_MARKS)
        behind = np.asarray(pc.binary_length(units)) - np.asarray(pc.binary_length(cores))
        cut = behind > 0
        cut[cut] = pc.match_substring_regex(cores.filter(pa.array(cut)), r"\pL$").to_numpy(zero_copy_only=False)
        own = self._codes(pc.if_else(pa.array(cut), cores, units), spaced)
        marks = np.zeros(len(units), dtype=np.int32)
        for n in np.unique(behind[cut]).tolist():
            these = np.flatnonzero(cut & (behind == n))
            marks[these] = self._codes(pc.utf8_slice_codeunits(units.take(pa.array(these)), start=-n), False)
        return own, marks

    def _parts(self, words: pa.Array, spaced: bool) -> np.ndarray:
        """A row of _PARTS codes for each word (0: none)."""
        coded = words.dictionary_encode()
        units = coded.dictionary
        parts = np.zeros((len(units), _PARTS), dtype=np.int32)
        broken = pc.match_substring_regex(units, _ONE_BREAK)
        at = np.flatnonzero(broken.to_numpy(zero_copy_only=False))
        if len(at):
            sides = pc.split_pattern(units.filter(broken), "\n").flatten()
            heads, tails = (sides.take(pa.array(np.arange(k, len(sides), 2))) for k in (0, 1))
            units = pc.replace_with_mask(units, broken, heads)
            parts[at, 2] = self._codes(pa.array(["\n"], pa.large_string()), False)[0]
            parts[at, 3], parts[at, 4] = self._marked(tails, False)
        parts[:, 0], parts[:, 1] = self._marked(units, spaced)
        return parts[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) as unsigned 32-bit integers, and the number of ids of each."""
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if len(self.sizes) > KNOWN_WORDS:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.or_(pc.match_substring_regex(texts, _ACROSS), pc.match_substring(texts, "<|"))
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        starts, words = np.asarray(cut.offsets)[:-1] - cut.offsets[0].as_py(), cut.flatten()
        later = np.ones(len(words), dtype=bool)
        later[starts] = False
        codes = np.zeros((len(words), _PARTS), dtype=np.int32)
        codes[starts] = self._parts(words.take(pa.array(starts)), False)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            at = self._add_each(texts.take(pa.array(odd)).to_pylist())
            codes[starts[odd]] = 0
            codes[starts[odd], 0] = np.arange(at, at + len(odd))
        if later.any():
            codes[later] = self._parts(words.filter(pa.array(later)), True)
        # Code 0 has no ids.
        held = codes.ravel() > 0
        ids, sizes = self._gather(codes.ravel()[held])
        last = np.cumsum(np.add.reduceat(held, starts * _PARTS, dtype=np.int64))
        before = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(before[last], prepend=0)
