"""Token ids by a public tokenizer file, with a bounded memory of whitespace-delimited chunks.

A text is cut where its tokenization cannot span: before a single space that
stands between two other characters.  Signs at a word's end are a chunk of their own.
Arrow cuts many texts at once and finds their distinct chunks.  Each goes through the tokenizers library
once while it is remembered; texts are then gathered from the remembered ids with numpy.  The result
equals that of encoding whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks after which a worker begins its memory anew, after one more slice of text at most.
REMEMBERED = 1_000_000
#: Characters of texts, and rows of a batch, taken at a time; longer texts are taken in slices of so many characters.
TOGETHER = 4_000_000
SLICE_ROWS = 2_000
SLICE = 500_000

#: Chunks that stay when the memory begins anew: the first ones, as frequent ones come up early.
KEPT = 200_000

_INNER = re.compile(r"(?<=\S) (?=\S)")
#: Letters that every Unicode version since 7.0 knows, but for the dotted capital I: lower case turns it into a letter and a combining mark.
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}\x{400}-\x{481}\x{48a}-\x{52f}"
#: Signs, apostrophes not among them, after a letter or digit at a word's end, which are a pre-token of their own.  Arrow's syntax.
_TAIL = rf"([{_LETTERS}0-9])([!#$%&*+,./:;=?@^~)\]}}-]+)( |\n|$)"
#: Space other than single spaces and line breaks between other characters.
_RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_PAIRS = ["  ", " \n", "\n ", "\n\n"]
#: Words that any pre-tokenizer by letters or by digits leaves whole.
_WHOLE = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f]+|[0-9]+")
#: How byte-level models write bytes: as the printable character of that number, others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip(sorted(set(range(256)).difference(_PRINTED)), range(256, 512), strict=False))
#: Marks before a chunk's name: at the start of a line, signs at a word's end, with space inside; and what stands between names.
_START, _SIGN, _WIDE, _BREAK = "\n", "\x01", "\x02", "\x03"


class IdTable:
    """Names and the positions of their ids, which lie in one growing array; the first name is empty and has none."""

    def __init__(self) -> None:
        self.names = pa.array([""])
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1, np.int64)
        self.lens = np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def places(self, names: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each of some distinct names is, and those that are new, which come last in the table."""
        at = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().copy()
        fresh = at < 0
        new = names.filter(pa.array(fresh))
        at[fresh] = len(self) + np.arange(len(new))
        if len(new):
            self.names = pa.concat_arrays([self.names, new])
            more = np.zeros(len(new), np.int64)
            self.starts, self.lens = np.append(self.starts, more), np.append(self.lens, more)
        return at, new

    def fill(self, which: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """The ids of the entries ``which`` in a row."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[which], self.lens[which] = self.used + np.cumsum(lens) - lens, lens
        self.used += len(ids)

    def first(self, n: int) -> IdTable:
        """A table of the first ``n`` entries."""
        out = IdTable()
        out.places(pa.array(self.names[1:n].to_pylist(), pa.string()))  # a copy, so that the others' memory is given back
        ids, lens = self.gather(np.arange(len(out)))
        out.fill(np.arange(len(out)), ids, lens)
        return out

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries ``at`` in a row, and how many each has."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        where = np.repeat(self.starts[at] - ends + lens, lens)
        where += np.arange(len(where))
        return self.flat[where], lens


def _plain_bytes(file: dict) -> bool:
    """Whether a tokenizer file takes bytes as they are, cut by letters, digits and signs with the space before them, into a model without chance."""
    cut = file.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    model = file["model"]
    return bool(plain and file.get("normalizer") is None and file.get("truncation") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix"))


#: The steps of a tokenizer file after which a word of letters is one pre-token in lower case.
_LOWERING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_LETTERWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _lowered_bytes(file: dict) -> bool:
    """Whether a tokenizer file takes words of letters in lower case and as bytes, each with an end mark, into a model without chance."""
    cut = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    letters = cut[0].get("pattern") == {"Regex": _LETTERWISE} and cut[0].get("behavior") == "Removed" and cut[0].get("invert")
    plain = len(cut) == 2 and cut[1].get("type") == "ByteLevel" and not cut[1].get("use_regex") and not cut[1].get("add_prefix_space")
    model = file["model"]
    same = (file.get("normalizer") or {}).get("normalizers") == _LOWERING and file.get("truncation") is None
    return bool(letters and plain and same and model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix"))


class ChunkEncoder:
    """Encodes texts to arrays of ids.

    A chunk is named by its word, which may stand for the word with the space
    before it; other chunks have a mark before their name.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The library looks for these before anything else, so texts that hold one are encoded as a whole.
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.signs = {s[0] for s in special} | {s[0].swapcase() for s in special}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab = model["vocab"]
        #: True: the model may be asked for words that are one pre-token, without normalizer and pre-tokenizer.
        self.by_model = _plain_bytes(whole)
        #: The same for words of letters in lower case.
        self.by_lower = _lowered_bytes(whole)
        self.model = self.tokenizer.model
        self.size = max(vocab.values()) + 1
        suffix = model.get("end_of_word_suffix")
        #: True: a space belongs to the word after it; False: spaces are dropped and words end with a mark.
        self.leading = not suffix
        self.border = np.zeros(max(self.size, self.tokenizer.get_vocab_size()) + 1, bool)
        for token, k in vocab.items():
            self.border[k] = token.endswith(suffix) if suffix else token.startswith("Ġ")
        self.line_break = self._encode("\n")[0] if self.leading else -1
        self.known = IdTable()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _each(self, which: list[int], texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.known.fill(np.array(which), np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found]))

    def _whole(self, which: list[int], words: list[str], before: str) -> None:
        """Words of one pre-token each, with ``before`` written before them."""
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(before + (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)))] for w in words]
        self.known.fill(np.array(which), np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found]))

    def _joined(self, which: list[int], words: list[str], by_line: bool = False) -> None:
        """Many words without space inside at once, told apart by their border tokens or by line breaks."""
        for at in range(0, len(words), 2000):
            part, places = words[at : at + 2000], which[at : at + 2000]
            joint = "\n" if by_line else " "
            text = joint.join(part)
            ids = self._encode(text if by_line or not self.leading else f" {text}")
            if by_line:
                ends = np.append(np.flatnonzero(ids == self.line_break), len(ids))
                begins = np.append(0, ends[:-1] + 1)
            else:
                cuts = np.flatnonzero(self.border[ids])
                begins, ends = (cuts, np.append(cuts[1:], len(ids))) if self.leading else (np.insert(cuts[:-1] + 1, 0, 0), cuts + 1)
            if len(begins) == len(part) and begins[0] == 0 and ends[-1] == len(ids):
                keep = ids != self.line_break if by_line else slice(None)
                self.known.fill(np.array(places), ids[keep], ends - begins)
            else:
                self._each(places, [f" {w}" for w in part] if self.leading and not by_line else part)

    def _learn(self, new: list[str]) -> None:
        """Encodes new chunks, the last ones of the table."""
        begin = len(self.known) - len(new)
        plain = [k for k, c in enumerate(new) if c[0] not in "\n\x01\x02"] if self.leading else [k for k, c in enumerate(new) if c.isalpha()]
        others = set(range(len(new))).difference(plain)
        starts = [k for k in others if self.leading and new[k][0] == _START and new[k][1:].split() == [new[k][1:]]]
        others = sorted(others.difference(starts))
        if self.by_model:
            for some, skipped, before in ((plain, 0, "Ġ"), (starts, 1, "")):
                whole = [k for k in some if _WHOLE.fullmatch(new[k], skipped)]
                if whole:
                    self._whole([begin + k for k in whole], [new[k][skipped:] for k in whole], before)
                    some[:] = sorted(set(some).difference(whole))
        if self.by_lower:
            whole = [k for k in plain if _WHOLE.fullmatch(new[k]) and "İ" not in new[k]]
            if whole:
                self._whole([begin + k for k in whole], [new[k].lower() for k in whole], "")
                plain = sorted(set(plain).difference(whole))
        if plain:
            self._joined([begin + k for k in plain], [new[k] for k in plain])
        if starts:
            self._joined([begin + k for k in starts], [new[k][1:] for k in starts], by_line=True)
        if others:
            named = {_START: "", _SIGN: "", _WIDE: " " if self.leading else ""}
            texts = [c if c == "\n" or c[0] not in named else named[c[0]] + c[1:] for c in map(new.__getitem__, others)]
            self._each([begin + k for k in others], texts)

    def _spaced(self, text: str) -> list[str]:
        """Names of the chunks of a text with any space."""
        words = [w if w.split() == [w] else f"{_WIDE}{w}" for w in _INNER.split(text)]
        if self.leading:
            words[0] = f"{_START}{words[0].removeprefix(_WIDE)}"
        return words

    def _named(self, texts: list[str]) -> pa.Array:
        """Names of the chunks of each text, which holds none of the marks but line breaks, with ``_BREAK`` between them."""
        plain = np.array([t != "" and not t[0].isspace() and not t[-1].isspace() and not any(p in t for p in _PAIRS) and not any(c in t for c in _RARE) for t in texts], bool)
        found = pc.replace_substring_regex(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string()), _TAIL, rf"\1 {_SIGN}\2\3")
        found = pc.replace_substring(found, "\n", f"{_BREAK}\n{_BREAK}{_START}" if self.leading else _BREAK)
        found = pc.replace_substring(found, " ", _BREAK)
        if self.leading:
            found = pc.binary_join_element_wise(_START, found, "")
        if plain.all():
            return found
        others = [_BREAK.join(self._spaced(t)) if t else "" for t, p in zip(texts, plain, strict=True) if not p]
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        return pa.concat_arrays([found, pa.array(others, pa.string())]).take(pa.array(order))

    def _gather(self, named: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, given as names of chunks, and how many each has."""
        if len(self.known) > REMEMBERED:
            self.known = self.known.first(KEPT)
        lists = pc.split_pattern(named, _BREAK)
        each = lists.flatten().dictionary_encode()
        at, new = self.known.places(each.dictionary)
        if len(new):
            self._learn(new.to_pylist())
        ids, lens = self.known.gather(at[each.indices.to_numpy()])
        edges = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        return ids, np.diff(edges[np.concatenate([[0], ends])])

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        group: list[str] = []
        held = 0

        def flush() -> Iterator[np.ndarray]:
            ids, counts = self._gather(self._named(group))
            yield from np.split(ids, np.cumsum(counts)[:-1])

        for text in texts:
            text = text or ""
            # a text is normalized as a whole first
            if (not self.leading and not unicodedata.is_normalized("NFC", text)) or (any(s in text for s in self.signs) and self.special.search(text)) or _SIGN in text or _WIDE in text or _BREAK in text:
                if group:
                    yield from flush()
                    group, held = [], 0
                yield self._encode(text)
                continue
            if len(text) > SLICE:
                if group:
                    yield from flush()
                    group, held = [], 0
                yield self._long(text)
                continue
            group.append(text)
            held += len(text)
            if held > TOGETHER:
                yield from flush()
                group, held = [], 0
        if group:
            yield from flush()

    def _long(self, text: str) -> np.ndarray:
        """A very long text, in slices that end before an inner space."""
        found, at = [], 0
        while at < len(text):
            cut = _INNER.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            part = text[at + 1 if at else 0 : end]  # a later slice begins with its inner space
            parts = self._named([part])[0].as_py().split(_BREAK)
            if at and self.leading:
                word = parts[0][1:]
                parts[0] = word if word.split() == [word] else f"{_WIDE}{word}"
            found.append(self._gather(pa.array([_BREAK.join(parts)]))[0])
            at = end
        return np.concatenate(found)


@lru_cache(maxsize=1)
def encoder_for(path: str) -> ChunkEncoder:
    """One encoder for all tasks that this worker runs, so that chunks stay remembered."""
    return ChunkEncoder(path)


def public_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
