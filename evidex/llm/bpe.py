"""BPE encoding and decoding of item descriptions by tree concatenation.

A long text is cut into halves again and again, wherever the middle falls. The leaves are encoded side by side, and neighbours are joined
as a tree: a window around the join is encoded anew and grows until, away from its own ends and from the cut, it agrees exactly with
the left side and with the right side; what stands between the two agreements is taken from the window.

Inside a leaf, white space splits the text into stretches that any BPE of this family encodes independently (the tokenizer's own
splitting never crosses white space); leaves of Latin-1 characters are split further, by the tokenizer's own pattern. Sides agree in such a
piece if its place and its tokens are equal. Most pieces are words and come from a memo that tasks of a worker share. A piece that is
itself long is a tree again, of tokens: sides then agree in a token away from every cut, as tokens of a BPE code are fixed pair by pair.

Rows are independent: there is no shuffle, and a lost task repeats its own rows only. A task holds one
Arrow batch and a memo that is emptied between batches beyond ``memo_words`` pieces.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.words import BASES, Powers

#: A text, or a piece of one, longer than this is encoded as a tree.
LEAF_CHARS = 4096
#: Characters on each side of a join in its first window.
REACH_CHARS = 48
#: Cuts and window ends distort tokens near them; agreement counts only this far away (longer than any added token).
GUARD_CHARS = 48
MEMO_WORDS = 150_000
_BATCH_WORDS = 1024
#: Characters that are split and looked up at once.
_BATCH_CHARS = 250_000
#: White space as the tokenizer's normalizer sees it; ``str.split`` also splits at four control characters.
_CONTROLS = re.compile(r"[\x1c-\x1f]")
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES, _STRETCH = re.compile(f"[{_BLANK}]+"), re.compile(f"[^{_BLANK}]+")
#: The split pattern that the lean path reproduces (fixed value).
_PATTERN = json.dumps("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
#: Rows that a task reads and hands on at once.
_ROWS = 100
#: A character no word of ordinary text has; it separates words that are encoded in one call.
_MARK = "\x01"


#: Kinds of Latin-1 characters in the split pattern (fixed values): white space, letters, single digits, all others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(9, 14), 32, 0x85, 0xA0]] = 0
_KIND[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_KIND[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
_BYTES = np.random.default_rng(20260103).integers(0, 2**64, 256, dtype=np.uint64)
_HASH = [Powers(b) for b in BASES[:2]]


class _Index:
    """Open addressing over arrays: 128-bit keys to numbers, looked up and filed many at a time; grows before it is half full."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, 0
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros((2, 1 << bits), np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)

    def _grow(self, bits: int) -> None:
        used = np.flatnonzero(self.values >= 0)
        key, check, value = self.keys[0][used], self.keys[1][used], self.values[used]
        self.__init__(bits)
        self.file(key, check, value)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        out, at = np.full(len(key), -1, np.int64), np.arange(len(key))
        slot = (key >> self.shift).astype(np.int64)
        while len(at):
            value = self.values[slot]
            same = (self.keys[0][slot] == key[at]) & (self.keys[1][slot] == check[at]) & (value >= 0)
            out[at[same]] = value[same]
            more = (value >= 0) & ~same
            at, slot = at[more], (slot[more] + 1) & self.mask
        return out

    def file(self, key: np.ndarray, check: np.ndarray, value: np.ndarray) -> None:
        if 2 * (self.held + len(key)) > len(self.values):
            self._grow((2 * (self.held + len(key))).bit_length())
        self.held += len(key)
        at, slot = np.arange(len(key)), (key >> self.shift).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.values[slot] < 0)
            place, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.values[place] = value[at[mine]]
            self.keys[0][place], self.keys[1][place] = key[at[mine]], check[at[mine]]
            left = np.ones(len(at), bool)
            left[mine] = False
            at, slot = at[left], (slot[left] + 1) & self.mask


def stretches(text: str) -> list[str]:
    """The text cut at white space, as the tokenizer understands it."""
    if _CONTROLS.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def _plain_text(text: str) -> bool:
    """Whether the plain split covers it: no character outside Latin-1, and no apostrophe, which may start a contraction."""
    if "'" in text:
        return False
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def halves(length: int, most: int) -> list[int]:
    """Places that cut a length into halves again and again until no part is longer than ``most``."""
    cuts = [0, length]
    while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > most:
        cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
    return cuts


class _Run:
    """The pieces of a span of a text: their numbers, and their places in the whole text where they are known."""

    def __init__(self, start: int, end: int, numbers: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.start, self.end, self.numbers = start, end, numbers
        self.lo, self.hi = (None, None) if lo is None else (lo + start, hi + start)

    def near(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, which) of the pieces of ``a`` to ``b``, which is at one end of the span or all of it."""
        if self.lo is not None:
            i, j = np.searchsorted(self.hi, a, side="right"), np.searchsorted(self.lo, b)
            return list(zip(self.lo[i:j].tolist(), self.hi[i:j].tolist(), range(int(i), int(j)), strict=True))
        spans = [(m.start() + a, m.end() + a) for m in _STRETCH.finditer(text[a:b])]
        first = 0 if a == self.start else len(self.numbers) - len(spans)
        return [(s, e, first + k) for k, (s, e) in enumerate(spans)]

    def between(self, text: str, left: _Run, right: _Run) -> _Run | None:
        """Left and right with this window, around the end of left, laid over them; none if it agrees with one of them nowhere."""
        at = left.end
        mine = self.near(text, self.start, self.end)
        i, first, j, last = 0, 0, len(right.numbers), len(self.numbers)
        if self.start > left.start:
            known = {(s, e): k for s, e, k in left.near(text, self.start, at)}
            same = [(known[s, e], k) for s, e, k in mine if self.start < s and e < at and (s, e) in known and left.numbers[known[s, e]] == self.numbers[k]]
            if not same:
                return None
            i, first = same[-1][0] + 1, same[-1][1] + 1
        if self.end < right.end:
            known = {(s, e): k for s, e, k in right.near(text, at, self.end)}
            same = [(known[s, e], k) for s, e, k in mine if at < s and e < self.end and (s, e) in known and right.numbers[known[s, e]] == self.numbers[k]]
            if not same:
                return None
            j, last = same[0]
        whole = _Run(left.start, right.end, np.concatenate([left.numbers[:i], self.numbers[first:last], right.numbers[j:]]))
        if self.lo is not None:
            whole.lo, whole.hi = (np.concatenate([x[:i], y[first:last], z[j:]]) for x, y, z in ((left.lo, self.lo, right.lo), (left.hi, self.hi, right.hi)))
        return whole


class TreeEncoder:
    """Encodes texts exactly as the tokenizers library does without special tokens; decodes likewise."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, memo_words: int = MEMO_WORDS, batch_chars: int = _BATCH_CHARS):
        # Tasks run side by side already; the library's own threads cost each of them processor time and memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.memo_words, self.batch_chars = memo_words, batch_chars

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf_chars = max(leaf_chars, 4 * GUARD_CHARS)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        mark = self.tokenizer.encode(f"a {_MARK} a", add_special_tokens=False).ids
        self.mark = mark[1] if len(mark) == 3 else None
        self.lean = self._lean()
        self.joins = 0
        self._reset()

    def _lean(self):
        """The same model without normalising and pattern splitting, for text that needs neither; else None."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        if not (_PATTERN in json.dumps(spec["pre_tokenizer"]) and spec["model"].get("end_of_word_suffix") and spec["decoder"] is None):
            return None
        if sorted(n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])) != ["Lowercase", "NFC", "Replace"]:
            return None
        lean = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ends_word = np.array([t is not None and t.endswith(suffix) for t in self.tokens])
        return lean

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.index, self.words = _Index(20), 0
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _remember(self, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Keep words whose ids stand one after the other in ``flat``; their numbers."""
        k, n = self.words, len(count)
        while k + n > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.count[k:k + n] = count
        self.begin[k:k + n] = self.used + np.cumsum(count) - count
        self.flat[self.used:self.used + len(flat)] = flat
        self.used, self.words = self.used + len(flat), k + n
        return np.arange(k, k + n)

    def _learn(self, words: list[str], split: bool) -> np.ndarray:
        """Encode new words, many per call; ``split`` says that they are whole pieces of the pattern. Their numbers."""
        number = np.zeros(len(words), np.int64)
        plain = [k for k, w in enumerate(words) if len(w) <= self.leaf_chars and (split or _MARK not in w and self.mark is not None)]
        for k in set(range(len(words))).difference(plain):
            ids = self.tree(words[k])
            number[k] = self._remember(ids, np.array([len(ids)]))[0]
        groups = [plain[i:i + _BATCH_WORDS] for i in range(0, len(plain), _BATCH_WORDS)]
        tokenizer, joint = (self.lean, " ") if split else (self.tokenizer, f" {_MARK} ")
        for group, encoding in zip(groups, tokenizer.encode_batch_fast([joint.join([words[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, np.uint32)
            if split:
                count = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
            else:
                own = ids != self.mark
                count = np.diff(np.append(np.flatnonzero(~own), len(ids)), prepend=-1) - 1
                ids = ids[own]
            if len(count) != len(group):
                raise ValueError("words encoded together came back as another number of words")
            number[group] = self._remember(ids, count)
        return number

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; a null text is empty."""
        out: list[np.ndarray] = []
        first, held = 0, 0
        for k, text in enumerate(texts):
            held += len(text or "")
            if held >= self.batch_chars:
                out += self._encode(texts[first:k + 1])
                first, held = k + 1, 0
        return out + self._encode(texts[first:])

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.words > self.memo_words:
            self._reset()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain, rest = [], []
        for k, text in enumerate(texts):
            if text:
                slow = self.lean is None or not _plain_text(text) or any(t in text for t in self.special)
                (rest if slow else plain).append(k)
        for chosen, pieces in ((plain, self._plain), (rest, self._rest)):
            if chosen:
                numbers = self._joined([texts[k] for k in chosen], pieces)
                at = np.concatenate(numbers)
                count = self.count[at]
                shift = self.begin[at] - (np.cumsum(count) - count)
                ids = self.flat[np.repeat(shift, count) + np.arange(count.sum())]
                ends = np.append(0, np.cumsum(count))[np.cumsum([len(n) for n in numbers])]
                for k, own in zip(chosen, np.split(ids, ends[:-1]), strict=True):
                    out[k] = own
        return out

    def _joined(self, texts: list[str], pieces) -> list[np.ndarray]:
        """The numbers of the pieces of each text: leaves side by side, then joins, level by level."""
        cuts = [halves(len(t), self.leaf_chars) for t in texts]
        leaves = iter(pieces([t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in zip(c, c[1:], strict=False)]))
        rows = [[_Run(a, b, *next(leaves)) for a, b in zip(c, c[1:], strict=False)] for c in cuts]
        while any(len(r) > 1 for r in rows):
            pairs = [(t, *r[k:k + 2]) for t, r in zip(texts, rows, strict=True) for k in range(0, len(r) - 1, 2)]
            joined = iter(self._pairs(pairs, pieces))
            rows = [[next(joined) if k + 1 < len(r) else r[k] for k in range(0, len(r), 2)] for r in rows]
        return [r[0].numbers for r in rows]

    def _pairs(self, pairs: list[tuple[str, _Run, _Run]], pieces) -> list[_Run]:
        """Neighbours as one run each, by windows that grow until both sides agree."""
        out: list[_Run | None] = [None] * len(pairs)
        open_, reach = list(range(len(pairs))), REACH_CHARS
        while open_:
            spans = [(max(pairs[k][1].start, pairs[k][1].end - reach), min(pairs[k][2].end, pairs[k][1].end + reach)) for k in open_]
            found = pieces([pairs[k][0][a:b] for k, (a, b) in zip(open_, spans, strict=True)])
            for k, (a, b), mid in zip(open_, spans, found, strict=True):
                out[k] = _Run(a, b, *mid).between(*pairs[k])
            self.joins += len(open_)
            open_, reach = [k for k in open_ if out[k] is None], 4 * reach
        return out

    def _plain(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, starts, ends) of the pattern pieces of each text, for Latin-1 texts."""
        whole = "\n".join(texts).encode("latin-1").translate(_LOWER)
        raw = np.frombuffer(whole, np.uint8)
        kind = _KIND[raw]
        edge = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))
        start = np.flatnonzero(edge)
        own = kind[start] != 0
        start, end = start[own], np.append(start[1:], len(raw))[own]
        value = _BYTES[raw]
        key, check = (p.spans(p.prefix(value), start, end) for p in _HASH)
        at = self.index.find(key, check)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            mine = new[first]
            number = self._learn([whole[a:b].decode("latin-1") for a, b in zip(start[mine].tolist(), end[mine].tolist(), strict=True)], True)
            self.index.file(key[mine], check[mine], number)
            at[new] = self.index.find(key[new], check[new])
            if (at < 0).any():
                raise ValueError("two words of one batch share a hash")
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = np.searchsorted(start, first)
        return [(at[i:j], start[i:j] - f, end[i:j] - f) for i, j, f in zip(cut.tolist(), cut[1:].tolist(), first.tolist(), strict=False)]

    def _rest(self, texts: list[str]) -> list[tuple[np.ndarray, None, None]]:
        """The same of the stretches of any text; places are found where they are needed."""
        words = [stretches(t) for t in texts]
        unknown = list(set().union(*words) - self.memo.keys())
        if unknown:
            self.memo.update(zip(unknown, self._learn(unknown, False).tolist(), strict=True))
        return [(np.fromiter(map(self.memo.__getitem__, own), np.int64, len(own)), None, None) for own in words]

    def tree(self, text: str) -> np.ndarray:
        """Ids of one unsplit stretch: leaves side by side, then joins, level by level."""
        cuts = halves(len(text), self.leaf_chars)
        leaves = self.tokenizer.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)
        parts = [_Part(a, b, e) for a, b, e in zip(cuts, cuts[1:], leaves, strict=False)]
        while len(parts) > 1:
            pairs = [self._join(text, *parts[i:i + 2]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[2 * len(pairs):]
        return parts[0].ids.astype(np.uint32)

    def _join(self, text: str, left: _Part, right: _Part) -> _Part:
        at, reach = left.end, 4 * GUARD_CHARS
        while True:
            a, b = max(left.start, at - reach), min(right.end, at + reach)
            mid = _Part(a, b, self.tokenizer.encode(text[a:b], add_special_tokens=False))
            i = 0 if a == left.start else left.agree(mid, a + GUARD_CHARS, at - GUARD_CHARS, last=True)
            j = 0 if b == right.end else right.agree(mid, at + GUARD_CHARS, b - GUARD_CHARS, last=False)
            if i is not None and j is not None:
                head = (0, 0) if a == left.start else i
                tail = (len(right.ids), len(mid.ids)) if b == right.end else j
                return _Part.of(left.start, right.end, [(left, 0, head[0]), (mid, head[1], tail[1]), (right, tail[0], len(right.ids))])
            reach *= 2

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each id sequence, special tokens kept."""
        if self.tokenizer.decoder is None:  # the library then puts one space between tokens
            return [" ".join(map(self.tokens.__getitem__, x.tolist())) for x in ids]
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@functools.cache
def encoder_of(path: str, leaf_chars: int = LEAF_CHARS, memo_words: int = MEMO_WORDS, batch_chars: int = _BATCH_CHARS) -> TreeEncoder:
    """The worker process's own encoder, with the words it has met in earlier tasks."""
    return TreeEncoder(path, leaf_chars, memo_words, batch_chars)


class _Part:
    """Tokens of a span of the text; ``lo`` and ``hi`` are their places in the whole text."""

    def __init__(self, start: int, end: int, encoding=None):
        self.start, self.end = start, end
        if encoding is not None:
            self.ids = np.array(encoding.ids, np.int64)
            spans = np.array(encoding.offsets, np.int64).reshape(-1, 2) + start
            self.lo, self.hi = spans[:, 0], spans[:, 1]

    @classmethod
    def of(cls, start: int, end: int, runs: list[tuple[_Part, int, int]]) -> _Part:
        out = cls(start, end)
        for name in ("ids", "lo", "hi"):
            setattr(out, name, np.concatenate([getattr(p, name)[a:b] for p, a, b in runs]))
        return out

    def agree(self, mid: _Part, lo: int, hi: int, last: bool) -> tuple[int, int] | None:
        """Where a token of this part and one of ``mid`` are equal between two places, if any.

        A character may be spread over several tokens with equal spans; its ordinal tells them apart.
        """
        keys = []
        for part in (self, mid):
            fresh = np.append(True, (part.lo[1:] != part.lo[:-1]) | (part.hi[1:] != part.hi[:-1]))[:len(part.ids)]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
            inside = np.flatnonzero((part.lo >= lo) & (part.hi <= hi))
            keys.append({(int(part.lo[k]), int(part.hi[k]), int(part.ids[k]), int(k - first[k])): int(k) for k in inside})
        shared = keys[0].keys() & keys[1].keys()
        if not shared:
            return None
        best = max(shared) if last else min(shared)
        return keys[0][best], keys[1][best]


def _step(items: DataFrame, columns: list[str], fields: str, make) -> DataFrame:
    """``item_id`` as it is (whole numbers of any size, nulls too) beside what ``make`` gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                made = make(*(part.column(c) for c in columns))
                yield pa.RecordBatch.from_arrays([part.column("item_id"), *made.values()], names=["item_id", *made])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", *columns).mapInArrow(run, f"item_id {kind}, {fields}")


def _ids(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(np.cumsum([0, *(len(x) for x in found)]).astype(np.int32), flat)


def encode_descriptions(items: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``item_id, token_ids``: the ids of every item's whole ``description``, in order.

    One row per input row, repeated rows and null ids included. A null or empty description has an empty
    array. Other columns of ``items`` are not looked at.
    """
    read = items.select("item_id", F.col("description").cast("string"))
    return _step(read, ["description"], "token_ids array<int>", lambda texts: {"token_ids": _ids(encoder_of(tokenizer_path, leaf_chars).encode_batch(texts.to_pylist()))})


def decode_tokens(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``item_id, description``: the text of every ``token_ids`` array; a null array gives an empty text."""

    def make(ids: pa.Array) -> dict[str, pa.Array]:
        return {"description": pa.array(encoder_of(tokenizer_path).decode_batch([np.array(x or [], np.int32) for x in ids.to_pylist()]), pa.string())}

    return _step(encoded, ["token_ids"], "description string", make)


def recode_descriptions(items: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``encode_descriptions`` and ``decode_tokens`` in one pass: ``item_id, token_ids, decoded``.

    Nulls, repeated rows and other columns are treated as there.
    """

    def make(texts: pa.Array) -> dict[str, pa.Array]:
        encoder = encoder_of(tokenizer_path, leaf_chars)
        ids = encoder.encode_batch(texts.to_pylist())
        return {"token_ids": _ids(ids), "decoded": pa.array(encoder.decode_batch(ids), pa.string())}

    return _step(items.select("item_id", F.col("description").cast("string")), ["description"], "token_ids array<int>, decoded string", make)
