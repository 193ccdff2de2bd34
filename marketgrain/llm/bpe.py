"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The last token of an encoding is enough to extend it: the encoding of a prefix ending in token ``t`` is
the encoding of the prefix without ``t``, followed by ``t``, where ``t`` is the one suffix token that the
merges would leave beside the token before it. Distinct words are sorted, so that words of one trie branch
are neighbours, and the trie is walked a letter deeper at a time for all its branches; every prefix keeps
its last token, so a prefix that many words share is encoded once.

A text is cut at its special tokens, then at single spaces into chunks, and each distinct chunk is cut into
words and encoded once per partition. Only texts in which a space touches other white space are cut into
words as a whole. Rows are independent; nothing is shuffled. Null texts are empty; empty texts have no
tokens. Input columns pass through; ``ids`` and ``decoded`` replace columns of those names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrain.llm.common import by_bytes

# White space of the pre-tokenizer's pattern.
_WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Fixed value: the pre-tokenizer's pattern, its white space spelled out.
_WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
#: Bytes of text encoded together, a longer text alone.
STEP_BYTES = 1 << 18
#: Bytes of encoded chunks kept in a worker, in each of two generations; what is gone is computed anew.
CACHE_BYTES = 8 << 20
#: Bytes of a chunk's two objects and its place in the table, beside its text and ids.
ENTRY_BYTES = 200
#: Bytes of a word beyond which it is walked on its own, and words walked together.
LONG = 48
WALK = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(256, _BASE)]))


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _hash(text: bytes) -> int:
    total = 0
    for byte in text:
        total = (total * int(_BASE) + int(_CODE[byte])) & 0xFFFFFFFFFFFFFFFF
    return total


class Slots:
    """An open hash table from 64-bit keys to numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self._bits = max(4, int(len(keys)).bit_length() + 2)
        self._keys = np.zeros((1 << self._bits) + 64, np.uint64)
        self._values = np.full((1 << self._bits) + 64, -1, np.int64)
        self._reach = 1
        for key, slot, value in zip(keys, self._slot(keys).tolist(), values.tolist()):
            k = 0
            while self._values[slot + k] >= 0:
                k += 1
            self._keys[slot + k], self._values[slot + k] = key, value
            self._reach = max(self._reach, k + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if unknown."""
        slot = self._slot(keys)
        found = np.where(self._keys[slot] == keys, self._values[slot], -1)
        open_ = np.flatnonzero((found < 0) & (self._values[slot] >= 0))
        for k in range(1, self._reach):
            if not len(open_):
                break
            near = slot[open_] + k
            found[open_] = np.where(self._keys[near] == keys[open_], self._values[near], -1)
            open_ = open_[(found[open_] < 0) & (self._values[near] >= 0)]
        return found


class BytePairs:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # tokens are numbered in the order in which merges make them, single bytes first
        made = [*(t for t in vocabulary if len(t) == 1), *(a + b for a, b in pairs)]
        number = {token: k for k, token in enumerate(dict.fromkeys(made))}
        self.ids = [vocabulary[token] for token in number]
        self.bytes = [as_bytes(token) for token in number]
        self.number = {text: k for k, text in enumerate(self.bytes)}
        self.lengths = [len(b) for b in self.bytes]
        self.longest = max(self.lengths)
        self.left, self.right = list(range(len(number))), list(range(len(number)))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            whole, left, right = number[a + b], number[a], number[b]
            if (left, right) not in self.merged:
                self.merged[left, right] = whole
            if self.left[whole] == whole:
                self.left[whole], self.right[whole] = left, right
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.text = {vocabulary[token]: b for token, b in zip(number, self.bytes)}
        self.text |= {k: token.encode() for token, k in self.special.items()}
        size = max(self.text) + 1
        self._sizes = np.zeros(size, np.int64)
        self._sizes[list(self.text)] = [len(b) for b in self.text.values()]
        self._bytes = np.frombuffer(b"".join(self.text.get(k, b"") for k in range(size)), np.uint8)
        self._firsts = np.cumsum(self._sizes) - self._sizes
        self._id_array = np.array(self.ids, np.int32)
        self._length_array = np.array(self.lengths, np.int64)
        self._sides = np.array([self.left, self.right], np.int64)
        self._token_at = Slots(np.array([_hash(t) for t in self.bytes], np.uint64), np.arange(len(self.bytes)))
        merged = np.array([a * len(self.ids) + b for a, b in self.merged], np.uint64)
        self._merge_at = Slots(merged, np.array(list(self.merged.values())))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0

    def _beside(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side.

        Undo the merges of both tokens, latest first. At every stage the two pieces that touch must not
        have a merge that comes before the next one to be redone.
        """
        bound = len(self.ids)
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and whole < bound:
                return False
            whole_a, whole_b = self.left[a] != a, self.left[b] != b
            if whole_a and (a > b or not whole_b):
                bound, a = a, self.right[a]
            elif whole_b:
                bound, b = b + 1, self.left[b]
            else:
                return True

    def _all_beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_beside`` for arrays of tokens."""
        left, right = self._sides
        size = len(self.ids)
        answer, at, bound = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), size)
        while len(at):
            whole = self._merge_at.find((a * size + b).astype(np.uint64))
            on = (whole < 0) | (whole >= bound)
            whole_a, whole_b = left[a] != a, left[b] != b
            answer[at[on & ~whole_a & ~whole_b]] = True
            on &= whole_a | whole_b
            undo_a = whole_a & ((a > b) | ~whole_b)
            bound = np.where(undo_a, a, b + 1)[on]
            a, b = np.where(undo_a, right[a], a)[on], np.where(undo_a, b, left[b])[on]
            at = at[on]
        return answer

    def _walk(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of sorted words: every prefix of the trie gets its last token, one letter at a time."""
        sizes = np.array([len(w) for w in words])
        width, count = int(sizes.max()), len(words)
        letters = np.array(words, f"S{width}").view(np.uint8).reshape(count, width)
        equal = (letters[1:] == letters[:-1]) & (np.arange(width) < np.minimum(sizes[1:], sizes[:-1])[:, None])
        shared = np.concatenate([[0], np.where(equal.all(axis=1), width, equal.argmin(axis=1))])
        hashes = np.zeros((width + 1, count), np.uint64)
        for end in range(width):
            hashes[end + 1] = hashes[end] * _BASE + _CODE[letters[:, end]]
        last = np.zeros((width + 1, count), np.int64)
        for end in range(1, width + 1):
            new = (sizes >= end) & (shared < end)
            here = np.flatnonzero(new)
            for size in range(min(end, self.longest), 0, -1):
                if not len(here):
                    break
                token = self._token_at.find(hashes[end][here] - hashes[end - size][here] * _POWERS[size])
                known = np.flatnonzero(token >= 0)
                if size < end:
                    known = known[self._all_beside(last[end - size][here[known]], token[known])]
                last[end][here[known]] = token[known]
                here = np.delete(here, known)
            last[end] = last[end][np.maximum.accumulate(np.where(new, np.arange(count), 0))]
        steps, at, end = [], np.arange(count), sizes.copy()
        while len(at):
            token = last[end[at], at]
            steps.append((at, token))
            end[at] -= self._length_array[token]
            at = at[end[at] > 0]
        order = np.concatenate([at for at, _ in steps])
        depth = np.concatenate([np.full(len(at), -k) for k, (at, _) in enumerate(steps)])
        flat = self._id_array[np.concatenate([t for _, t in steps])[np.lexsort((depth, order))]].tobytes()
        ends = np.cumsum(np.bincount(order, minlength=count)) * 4
        return {w: flat[a:b] for w, a, b in zip(words, [0, *ends.tolist()], ends.tolist())}

    def _walk_long(self, word: bytes) -> bytes:
        last: list[int] = []
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.number.get(word[start:end])
                if token is not None and (not start or self._beside(last[start - 1], token)):
                    last.append(token)
                    break
        tokens, end = [], len(word)
        while end:
            tokens.append(last[end - 1])
            end -= self.lengths[tokens[-1]]
        return self._id_array[tokens[::-1]].tobytes()

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct word as 32-bit numbers."""
        distinct = set(words)
        long = {w for w in distinct if len(w) > LONG}
        encoded = {w: self._walk_long(w) for w in long}
        short = sorted(distinct - long)
        for at in range(0, len(short), WALK):
            encoded |= self._walk(short[at : at + WALK])
        return encoded

    def _keys(self, text: str) -> list[str]:
        """The text as pieces whose words don't reach into their neighbours.

        A key without a leading space stands for a space and the key, another for what follows its first space.
        """
        keys = []
        for part in self.cut.split(text) if self.special else (text,):
            if part in self.special:
                keys.append(" " + part)
                continue
            chunks = part.split(" ")
            if "" in chunks[1:-1] or list(map(str.strip, chunks)) != chunks:
                keys += [w[1:] if w[0] == " " and " " not in w[1:] else " " + w for w in _WORD.findall(part)]
            else:
                if chunks[0]:
                    keys.append(" " + chunks[0])
                keys += chunks[1:]
        return keys

    def _encode_keys(self, keys: set[str]) -> dict[str, bytes]:
        plain = {key: b" " + key.encode() for key in keys if key.isalpha()}
        mixed = {k: _WORD.findall(k[1:] if k[:1] == " " else " " + k) for k in keys if k not in plain}
        mixed = {key: [w.encode() for w in words] for key, words in mixed.items()}
        words = self.encode_words([*plain.values(), *chain.from_iterable(mixed.values())])
        encoded = {key: words[word] for key, word in plain.items()}
        encoded |= {key: b"".join([words[w] for w in parts]) for key, parts in mixed.items()}
        return encoded | {" " + token: np.int32(k).tobytes() for token, k in self.special.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        if self.young_bytes > CACHE_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        known, old = self.young, self.old
        rows = [self._keys(text) for text in texts]
        found = [list(map(known.get, row)) for row in rows]
        unknown = [k for k, ids in enumerate(found) if None in ids]
        fresh = {key for k in unknown for key, ids in zip(rows[k], found[k]) if ids is None}
        again = {key: old[key] for key in fresh if key in old}
        known.update(again)
        known.update(self._encode_keys(fresh - again.keys()))
        self.young_bytes += sum(ENTRY_BYTES + len(key) + len(known[key]) for key in fresh)
        for k in unknown:
            found[k] = list(map(known.__getitem__, rows[k]))
        return list(map(b"".join, found))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self._firsts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self._bytes[places].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    return BytePairs(path)


def _coded_rows(path: str, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for part in (part for whole in batches for part in by_bytes(whole, "text", STEP_BYTES)):
            for at in range(0, part.num_rows, rows):
                batch = part.slice(at, rows)
                coded = model.encode([text or "" for text in batch["text"].to_pylist()])
                flat = np.frombuffer(b"".join(coded), np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(row) // 4 for row in coded])]).astype(np.int32)
                decoded = pa.array([model.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                kept = [n for n in batch.schema.names if n not in ("ids", "decoded")]
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), lists, decoded], [*kept, "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, path: str, rows: int = 512) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded``; at most ``rows`` texts, of ``STEP_BYTES``, share one trie.

    Columns named ``ids`` or ``decoded`` are replaced, the others pass through under any name. Repeated rows are
    coded each, a null text as an empty one; an empty table gives an empty table.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    names = [f.name if f.name == "text" else f"given_{k}" for k, f in enumerate(kept)]  # names with dots can't be passed
    given = docs.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names)])
    schema = T.StructType([T.StructField(n, f.dataType) for f, n in zip(kept, names)])
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return given.mapInArrow(_coded_rows(path, rows), schema).toDF(*[f.name for f in kept], "ids", "decoded")
