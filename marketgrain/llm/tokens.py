"""Token ids of a byte-pair vocabulary, from tiktoken's rank file or a tokenizers file of the same kind."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex
import tiktoken

# Fixed value: how the public vocabularies cut texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space from this length on don't go through the pattern, whose look-ahead tries them again and again.
LONG_SPACE = 4096


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The id of every token's bytes; special tokens are left out. A merge comes earlier the smaller its id."""
    if not path.endswith(".json"):
        with open(path, "rb") as file:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    special = {token["content"] for token in given["added_tokens"]}
    value = _byte_values()
    return {bytes(map(value.__getitem__, t)): i for t, i in given["model"]["vocab"].items() if t not in special}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a vocabulary; strings of special tokens are ordinary text."""
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def encode(path: str) -> Callable[[str], list[int]]:
    """The ids of any text, however long its runs of white space.

    The last white space of a run before a word belongs to that word's side; the rest of the run is one word
    of the pattern. A long run is therefore cut there and encoded as the one word it is.
    """
    words = encoding(path).encode_ordinary

    def run(text: str) -> list[int]:
        parts = list(_parts(text))
        if len(parts) == 1:
            return words(text)
        return [k for part, is_space in parts for k in (_run_encoding(path) if is_space else encoding(path)).encode_ordinary(part)]

    return run


def encode_array(path: str, text: str) -> np.ndarray:
    """``encode`` as an array of 32-bit numbers, without a Python number per id."""
    found = [
        (_run_encoding(path) if is_space else encoding(path)).encode_to_numpy(part, disallowed_special=())
        for part, is_space in _parts(text)
    ]
    return (found[0] if len(found) == 1 else np.concatenate(found)).astype(np.int32)


@lru_cache(maxsize=4)
def _run_encoding(path: str) -> tiktoken.Encoding:
    """Takes a whole text for one word."""
    return tiktoken.Encoding("run", pat_str="(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _long_space(least: int) -> regex.Pattern:
    return regex.compile(rf"(?<!\p{{White_Space}})\p{{White_Space}}{{{least},}}")


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut around its long runs of white space; true for such a run."""
    at = 0
    if len(text) >= LONG_SPACE:
        for space in _long_space(LONG_SPACE).finditer(text):
            end = space.end() - (space.end() < len(text))
            if space.start() > at:
                yield text[at : space.start()], False
            yield text[space.start() : end], True
            at = end
    if at < len(text) or not at:
        yield text[at:], False
