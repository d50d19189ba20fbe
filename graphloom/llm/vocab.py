"""Vocabulary files, opened once per Python worker. Their paths are parameters."""

from __future__ import annotations

import base64
import functools
import re

#: Two pieces of text meet at each space that a visible character follows: the
#: pattern of the rank files starts a match there. A text with a space before
#: more white space needs the whole pattern.
SPACE_BEFORE_SPACE = re.compile(r" (?=\s)")


def default_path(name: str) -> str:
    """Where the installed package of public tokenizers has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def json_ids(path: str):
    """A function from text to its ids as little-endian 32-bit bytes, by the
    byte-level BPE of a tokenizers JSON file, without special tokens.

    The ids of what lies between two spaces are kept, up to a fixed number, as
    words recur; the tokenizer itself splits a text at the same places.
    """
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path) as f:
        held = json.load(f)
    splits = held["normalizer"] is None and held["pre_tokenizer"].get("type") == "ByteLevel" and not held["pre_tokenizer"].get("add_prefix_space")
    model = _fast_model(held, path) if splits else None
    four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size() + 1)]

    def whole(text: str) -> bytes:
        ids = model.encode_ordinary(text) if model else tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([four[i] for i in ids])

    # Words cost little here, and their memory stays with the worker.
    return cut_at_spaces(whole, 100_000) if splits else whole


def _fast_model(held: dict, path: str):
    """The same vocabulary and merges in tiktoken's form, if it is one in which
    an id is its merge's rank (tested in tests/llm); else None."""
    import public_tokenizers
    import tiktoken

    places = {**{b: b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    for n, b in enumerate(x for x in range(256) if x not in places):
        places[b] = 256 + n
    back = {chr(c): b for b, c in places.items()}
    special = {x["content"] for x in held["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    merged = [bytes(back[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in held["model"]["merges"]]
    if [ranks.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Most words of a generation whose ids a worker keeps; it has two.
KEPT = 250_000


class Kept(dict):
    """Results of ``work`` for short words. When a generation is full, it
    becomes the old one: what is asked for again moves to the new one, the rest
    goes with the next change."""

    def __init__(self, work, most: int = KEPT, longest: int = 40):
        self.work, self.most, self.longest, self.old = work, most, longest, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.work(word)
            if len(word) > self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


def cut_at_spaces(whole, most: int = KEPT):
    """The function ``whole`` made to work word by word where that's the same."""
    kept = Kept(lambda word: whole(" " + word), most)

    def encode(text: str) -> bytes:
        if SPACE_BEFORE_SPACE.search(text):
            return whole(text)
        first, *words = text.split(" ")
        return whole(first) + b"".join([kept[w] for w in words])

    return encode
