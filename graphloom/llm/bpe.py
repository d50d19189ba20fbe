"""Byte-level BPE as finite-state machines.

**Encoding.** A rank file's merges define, for each pair of tokens, whether
they can stand side by side: when merging their joined bytes gives the two
tokens back. A sequence of tokens is the encoding of its bytes exactly when
all neighbours can. So an encoder can read bytes from left to right and hold,
for each place where a token may have ended, the one valid way to get there:
a nondeterministic transducer whose configurations are pairs (last token, node
of the trie of tokens that the open bytes have reached). ``Transducer``
determinises it lazily: a state is the sequence of nodes of the live
configurations, and a step by a byte is computed when it is first taken and then
kept, with what it does to the tokens that each configuration holds back. Last
tokens are no part of a state, as there would be nearly as many states as words:
a step that may end a token has an outcome for each token that may end there,
and the last tokens, by a table of pairs that is filled as it is asked, choose
the one valid outcome. When all live configurations come from one, its tokens
are certain and are emitted; no configuration has more open bytes than the
longest token, which bounds the lookahead.

**Decoding.** ``Decoder`` turns ids into text piece by piece with an
incremental UTF-8 automaton: its state is the bytes of the character that is
still open, and steps by a token are computed once per state and kept.

Defined results: null text counts as empty; empty texts have no ids; ids
outside the vocabulary raise KeyError.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.shared import PRIVATE, filled
from graphloom.llm.vocab import Kept, cut_at_spaces, read_ranks

#: Ids decoded at a time.
STRETCH = 8192

#: Texts of these characters only are split by ``NEAR``, which is faster and the
#: same there: of the numbers and white space on which libraries differ, it
#: leaves out all but ASCII ones.
PLAIN = re.compile(r"[\x00-\x08\t\n\x0b\x0c\r\x0e-\x1b\x20-\x7e\xc0-ɏ]*\Z")
NEAR = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """A piece's tokens by repeated merging of the lowest rank (of ranks less
    than ``below``): the definition."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Bytes to tokens of a rank file, determinised as far as inputs ask for."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000, most_borders: int = 1_000_000):
        self.ranks, self.most_states, self.most_borders = ranks, most_states, most_borders
        # A trie: child[node << 8 | byte]; node 0 is the empty prefix.
        self.child: dict[int, int] = {}
        self.inner: list[bool] = [False]
        self.token: list[int] = [-1]
        self.bytes_of: dict[int, bytes] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token)
                    self.inner.append(False)
                    self.token.append(-1)
                node = nxt
            self.token[node] = rank
            self.bytes_of[rank] = token
        #: Two tokens as one number: left * size + right.
        self.size = max(ranks.values()) + 1
        self.joined = {ranks[t[:i]] * self.size + ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.borders: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[int, ...]] = []
        # By state << 8 | byte: what happens if no token ends, and for each
        # token that may end here its configuration, itself, what happens then.
        self.moves: dict[int, tuple[tuple, list[tuple]]] = {}
        self._number((0,))

    def _number(self, state: tuple[int, ...]) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token last; None for single bytes
        and for tokens that merging never makes."""
        if token not in self.parts:
            held = self.bytes_of[token]
            low = {}
            if len(held) > 1:
                low = merged(held, self.ranks, below=token)
            self.parts[token] = (self.ranks[low[0]], self.ranks[low[1]]) if len(low) == 2 else None
        return self.parts[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens can be neighbours (``left`` -1: at the start).

        Merging happens in the order of ranks. Back from the finished tokens,
        the later made of the two at the border is taken apart again; they
        can't be neighbours if a pair at the border would have merged before
        the border's tokens became part of longer ones. Of equal ranks the
        left one merges first.
        """
        if left < 0:
            return True
        never = 1 << 60
        x, y, x_until, y_until = left, right, never, never
        while True:
            rank = self.joined.get(x * self.size + y, never)
            if rank < x_until and rank <= y_until and rank < never:
                return False
            a, b = self.halves(x), self.halves(y)
            if a is None and b is None:
                return True
            if b is None or a is not None and x > y:
                x, x_until = a[1], x
            else:
                y, y_until = b[0], y

    def _border(self, key: int) -> bool:
        if len(self.borders) >= self.most_borders:
            self.borders.clear()
        left = key // self.size
        found = self.borders[key] = self.may_follow(left, key - left * self.size)
        return found

    def _move(self, number: int, byte: int) -> tuple[tuple, list[tuple]]:
        """The step from a state by a byte: an outcome without a token's end,
        and one for each token that may end here. An outcome is the next state,
        the configurations that go on (None: all of them) and the one that all
        come from, or -1."""
        on, nodes, ends = [], [], []
        before = self.states[number]
        for i, node in enumerate(before):
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            if self.inner[nxt]:
                on.append(i)
                nodes.append(nxt)
            token = self.token[nxt]
            if token >= 0 and (len(self.bytes_of[token]) == 1 or self.halves(token)):
                ends.append((i, token))
        all_on = len(on) == len(before)
        go = tuple(on)

        def outcome(end: tuple, sources: set[int]) -> tuple[int, tuple[int, ...] | None, int]:
            certain = min(sources) if len(sources) == 1 and (end or len(before) > 1) else -1
            return self._number((*nodes, *end)), None if all_on else go, certain

        found = self.moves[number << 8 | byte] = outcome((), set(on)), [(i, token, outcome((0,), {*on, i})) for i, token in ends]
        return found

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self._restart()
        out: list[int] = []
        # What each configuration holds back, as (earlier, token); the innermost
        # is the last token that is out already, -1 at the start.
        held: list[tuple] = [(None, -1)]
        state, moves, borders, size = 0, self.moves, self.borders, self.size
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            outcome, ends = move
            new = None
            # There is one valid way to have a token end here.
            for i, token, ended in ends:
                cell = held[i]
                key = cell[1] * size + token
                ok = borders.get(key)
                if ok or ok is None and self._border(key):
                    outcome, new = ended, (cell, token)
                    break
            state, on, certain = outcome
            if certain >= 0 and held[certain][0] is not None:
                out += _unwound(held[certain])
                held[certain] = base = None, held[certain][1]
                if new:
                    new = base, new[1]
            if on is not None:
                held = [held[i] for i in on]
            if new:
                held.append(new)
        out += _unwound(held[-1])
        return out


def _unwound(cell: tuple) -> list[int]:
    tokens = []
    while cell[0] is not None:
        cell, token = cell
        tokens.append(token)
    tokens.reverse()
    return tokens


class Decoder:
    """Ids to text, incrementally; bytes that are no UTF-8 become U+FFFD."""

    class State(dict):
        """What has been read of an open character; by id, the next state and
        the text that is whole with it."""

        def __init__(self, decoder: Decoder, held: bytes):
            self.decoder, self.held = decoder, held

        def __missing__(self, i: int) -> tuple[Decoder.State, str]:
            data = self.held + self.decoder.tokens[i]
            whole = len(data) - self.decoder.open_tail(data)
            found = self[i] = self.decoder.state(data[whole:]), data[:whole].decode("utf-8", "replace")
            return found

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.states = tokens, {}

    def state(self, held: bytes) -> State:
        if held not in self.states:
            self.states[held] = self.State(self, held)
        return self.states[held]

    @staticmethod
    def open_tail(held: bytes) -> int:
        """How many bytes at the end begin a character that more bytes may end."""
        for back in range(1, min(3, len(held)) + 1):
            byte = held[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 0
                if need <= back:
                    return 0
                # The second byte's range rules out overlong forms, surrogates and what lies beyond U+10FFFF.
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                return back if back == 1 or low <= held[-back + 1] <= high else 0
        return 0

    def feed(self, state: State, ids: Iterable[int]) -> tuple[State, str]:
        """The next stretch of a stream: the state after it and the text of all
        characters that are whole by then."""
        out = []
        for i in ids:
            state, text = state[i]
            out.append(text)
        return state, "".join(out)

    def decode(self, stretches: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of a stream of stretches of ids, as it becomes whole."""
        state = self.state(b"")
        for ids in stretches:
            state, text = self.feed(state, ids)
            yield text
        if state.held:
            yield state.held.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str):
    """Per worker: (text to ids as little-endian 32-bit bytes, decoder, tokens)."""
    import regex

    ranks = read_ranks(path)
    machine = Transducer(ranks)
    split = regex.compile(pattern).findall
    same = pattern == _known_pattern()
    four = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}

    def coded(piece: str) -> bytes:
        return b"".join([four[i] for i in machine.encode(piece.encode("utf-8"))])

    kept = Kept(coded)

    def whole(text: str) -> bytes:
        pieces = NEAR.findall(text) if same and PLAIN.match(text) else split(text)
        # A word of one piece is kept as a word.
        return coded(pieces[0]) if len(pieces) == 1 else b"".join([kept[p] for p in pieces])

    tokens = {rank: token for token, rank in ranks.items()}
    return (cut_at_spaces(whole) if same else whole), Decoder(tokens), tokens


def _known_pattern() -> str:
    """The pattern for which ``NEAR`` and cutting at spaces are the same."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids: id, n_tokens, ids_sha256 (of ids as
    little-endian 32-bit integers) and decoded_sha256 (of the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decoder, _ = coder(path, pattern)
        for batch in batches:
            number, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                held = encode(text.as_py())
                number.append(len(held) // 4)
                ids_sha.append(hashlib.sha256(held).hexdigest())
                out = hashlib.sha256()
                ids = np.frombuffer(held, "<u4")
                for piece in decoder.decode(ids[at : at + STRETCH].tolist() for at in range(0, len(ids), STRETCH)):
                    out.update(piece.encode("utf-8"))
                text_sha.append(out.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_col, filled(text_col).alias(PRIVATE + "text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
