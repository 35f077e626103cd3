"""Byte-level BPE as a lazily determinised finite-state transducer.

Which token ends at a byte is decided by the bytes up to it alone: a chain of tokens is the encoding of its bytes
exactly if each two neighbours are the encoding of theirs. So the transducer reads bytes from left to right; its state
is the token emitted last and the bytes not yet emitted. For each place in those bytes it knows the one token that ends
there. As soon as every way on shares its first token, that token is emitted, which bounds the bytes a state holds.
States and transitions are made when they are needed a second time and kept; beyond a number of them the machine starts
over. What is met for the first time, as the end of most rare words is, goes on without them: an automaton over the
tokens' beginnings, made as lazily, names the tokens that end at a byte, longest first.
"""

from __future__ import annotations

import base64
import gc
import json
import re
import sys
from array import array
from functools import cache
from pathlib import Path

import numpy as np
import regex

#: Unicode White_Space, as character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: What makes a text unfit for the standard library's classes.
_UNSURE = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\x00-\u024f]")
#: States that a machine keeps before it starts over.
MEMO_STATES = 100_000
#: Pieces of text whose tokens are remembered.
MEMO_PIECES = 800_000

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """Tokens and ranks from a ``.tiktoken`` file, or from a byte-level BPE ``.json``, where merge order is rank.

    A ``.json`` whose ids differ from its merge order is refused, as ids would then not be ranks.
    """
    if not path.endswith(".json"):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        return {base64.b64decode(token): int(rank) for token, rank in lines}
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    letters = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    order = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
    if order != sorted(order):
        raise ValueError("token ids do not follow the order of the merges")
    return ranks


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a ``.json`` vocabulary: itself, or one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_NEVER = 1 << 60
_BYTES = [bytes([b]) for b in range(256)]


def merge_by_rank(text: bytes, ranks: Ranks, below: int = _NEVER) -> list[int]:
    """The definition: join the neighbours of the lowest rank (under ``below``), leftmost first, until none is a token."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        joined = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        best = min(joined)
        if best >= below:
            break
        i = joined.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes bytes; ``feed`` and ``finish`` take them as they come."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.token_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self._whole: dict[int, bool] = {}
        self._grown: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._node_of: dict[bytes, int] = {}
        self._nodes: list[bytes] = []
        #: By node: sizes and numbers of the tokens that end there, longest first; and the node after a byte.
        self._endings: list[tuple[tuple[int, int], ...]] = []
        self._goto: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._once: set[int] = set()
        #: By number: the token emitted last (-1: none), the pending bytes, the token that ends at each place of them, the
        #: size of the first token on the way there, the places where a longer token may have begun, and steps by byte.
        self.states: list[tuple] = []
        self._number: dict[tuple[int, bytes], int] = {}
        self.state(-1, b"", (), (), [0])

    def state(self, last: int, pending: bytes, ends: tuple, firsts: tuple, open_: list[int]) -> int:
        number = self._number.get((last, pending))
        if number is None:
            number = self._number[last, pending] = len(self.states)
            self.states.append((last, pending, ends, firsts, open_, {}))
        return number

    def _edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """How a token grows by its merges, seen from its last and from its first byte: what stands there, and the rank
        of the merge that ends it."""
        known = self._grown.get(token)
        if known is not None:
            return known
        text = self.token_of[token]
        if len(text) == 1:
            out = ([(text, _NEVER)], [(text, _NEVER)])
        else:
            left, right = merge_by_rank(text, self.ranks, token)
            at_end, at_start = self._edges(right)[0], self._edges(left)[1]
            out = (
                [*at_end[:-1], (at_end[-1][0], token), (text, _NEVER)],
                [*at_start[:-1], (at_start[-1][0], token), (text, _NEVER)],
            )
        self._grown[token] = out
        return out

    def _alone(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = merge_by_rank(self.token_of[token], self.ranks) == [token]
        return ok

    def _fits(self, last: int, token: int) -> bool:
        """Whether the two are the encoding of their bytes: at no time did a merge across their border come first."""
        ok = self._follows.get((last, token))
        if ok is None:
            if len(self._follows) > 4 * MEMO_STATES:
                self._follows.clear()
            if last < 0 or not self._alone(token):
                ok = self._follows[last, token] = self._alone(token)
                return ok
            left, right = self._edges(last)[0], self._edges(token)[1]
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get(x + y, _NEVER)
                if across < x_ends and across <= y_ends and across != _NEVER:
                    ok = False
                    break
                if x_ends == y_ends == _NEVER:
                    ok = True
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self._follows[last, token] = ok
        return ok

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, pending, ends, firsts, open_, steps = self.states[number]
        pending += _BYTES[byte]
        n, prefixes, follows = len(pending), self._prefixes, self._follows
        token, still = -1, []
        for place in open_:  # longest first; a token that ends here began at one of these
            run = pending[place:]
            if token < 0:
                known = self.ranks.get(run)
                if known is not None:
                    before = ends[place - 1] if place else last
                    fits = follows.get((before, known))
                    if fits is None:
                        fits = self._fits(before, known)
                    if fits:
                        token, first = known, firsts[place - 1] if place else n
            if run in prefixes:
                still.append(place)
        if token < 0:
            raise ValueError(f"byte {byte} is no token of the vocabulary")
        still.append(n)
        ends, firsts, open_ = (*ends, token), (*firsts, first), still
        emitted: list[int] = []
        # Ways on begin at the open places; if all of them went through one first token, that token is sure.
        while open_[0]:
            size = firsts[open_[0] - 1]
            if len(open_) > 1 and any([firsts[p - 1] != size for p in open_]):
                break
            last = ends[size - 1]
            emitted.append(last)
            pending, ends = pending[size:], ends[size:]
            open_ = [p - size for p in open_]
            firsts = self._first_sizes(ends) if ends else ()
        out = (self.state(last, pending, ends, firsts, open_), tuple(emitted))
        steps[byte] = out
        return out

    def _first_sizes(self, ends: tuple[int, ...]) -> tuple[int, ...]:
        """For each place the size of the first token on the way to it; 0 for places that the emitted token covers."""
        sizes: list[int] = []
        for place, token in enumerate(ends, 1):
            before = place - len(self.token_of[token])
            sizes.append(place if not before else 0 if before < 0 else sizes[before - 1])
        return tuple(sizes)

    def rest(self, number: int) -> list[int]:
        """The tokens of the bytes that a state still holds, if the text ends there."""
        _, pending, ends, *_ = self.states[number]
        out, place = [], len(pending)
        while place:
            out.append(ends[place - 1])
            place -= len(self.token_of[ends[place - 1]])
        return out[::-1]

    def _node(self, run: bytes) -> int:
        """The number of the longest end of these bytes that a token begins with or is."""
        while run and run not in self._prefixes and run not in self.ranks:
            run = run[1:]
        number = self._node_of.get(run)
        if number is None:
            number = self._node_of[run] = len(self._nodes)
            self._nodes.append(run)
            ends = [(len(run) - i, self.ranks.get(run[i:])) for i in range(len(run))]
            self._endings.append(tuple((size, token) for size, token in ends if token is not None))
        return number

    def _go_on(self, number: int, text: bytes) -> list[int]:
        """The tokens of what a state holds and the rest of a text, without making states."""
        last, pending, ends, _, open_, _ = self.states[number]
        ends, node = list(ends), self._node(pending[open_[0] :])
        goto, endings, follows = self._goto, self._endings, self._follows
        if len(goto) > 10 * MEMO_STATES:
            goto.clear()
        n = len(pending)
        for byte in text:
            key = node << 8 | byte
            after = goto.get(key)
            if after is None:
                after = goto[key] = self._node(self._nodes[node] + _BYTES[byte])
            node = after
            n += 1
            for size, token in endings[node]:
                before = ends[n - size - 1] if n > size else last
                fits = follows.get((before, token))
                if fits is None:
                    fits = self._fits(before, token)
                if fits:
                    ends.append(token)
                    break
            else:
                raise ValueError(f"byte {byte} is no token of the vocabulary")
        out, sizes = [], self.size_of
        while n:
            token = ends[n - 1]
            out.append(token)
            n -= sizes[token]
        return out[::-1]

    def make_room(self) -> None:
        """Start over with too many states; call where state 0 is entered."""
        if len(self.states) > MEMO_STATES or len(self._once) > 10 * MEMO_STATES:
            self._reset()

    def encode(self, text: bytes) -> list[int]:
        self.make_room()
        states = self.states
        state, out = 0, []
        for at, byte in enumerate(text):
            step = states[state][5].get(byte)
            if step is None:
                key = state << 8 | byte
                if key not in self._once:
                    self._once.add(key)
                    return out + self._go_on(state, text[at:])
                step = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        return out + self.rest(state)


@cache
def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """One encoder per worker process: what it has learned serves all its tasks.

    What it keeps is bounded and has no cycles, so the collector of cycles need not go over it again and again.
    """
    gc.set_threshold(200_000, 50, 1_000)
    return PieceEncoder(read_ranks(path), pattern)


class PieceEncoder:
    """Tokens of whole texts: split by a pattern, each match encoded on its own, frequent matches remembered.

    Texts of letters whose classes the standard library's patterns know as well are split by those, which is faster;
    the classes differ in numerals that are no decimal digits and are only trusted up to U+024F.
    """

    def __init__(self, ranks: Ranks, pattern: str):
        self.machine = Transducer(ranks)
        spaces = pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")
        self._split = regex.compile(spaces)
        plain = spaces.replace(rf"[^{SPACE}\p{{L}}\p{{N}}]", rf"(?:[^\w{SPACE}]|_)")
        plain = plain.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self._plain = re.compile(plain) if r"\p" not in plain else None
        #: The ids of a piece, 32 bits each, little-endian.
        self._known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self._plain is not None and not _UNSURE.search(text):
            return self._plain.findall(text)
        return self._split.findall(text)

    def packed(self, piece: str) -> bytes:
        out = array("I", self.machine.encode(piece.encode("utf-8", "surrogatepass")))
        if sys.byteorder == "big":
            out.byteswap()
        out = out.tobytes()
        if len(piece) <= 64:
            if len(self._known) >= MEMO_PIECES:
                self._known.clear()
            self._known[piece] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text, 32 bits each, little-endian."""
        get, packed = self._known.get, self.packed
        return b"".join([get(piece) or packed(piece) for piece in self.pieces(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()


#: The ranges of UTF-8's second bytes that depend on the first.
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class Utf8Decoder:
    """An incremental UTF-8 state machine over tokens.

    A state is the begun character's bytes. A step takes a whole token's bytes, gives the characters that they finish
    and the state after them; steps are remembered by state and token. What is no UTF-8 becomes U+FFFD, one for each
    longest valid beginning.
    """

    def __init__(self, token_of: dict[int, bytes]):
        self.token_of = token_of
        #: Tokens that are whole characters by themselves need no machine, unless a character was begun before them.
        self._whole = np.zeros(max(token_of, default=0) + 1, bool)
        for number, token in token_of.items():
            self._whole[number] = self._is_text(token)
        self._steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def _is_text(token: bytes) -> bool:
        try:
            token.decode()
        except UnicodeDecodeError:
            return False
        return True

    @staticmethod
    def _needs(begun: bytes) -> tuple[int, int, int]:
        """For a begun character: its length, and the range of its next byte."""
        first = begun[0]
        size = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        low, high = _SECOND.get(first, (0x80, 0xBF)) if len(begun) == 1 else (0x80, 0xBF)
        return size, low, high

    def step(self, begun: bytes, token: int) -> tuple[str, bytes]:
        known = self._steps.get((begun, token))
        if known is not None:
            return known
        out, state = [], begun
        for byte in self.token_of[token]:
            if state:
                size, low, high = self._needs(state)
                if low <= byte <= high:
                    state += bytes([byte])
                    if len(state) == size:
                        out.append(state.decode())
                        state = b""
                    continue
                out.append("�")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                state = bytes([byte])
            else:
                out.append("�")
        if len(self._steps) > MEMO_PIECES:
            self._steps.clear()
        self._steps[begun, token] = result = ("".join(out), state)
        return result

    def decode(self, ids: list[int]) -> str:
        out, state, steps = [], b"", self._steps
        for i in ids:
            known = steps.get((state, i))
            text, state = known if known is not None else self.step(state, i)
            out.append(text)
        return "".join(out) + ("�" if state else "")

    def decode_packed(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a whole text; the machine runs over tokens that are no whole characters, the others, which
        end what was begun before them, are joined as they are."""
        tokens = [*map(self.token_of.__getitem__, ids.tolist())]
        odd = np.flatnonzero(~self._whole[ids])
        if not len(odd):
            return b"".join(tokens)
        out, done = [], 0
        starts = np.flatnonzero(np.diff(odd, prepend=-2) > 1)
        for run in np.split(odd, starts[1:]):
            first, last = int(run[0]), int(run[-1]) + 1
            out += tokens[done:first]
            out.append(self.decode(ids[first:last].tolist()).encode())
            done = last
        return b"".join([*out, *tokens[done:]])
