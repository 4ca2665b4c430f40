"""Byte-level BPE as a lazily determinised finite-state transducer.

Compilation.  In BPE the last token of a prefix of a piece, together with the
encoding of what stands before it, fixes the encoding of that prefix, and two
tokens may stand side by side exactly when encoding their joined bytes gives
the two back.  So after each byte one new *edge* (token, from an earlier
position) is enough.  A state of the transducer holds the edges that later
bytes can still use: positions from which the bytes read so far are a path in
the vocabulary's trie, and the edges that lead there.  A token is emitted when
all these lead through it, at most the longest token's length later; the rest
leaves at the end of the piece.  States and transitions are made when first
needed and kept in tables of bounded size; beyond that a step is worked out
without being kept, so work is linear in the bytes for any piece.

Pieces are the matches of ``pattern``.  A piece that is itself in the
vocabulary is that token.  Encodings of short pieces are kept in two bounded
tables, the newer of which replaces the older when full.  No special tokens.

Decoding joins the tokens' bytes in chunks and feeds them to an incremental
UTF-8 state machine that holds back an unfinished character.

Defined results
---------------
* null or empty text: no tokens, hashes of no bytes.
* repeated rows, null ``doc_id``: one output row for each input row.
* extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeframe.llm.tables import map_text
from cladeframe.llm.textnum import claim

STATE_LIMIT = 20_000
MOVE_LIMIT = 80_000
PAIR_LIMIT = 300_000
PIECE_LIMIT = 300_000
PIECE_BYTES = 48
OUTPUT_BYTES = 4_000_000
UNKEPT_BYTES = 64
#: Characters with the property White_Space; ``\s`` of the regex module has more.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def exact_spaces(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelled out, inside and outside of classes."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e == "s":
                out.append(WHITE_SPACE if inside else f"[{WHITE_SPACE}]")
            elif e == "S" and not inside:
                out.append(f"[^{WHITE_SPACE}]")
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(c)
        i += 1
    return "".join(out)


class Transducer:
    """Encodes pieces of bytes; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.next: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token_at = [-1]  # by node
        for t, r in ranks.items():
            at = 0
            for b in t:
                key = at << 8 | b
                if key not in self.next:
                    self.next[key] = len(self.token_at)
                    self.token_at.append(-1)
                at = self.next[key]
            self.token_at[at] = r
        self.start = max(ranks.values(), default=0) + 1  # stands for "no token before"
        self.width = self.start + 1
        self.fits: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first."""
        #: A state: (tokens, starts, live).  For each entry the token that ends there and the entry it starts from;
        #: entry 0 is the frontier, whose token is the last emitted one, the last entry is the end.  live: entries with
        #: the trie node of the bytes read since, where there is one, as entry << 32 | node.
        self.states: list[tuple] = [((self.start,), (-1,), (0,))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.tails: dict[int, tuple[int, ...]] = {}

    def merge(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Plain BPE of a few bytes with the ranks below a bound: always the leftmost pair of the lowest rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into ``token`` last; the token twice for a byte; (-1, -1) if BPE never makes it."""
        said = self.split.get(token)
        if said is None:
            data = self.tokens[token]
            parts = self.merge(data, token)
            said = (token, token) if len(data) == 1 else tuple(parts) if len(parts) == 2 else (-1, -1)
            self.split[token] = said
        return said

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether the tokens' joined bytes encode to the two; for ``start`` on the left, whether the right is its own encoding.

        Takes the merges of both sides back, the latest first, and looks whether
        the parts at the border would have merged before that.
        """
        if len(self.fits) > PAIR_LIMIT:
            self.fits.clear()
        said = self.halves(right) != (-1, -1) and (left == self.start or self.halves(left) != (-1, -1))
        if said and left != self.start:
            a, b, before = left, right, self.width
            while True:
                joined = self.ranks.get(self.tokens[a] + self.tokens[b])
                if joined is not None and joined < before:
                    said = False
                    break
                inner_a, inner_b = self.halves(a)[1], self.halves(b)[0]
                if inner_a == a and inner_b == b:
                    break
                if inner_b == b or (inner_a != a and a > b):  # a was made last; at its time a merge of equal rank on the right came later
                    a, before = inner_a, a
                else:
                    b, before = inner_b, b + 1
        self.fits[left * self.width + right] = said
        return said

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after one more byte and the tokens that are certain by then."""
        tokens, starts, live = state
        follow, token_at, fits, width = self.next.get, self.token_at, self.fits.get, self.width
        kids, edge, token = [], -1, -1
        for item in live:  # longest first
            child = follow((item & 0xFFFFFFFF) << 8 | byte)
            if child is None:
                continue
            at = item >> 32
            kids.append(item - (item & 0xFFFFFFFF) + child)
            if edge < 0 and token_at[child] >= 0:
                said = fits(tokens[at] * width + token_at[child])
                if self.side_by_side(tokens[at], token_at[child]) if said is None else said:
                    edge, token = at, token_at[child]
        if edge < 0:
            raise ValueError("the vocabulary lacks a byte")
        end = len(tokens)
        tokens, starts = (*tokens, token), (*starts, edge)
        kids.append(end << 32)
        if len(kids) > end:  # all entries are live
            return (tokens, starts, tuple(kids)), ()
        used = {0}
        for item in kids:
            i = item >> 32
            while i not in used:
                used.add(i)
                i = starts[i]
        kept, skip = sorted(used), 0
        lowest = kids[0] >> 32
        if lowest:  # the frontier is not live: emit while one entry alone follows it
            ways = [0] * (end + 1)
            for i in kept[1:]:
                ways[starts[i]] += 1
            while kept[skip] != lowest and ways[kept[skip]] == 1:
                skip += 1
        emitted = tuple([tokens[i] for i in kept[1 : skip + 1]])
        kept = kept[skip:]
        if len(kept) <= end:
            place = {i: k for k, i in enumerate(kept)}
            tokens, starts = tuple([tokens[i] for i in kept]), (-1, *[place[starts[i]] for i in kept[1:]])
            kids = [place[item >> 32] << 32 | item & 0xFFFFFFFF for item in kids]
        return (tokens, starts, tuple(kids)), emitted

    @staticmethod
    def _tail(state: tuple) -> tuple[int, ...]:
        tokens, starts, _ = state
        i, chain = len(tokens) - 1, []
        while i > 0:
            chain.append(tokens[i])
            i = starts[i]
        return tuple(reversed(chain))

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        number, moves, states = 0, self.moves, self.states
        for at, byte in enumerate(piece):
            move = moves.get(number << 8 | byte)
            if move is None:
                state, emitted = self._step(states[number], byte)
                to = self.numbers.get(state)
                if to is None:
                    if len(states) >= STATE_LIMIT:
                        return out + self._unkept(state, emitted, piece[at + 1 :])
                    to = self.numbers[state] = len(states)
                    states.append(state)
                move = (to, emitted)
                if len(moves) < MOVE_LIMIT:
                    moves[number << 8 | byte] = move
            number, emitted = move
            if emitted:
                out += emitted
        tail = self.tails.get(number)
        if tail is None:
            tail = self.tails[number] = self._tail(states[number])
        return out + list(tail)

    def _unkept(self, state: tuple, emitted: tuple, rest: bytes) -> list[int]:
        """Goes on from a state that there is no room to keep."""
        out = list(emitted)
        for byte in rest[:-UNKEPT_BYTES]:  # long: with emission, so what is held stays bounded
            state, emitted = self._step(state, byte)
            out += emitted
        rest = rest[-UNKEPT_BYTES:]
        tokens, starts, live = list(state[0]), list(state[1]), state[2]
        follow, token_at, fits, width = self.next.get, self.token_at, self.fits.get, self.width
        for byte in rest:  # short: the same steps without dropping entries
            kids, edge, token = [], -1, -1
            for item in live:
                child = follow((item & 0xFFFFFFFF) << 8 | byte)
                if child is None:
                    continue
                at = item >> 32
                kids.append(at << 32 | child)
                if edge < 0 and token_at[child] >= 0:
                    said = fits(tokens[at] * width + token_at[child])
                    if self.side_by_side(tokens[at], token_at[child]) if said is None else said:
                        edge, token = at, token_at[child]
            if edge < 0:
                raise ValueError("the vocabulary lacks a byte")
            kids.append(len(tokens) << 32)
            tokens.append(token)
            starts.append(edge)
            live = kids
        return out + list(self._tail((tokens, starts, live)))


class Codec:
    """Texts to token ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(exact_spaces(pattern))
        self.transducer = Transducer(ranks)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        lens = np.zeros(size + 1, np.int64)
        for t, r in ranks.items():
            lens[r + 1] = len(t)
        self.at = np.cumsum(lens)
        self.lens = lens[1:]
        flat = bytearray(int(self.at[-1]))
        for t, r in ranks.items():
            flat[self.at[r] : self.at[r] + len(t)] = t
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            ids = self.pack(self.transducer.encode_piece(data))
            if len(data) > PIECE_BYTES:
                return ids
        if len(self.pieces) >= PIECE_LIMIT:
            self.older = dict(self.pieces)
            self.pieces.clear()  # in place: encode() holds its methods
            self.transducer.reset()
        self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, fresh = self.pieces.get, self._piece
        return b"".join([known(p) or fresh(p) for p in self.pattern.findall(text)])

    def chunks(self, ids: bytes, size: int = 1 << 16):
        """The bytes of the tokens, ``size`` tokens at a time."""
        every = np.frombuffer(ids, "<u4").astype(np.int64)
        for lo in range(0, len(every), size):
            part = every[lo : lo + size]
            n = self.lens[part]
            ends = np.cumsum(n)
            yield self.flat[np.arange(ends[-1]) + np.repeat(self.at[part] - (ends - n), n)].tobytes()

    def decode(self, ids: bytes) -> str:
        machine = Utf8Machine()
        return "".join([machine.feed(c) for c in self.chunks(ids)] + [machine.close()])


#: First bytes of the characters of several bytes, with the number of bytes that follow and the range of the next byte.
_LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the finished characters, the rest is held back.

    Only the last three bytes of a chunk can be unfinished, so the machine
    walks over these; ill-formed bytes become U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of the unfinished character at the end of ``data``."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                for lo, hi, more, least, most in _LEADS:
                    if lo <= byte <= hi:
                        if back > more or back > 1 and not least <= data[-back + 1] <= most:
                            return 0
                        return back
                return 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec a process for each vocabulary, so its tables serve all batches."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the packed ids) for every document row.

    ``vocabulary`` is the path of a rank file; it is read by the driver, so
    executors need not have it.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the rank file's size

    def run(batches):
        claim("bpe", _codecs.clear)
        own = codec(shared.value, pattern)
        gc.disable()  # the tables hold millions of tuples and no cycles; reference counts free all of it
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                n, ids_hash, text_hash, packed, size, first = [], [], [], [], 0, done
                while done < batch.num_rows and size < OUTPUT_BYTES:
                    ids = own.encode(batch.column("text")[done].as_py() or "")
                    done += 1
                    size += len(ids)
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    machine, said = Utf8Machine(), hashlib.sha256()
                    for chunk in own.chunks(ids):
                        said.update(machine.feed(chunk).encode("utf-8"))
                    said.update(machine.close().encode("utf-8"))
                    text_hash.append(said.hexdigest())
                    if with_ids:
                        packed.append(ids)
                cols = [batch.column("doc_id").slice(first, done - first), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(packed, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        gc.enable()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_text(docs.select("doc_id", "text"), run, schema)
