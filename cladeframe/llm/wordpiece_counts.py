"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that start a word and pieces
that continue one.  Every node has a failure link and the number of pieces
that leaving it pops, both precomputed, so a word's greedy longest-match
length is found in one pass over its characters without building pieces.  A
word that cannot be written in pieces counts as one unknown token.

The distinct words of a block of documents run through the automaton together,
one character position at a time; transitions are looked up in one sorted
array of (node, character) keys.

Words are runs without ASCII white space.

Defined results
---------------
* null or empty text: no words, no tokens.
* repeated rows, null ``doc_id``: one output row for each input row.
* very long words: linear time.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeframe.llm.tables import map_text
from cladeframe.llm.textnum import blocks, claim, span_hashes, words


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces that continue one) of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if "▁" not in piece:
            later.append(piece)
        elif piece.startswith("▁") and len(piece) > 1 and "▁" not in piece[1:]:
            first.append(piece[1:])
    return first, later


class Automaton:
    """Trie with failure links and popped-token counts."""

    FIRST, LATER = 0, 1

    def __init__(self, first: list[str], later: list[str]):
        chars = sorted(set("".join(first)) | set("".join(later)))
        self.classes = np.zeros(0x110000, np.int32)
        for i, c in enumerate(chars):
            self.classes[ord(c)] = i + 1
        self.width = len(chars) + 1
        goto: dict[tuple[int, str], int] = {}
        piece, order = [False, False], []
        for root, pieces in ((self.FIRST, first), (self.LATER, later)):
            for word in pieces:
                at = root
                for c in word:
                    to = goto.get((at, c))
                    if to is None:
                        to = goto[at, c] = len(piece)
                        piece.append(False)
                        order.append((to, at, c))
                    at = to
                piece[at] = True
        n = len(piece)
        fail, pops, depth = [-1] * n, [0] * n, [0] * n
        for v, parent, _ in order:
            depth[v] = depth[parent] + 1
        for v, parent, c in sorted(order, key=lambda x: depth[x[0]]):
            if piece[v]:
                fail[v], pops[v] = self.LATER, 1
                continue
            z, count = fail[parent], pops[parent]
            while z >= 0 and (z, c) not in goto:
                count += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = goto[z, c], count
        ends = [-1] * n  # tokens popped at the end of a word, -1: unknown
        for v in range(n):
            z, count = v, 0
            while z > self.LATER:
                count, z = count + pops[z], fail[z]
            ends[v] = count if z == self.LATER else -1
        self.fail, self.pops, self.ends = np.array(fail), np.array(pops), np.array(ends)
        keys = np.array([at * self.width + self.classes[ord(c)] for at, c in goto], np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.to = np.array(list(goto.values()), np.int64)[by]

    def counts(self, points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of every word (given as code points), 0 where it is unknown."""
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        alive = np.ones(len(order), bool)
        kinds = self.classes[points]
        for j in range(int(lens[0]) if len(lens) else 0):
            now = np.searchsorted(-lens, -j, side="left")  # words longer than j come first
            todo = np.flatnonzero(alive[:now])
            char = kinds[starts[todo] + j]
            while len(todo):
                key = state[todo] * self.width + char
                at = np.searchsorted(self.keys, key)
                hit = (at < len(self.keys)) & (char > 0)
                hit[hit] = self.keys[at[hit]] == key[hit]
                state[todo[hit]] = self.to[at[hit]]
                todo, char = todo[~hit], char[~hit]
                back = self.fail[state[todo]]
                lost = back < 0
                alive[todo[lost]] = False
                total[todo] += self.pops[state[todo]]
                state[todo] = back
                todo, char = todo[~lost], char[~lost]
        tail = self.ends[state]
        out = np.zeros(len(order), np.int64)
        out[order] = np.where(alive & (tail >= 0), total + tail, 0)
        return out


def count_tokens(docs: DataFrame, first: list[str], later: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(first, later))  # the vocabulary's size

    def run(batches):
        claim("pieces")
        automaton = shared.value
        for batch in batches:
            cols = [[], [], []]
            for _, _, data, offs in blocks(batch.column("text")):
                n = len(offs) - 1
                starts, ends, doc = words(data, offs)
                if len(starts):
                    _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    a, b = place[starts[one]], place[ends[one]]
                    said = automaton.counts(points, a, b - a)[which]
                else:
                    said = np.zeros(0, np.int64)
                unknown = said == 0
                cols[0].append(np.bincount(doc, minlength=n))
                cols[1].append(np.bincount(doc, weights=np.where(unknown, 1, said), minlength=n).astype(np.int64))
                cols[2].append(np.bincount(doc, weights=unknown, minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in cols)],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return map_text(docs.select("doc_id", "text"), run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
