"""Token counts by a linear longest-match automaton.

Greedy word pieces: from the start of a word, the longest piece of the vocabulary, then the longest piece
from there, and so on. The vocabulary is a trie; a node that has no way on for a byte falls back along its
failure link, which stands for the pieces that are thereby complete. Links and the number of pieces they
complete are computed once, so a word is counted in one pass over its bytes, without building pieces.

A word is `[^\\x20\\x09-\\x0D]+`, read as UTF-8 behind a mark (a space), as byte-level vocabularies have it:
pieces that begin with the mark start a word, all others continue one. A word that can't be cut into pieces
counts as one token, the unknown one.

Results for odd rows: null and empty texts have no word and no token; repeated rows give repeated results;
texts are counted whole.
"""

from __future__ import annotations

import json
from collections import deque
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.bpe import byte_letters, read_vocabulary
from larkspur.llm.common import in_parts, slim

MARK = b" "


class LongestMatch:
    """Trie over the pieces' bytes with, per node, a failure link (-1: none) and the number of pieces it completes."""

    def __init__(self, pieces):
        self.goto: dict[int, int] = {}
        label, parent, whole = [0], [0], [False]
        for piece in pieces:
            node = 0
            for b in piece:
                to = self.goto.get(node << 8 | b)
                if to is None:
                    to = self.goto[node << 8 | b] = len(label)
                    label.append(b)
                    parent.append(node)
                    whole.append(False)
                node = to
            whole[node] = node > 0
        below: list[list[int]] = [[] for _ in label]
        for v in range(1, len(label)):
            below[parent[v]].append(v)
        self.link, self.popped = [-1] * len(label), [0] * len(label)
        todo = deque(below[0])
        while todo:
            v = todo.popleft()
            todo.extend(below[v])
            if whole[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            u = parent[v]
            at, n = self.link[u], self.popped[u]
            while at >= 0 and (to := self.goto.get(at << 8 | label[v])) is None:
                n += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[v], self.popped[v] = to, n

    def pieces(self, word: bytes) -> int:
        """The number of pieces; 0 if the word can't be cut into pieces."""
        goto, link, popped, at, n = self.goto, self.link, self.popped, 0, 0
        for b in word:
            to = goto.get(at << 8 | b)
            while to is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 0
                to = goto.get(at << 8 | b)
            at = to
        while at > 0:
            n += popped[at]
            at = link[at]
        return n if at == 0 else 0


class Counts(dict):
    """Tokens of words seen so far, in a table of bounded size; -1 stands for an unknown word."""

    def __init__(self, automaton: LongestMatch, most: int = 500_000):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.pieces(MARK + word) or -1
        if len(word) < 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def pieces_of(spec: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file."""
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    return [bytes(map(to_byte.__getitem__, t)) for t in json.loads(spec)["model"]["vocab"] if all(c in to_byte for c in t)]


#: The table of one vocabulary stays in a worker.
_COUNTS: dict[str, Counts] = {}


def counts_for(spec: str) -> Counts:
    key = sha256(spec.encode()).hexdigest()
    if key not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[key] = Counts(LongestMatch(pieces_of(spec)))
    return _COUNTS[key]


def count(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown. The vocabulary file (of checked size) is broadcast."""
    import pyarrow as pa

    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    slimmed = slim(docs, "doc_id", "text")
    schema = T.StructType([slimmed.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")]])

    def run(batches):
        counts = counts_for(spec.value)
        for batch in in_parts(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                each = list(map(counts.__getitem__, words))
                unknown = each.count(-1)
                rows.append((len(each), sum(each) + 2 * unknown, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]], names=schema.names)

    return slimmed.mapInArrow(run, schema)
