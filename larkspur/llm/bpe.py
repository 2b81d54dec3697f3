"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two neighbouring bytes if some token of the vocabulary holds them side by side.
Byte pairs that no token holds are therefore certain cuts: the fragments between cuts are encoded on
their own, and their ids are put together again. The runs of some rows that no table has are encoded
together, a merge in each fragment at a time; long ones go one by one and their fragments are kept in a bounded table.

Results for odd rows: null text counts as empty (no ids); repeated rows give repeated results; text
without a word gives no ids; very long runs without a cut are merged with a heap, in n log n steps.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.common import in_parts, slim

#: Unicode's White_Space, as the vocabulary's own normaliser takes it (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
WHITE_RUN = re.compile(f"[{WHITE}]+")
#: str.split() would also split at these.
NOT_WHITE = re.compile("[\x1c-\x1f]")
#: Runs that the vocabulary's own pattern takes as one word, or as one word and one run of signs: letters of Latin blocks (all of
#: these are letters in every version of Unicode since 5), then signs of ASCII without the apostrophe, which begins endings.
PLAIN = re.compile("([a-zß-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")
#: The pattern of which that is known; runs go through any other pattern as they are.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the rank of a pair that is never merged.
NEVER = 1 << 30
#: Runs of fewer letters are encoded together and kept.
LONG = 64
#: A vocabulary file may be this large; it is sent to every executor.
MOST_VOCABULARY_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class ForcedBoundaryBpe:
    """Encoder for a vocabulary of whole words: lower case, white space dropped, word ends marked by a suffix."""

    def __init__(self, spec: str, most_kept: int = 120_000):
        import regex

        d = json.loads(spec)
        model = d["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.numbers = {i: str(i) for i in self.tokens}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.ranks, self.made = {}, []  # of a pair; the id that a rank makes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.numbers.update({i: str(i) for i in self.special.values()})
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.regex = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern, self.plain = regex.compile(self.regex), PLAIN.fullmatch if self.regex == WORDS else lambda chunk: None
        to_byte = {c: b for b, c in enumerate(letters)}
        self.inside = inside = bytearray(1 << 16)  # 1: the two bytes stand side by side in a token
        for token in vocab:
            if self.end and token.endswith(self.end):
                token = token[: -len(self.end)]
            b = [to_byte[c] for c in token if c in to_byte]
            for x, y in zip(b, b[1:]):
                inside[x << 8 | y] = 1
        self.apart = {(k >> 8, k & 255) for k, x in enumerate(inside) if not x}
        self.first_ids, self.cut = np.array([self.inner, self.last]), ~np.frombuffer(inside, bool)
        pairs = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        self.by_pair = np.argsort(pairs)
        self.pairs, self.makes = pairs[self.by_pair], np.array(self.made)
        self.most, self.chunks, self.older, self.fragments = most_kept, {}, {}, {}

    def cuts(self, word: bytes) -> list[int]:
        """Where the word certainly falls apart."""
        pairs, apart = [*zip(word, word[1:])], self.apart
        return [] if apart.isdisjoint(pairs) else [i for i, pair in enumerate(pairs, 1) if pair in apart]

    def fragment(self, part: bytes, final: bool) -> list[int]:
        key = (part, final)
        ids = self.fragments.get(key)
        if ids is None:
            ids = [self.inner[b] for b in part]
            if final:
                ids[-1] = self.last[part[-1]]
            ids = self.merged(ids)
            if len(self.fragments) >= self.most // 4:  # fragments are only looked up for runs that both other tables lack
                self.fragments.clear()
            if len(part) < 64:
                self.fragments[key] = ids
        return ids

    def merged(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first."""
        rank_of, made, n = self.ranks.get, self.made, len(ids)
        if n < 24:  # so short that the least of all ranks costs less than a heap
            ranks = [rank_of(pair, NEVER) for pair in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < NEVER:
                at = ranks.index(best)
                ids[at] = to = made[best]
                del ids[at + 1], ranks[at]
                if at:
                    ranks[at - 1] = rank_of((ids[at - 1], to), NEVER)
                if at < len(ranks):
                    ranks[at] = rank_of((to, ids[at + 1]), NEVER)
            return ids
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        ids = [*ids]
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] is None or (j := right[i]) >= n or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = made[rank], None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (rank := rank_of((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (rank, a))
        return [x for x in ids if x is not None]

    def word(self, word: bytes) -> list[int]:
        cuts = self.cuts(word)
        if not cuts:
            return self.fragment(word, True)
        at = [0, *cuts, len(word)]
        out: list[int] = []
        for a, b in zip(at, at[1:]):
            out += self.fragment(word[a:b], b == len(word))
        return out

    def words(self, chunk: str) -> list[bytes]:
        """The words of one run without white space."""
        plain = self.plain(chunk)
        return [w.encode("utf-8", "surrogatepass") for w in (plain.groups() if plain else self.pattern.findall(chunk)) if w]

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Of one run without white space: the number of ids, the ids, the tokens."""
        ids: list[int] = []
        for w in self.words(chunk):
            ids += self.word(w)
        return self.shown(ids)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.by_pair[at], NEVER)

    def merged_together(self, flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of words that stand one behind another (last: a word ends here): the id that begins at each byte, -1 where none does."""
        out = np.full(len(flat), -1)
        ids, at = self.first_ids[last.astype(int), flat], np.arange(len(flat))
        end = last.copy()  # of a fragment
        end[:-1] |= self.cut[flat[:-1].astype(int) << 8 | flat[1:]]
        rank = np.full(len(flat), NEVER)
        inner = np.flatnonzero(~end)
        rank[inner] = self.ranked(ids[inner], ids[inner + 1])
        while len(ids):
            ends = np.flatnonzero(end)
            starts = np.append(0, ends[:-1] + 1)
            least = np.minimum.reduceat(rank, starts)
            sizes, open_ = ends - starts + 1, least < NEVER
            if not open_.all():  # those fragments are done
                stay = np.repeat(open_, sizes)
                out[at[~stay]] = ids[~stay]
                ids, at, end, rank = ids[stay], at[stay], end[stay], rank[stay]
                least, sizes = least[open_], sizes[open_]
                if not len(ids):
                    break
            of = np.repeat(np.arange(len(sizes)), sizes)
            k = np.flatnonzero(rank == least[of])
            k = k[np.append(True, of[k[1:]] != of[k[:-1]])]  # the leftmost of each fragment
            ids[k], end[k] = self.makes[least], end[k + 1]
            rank[k] = NEVER
            go = k[~end[k]]
            rank[go] = self.ranked(ids[go], ids[go + 2])
            go = k[k > 0]
            go = go[~end[go - 1]]
            rank[go - 1] = self.ranked(ids[go - 1], ids[go])
            stay = np.ones(len(ids), bool)
            stay[k + 1] = False
            ids, at, end, rank = ids[stay], at[stay], end[stay], rank[stay]
        return out

    def together(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """`chunk` of each of some short runs."""
        words = [self.words(c) for c in chunks]
        flat = [w for x in words for w in x]
        if not flat:
            return [self.shown([])] * len(chunks)
        ends = np.cumsum([len(w) for w in flat])
        last = np.zeros(ends[-1], bool)
        last[ends - 1] = True
        got = self.merged_together(np.frombuffer(b"".join(flat), np.uint8), last)
        many = np.append(0, np.cumsum(got >= 0))
        upto = many[np.append(0, ends)][np.cumsum([0, *map(len, words)])].tolist()
        ids = got[got >= 0].tolist()
        return [self.shown(ids[a:b]) for a, b in zip(upto, upto[1:])]

    def shown(self, ids: list[int]) -> tuple[int, str, str]:
        numbers, tokens = self.numbers, self.tokens
        return len(ids), " ".join([numbers[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def normal(self, text: str) -> list[str]:
        """The runs without white space of the normalised text. Letters are lowered one by one, so a sigma at a word's end stays plain."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in WHITE_RUN.split(text) if x] if NOT_WHITE.search(text) else text.split()

    def kept(self, got: dict[str, tuple[int, str, str]]) -> None:
        """Short runs go to the younger of two bounded tables; a full one becomes the older one."""
        for chunk, x in got.items():
            if len(chunk) < LONG:
                if len(self.chunks) >= self.most:
                    self.older, self.chunks = self.chunks, {}
                self.chunks[chunk] = x

    def missed(self, chunk: str) -> tuple[int, str, str]:
        """A run that the younger table lacks."""
        x = self.older.get(chunk) or self.chunk(chunk)
        self.kept({chunk: x})
        return x

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        got = []
        for piece in self.special_cut.split(text) if self.special_cut else [text]:
            if piece in self.special:
                got.append(self.shown([self.special[piece]]))
            elif piece:
                chunks, missed = self.chunks, self.missed
                for c in self.normal(piece):
                    got.append(chunks.get(c) or missed(c))
                    chunks = self.chunks
        return [x for x in got if x[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for x in self.parts(text or "") for i in x[1].split()]

    def decode(self, ids: list[int]) -> str:
        """This vocabulary has no decoder: the tokens, with a space between them."""
        return " ".join([self.tokens[i] for i in ids])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """The number of ids, the ids as text, the decoded text."""
        got = self.parts(text or "")
        if not got:
            return 0, "", ""
        n, ids, tokens = zip(*got)
        return sum(n), " ".join(ids), " ".join(tokens)

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """`digest` of each text, with the runs that no table has encoded together."""
        rows, new, known, older = [], {}, self.chunks.get, self.older.get
        for text in texts:
            if not text or any(x in text for x in self.special):
                rows.append(None)
                continue
            runs = self.normal(text)
            row = [known(c) or c for c in runs]
            new.update((c, None) for c in row if c.__class__ is str)
            rows.append(row)
        for c in new:
            new[c] = older(c) or (None if len(c) < LONG else self.chunk(c))
        todo = [c for c, x in new.items() if x is None]
        new.update(zip(todo, self.together(todo)))
        out = []
        for text, row in zip(texts, rows):
            if row is None:
                out.append(self.digest(text))
                continue
            got = [y for x in row if (y := new[x] if x.__class__ is str else x)[0]]
            n, ids, tokens = zip(*got) if got else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(tokens)))
        self.kept(new)
        return out


#: One encoder for each vocabulary stays in a worker, so that its tables serve later tasks.
_ENCODERS: dict[str, ForcedBoundaryBpe] = {}


def encoder(spec: str) -> ForcedBoundaryBpe:
    key = sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ForcedBoundaryBpe(spec)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> str:
    """A vocabulary file, read by the driver; it is of a fixed size, which is checked."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(spec) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of over {MOST_VOCABULARY_BYTES} bytes is not sent to the executors")
    return spec


def encode(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, the SHA-256 of the ids and of the decoded text; with ids=True also ids and decoded.

    The vocabulary file goes to each executor once (broadcast of a file of checked, fixed size).
    """
    import pyarrow as pa

    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    slimmed = slim(docs, "doc_id", "text")
    fields = [slimmed.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches):
        bpe = encoder(spec.value)
        for batch in in_parts(batches):
            n, a, b, shown, back = [], [], [], [], []
            for k, i, t in bpe.digests(batch.column(1).to_pylist()):
                n.append(k)
                a.append(sha256(i.encode()).hexdigest())
                b.append(sha256(t.encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    shown.append([int(x) for x in i.split()])
                    back.append(t)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if ids:
                columns += [pa.array(shown, pa.list_(pa.int32())), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return slimmed.mapInArrow(run, T.StructType(fields))
