"""SentencePiece encoding and decoding by suffix-array matching.

Text becomes a sequence of chunks: blanks are written as U+2581, one is put in front, and the text is cut where no
piece can span: where U+2581 follows another character (checked when the model is read), between a word character and
a sign that follows none in any piece, and around line ends and tabs if no piece has them. Chunks are encoded on their
own, and equal chunks once.

New chunks of a batch are concatenated and indexed by a suffix array (prefix doubling up to the longest piece). Every
piece is located in it by binary search, all pieces at once, one character a step; its range of suffixes gives its
occurrences, which are edges from their first to past their last character. Edges are sorted by position (that of their
end in its chunk, so that all chunks advance together) and relaxed: for each place, the one edge is kept that continues
the kept edge where it begins. For a byte-pair model an edge
continues another exactly when merging their joined text from scratch gives those two pieces again; this is decided by
running the merges, and remembered. (A search for the best sum of scores would give other pieces than the model's own
merges do.) Characters without a piece are edges of their own and become byte pieces.

Null text gives null ids, empty text none. Repeated rows get the same ids each, an empty table gives an empty table.
Other columns pass through; one with the name of a result is replaced by it. No ties arise: merges decide all. Only identity-normalised byte-pair models with byte fallback and a dummy
prefix are read; others raise ValueError. The model is read once, on the driver; executors get its piece list.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, PART, MOST_WORDS, MOST_PAIRS, TEXTS = "▁", 400_000, 400_000, 1 << 21, 1250


def chunk_pattern(pieces: list[str]) -> re.Pattern:
    """Chunks of a text, by what the model's pieces can span."""
    after_word = {b for p in pieces for a, b in zip(p, p[1:]) if re.match(r"\w", a)}
    inside = {c for p in pieces for c in p}
    signs = "".join(re.escape(chr(c)) for c in range(33, 127) if not re.match(r"\w", chr(c)) and chr(c) not in after_word) or "\0"
    lone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside) or "\0"
    # first the common case, a blank and a word up to a cut
    return re.compile(rf"{BLANK}?\w++(?=[{BLANK}{signs}{lone}]|\Z)|{BLANK}*(?:[^{BLANK}{lone}\w]|\w(?![{signs}]))+\w?|{BLANK}*\w|{BLANK}+|[{lone}]")


class Model:
    """Pieces, ranks and byte ids of a model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        self.bytes = [i for i in range(n) if m.is_byte(i)]
        plain = [i for i in range(n) if i not in self.special and not m.is_byte(i)]
        if len(self.bytes) != 256 or [self.pieces[i] for i in self.bytes] != [f"<0x{k:02X}>" for k in range(256)]:
            raise ValueError("the model has no byte pieces")
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in plain):
            raise ValueError("a piece holds a blank after another character")
        probe = "ﬁ a  b\t"
        if "".join(m.encode(probe, out_type=str)).replace("<0x09>", "\t") != BLANK + probe.replace(" ", BLANK):
            raise ValueError("the model normalises text or adds no prefix")
        self.score = {self.pieces[i]: m.get_score(i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.digest = hashlib.sha256("\0".join(self.pieces).encode()).hexdigest()


def merge(text: str, score: dict[str, float]) -> list[str]:
    """The model's own rule: join the adjacent pair whose piece scores highest, the leftmost of equals, until none is left."""
    parts = list(text)
    while True:
        best, at = None, -1
        for k in range(len(parts) - 1):
            s = score.get(parts[k] + parts[k + 1])
            if s is not None and (best is None or s > best):
                best, at = s, k
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Pairs:
    """An open-addressed table from pairs of pieces to whether the second may follow the first, read in bulk."""

    def __init__(self, bits: int = 16):
        self.shift, self.keys, self.values, self.n = 64 - bits, np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at[todo]]
            todo = todo[(there != 0) & (there != keys[todo])]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return at

    def add(self, keys: list[int], values: list[bool]) -> None:
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys != 0
            old, more = (self.keys[full], self.values[full]) if self.n < MOST_PAIRS else (np.empty(0, np.int64), np.empty(0, bool)), len(keys)
            self.__init__(max(16, (4 * (len(old[0]) + more)).bit_length()))
            self.put(*old)
        self.put(np.array(keys, np.int64), np.array(values, bool))

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):  # keys that want one free slot take it one after another
            at = self.slots(keys)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            self.n += len(first)
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]


class Index:
    """Pieces that their own merges produce, sorted, with what has been learnt about chunks and pairs of pieces."""

    def __init__(self, pieces: list[str], score: dict[str, float], ids: dict[str, int], bytes_: list[int]):
        self.score, self.ids, self.bytes = score, ids, bytes_
        self.pieces = pieces
        self.chunks = chunk_pattern(list(ids))
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.int64) for p in pieces]
        self.length = np.array([len(c) for c in codes])
        self.longest = int(self.length.max())
        self.matrix = np.zeros((len(pieces), self.longest), np.int64)
        for k, c in enumerate(codes):
            self.matrix[k, : len(c)] = c
        self.id_of = np.array([ids[p] for p in pieces], np.int64)
        self.piece_of = dict(zip(self.id_of.tolist(), pieces))
        self.pairs = Pairs()
        self.forget()

    def forget(self) -> None:
        """Start over with no chunks known: ``rows`` numbers them, their ids lie one after another in ``flat``."""
        self.rows: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start = np.zeros(1 << 14, np.int64)

    def remember(self, chunks: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.rows), len(self.rows) + len(chunks)
        if m >= len(self.start):
            self.start = np.concatenate((self.start, np.zeros(m, np.int64)))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(self.used + len(ids), np.int32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n + 1 : m + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.rows.update(zip(chunks, range(n, m)))

    def ids_of(self, chunk: str) -> list[int]:
        k = self.rows[chunk]
        return self.flat[self.start[k] : self.start[k + 1]].tolist()

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may come after piece a, element by element."""
        keys = (a << 32) | b
        at = self.pairs.slots(keys)
        new = np.unique(keys[self.pairs.keys[at] == 0])
        if len(new):
            got = []
            for k in new.tolist():
                x, y = self.piece_of[k >> 32], self.piece_of[k & 0xFFFFFFFF]
                got.append(merge(x + y, self.score) == [x, y])
            self.pairs.add(new.tolist(), got)
            at = self.pairs.slots(keys)
        return self.pairs.values[at]

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, id) of every occurrence of a piece in ``text``."""
        order = suffix_array(text, self.longest)
        n = len(order)
        low, high = np.zeros(len(self.pieces), np.int64), np.full(len(self.pieces), n, np.int64)
        padded = np.concatenate((text, np.full(self.longest + 1, -1)))
        for depth in range(self.longest):  # narrow each piece's range of suffixes by its next character
            live = np.nonzero((self.length > depth) & (low < high))[0]
            if not len(live):
                break
            c = self.matrix[live, depth]
            for side, bound in (("left", low), ("right", high)):
                a, b = low[live].copy() if side == "left" else bound_low[live], high[live].copy()
                while (a < b).any():
                    mid = (a + b) >> 1
                    x = padded[order[np.minimum(mid, n - 1)] + depth]
                    up = (x < c) if side == "left" else (x <= c)
                    up &= a < b
                    a, b = np.where(up, mid + 1, a), np.where((a < b) & ~up, mid, b)
                if side == "left":
                    bound_low = low.copy()
                    new_low = a
                else:
                    high[live] = a
            low[live] = new_low
        hits = high - low
        which = np.repeat(np.arange(len(self.pieces)), hits)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)
        begin = order[np.repeat(low, hits) + offset]
        end = begin + self.length[which]
        return begin, end, self.id_of[which]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks of one blank at most in front, and remember them."""
        text = np.frombuffer(("\0" + "\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stops = np.nonzero(text == 0)[0]
        begin, end, ids = self.edges(text)
        known = np.zeros(len(text) + 1, bool)
        known[end[end - begin == 1]] = True
        lone = np.nonzero(~known[1:] & (text != 0))[0]  # characters without a piece
        begin, end, ids = (np.concatenate(x) for x in ((begin, lone), (end, lone + 1), (ids, np.full(len(lone), -2))))
        opened = np.zeros(len(text), np.int64)
        opened[stops] = stops
        place = end - np.maximum.accumulate(opened)[end - 1]  # of the end, in its chunk
        if int(place.max()) <= 0xFFFF:
            place = place.astype(np.uint16)  # sorted faster
        by = np.argsort(place, kind="stable")
        begin, end, ids, place = begin[by], end[by], ids[by], place[by]
        kept = np.full(len(text) + 1, -1, np.int64)  # the id of the edge kept that ends here
        back = np.zeros(len(text) + 1, np.int64)
        kept[stops + 1] = 0  # a chunk's begin, which every piece may follow
        cut = np.nonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))[0]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            a, p = kept[begin[i:j]], ids[i:j]
            ok = a != -1
            ask = np.nonzero((a > 0) & (p > 0))[0]  # what follows an unknown character always fits, and that fits anywhere
            ok[ask] = self.follows(a[ask], p[ask])
            at = i + np.nonzero(ok)[0][::-1]
            kept[end[at]], back[end[at]] = ids[at], begin[at]
        rows, tokens = [], []
        row, at, first = np.arange(len(chunks)), stops[1:].copy(), stops[:-1] + 1
        while len(row):  # walk all chunks back from their ends
            rows.append(row)
            tokens.append(np.where(kept[at] == -2, -2 - text[at - 1], kept[at]))
            at = back[at]
            live = at > first
            row, at, first = row[live], at[live], first[live]
        row = np.concatenate(rows)
        by = np.argsort(row[::-1], kind="stable")
        row, flat = row[::-1][by], np.concatenate(tokens)[::-1][by]
        odd = np.zeros(len(chunks), bool)
        odd[row[flat < 0]] = True
        plain = ~odd[row]
        counts = np.bincount(row, minlength=len(chunks))
        self.remember([c for c, o in zip(chunks, odd.tolist()) if not o], counts[~odd], flat[plain])
        stop = np.cumsum(counts)
        for k in np.nonzero(odd)[0].tolist():
            out = [y for x in flat[stop[k] - counts[k] : stop[k]].tolist() for y in ([self.bytes[z] for z in chr(-2 - x).encode("utf-8", "surrogatepass")] if x < 0 else (x,))]
            self.remember([chunks[k]], np.array([len(out)]), np.array(out, np.int32))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        find = self.chunks.findall
        whole = [None if t is None else find(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set().union(*(c for c in whole if c))
        if len(self.rows) + len(new) > MOST_WORDS:
            self.forget()
        new.difference_update(self.rows)
        odd = [c for c in new if c[:2] == BLANK * 2 or c == BLANK or "\0" in c]
        new.difference_update(odd)
        size, part = 0, []
        for c in new:
            part.append(c)
            size += len(c) + 1
            if size >= PART or len(c) >= 0xFFFF:
                self.learn(part)
                size, part = 0, []
        if part:
            self.learn(part)
        for c in odd:
            out = self.rare(c)
            if c not in self.rows:
                self.remember([c], np.array([len(out)]), np.array(out, np.int32))
        sizes = [len(c) for c in whole if c is not None]
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(c for c in whole if c)), np.int64, sum(sizes))
        begin, n = self.start[at], self.start[at + 1] - self.start[at]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - stop + n, n)]
        ends = np.concatenate(([0], stop))[np.cumsum([0, *sizes])].tolist()
        parts = iter([ids[i:j] for i, j in zip(ends[:-1], ends[1:])])
        return [None if c is None else next(parts) for c in whole]

    def rare(self, chunk: str) -> list[int]:
        """Chunks of blanks only, with several blanks in front, or with a NUL character."""
        if "\0" in chunk:
            out: list[int] = []
            for k, part in enumerate(chunk.split("\0")):
                out += [self.bytes[0]] if k else []
                if part:
                    if part not in self.rows and part.strip(BLANK) and part[:2] != BLANK * 2:
                        self.learn([part])
                    out += self.ids_of(part) if part in self.rows else self.rare(part)
        else:
            body = chunk.lstrip(BLANK)
            blanks, tail = len(chunk) - len(body), []
            if body:  # the last blank belongs to the body where merges take it, since blanks join each other last of all
                if BLANK + body not in self.rows:
                    self.learn([BLANK + body])
                tail = self.ids_of(BLANK + body)
                if tail[0] == self.ids[BLANK]:
                    tail = tail[1:]
                else:
                    blanks -= 1
            out = []
            widest = max((len(p) for p in self.ids if not p.strip(BLANK)), default=1)
            while blanks > 0:  # equal scores join from the left, so runs grow to the longest piece first
                w = min(blanks, widest)
                while BLANK * w not in self.ids:
                    w -= 1
                out.append(self.ids[BLANK * w])
                blanks -= w
            out += tail
        return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes' first ``depth`` characters or more, by prefix doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    n, k = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key)
        k *= 2
        if k >= depth:
            return order
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate(([1], sorted_key[1:] != sorted_key[:-1])))


def _index(spec: tuple) -> Index:
    """One index a Python worker, so that what one task learns serves the next."""
    digest, pieces, score, ids, bytes_ = spec
    store = sys.__dict__.setdefault("_noveltide_indexes", {})
    if digest not in store:
        store[digest] = Index(pieces, score, ids, bytes_)
    return store[digest]


def spec_of(model: Model) -> tuple:
    own = [p for p in model.ids if merge(p, model.score) == [p]]
    return model.digest, own, model.score, model.ids, model.bytes


def decode_ids(ids, pieces: list[str | bytes]) -> str:
    """Text of ids; ``pieces`` is from decode_table()."""
    got = list(map(pieces.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    try:
        text = "".join(got)
    except TypeError:  # byte pieces above 0x7F
        text = b"".join(p if type(p) is bytes else p.encode("utf-8", "surrogatepass") for p in got).decode("utf-8", "replace")
    text = text.replace(BLANK, " ")
    return text[1:] if text[:1] == " " else text


def decode_table(model: Model) -> list[str | bytes]:
    """For each id its string; bytes for byte pieces that are no characters of their own, "" for special ids."""
    place = {i: k for k, i in enumerate(model.bytes)}
    return ["" if i in model.special else p if i not in place else chr(place[i]) if place[i] < 128 else bytes((place[i],)) for i, p in enumerate(model.pieces)]


def encode(docs: DataFrame, model: str = MODEL, column: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` plus ``out``: array<int>."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(spec_of(Model(model)))  # of fixed size: the model's piece list

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(spec.value)
        for x in batches:
            yield pd.Series([g for k in range(0, len(x), TEXTS) for g in index.encode(x.iloc[k : k + TEXTS].tolist())], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "array<int>")(F.col(column)))


def decode(rows: DataFrame, model: str = MODEL, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` plus ``out``: the text of ``column``; null for null, ids outside the model raise IndexError."""
    pieces = rows.sparkSession.sparkContext.broadcast(decode_table(Model(model)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([None if g is None else decode_ids(g, pieces.value) for g in x], dtype=object)

    return rows.withColumn(out, F.pandas_udf(run, "string")(F.col(column)))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip: whether decoding gives the text back.

    Encoding and decoding follow each other in the task, so ids need not leave it.
    """
    loaded = Model(model)
    shared = docs.sparkSession.sparkContext.broadcast((spec_of(loaded), decode_table(loaded)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        spec, pieces = shared.value
        index = _index(spec)
        for x in batches:
            rows = []
            for k in range(0, len(x), TEXTS):  # the ids of so many texts are held at a time
                texts = x.iloc[k : k + TEXTS].tolist()
                for t, g in zip(texts, index.encode(texts)):
                    rows.append((None, None, None) if g is None else (len(g), hashlib.sha256(g.astype("<i4").tobytes()).hexdigest(), decode_ids(g, pieces) == t))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "round_trip"]).astype({"n_tokens": "Int64"})
        x = rows = texts = t = g = index = spec = pieces = None
        give_back()

    both = F.pandas_udf(run, "n_tokens long, ids_sha256 string, round_trip boolean")
    return beside(docs, both(F.col("text")), {c: c for c in ("n_tokens", "ids_sha256", "round_trip")})
