"""Byte-level BPE by prefix dynamic programming (operator 2).

For every byte prefix of a piece there is exactly one token that ends the prefix's encoding.  The table of
these last tokens is built left to right, from the tokens that an automaton finds to end at each byte: a token t that
ends at byte i is the last one exactly if t is
what its own bytes encode to and t may follow the last token of the prefix before it; it may, if the bytes
of both, encoded together, give just these two.  Following the table backwards reads the encoding off.
Since a prefix's entry never depends on later bytes, appending only adds entries (``Prefixes.append``), and
an edit only needs new entries from the edit on, until as many entries after it as the longest token has bytes
are what they were: from there on all are (``Prefixes.replace``).

A text is first cut into the matches of the tokenizer's pattern and each match is encoded alone, like the
tiktoken library does; a match that is a token as a whole is that token.  ``EncodedText`` keeps a text with
its pieces, so that an append or edit re-cuts only near it.

Defined cases: null is the empty text (no tokens, empty decoding).  Rows are mapped one by one, so repeated
ids, empty tables and further columns need nothing special.  A worker's memory holds a bounded cache of
pieces and the table of the longest piece.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the caches of pieces and of token pairs; a full cache starts anew.
CACHE, PAIRS = 400_000, 1_000_000


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank from the lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        #: The tokens that their own bytes encode to, no other can end a prefix; and the two that each was last merged from.
        self.usable: dict[bytes, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            parts = self._merge(token, 2)
            if len(parts) == 2:  # which then merge to the token
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            if len(parts) <= 2:
                self.usable[token] = rank
        self.finder = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.finder.add_word(token.decode("latin-1"), (len(token), rank))
        self.finder.make_automaton()
        self.packed = _Packed(self)

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, while there is one."""
        return [self.ranks[p] for p in self._merge(data, 1)]

    def _merge(self, data: bytes, least: int) -> list[bytes]:
        """The parts that are left when no pair can be merged, or only `least` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            ranked = [self.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            rank = min(ranked)
            if rank == 1 << 40:
                break
            at = ranked.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both, encoded together, give just these two.

        They do unless, at some time while the two were made, the parts on either side of the border could have been
        merged first.  The merges are undone from the last one on, the later of both sides' first; a merge over the
        border that ranks below the one just undone would have come before it."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        bytes_of, rank_of, halves = self.bytes_of, self.ranks.get, self.halves.get
        a, b, undone, fits = left, right, 1 << 40, True
        while True:
            over = rank_of(bytes_of[a] + bytes_of[b])
            if over is not None and over < undone:
                fits = False
                break
            x, y = halves(a), halves(b)
            if x is not None and (y is None or a > b):
                undone, a = a, x[1]
            elif y is not None:
                undone, b = b + 1, y[0]  # of equal ranks the border's pair is further left, and comes first
            else:
                break
        self.pairs[left << 32 | right] = fits
        return fits

    def encode_piece(self, data: bytes) -> list[int]:
        rank = self.ranks.get(data)
        return [rank] if rank is not None else Prefixes(self, data).tokens()

    def encode(self, text: str) -> list[int]:
        return [x for p in self.pattern.findall(text) for x in self.encode_piece(p.encode())]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pattern.findall(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Packed(dict):
    """Piece to its packed ids, made when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        out = b"".join(x.to_bytes(4, "little") for x in self.vocabulary.encode_piece(piece.encode()))
        if len(piece) < 256:
            self[piece] = out
        return out


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend([], len(self.data), 0)

    def _extend(self, old: list[int], first: int, shift: int) -> None:
        """Entries up to the end of data; as soon as enough of those from `first` on are what old has `shift` before
        them, the rest is taken from old."""
        v, data, last, done, agreed = self.v, self.data, self.last, len(self.last), 0
        known, longest = v.pairs.get, v.longest
        from_ = max(0, done - longest + 1)
        # The tokens that end at each byte, longest first.
        for at, (size, token) in v.finder.iter(data[from_:].decode("latin-1")):
            end = from_ + at + 1
            if end <= done:
                continue
            if end > done + 1:
                break
            if end > size:
                before = last[end - size - 1]
                fits = known(before << 32 | token)
                if fits is None:
                    fits = v.may_follow(before, token)
                if not fits:
                    continue
            last.append(token)
            done = end
            if end > first:
                # A later token begins in the last `longest` bytes, so it sees only entries and bytes that agree.
                agreed = agreed + 1 if old[end - 1 - shift] == token else 0
                if agreed >= longest:
                    last += old[end - shift :]
                    return
        if done < len(data):
            raise ValueError("the vocabulary lacks a byte of the text")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """data[start:end] becomes new; entries before start stay, and those well after the edit."""
        old, self.last = self.last, self.last[:start]
        self.data = self.data[:start] + new + self.data[end:]
        self._extend(old, start + len(new), len(new) - (end - start))

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


class EncodedText:
    """A text with the starts of its pieces and their tokens, kept right under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v, self.text, self.starts, self.pieces = vocabulary, "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        # The piece that holds the character before the edit is cut anew, and the one before it: a run of spaces
        # leaves its last one to a word that follows, so the end of both may have depended on the edit.
        first = max(0, bisect_right(self.starts, max(0, start - 1)) - 2)
        begin = self.starts[first] if self.starts else 0
        shift, safe = len(new) - (end - start), start + len(new)
        self.text = self.text[:start] + new + self.text[end:]
        starts, pieces, tail = [], [], len(self.starts)
        for m in self.v.pattern.finditer(self.text, begin):
            if m.start() >= safe and m.start() - shift >= end:
                at = bisect_left(self.starts, m.start() - shift)
                if at < len(self.starts) and self.starts[at] == m.start() - shift:
                    tail = at  # from a common start on, the same characters are cut the same way
                    break
            starts.append(m.start())
            pieces.append(self.v.encode_piece(m.group().encode()))
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[tail:]]
        self.pieces = self.pieces[:first] + pieces + self.pieces[tail:]

    def tokens(self) -> list[int]:
        return [x for p in self.pieces for x in p]


@lru_cache(maxsize=2)
def _vocabulary(content: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(load_ranks(content), pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the packed ids of text_col. ranks: the content of a rank file."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def packed(texts):
        v = _vocabulary(shared.value, pattern)
        return texts.map(lambda t: v.encode_packed(t or ""))

    return docs.withColumn(ids_col, packed(F.col(text_col)))


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (whether decoding gives the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np

        v = _vocabulary(shared.value, pattern)
        for batch in batches:
            n, ids_hex, out_hex, same = [], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                packed = v.encode_packed(text)
                decoded = v.decode(np.frombuffer(packed, "<u4").tolist())
                n.append(len(packed) // 4)
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                out_hex.append(hashlib.sha256(decoded).hexdigest())
                same.append(decoded == text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(out_hex, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
