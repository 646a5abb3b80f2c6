"""Substring dedup (operator 8): Rabin-Karp hashes of every fixed-length token window, counted across the corpus.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word goes if a window of `length` words that covers it starts
earlier too, in a text of smaller id or earlier in the same one; windows are judged on the input.

1. A task hashes all windows of a bounded piece of its texts (Rabin-Karp prefix sums modulo 2^61 - 1 over word
   hashes, which are such sums over bytes themselves).  Of equal windows in a piece all but the first are known to repeat; only the first is sent on.  So a
   passage that a third of all rows share is one window per piece, however many texts hold it.
2. Windows go to the bucket of their smallest inner hash of `gram` words, which neighbouring windows mostly share.
   Neighbours travel as one run: id, start, count, inner hash, and a hash of 61 bits per window, packed by bucket.
   Windows count as equal when both hashes are: two sums to different bases over different words, 122 bits in all.
3. Each bucket counts its windows and returns the runs of windows that are not the first of their kind.
4. The runs of a text merge to maximal removal intervals, which meet the text in one join on its key.

Buckets grow in number with the input, so each stays a few MB.

Defined cases: null is the empty text (no words).  Rows that repeat an id, or have none, are texts of their own;
texts with equal ids are in an arbitrary fixed order, null ids come last.  Texts of fewer words than a window lose
nothing.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import even_ids, parts_for, plain, slices, starts_in_text, windows, with_key, word_hashes, word_spans
from millrace.llm.lm import _pieces, _rows, _split, _unpack

_U = np.uint64
_RUN = (np.int64, np.uint32, np.uint8, _U, _U)  # key, first window, windows, inner hash, each window's hash


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    if len(x) < n:
        return x[:0]
    pad = -len(x) % n
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, n)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - n + 1
    return np.minimum(right[:m], left[n - 1 : n - 1 + m])


def _later(hashes: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Of windows with equal hashes, all but the first, as a mask."""
    order = np.argsort(hashes, kind="stable")
    s, t = hashes[order], inner[order]
    equal = s[1:] == s[:-1]
    if (equal & (t[1:] != t[:-1])).any():  # so rare that a second sort does not matter
        order = np.lexsort((inner, hashes))
        s, t = hashes[order], inner[order]
        equal = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    same = np.zeros(len(hashes), bool)
    same[order[1:]] = equal
    return same


def _runs(key: np.ndarray, start: np.ndarray, inner: np.ndarray | None = None, most: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of runs of neighbouring windows (same key, next start, same inner hash)."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    if inner is not None:
        new[1:] |= inner[1:] != inner[:-1]
    first = np.flatnonzero(new)
    if most:
        length = np.diff(np.r_[first, n])
        if length.max(initial=0) > most:
            at = np.concatenate([np.arange(a, a + c, most) for a, c in zip(first, length)])
            first = at
    return first, np.diff(np.r_[first, n])


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for each run."""
    total = int(length.sum())
    return np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(total)


def removal_runs(texts: DataFrame, length: int = 20, gram: int = 6, piece: int = 1_000_000, bucket: int = 8 << 20) -> DataFrame:
    """(_key, payload) with packed runs of repeated windows: first window and their number. texts: _key, text."""
    ids = even_ids(texts.sparkSession, parts_for(texts, bucket))
    buckets = len(ids)

    def hashed(batches):
        held, size = [], 0

        def sent():
            key, start, window, inner = (np.concatenate(x) for x in zip(*held))
            if (key[1:] < key[:-1]).any():  # the earliest text comes first
                order = np.argsort(key, kind="stable")
                key, start, window, inner = key[order], start[order], window[order], inner[order]
            repeated = _later(window, inner)
            rows = []
            first, n = _runs(key[repeated], start[repeated], None, 0)
            if len(first):
                # Known already; they only pass, spread over the buckets by their key.
                k, s = key[repeated][first], start[repeated][first]
                rows += [(ids[b], b"\1" + _pieces([k[x], s[x].astype(np.uint32), n[x].astype(np.uint32)])) for b, x in _split((k % buckets).astype(np.int64))]
            key, start, window, inner = key[~repeated], start[~repeated], window[~repeated], inner[~repeated]
            first, n = _runs(key, start, inner)
            for b, x in _split((inner[first] % _U(buckets)).astype(np.int64)):
                body = window[_spread(first[x], n[x])]
                rows.append((ids[b], b"\0" + _pieces([key[first[x]], start[first[x]].astype(np.uint32), n[x].astype(np.uint8), inner[first[x]], body])))
            return _rows(rows)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, last, data, offsets in slices(batch.column(1)):
                starts, ends, first = word_spans(data, offsets)
                words = word_hashes(data, starts, ends)
                if len(words) < length:
                    continue
                ok = np.flatnonzero(starts_in_text(first, length))
                inner = sliding_min(windows(words, gram), length - gram + 1)
                doc = np.repeat(np.arange(row, last), np.diff(first))[ok]
                held.append((keys[doc], ok - first[doc - row], windows(words, length)[ok], inner[ok]))
                size += len(ok)
                if size >= piece:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def count(key, table):
        out_key, out_start, out_n, parts = [], [], [], []
        for p in table.column("payload"):
            raw = p.as_py()
            if raw[0]:
                k, s, n = _unpack(raw[1:], (np.int64, np.uint32, np.uint32))
                out_key.append(k)
                out_start.append(s.astype(np.int64))
                out_n.append(n.astype(np.int64))
            else:
                parts.append(_unpack(raw[1:], _RUN))
        if parts:
            k, s, n, inner, body = (np.concatenate(x) for x in zip(*parts))
            n = n.astype(np.int64)
            at = np.r_[0, np.cumsum(n)[:-1]]
            order = np.lexsort((s, k))  # the earliest window of a kind comes first
            repeated = _later(body[_spread(at[order], n[order])], np.repeat(inner[order], n[order]))
            key_of, start_of = np.repeat(k[order], n[order])[repeated], (np.repeat(s[order].astype(np.int64), n[order]) + _spread(np.zeros(len(order), np.int64), n[order]))[repeated]
            first, n = _runs(key_of, start_of, None, 0)
            out_key.append(key_of[first])
            out_start.append(start_of[first])
            out_n.append(n)
        k, s, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_key, out_start, out_n))
        return pa.table({"_key": pa.array(k, pa.int64()), "start": pa.array(s.astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    rows = texts.select("_key", "text").mapInArrow(hashed, "bucket long, payload binary")
    return rows.groupBy("bucket").applyInArrow(count, "_key long, start int, n int")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of the union."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    at = np.flatnonzero(new)
    return s[at], e[np.r_[at[1:] - 1, len(e) - 1]]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, kept_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, n_intervals, and kept_text if asked for."""
    keyed = with_key(plain(docs, id_col, text_col).toDF("doc_id", "text"), "doc_id", "substring-dedup")
    texts = keyed.select("_key", "doc_id", F.col("text").cast("string").alias("text"))
    # A text has no more runs than words, so its list is bounded by the text.
    runs = removal_runs(texts, length).groupBy("_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_intervals long" + ", kept_text string" * kept_text

    def cut(batches):
        for batch in batches:
            n_words, gone, digest, spans, kept = [], [], [], [], []
            lists = batch.column(2)
            for row, last, data, offsets in slices(batch.column(1)):
                starts, ends, first = word_spans(data, offsets)
                for i in range(row, last):
                    a, b = int(first[i - row]), int(first[i - row + 1])
                    keep = np.ones(b - a, bool)
                    n = 0
                    if lists[i].is_valid:
                        flat = lists[i].values
                        s = flat.field("start").to_numpy().astype(np.int64)
                        s, e = merged(s, s + flat.field("n").to_numpy() + (length - 1))
                        n = len(s)
                        for x, y in zip(s, e):
                            keep[x:y] = False
                    left = np.flatnonzero(keep) + a
                    text = data.tobytes() if last - row == 1 else bytes(data[offsets[i - row] : offsets[i - row + 1]])
                    base = 0 if last - row == 1 else int(offsets[i - row])
                    words = b" ".join([text[x:y] for x, y in zip((starts[left] - base).tolist(), (ends[left] - base).tolist())])
                    n_words.append(b - a)
                    gone.append(b - a - len(left))
                    digest.append(hashlib.sha256(words).hexdigest())
                    spans.append(n)
                    if kept_text:
                        kept.append(words.decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.int64())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals"]
            if kept_text:
                cols.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return texts.join(runs, "_key", "left").select("doc_id", "text", "runs").mapInArrow(cut, fields)


def brute(rows: list[tuple[int, str | None]], length: int = 20) -> dict[int, tuple[int, int, str]]:
    """The definition, for small inputs: id to (words, removed words, digest of the rest)."""
    import re

    seen: set[tuple[str, ...]] = set()
    out = {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        keep = [True] * len(words)
        for at in range(len(words) - length + 1):
            w = tuple(words[at : at + length])
            if w in seen:
                keep[at : at + length] = [False] * length
            seen.add(w)
        left = [w for w, k in zip(words, keep) if k]
        out[i] = (len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out
