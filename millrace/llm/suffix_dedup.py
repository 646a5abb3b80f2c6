"""Suffix-array dedup (operator 10): maximal repeats of bytes from the interval tree of an enhanced suffix array.

A byte goes if a string of `length` bytes that covers it starts anywhere else too.  Bytes that a shorter repeat of
`least` bytes covers stay, but are counted (`n_repeated`).  Strings never cross texts.

The suffix array is built where repeats can be, not over the whole corpus in one place:

1. Every window of `least` bytes has a smallest inner hash (of 32 bytes).  Neighbouring windows with the same one, at
   up to `group` different distances from it, are a run.  All windows of a run hold the same core bytes, so two windows
   can only be equal if their runs' cores are.  A run's content is all its windows' bytes and so many more that each
   window's string of `length` bytes is in it.  Equal contents of a piece of texts are one leaf with a number.
2. Cores meet in the bucket of their hash.  A core that is nowhere else holds no repeat.  Of equal contents one goes on,
   as a leaf that occurs more than once; a copy has its leaf's answer, which is that all of it repeats.
3. The different contents of a core, by their bytes, make an enhanced suffix array: suffixes in order, common prefixes
   of neighbours, and a stack scan over these that yields every interval of suffixes with a common prefix of `least`
   and more.  Intervals whose suffixes have different left neighbours are the maximal repeats, with all occurrences.
   Suffixes at a distance from the inner hash at which all contents have the same left neighbour begin none.
   A core in more than `crowd` different contents is first split by the next bytes: its runs are cut to an eighth and
   then to single windows, each with a longer core, for `least` and `length` apart.  So no task gets a group that grows
   with the corpus, and what the split leaves takes the same way through a suffix array.
4. The repeats of a text merge to maximal spans, which meet the text in one join on its key.

Cores, and the contents of each core, are named by Rabin-Karp sums of 61 bits.

Defined cases: null is the empty text.  Rows that repeat an id, or have none, are texts of their own.  Texts
shorter than a window lose nothing.  Texts of any length are taken whole; hashing goes by overlapping chunks of a
few MB.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import _BASE, even_ids, mix, parts_for, plain, prefix_hash, slices, span_hash, with_key, written
from millrace.llm.lm import _pieces, _rows, _split, _unpack
from millrace.llm.substring_dedup import _runs, merged, sliding_min

_U = np.uint64
_POSITION = 24  # bits of a position within a chunk
_CHUNK = 1 << 22
_GRAM = 32
#: core, content, key, start, windows, distance to the inner hash, bytes of the content, window, whether its piece has it again
_RUN = (_U, _U, np.int64, np.uint32, np.uint8, np.uint16, np.uint16, np.uint16, bool)
FOUND = "_key long, start long, n int, off int, size int, core long, state int, again boolean, window int"
COPY, LEAF, CROWDED = 0, 1, 2


class Level(NamedTuple):
    """How runs are cut: bytes of a window, bytes that a content holds from each window's start, windows of a run."""

    window: int
    content: int
    group: int


# ------------------------------------------------------------------------- enhanced suffix array


def suffix_array(parts: list[bytes], starts: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all parts, part i's from the positions starts[i]: (part, position) in order, and the length of the
    common prefix with the one before (0 if it is shorter than `least`)."""
    views, part, position = [], [], []
    for i, data in enumerate(parts):
        for at in starts[i]:
            views.append(data[at:])
            part.append(i)
            position.append(at)
    order = sorted(range(len(views)), key=views.__getitem__)
    lcp = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        a, b = views[order[k - 1]], views[order[k]]
        if a[:least] == b[:least] and len(a) >= least:
            lcp[k] = _common(a, b)
    return np.array(part, np.int64)[order], np.array(position, np.int64)[order], lcp


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first low bytes are equal, the first high are not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the tree with a common prefix of `least` or more."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # common prefix, first
    values = lcp.tolist()
    for at in range(1, len(values) + 1):
        value = values[at] if at < len(values) else 0
        if value < least:
            value = 0
        first = at - 1
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            out.append((top, first, at - 1))
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return out


def beginnings(parts: list[bytes], n: np.ndarray, off: np.ndarray) -> list:
    """The positions of each part, of the first n, where a maximal repeat can begin: at a distance from the inner hash
    (off - position) at which some part begins, or the parts' left neighbours differ."""
    size = int(off.max()) + 1
    low, high, need = np.full(size, 255, np.uint8), np.zeros(size, np.uint8), np.zeros(size, bool)
    need[off] = True
    left = np.frombuffer(b"".join([p[: k - 1] for p, k in zip(parts, n.tolist())]), np.uint8)
    far = np.concatenate([np.arange(o - 1, o - k, -1) for o, k in zip(off.tolist(), n.tolist())])
    np.minimum.at(low, far, left)
    np.maximum.at(high, far, left)
    need |= low < high
    return [np.flatnonzero(need[o - k + 1 : o + 1][::-1]).tolist() for o, k in zip(off.tolist(), n.tolist())]


def maximal_repeats(parts: list[bytes], least: int, starts: list | None = None, again: list[bool] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal strings that no byte more to either side keeps equal: (length, all (part, position)).
    again: parts that occur more than once; their suffixes are intervals by themselves."""
    starts = [range(len(p)) for p in parts] if starts is None else starts
    again = [False] * len(parts) if again is None else again
    part, position, lcp = suffix_array(parts, starts, least)
    intervals = lcp_intervals(lcp, least)
    after = np.r_[lcp[1:], 0]
    for k in range(len(part)):
        size = len(parts[part[k]]) - int(position[k])
        if again[part[k]] and size >= least and size > max(lcp[k], after[k]):
            intervals.append((size, k, k))
    groups = []
    for length, first, last in intervals:
        # What is left of a part's beginning is not known, and may differ.
        left = {-1 - k if not position[k] else parts[part[k]][position[k] - 1] for k in range(first, last + 1)}
        if len(left) > 1 or min(left) < 0:
            groups.append((length, [(int(part[k]), int(position[k])) for k in range(first, last + 1)]))
    return groups


# ------------------------------------------------------------------------- runs of windows


def _chunks(texts: pa.Array, reach: int):
    """(row, where the chunk begins in its text, bytes, offsets, starts below which windows count) of every text; long
    texts in chunks that overlap by `reach`."""
    for row, last, data, offsets in slices(texts):
        if last - row == 1 and len(data) > _CHUNK:
            for at in range(0, len(data), _CHUNK):
                piece = data[at : at + _CHUNK + reach]
                yield row, at, piece, np.array([0, len(piece)]), _CHUNK
        else:
            yield row, 0, data, offsets, len(data)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of every 32 bytes, from those of its four words."""
    data = np.ascontiguousarray(data)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) * _U(0xFF51AFD7ED558CCD)
    words ^= words >> _U(32)
    n = len(data) - _GRAM + 1
    out = words[:n] * _U(0x9E3779B97F4A7C15)
    for at, by in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x9FB21C651E98DF25), (24, 0xD1B54A32D192ED03)):
        out += words[at : at + n] * _U(by)
    out ^= out >> _U(29)
    out *= _U(0xBF58476D1CE4E5B9)
    return out


def _named(data: np.ndarray, s: np.ndarray, n: np.ndarray, off: np.ndarray, end: np.ndarray, level: Level, prefix=None):
    """(content bytes, core hash, content hash) of runs. off: from a run's first window to its inner hash; end: of its text."""
    step = off // level.group
    a = s + off - level.group * step
    prefix = prefix_hash(data, _BASE) if prefix is None else prefix
    core = mix(span_hash(prefix, a, a - level.group + 1 + level.window, _BASE) + (step << 20 | level.window).astype(_U) * _U(0x9FB21C651E98DF25))
    e = np.minimum(s + n - 1 + level.content, end)
    content = mix(span_hash(prefix, s, e, _BASE) + off.astype(_U) * _U(0xD1B54A32D192ED03) + (n << 16 | e - s).astype(_U))
    return e - s, core, content


def runs_of(data: np.ndarray, offsets: np.ndarray, limit: int, level: Level):
    """(text, start in the chunk, windows, distance to the inner hash, content bytes, core hash, content hash) of every run."""
    if len(data) < level.window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, _U, _U))
    # The position in the low bits gives the leftmost of equal hashes.
    hashed = grams(data)
    ranked = (hashed >> _U(_POSITION) << _U(_POSITION)) | np.arange(len(hashed), dtype=_U)
    place = (sliding_min(ranked, level.window - _GRAM + 1) & _U((1 << _POSITION) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    start = np.arange(len(place))
    ok = np.flatnonzero((start + level.window <= offsets[text + 1]) & (start < limit))
    place, text, start = place[ok], text[ok], start[ok]
    first, n = _runs(text, start, (place.astype(_U) << _U(20)) | ((place - start) // level.group).astype(_U), 0)
    s, off, text = start[first], (place - start)[first], text[first]
    return text, s, n, off, *_named(data, s, n, off, offsets[text + 1], level)


def shorter_runs(data: np.ndarray, s: np.ndarray, n: np.ndarray, off: np.ndarray, level: Level, prefix):
    """The runs of a text cut to those of a finer level: (start, windows, distance, content bytes, core, content)."""
    at = np.concatenate([np.arange(x) for x in n])
    run = np.repeat(np.arange(len(n)), n)
    start, far = s[run] + at, off[run] - at
    ok = np.flatnonzero(start + level.window <= len(data))
    run, start, far = run[ok], start[ok], far[ok]
    first, n = _runs(run, start, (far // level.group).astype(_U), 0)
    s, off = start[first], far[first]
    return s, n, off, *_named(data, s, n, off, np.full(len(s), len(data)), level, prefix)


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (a, b), and in it where a new a and a new (a, b) begin."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new_a = np.r_[True, x[1:] != x[:-1]]
    return order, new_a, new_a | np.r_[True, y[1:] != y[:-1]]


def _sent(held: list[tuple], ids: np.ndarray) -> pa.RecordBatch:
    """A piece's runs by bucket: one of equal contents, and where the others are, which need no bucket of their own."""
    core, content, key, start, n, off, size, window = (np.concatenate(x) for x in zip(*held))
    order, _, new = _same(core, content)
    of, one = np.cumsum(new) - 1, order[new]
    copies, rows = order[~new], []
    if len(copies):
        rows += [(ids[b], b"\1" + _pieces([key[x], start[x].astype(np.uint32), size[x].astype(np.uint16)])) for b, x in ((b, copies[i]) for b, i in _split(key[copies] % len(ids)))]
    again = (np.bincount(of) > 1)[of[new]]
    for b, x in _split((core[one] % _U(len(ids))).astype(np.int64)):
        i = one[x]
        rows.append((ids[b], b"\0" + _pieces([core[i], content[i], key[i], start[i].astype(np.uint32), n[i].astype(np.uint8), off[i].astype(np.uint16), size[i].astype(np.uint16), window[i].astype(np.uint16), again[x]])))
    return _rows(rows)


def _judged(rows: DataFrame, crowd: int, group: int) -> DataFrame:
    """FOUND of the packed runs: copies, leaves for a suffix array, and crowded cores' runs."""

    def judge(key, table):
        out, parts = [], []
        for p in table.column("payload"):
            raw = p.as_py()
            if raw[0]:
                k, s, size = _unpack(raw[1:], (np.int64, np.uint32, np.uint16))
                none = np.zeros(len(k), np.int64)
                out.append((k, s, none, none, size, none, none, none > 0, none))
            else:
                parts.append(_unpack(raw[1:], _RUN))
        if parts:
            core, content, k, s, n, off, size, window, again = (np.concatenate(x) for x in zip(*parts))
            order, new_core, new = _same(core, content)
            of, of_core = np.cumsum(new) - 1, np.cumsum(new_core) - 1
            leaf = np.flatnonzero(new)
            twice = (np.bincount(of) > 1) | np.logical_or.reduceat(again[order], leaf)
            kinds = np.bincount(of_core[new])
            repeated = (kinds > 1) | np.logical_or.reduceat(twice, np.flatnonzero(new_core[new]))
            state = np.where(kinds > crowd, CROWDED if group > 1 else LEAF, LEAF)
            i = order[~new]
            none = np.zeros(len(i), np.int64)
            out.append((k[i], s[i], none, none, size[i], none, none, none > 0, none))
            ok = repeated[of_core[leaf]]
            i, c = order[leaf][ok], of_core[leaf][ok]
            out.append((k[i], s[i], n[i], off[i], size[i], core[i].view(np.int64), state[c], twice[ok], window[i]))
            # A crowded content that occurs again repeats as a whole; its windows still are partners for others.
            i = i[(state[c] == CROWDED) & twice[ok]]
            none = np.zeros(len(i), np.int64)
            out.append((k[i], s[i], none, none, size[i], none, none, none > 0, none))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32())
        cols = [np.concatenate(x) for x in zip(*out)] if out else [[]] * len(kinds)
        names = ("_key", "start", "n", "off", "size", "core", "state", "again", "window")
        return pa.table({name: pa.array(c, pa.bool_()) if t == pa.bool_() else pa.array(np.asarray(c, np.int64)).cast(t) for name, c, t in zip(names, cols, kinds)})

    return rows.groupBy("bucket").applyInArrow(judge, FOUND)


def find_runs(texts: DataFrame, level: Level, crowd: int, piece: int, bucket: int) -> DataFrame:
    """FOUND of all texts' runs that can hold repeats. texts: _key, text."""
    ids = even_ids(texts.sparkSession, parts_for(texts, bucket))

    def hashed(batches):
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, at, data, offsets, limit in _chunks(batch.column(1), level.content):
                text, start, n, off, content_size, core, content = runs_of(data, offsets, limit, level)
                if len(text):
                    held.append((core, content, keys[row + text], at + start - offsets[text], n, off, content_size, np.zeros(len(text), np.int64)))
                    size += len(text)
                if size >= piece:
                    yield _sent(held, ids)
                    held, size = [], 0
        if size:
            yield _sent(held, ids)

    return _judged(texts.select("_key", "text").mapInArrow(hashed, "bucket long, payload binary"), crowd, level.group)


def split_runs(packed: DataFrame, crowded: DataFrame, windows: list[int], group: int, crowd: int, piece: int, bucket: int) -> DataFrame:
    """FOUND of the crowded runs, cut to a finer level, of each window or the one that they are of already.
    packed: _key, packed; crowded: FOUND."""
    ids = even_ids(packed.sparkSession, parts_for(packed, bucket))
    wanted = crowded.groupBy("_key").agg(F.collect_list(F.struct("start", "n", "off", "window")).alias("runs"))

    def hashed(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        held, size = [], 0
        for batch in batches:
            for key, data, runs in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = np.frombuffer(unzip.decompress(data.as_py()), np.uint8)
                s, n, off, window = (runs.values.field(f).to_numpy().astype(np.int64) for f in ("start", "n", "off", "window"))
                prefix = prefix_hash(data, _BASE)
                for w in windows:
                    x = np.flatnonzero((window == 0) | (window == w))
                    if not len(x):
                        continue
                    start, many, far, content_size, core, content = shorter_runs(data, s[x], n[x], off[x], Level(w, w, group), prefix)
                    if len(start):
                        held.append((core, content, np.full(len(start), key.as_py(), np.int64), start, many, far, content_size, np.full(len(start), w)))
                        size += len(start)
                if size >= piece:
                    yield _sent(held, ids)
                    held, size = [], 0
        if size:
            yield _sent(held, ids)

    rows = packed.join(wanted, "_key").select("_key", "packed", "runs").mapInArrow(hashed, "bucket long, payload binary")
    return _judged(rows, crowd, group)


def array_repeats(packed: DataFrame, leaves: DataFrame, least: int, bucket: int, groups: bool = False) -> DataFrame:
    """(_key, start, size) of the repeats that the suffix arrays of the leaves' cores give, longest first at each start;
    with groups, (repeat, size, _key, start) of every maximal repeat and all the leaves' occurrences.
    packed: _key, packed; leaves: FOUND."""
    ids = even_ids(packed.sparkSession, parts_for(packed, bucket))
    wanted = leaves.groupBy("_key").agg(F.collect_list(F.struct("start", "n", "size", "core", "again", "off")).alias("runs"))

    def fetch(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        by_bucket: dict[int, list] = {}
        held = 0

        def sent():
            rows = []
            for b, own in by_bucket.items():
                about = np.array([x[:7] for x in own], np.int64)
                rows.append((ids[b], _pieces([about.ravel(), np.frombuffer(b"".join(x[7] for x in own), np.uint8)])))
            by_bucket.clear()
            return _rows(rows)

        for batch in batches:
            for key, data, runs in zip(batch.column(0), batch.column(1), batch.column(2)):
                data, key, flat = unzip.decompress(data.as_py()), key.as_py(), runs.values
                for s, n, size, core, again, off in zip(*(flat.field(f).to_pylist() for f in ("start", "n", "size", "core", "again", "off"))):
                    by_bucket.setdefault((core & 0x7FFFFFFFFFFFFFFF) % len(ids), []).append((key, s, n, size, core, again, off, data[s : s + size]))
                    held += size
                if held >= bucket:
                    yield sent()
                    held = 0
        if held:
            yield sent()

    def array(key, table):
        places, parts = [], []
        for p in table.column("payload"):
            about, body = _unpack(p.as_py(), (np.int64, np.uint8))
            about, body = about.reshape(-1, 7), body.tobytes()
            ends = np.cumsum(about[:, 3])
            parts += [body[e - n : e] for e, n in zip(ends.tolist(), about[:, 3].tolist())]
            places.append(about)
        places = np.concatenate(places)
        out: tuple[list, ...] = ([], [], [], [])
        # One array for each core: equal windows have equal cores.
        for core, own in _split(places[:, 4]):
            longest: dict[tuple[int, int], int] = {}
            if len(own) == 1 and not groups:
                longest[0, 0] = len(parts[own[0]])  # the tree of one leaf that occurs again
                found = []
            else:
                contents = [parts[i] for i in own]
                found = maximal_repeats(contents, least, beginnings(contents, places[own, 2], places[own, 6]), (places[own, 5] > 0).tolist())
            for number, (size, where) in enumerate(found):
                for part, position in where:
                    if groups:
                        k, s = places[own[part], :2].tolist()
                        for column, v in zip(out, (k, s + position, size, f"{core & 0xFFFFFFFFFFFFFFFF:016x}-{number}")):
                            column.append(v)
                    elif size > longest.get((part, position), 0):
                        longest[part, position] = size
            for (part, position), size in longest.items():
                k, s = places[own[part], :2].tolist()
                for column, v in zip(out, (k, s + position, size)):
                    column.append(v)
        cols = {"_key": pa.array(out[0], pa.int64()), "start": pa.array(out[1], pa.int64()), "size": pa.array(out[2], pa.int32())}
        return pa.table(cols | ({"repeat": pa.array(out[3], pa.string())} if groups else {}))

    rows = packed.join(wanted, "_key").select("_key", "packed", "runs").mapInArrow(fetch, "bucket long, payload binary")
    return rows.groupBy("bucket").applyInArrow(array, "_key long, start long, size int" + ", repeat string" * groups)


def packed_texts(texts: DataFrame) -> DataFrame:
    """_key, doc_id, and the text's bytes compressed: they are shuffled twice."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zstandard

        zipped = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [zipped.compress((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["_key", "doc_id", "packed"])

    return texts.select("_key", "doc_id", "text").mapInArrow(run, f"_key long, doc_id {kind}, packed binary")


def _found(texts: DataFrame, length: int, least: int, group: int, crowd: int, piece: int, bucket: int) -> list[DataFrame]:
    """Written FOUND tables of all levels, without crowded runs."""
    tables = [written(find_runs(texts, Level(least, length, group), crowd, piece, bucket), "suffix-runs")]
    while group > 1 and not (crowded := tables[-1].where(f"state = {CROWDED}")).isEmpty():
        group = max(1, group // 8)
        tables.append(written(split_runs(packed_texts(texts), crowded, sorted({least, length}), group, crowd, piece, bucket), "suffix-runs"))
    return tables


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = with_key(plain(docs, id_col, text_col).toDF("doc_id", "text"), "doc_id", "suffix-dedup")
    return keyed.select("_key", "doc_id", F.col("text").cast("string").alias("text"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, group: int = 64, crowd: int = 2000, piece: int = 400_000, bucket: int = 8 << 20) -> DataFrame:
    """Maximal repeats with their occurrences: repeat (a name), size, doc_id, start.  A repeat is as long as the contents
    it is found in reach, so a longer one is several that overlap.  Copies of a content count for its leaf: the leaf
    is listed, with `again`."""
    texts = _texts(docs, id_col, text_col)
    leaves = _union(_found(texts, length, length, group, crowd, piece, bucket)).where(f"state = {LEAF}")
    found = array_repeats(packed_texts(texts), leaves, length, bucket, groups=True)
    return found.join(texts.select("_key", "doc_id"), "_key").select("repeat", "size", "doc_id", "start")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, least: int = 200, group: int = 64, crowd: int = 2000, piece: int = 400_000, bucket: int = 8 << 20) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated."""
    texts = _texts(docs, id_col, text_col)
    found = _union(_found(texts, length, min(least, length), group, crowd, piece, bucket))
    packed = packed_texts(texts)
    more = array_repeats(packed, found.where(f"state = {LEAF}"), min(least, length), bucket)
    repeats = found.where(f"state = {COPY}").select("_key", "start", "size").unionByName(more)
    spans = repeats.groupBy("_key").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            n_bytes, gone, n_spans, digest, repeated = [], [], [], [], []
            for packed, runs in zip(batch.column(1), batch.column(2)):
                data = unzip.decompress(packed.as_py())
                kept, last, count, seen = hashlib.sha256(), 0, 0, 0
                left = 0
                if runs.is_valid:
                    flat = runs.values
                    s, size = flat.field("start").to_numpy().astype(np.int64), flat.field("size").to_numpy().astype(np.int64)
                    a, b = merged(s, s + size)
                    seen = int((b - a).sum())
                    long = size >= length
                    s, e = merged(s[long], (s + size)[long])
                    count = len(s)
                    for a, b in zip(s.tolist(), e.tolist()):
                        kept.update(data[last:a])
                        left += a - last
                        last = b
                kept.update(data[last:])
                left += len(data) - last
                n_bytes.append(len(data))
                gone.append(len(data) - left)
                n_spans.append(count)
                digest.append(kept.hexdigest())
                repeated.append(seen)
            cols = [pa.array(x, pa.int64()) for x in (n_bytes, gone, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(digest, pa.string()), pa.array(repeated, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])

    return packed.join(spans, "_key", "left").select("doc_id", "packed", "runs").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")


def brute(rows: list[tuple[int, str | None]], length: int = 400, least: int = 200) -> dict[int, tuple[int, int, int, str, int]]:
    """The definition, for small inputs: id to (bytes, removed bytes, spans, digest of the rest, bytes in shorter repeats)."""
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in rows]

    def kept(n):
        seen = Counter(t[a : a + n] for _, t in texts for a in range(len(t) - n + 1))
        for i, t in texts:
            keep = np.ones(len(t), bool)
            for a in range(len(t) - n + 1):
                if seen[t[a : a + n]] > 1:
                    keep[a : a + n] = False
            yield i, t, keep

    out = {}
    for (i, t, keep), (_, _, short) in zip(kept(length), kept(least)):
        gone = ~keep
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[keep].tobytes()).hexdigest(), int((~short).sum()))
    return out
