"""N-gram Jaccard join (operator 1): a MinHash LSH forest with adaptive prefixes, then exact verification.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; shingles are five words (a text of one to four words is one
shingle).  Two texts are linked if the Jaccard similarity of their shingle sets is at least `similarity`.

1. Each text gets the hash of its shingle set and a signature of trees x depth MinHash values.  Texts with one and
   the same set are one class, named by its smallest key; from here on only class representatives are looked at.
2. Each of the `trees` parts of a signature is a way down a prefix trie of `depth` levels.  A text's prefixes are
   shortened from the full depth, tree by tree, until the wanted recall is reached: down to the length at which all
   trees together find a pair of the wanted similarity with a chance well over `recall`, but less far in the trees
   where the text's next shorter prefix is crowded (more than `group` texts), the most crowded first, as long as the
   chance stays at least `recall` for every pair (each of two texts may spend half of what is to spare).  Within a
   prefix group every pair is a candidate: it is tied unless the whole signatures rule the similarity out.  Pairs that
   other ties join already are skipped, and one tie for each text leaves.  A group of more than `group` texts meets as
   pairs of blocks.
3. Tied texts form candidate sets.  The texts of a set meet, in blocks of at most `block`, and all their pairs are
   verified by the exact shingle sets with a matrix product.  Only a row for each text leaves: its number of links and
   the smallest text it is linked with.  A larger set meets as pairs of blocks, so no task gets it whole.
4. Verified links give the groups.

Links between different texts are counted for the representative of each class; copies share the class's links.

Defined cases: null is empty.  A text without words is linked with nothing and is a group alone, its class too.  Rows
that repeat an id, or have none, are texts of their own.  Empty tables give no rows.  Further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import _LOWER, _WORD_BASE, even_ids, free_name, mix, parts_for, plain, prefix_hash, release, slices, span_hash, starts_in_text, windows, with_key, word_hashes, word_spans, written
from millrace.llm.components import components
from millrace.llm.lm import _added, _pieces, _rows, _split, _unpack
from millrace.llm.substring_dedup import _spread

_U = np.uint64


@dataclass(frozen=True)
class Forest:
    similarity: float = 0.8
    gram: int = 5
    trees: int = 16
    depth: int = 6
    recall: float = 0.999
    next: int = 2  # sets are joined after each of so many next ones in a trie's order, then ever more seldom (work only)
    slack: float = 0.16  # four standard deviations of the signatures' estimate
    piece: int = 20_000
    block: int = 512
    group: int = 2048  # a larger prefix group meets as pairs of blocks of about so many texts
    bucket: int = 8 << 20
    most: int = 1_000_000  # crowded prefixes of a level that the driver and every task may hold

    @property
    def shortest(self) -> int:
        """The longest prefix that reaches the recall, if used in all trees."""
        reach = [k for k in range(1, self.depth + 1) if 1 - (1 - self.similarity**k) ** self.trees >= self.recall]
        return max(reach, default=1)

    def missed(self, k: int) -> float:
        """The logarithm of the chance that a pair of the wanted similarity shares no prefix of k values in one tree."""
        return math.log1p(-(self.similarity**k))

    @property
    def spare(self) -> float:
        """What one text may give away: half of what its shortest prefixes reach beyond the recall."""
        return max(0.0, (math.log1p(-self.recall) - self.trees * self.missed(self.shortest)) / 2)


def shingle_sets(texts: pa.Array, gram: int):
    """(first row, sorted distinct shingle hashes of each text, one after the other, number of each) by slice."""
    for row, last, data, offsets in slices(texts):
        data = _LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        n = np.diff(first)
        whole = windows(words, gram)[starts_in_text(first, gram)] if len(words) >= gram else np.zeros(0, _U)
        doc = np.repeat(np.arange(last - row), np.maximum(n - gram + 1, 0))
        short = np.flatnonzero((n > 0) & (n < gram))
        if len(short):
            single = mix(span_hash(prefix_hash(words >> _U(3), _WORD_BASE), first[short], first[short + 1], _WORD_BASE) + n[short].astype(_U))
            whole, doc = np.r_[whole, single], np.r_[doc, short]
        order = np.lexsort((whole, doc))
        whole, doc = whole[order], doc[order]
        new = np.ones(len(whole), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])
        yield row, whole[new], np.bincount(doc[new], minlength=last - row)


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of each set; the sets must not be empty."""
    rng = np.random.default_rng(20240101)
    a, b = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    low, high = hashes.astype(np.uint32), (hashes >> _U(32)).astype(np.uint32)
    at = np.r_[0, np.cumsum(counts)[:-1]]
    out = np.empty((len(counts), n), np.uint32)
    for i in range(n):
        x = low * a[i]
        x ^= high + b[i]
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(x, at)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            break
    return root


def _ties(prefix: np.ndarray, rest: np.ndarray, small: np.ndarray, member: np.ndarray, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """The sets that ties of all pairs within prefix groups make: each member of one but its smallest, and that smallest.
    small: a byte of each MinHash value, by member. Pairs of one set already are not looked at again."""
    order = np.lexsort((member, rest, prefix))
    p, m = prefix[order], member[order]
    n, width = len(p), small.shape[1]
    root = np.arange(len(small))
    left, right = [], []
    if n < 2:
        return root[:0], root[:0]

    def tie(a, b):
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            share = (small[x] == small[y]).sum(1) / width
            ok = (share - 1 / 256) / (1 - 1 / 256) >= f.similarity - f.slack
            left.append(x[ok])
            right.append(y[ok])

    def joined():
        if not left:
            return root
        new = _roots(len(small), np.concatenate([root_of[0], *left]), np.concatenate([root_of[1], *right]))
        left.clear()
        right.clear()
        inner = np.flatnonzero(new != np.arange(len(new)))
        root_of[:] = [inner, new[inner]]
        return new

    root_of = [root[:0], root[:0]]
    new = np.r_[True, p[1:] != p[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], n][np.cumsum(new) - 1] - 1
    first = first[np.cumsum(new) - 1]
    # The group's first and the next ones, which make most sets; then every pair that these left apart.
    i = np.flatnonzero(np.arange(n) > first)
    tie(m[first[i]], m[i])
    at, due = np.flatnonzero(np.arange(n) < last), 1
    for step in range(1, int((last - first).max()) + 1):
        at = at[at + step <= last[at]]
        if step <= f.next or step >= due:
            root, due = joined(), 2 * step
        a, b = m[at], m[at + step]
        apart = root[a] != root[b]
        if apart.any():
            tie(a[apart], b[apart])
    joined()
    return root_of[0], root_of[1]


def sketch(texts: DataFrame, f: Forest) -> DataFrame:
    """(_key, n, one, two, sig): size, two hashes of the shingle set, signature. texts: _key, text."""
    width = f.trees * f.depth

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, hashes, n in shingle_sets(batch.column(1), f.gram):
                full = np.flatnonzero(n)
                at = np.r_[0, np.cumsum(n[full])[:-1]].astype(np.int64)
                one, two = np.zeros(len(n), _U), np.zeros(len(n), _U)
                sig: list[bytes | None] = [None] * len(n)
                if len(full):
                    one[full] = np.add.reduceat(hashes, at)
                    two[full] = np.add.reduceat(mix(hashes ^ _U(0xABCDEF1234567)), at)
                    values = signatures(hashes, n[full], width)
                    for i, v in zip(full, values):
                        sig[i] = v.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(keys[row : row + len(n)], pa.int64()), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sig, pa.binary())], ["_key", "n", "one", "two", "sig"])

    return texts.select("_key", "text").mapInArrow(run, "_key long, n long, one long, two long, sig binary")


def _labels(sig: np.ndarray, tree: int, level: int, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of `level` values of each text in a tree, and the values after it, which order a group."""
    own = sig[:, tree * f.depth : (tree + 1) * f.depth].astype(_U)
    prefix = np.full(len(sig), (level << 32) + tree + 1, _U)
    for k in range(level):
        prefix = mix(prefix * _U(0x9E3779B97F4A7C15) + own[:, k])
    rest = np.zeros(len(sig), _U)
    for k in range(level, min(f.depth, level + 2)):
        rest = rest << _U(32) | own[:, k]
    return prefix, rest


def _held(batches, f: Forest):
    """Pieces of (keys, signatures)."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, f.trees * f.depth)))
            size += batch.num_rows
        if size >= f.piece:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, size = [], 0
    if size:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


class Crowds(NamedTuple):
    """Prefixes, sorted, that more than `group` texts share, and how many."""

    prefix: np.ndarray
    size: np.ndarray
    group: int

    def sizes(self, prefix: np.ndarray) -> np.ndarray:
        """The number of texts that share each prefix, 0 if it is not crowded."""
        if not len(self.prefix):
            return np.zeros(len(prefix), np.int64)
        at = np.minimum(np.searchsorted(self.prefix, prefix), len(self.prefix) - 1)
        return np.where(self.prefix[at] == prefix, self.size[at], 0)


def crowds(sketched: DataFrame, f: Forest, level: int, within: Crowds | None) -> Crowds:
    """The crowded prefixes of a level; only those under `within`'s are looked at. What the driver gets is bounded: if
    there are more than `most`, `group` is doubled, and the groups it no longer splits are met by one task.
    sketched: _key, sig."""
    ids = even_ids(sketched.sparkSession, parts_for(sketched, f.bucket))

    def count(batches):
        for _, sig in _held(batches, f):
            held = []
            for t in range(f.trees):
                own = sig if within is None else sig[within.sizes(_labels(sig, t, level - 1, f)[0]) > 0]
                held.append(_labels(own, t, level, f)[0])
            prefixes, n = np.unique(np.concatenate(held), return_counts=True)
            yield _rows([(ids[b], _pieces([prefixes[x], n[x].astype(np.uint32)])) for b, x in _split((prefixes % _U(len(ids))).astype(np.int64))])

    def add(key, table):
        parts = [_unpack(p.as_py(), (_U, np.uint32)) for p in table.column("payload")]
        prefixes, n = _added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
        large = n > f.group
        return pa.table({"prefix": pa.array(prefixes[large].view(np.int64)), "n": pa.array(n[large])})

    if within is not None and not len(within.prefix):
        return Crowds(np.zeros(0, _U), np.zeros(0, np.int64), f.group)
    found = written(sketched.select("_key", "sig").mapInArrow(count, "bucket long, payload binary").groupBy("bucket").applyInArrow(add, "prefix long, n long"), "crowds")
    group = f.group
    while found.where(F.col("n") > group).count() > f.most:
        group *= 2
    rows = found.where(F.col("n") > group).collect()
    release(found)
    prefixes, n = np.array([r["prefix"] for r in rows], np.int64).view(_U), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(prefixes)
    return Crowds(prefixes[order], n[order], group)


def levels(sig: np.ndarray, crowded: list[Crowds], f: Forest) -> np.ndarray:
    """The prefix length of each text in each tree. crowded: by level, from the shortest."""
    n = len(sig)
    out, spare = np.full((n, f.trees), f.shortest), np.full(n, f.spare)
    if not crowded or not len(crowded[0].prefix):
        return out
    sizes = np.stack([crowded[0].sizes(_labels(sig, t, f.shortest, f)[0]) for t in range(f.trees)], axis=1)
    # How far down each tree stays crowded is how long the text wants its prefix there.
    wish = (sizes > 0).astype(np.int64)
    for step, crowd in enumerate(crowded[1:], 1):
        for t in np.flatnonzero((wish == step).any(0)):
            wish[:, t] += (wish[:, t] == step) & (crowd.sizes(_labels(sig, t, f.shortest + step, f)[0]) > 0)
    cost = np.array([f.missed(f.shortest + k) - f.missed(f.shortest) for k in range(f.depth - f.shortest + 1)])
    order = np.argsort(-sizes, axis=1, kind="stable")
    row = np.arange(n)
    for rank in range(f.trees):
        t = order[:, rank]
        want = np.minimum(wish[row, t], f.depth - f.shortest)
        while (over := (cost[want] > spare) & (want > 0)).any():
            want = want - over
        spare -= cost[want]
        out[row, t] = f.shortest + want
    return out


def candidate_ties(sketched: DataFrame, f: Forest) -> DataFrame:
    """(a, b): texts of one set of tied ones, each with the smallest that its bucket knows. sketched: _key, sig of class
    representatives."""
    ids = even_ids(sketched.sparkSession, parts_for(sketched, f.bucket))
    buckets = len(ids)
    width = f.trees * f.depth
    crowded: list[Crowds] = []
    for level in range(f.shortest, f.depth + 1):
        crowded.append(crowds(sketched, f, level, crowded[-1] if crowded else None))
    shared = sketched.sparkSession.sparkContext.broadcast(crowded)

    def meetings(prefix, keys, crowd):
        """(index, label): a text of a large group goes to the meetings of its block with each other block."""
        blocks = -(-crowd.sizes(prefix) // crowd.group)
        i = np.flatnonzero(blocks)
        index, label = [np.flatnonzero(blocks == 0)], [prefix[blocks == 0]]
        of = blocks[i]
        own = (mix(keys[i].view(_U)) % of.astype(_U)).astype(np.int64) if len(i) else i
        for other in range(int(of.max()) if len(i) else 0):
            x = np.flatnonzero((other < of) & ((other != own) | (of == 1)))
            low, high = np.minimum(own[x], other).astype(_U), np.maximum(own[x], other).astype(_U)
            index.append(i[x])
            label.append(mix(prefix[i[x]] ^ mix(low << _U(32) | high)))
        return np.concatenate(index), np.concatenate(label)

    def deal(batches):
        crowded = shared.value
        for keys, sig in _held(batches, f):
            small = sig.astype(np.uint8)
            joined: dict[int, list[bytes]] = {}
            stops = levels(sig, crowded, f)
            for t in range(f.trees):
                # A text that stays at a crowded prefix also meets those there that went for a longer one.
                above = crowded[0].sizes(_labels(sig, t, f.shortest, f)[0]) > 0
                for level in range(f.shortest, f.depth + 1):
                    member = np.flatnonzero((stops[:, t] == level) | (above & (stops[:, t] < level)))
                    if not len(member):
                        continue
                    prefix, rest = _labels(sig[member], t, level, f)
                    index, label = meetings(prefix, keys[member], crowded[level - f.shortest])
                    if level < f.depth:
                        above[member] &= crowded[level - f.shortest].sizes(prefix) > 0
                    for b, x in _split((label % _U(buckets)).astype(np.int64)):
                        i = member[index[x]]
                        joined.setdefault(b, []).append(_pieces([label[x], rest[index[x]], keys[i], small[i].ravel()]))
            # A bucket's pieces of all trees travel as one row.
            yield _rows([(ids[b], _pieces([np.frombuffer(x, np.uint8) for x in parts])) for b, parts in joined.items()])

    def across(key, table):
        parts = []
        for p in table.column("payload"):
            raw = p.as_py()
            for one in _unpack(raw, (np.uint8,) * int(np.frombuffer(raw, np.int64, 1)[0])):
                parts.append(_unpack(one.tobytes(), (_U, _U, np.int64, np.uint8)))
        label, rest, keys = (np.concatenate([p[i] for p in parts]) for i in range(3))
        # A label that one text has ties nothing.
        order = np.argsort(label, kind="stable")
        same = label[order][1:] == label[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        if not len(order):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        small = np.concatenate([p[3].reshape(-1, width) for p in parts])
        names, where, member = np.unique(keys[order], return_index=True, return_inverse=True)
        x, y = _ties(label[order], rest[order], small[order[where]], member, f)
        return pa.table({"a": pa.array(names[x], pa.int64()), "b": pa.array(names[y], pa.int64())})

    return sketched.select("_key", "sig").mapInArrow(deal, "bucket long, payload binary").groupBy("bucket").applyInArrow(across, "a long, b long")


def overlaps(sets: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections, by matrix products over columns of shingles that several sets hold."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    of = np.cumsum(new) - 1
    size = np.bincount(of)
    shared = size[of] > 1
    owner, of = owner[shared], np.cumsum(size > 1)[of[shared]] - 1
    columns = int(of[-1]) + 1 if len(of) else 0
    each = max(1, most // n)
    for at in range(0, columns, each):
        low, high = np.searchsorted(of, [at, at + each])
        grid = np.zeros((n, min(each, columns - at)), np.float32)
        grid[owner[low:high], of[low:high] - at] = 1
        out += grid @ grid.T
    return out


def verify(texts: DataFrame, sets_of: DataFrame, f: Forest) -> DataFrame:
    """(_key, links, least, whole): for each text of a candidate set, by block pair: its verified links, the smallest
    text it is connected with there, whether the set was one block. sets_of: _key, component, size."""
    buckets = parts_for(texts, f.bucket)
    placed = sets_of.select(
        "_key",
        "component",
        F.greatest(F.lit(1), F.ceil(F.col("size") / f.block)).cast("int").alias("blocks"),
    ).withColumn("own", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int"))

    def fetch(batches):
        for batch in batches:
            keys, component, own, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for row, hashes, n in shingle_sets(batch.column(1), f.gram):
                ends = np.cumsum(n)
                for i, (end, count) in enumerate(zip(ends, n)):
                    r = row + i
                    body = hashes[end - count : end].tobytes()
                    for other in range(int(blocks[r])):
                        x, y = min(other, int(own[r])), max(other, int(own[r]))
                        for column, v in zip(out, (int(hash((int(component[r]), x, y)) % buckets), int(component[r]), x, y, int(keys[r]), int(own[r]), body)):
                            column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["bucket", "component", "x", "y", "_key", "own", "body"])

    def compare(key, table):
        component, x, y, keys, own = (table.column(c).to_numpy() for c in ("component", "x", "y", "_key", "own"))
        bodies = table.column("body").combine_chunks()
        out_key, out_links, out_least = [], [], []
        order = np.lexsort((keys, y, x, component))
        c, u, v = component[order], x[order], y[order]
        new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        for i in np.split(order, new[1:]):
            sets = [np.frombuffer(bodies[int(k)].as_buffer(), _U) for k in i]
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps(sets)
            union = size[:, None] + size[None, :] - both
            linked = both >= (f.similarity - 1e-9) * union
            np.fill_diagonal(linked, False)
            if x[i[0]] != y[i[0]]:  # within a block, pairs are counted by the block's own meeting
                linked &= own[i][:, None] != own[i][None, :]
            a, b = np.nonzero(linked)
            root = _roots(len(i), a, b)
            links = linked.sum(1)
            out_key.append(keys[i])
            out_links.append(links)
            out_least.append(keys[i][root])
        k, n, least = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_key, out_links, out_least))
        return pa.table({"_key": pa.array(k, pa.int64()), "links": pa.array(n.astype(np.int64)), "least": pa.array(least, pa.int64())})

    rows = texts.join(placed, "_key").select("_key", "text", "component", "own", "blocks")
    rows = rows.mapInArrow(fetch, "bucket long, component long, x int, y int, _key long, own int, body binary")
    return rows.groupBy("bucket").applyInArrow(compare, "_key long, links long, least long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", f: Forest = Forest()) -> DataFrame:
    """Per row: doc_id, class_id (the group's smallest id), copy_id (the smallest id with the same shingles), n_copies,
    n_links, kept, _key."""
    keyed = with_key(plain(docs, id_col, text_col).toDF("doc_id", "text"), "doc_id", "jaccard")
    texts = keyed.select("_key", "doc_id", F.col("text").cast("string").alias("text"))
    sketched = written(sketch(texts, f), "sketches")
    same = ["n", "one", "two"]
    # Written, so that the join has an exchange of its own on either side and a hot class can be split.
    copies = written(sketched.where("n > 0").groupBy(*same).agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1"), "copies")
    classes = sketched.select("_key", *same).join(copies, same, "left")
    classes = written(classes.select("_key", F.coalesce("rep", "_key").alias("rep"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")), "classes")
    first = classes.where("rep = _key").select("_key")
    ties = written(candidate_ties(sketched.where("n > 0").join(first, "_key", "left_semi"), f).distinct(), "ties")
    release(sketched, copies)
    # Written before it is joined back, so that a large set can be split.
    members = written(components(ties).select(F.col("node").alias("_key"), "component"), "members")
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "set-sizes")
    sets_of = written(members.join(sizes, "component"), "candidate-sets")
    checked = written(verify(texts, sets_of, f), "verified")
    release(ties, members, sizes, sets_of)
    links = checked.groupBy("_key").agg(F.sum("links").alias("n_links"))
    if checked.groupBy("_key").count().where("count > 1").isEmpty():
        groups = checked.select(F.col("_key").alias("node"), F.col("least").alias("component"))  # every set was one block
    else:
        groups = components(checked.select(F.col("_key").alias("a"), F.col("least").alias("b")))
    named = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links.select(F.col("_key").alias("rep"), "n_links"), "rep", "left")
    named = written(named.select("_key", "rep", "n_copies", F.coalesce("component", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    release(classes, checked)
    ids = texts.select("_key", "doc_id")
    out = named.join(ids, "_key")
    out = out.join(ids.select(F.col("_key").alias("class"), F.col("doc_id").alias("class_id")), "class").join(ids.select(F.col("_key").alias("rep"), F.col("doc_id").alias("copy_id")), "rep")
    return out.select("doc_id", "class_id", "copy_id", "n_copies", "n_links", (F.col("_key") == F.col("class")).alias("kept"), "_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", f: Forest = Forest()) -> DataFrame:
    """docs with one row of each group of linked texts; all its columns stay."""
    key = free_name(docs.columns, "_key")
    keyed = with_key(docs, id_col, "jaccard-rows", key)
    inner = keyed.select(F.col(key).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    gone = jaccard_join(inner, "_row", "_text", f).where("not kept").select(F.col("doc_id").alias(key))
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def brute(rows: list[tuple[int, str | None]], similarity: float = 0.8, gram: int = 5) -> dict[int, tuple[int, int]]:
    """The definition, for small inputs: id to (group, links of its class with other texts)."""
    import re

    sets: dict[int, frozenset] = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(words[k : k + gram]) for k in range(len(words) - gram + 1)) if len(words) >= gram else frozenset([tuple(words)] if words else [])
    group = {i: i for i in sets}
    links: dict[int, set] = {i: set() for i in sets}
    ids = sorted(sets)

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and len(a & b) >= similarity * len(a | b):
                r, s = sorted((top(x), top(y)))
                group[s] = r
                if a != b:
                    links[x].add(b)
                    links[y].add(a)
    return {i: (top(i), len(links[i])) for i in ids}
