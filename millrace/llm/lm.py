"""Language-model scores (operator 6): a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased, then one end token per text.  Each is named
by 58 bits of a hash of its bytes and 6 bits of its shape, a group of word endings and lengths.

1. Every token of every training text is counted.  A task counts a bounded piece of its texts at a time and
   sends each bucket of the hash space one packed row; a bucket's counts are summed by one task.
2. Every word has a class: the commonest `classes` tokens and the end token are classes of their own, each other word
   is in the class of its shape, of which there are 64.  All training texts' class trigrams are counted (at most
   (classes + 66)^3 cells, whatever the corpus's size) and are all that training needs: the context vector is
   c1 * R[w-1] + c2 * R[w-2], a class scores r . Q[w] + b[w], and minibatches of trigrams drawn by their counts are told
   from noise classes in numpy.  The number of minibatches grows with the root of the number of training tokens.
3. Batched matrix products turn the model into normalised log-probabilities for every context.  A text's score
   adds those up; a word of a shape's class also takes its share of that class, (c + 1/2) over the class's sum,
   in which one more type stands for all unseen ones.  So the probabilities of all tokens add up to one.

Counts for scoring: the commonest `common` tokens go with the task; other tokens are sent, packed, to the bucket
that holds their count, and the counts come back to the piece of texts that asked.  A token that a third of all
rows hold is common, or is one entry of a piece in the counting step.

Defined cases: null is the empty text (one end token).  Without training texts all counts are 0.  Rows that repeat
an id are scored each; a null id counts as the empty string for the fold.  Ids are integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import _LOWER, mix, parts_for, plain, release, slices, word_hashes, word_spans, written

#: The end token's name: no word's hash can be relied on to differ, so words never get it (see _tokens).
END = np.uint64(0xFFFFFFFFFFFFFFFF)
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    classes: int = 128
    size: int = 24
    common: int = 20_000
    piece: int = 1_000_000  # tokens that a task holds before it sends
    bucket: int = 8 << 20  # scanned bytes for each bucket of the hash space
    noise: int = 64
    batch: int = 4096
    steps: int | None = None  # minibatches; by default a fifth of the root of the training tokens, in these bounds
    least_steps: int = 400
    most_steps: int = 20_000
    seed: int = 1


SHAPES = 64


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape of each word: its last two bytes and the rough length, dealt to 64 groups."""
    n = ends - starts
    two = data[ends - 1].astype(_U) << _U(8) | np.where(n > 1, data[np.maximum(ends - 2, 0)], 0).astype(_U)
    return mix(two << _U(8) | np.minimum(n // 4, 4).astype(_U)) % _U(SHAPES)


def _tokens(texts: pa.Array):
    """(first row, last row, hashes with an end token after each text, first token of each text and the total)."""
    for row, last, data, offsets in slices(texts):
        data = _LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        if len(words):
            words = words & ~_U(SHAPES - 1) | _shapes(data, starts, ends)
            words[words == END] = END - _U(SHAPES)
        yield row, last, np.insert(words, first[1:], END), first + np.arange(len(first))


def _pieces(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one packed row: their byte lengths, then their bytes."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(payload: bytes, kinds: tuple) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    sizes = np.frombuffer(payload, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(payload, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> _U(20)) % _U(n)).astype(np.int64)


def _split(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The positions of each value of key."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    return [(int(key[x[0]]), x) for x in np.split(order, cut) if len(x)]


def _rows(rows: list[tuple[int, bytes]], name: str = "bucket") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], [name, "payload"])


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


def count_tokens(texts: DataFrame, buckets: int, piece: int) -> DataFrame:
    """A row for each bucket: its tokens' sorted hashes and counts, the number of both. texts: one column."""

    def count(batches):
        held, size = [], 0

        def sent():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return _rows([(b, _pieces([keys[x], n[x].astype(np.uint32)])) for b, x in _split(_bucket(keys, buckets))])

        for batch in batches:
            for _, _, tokens, _ in _tokens(batch.column(0)):
                held.append(tokens)
                size += len(tokens)
                if size >= piece:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def add(key, table):
        parts = [_unpack(p.as_py(), (_U, np.uint32)) for p in table.column("payload")]
        keys, n = _added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.uint64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([_pieces([keys, n])], pa.binary()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    return texts.mapInArrow(count, "bucket long, payload binary").groupBy("bucket").applyInArrow(add, "bucket long, payload binary, types long, tokens long")


def commonest(counted: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n commonest tokens' hashes and counts, commonest first (then by hash)."""

    def top(batches):
        for batch in batches:
            for p in batch.column(0):
                keys, counts = _unpack(p.as_py(), (_U, np.uint64))
                best = np.lexsort((keys, -counts.astype(np.int64)))[:n]
                yield pa.RecordBatch.from_arrays([pa.array(keys[best].view(np.int64)), pa.array(counts[best].astype(np.int64))], ["token", "n"])

    # Ordered like unsigned numbers; a task keeps its own n best before any are sent.
    best = counted.select("payload").mapInArrow(top, "token long, n long").orderBy(F.desc("n"), (F.col("token") < 0), "token").limit(n).collect()
    return np.array([r["token"] for r in best], np.int64).view(_U), np.array([r["n"] for r in best], np.int64)


def shape_sums(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of tokens and of types of each shape."""

    def sums(batches):
        for batch in batches:
            for p in batch.column(0):
                keys, n = _unpack(p.as_py(), (_U, np.uint64))
                shape = (keys % _U(SHAPES)).astype(np.int64)
                tokens, types = np.bincount(shape, weights=n, minlength=SHAPES), np.bincount(shape, minlength=SHAPES)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(tokens.astype(np.int64)), pa.array(types)], ["shape", "tokens", "types"])

    rows = counted.select("payload").mapInArrow(sums, "shape long, tokens long, types long").groupBy("shape").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()
    tokens, types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in rows:
        tokens[r["shape"]], types[r["shape"]] = r["tokens"], r["types"]
    return tokens, types


def _classes(tokens: np.ndarray, sorted_known: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The class of each token: its shape's, from 1 on, or its own. sorted_known, number: the own classes' hashes and
    numbers."""
    shape = (tokens % _U(SHAPES)).astype(np.int64) + 1
    if not len(sorted_known):
        return shape
    at = np.searchsorted(sorted_known, tokens)
    at[at == len(sorted_known)] = 0
    return np.where(sorted_known[at] == tokens, number[at], shape)


def _trigrams(classes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The number of (class two before, class before, class) of each token; class 0 stands before a text."""
    before = np.empty_like(classes)
    before[1:] = classes[:-1]
    before[first[:-1]] = 0
    two = np.empty_like(classes)
    two[1:] = before[:-1]
    two[first[:-1]] = 0
    return (two * width + before) * width + classes


def count_trigrams(texts: DataFrame, known: np.ndarray, number: np.ndarray, width: int, piece: int, buckets: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """All class trigrams and their counts; at most width^3 of them."""

    def count(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def gathered():
            k, c = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], n[:0])
            return _added(np.concatenate([keys, k]), np.concatenate([n, c]))

        for batch in batches:
            for _, _, tokens, first in _tokens(batch.column(0)):
                held.append(_trigrams(_classes(tokens, known, number), first, width))
                size += len(tokens)
                if size >= piece:
                    keys, n = gathered()
                    held, size = [], 0
        keys, n = gathered()
        if len(keys):
            yield _rows([(b, _pieces([keys[x].astype(np.uint32), n[x].astype(np.uint64)])) for b, x in _split(keys % buckets)])

    def add(key, table):
        parts = [_unpack(p.as_py(), (np.uint32, np.uint64)) for p in table.column("payload")]
        keys, n = _added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([_pieces([keys, n])], pa.binary())})

    rows = texts.mapInArrow(count, "bucket long, payload binary").groupBy("bucket").applyInArrow(add, "bucket long, payload binary").collect()
    parts = [_unpack(bytes(r["payload"]), (np.uint32, np.uint64)) for r in rows]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]).astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in pieces that are too small for the matrix library to start threads, which would spin on the driver."""
    out = np.empty((len(a), b.shape[1]))
    rows = max(1, (1 << 18) // (b.shape[0] * b.shape[1] + 1))
    for at in range(0, len(a), rows):
        np.matmul(a[at : at + rows], b, out=out[at : at + rows])
    return out


def _spread(at: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """The sums of the rows of x that go to each of `width` places."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    out = np.zeros((width, x.shape[1]))
    out[s[first]] = np.add.reduceat(x[order], first, axis=0)
    return out


def train(trigrams: np.ndarray, counts: np.ndarray, width: int, s: Settings = Settings()) -> np.ndarray:
    """Normalised log10 probabilities by context: an array of width**2 rows (two before, before) and width columns."""
    rng = np.random.default_rng(s.seed)
    target = trigrams % width
    unigram = np.bincount(target, weights=counts, minlength=width) if len(target) else np.zeros(width)
    unigram[1:] += 0.5
    noise_p = unigram / unigram.sum()
    log_noise = np.log(np.maximum(noise_p, 1e-300)) + math.log(s.noise)
    R, Q = rng.normal(0, 0.1, (width, s.size)), rng.normal(0, 0.1, (width, s.size))
    C, b = np.ones((2, s.size)), np.log(np.maximum(noise_p, 1e-12))
    params = [R, Q, C, b]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = counts.cumsum() if len(counts) else np.zeros(0)
    steps = s.steps or min(s.most_steps, max(s.least_steps, int(math.sqrt(counts.sum()) / 5)))
    for step in range(1, (steps if len(counts) else 0) + 1):
        drawn = np.searchsorted(total, rng.integers(0, total[-1], s.batch), side="right")
        code = trigrams[drawn]
        w, one, two = code % width, code // width % width, code // width**2
        negative = rng.choice(width, s.noise, p=noise_p)
        r1, r2 = R[one], R[two]
        context = r1 * C[0] + r2 * C[1]
        # The right class against its noise rate, and the batch's shared noise classes against theirs.
        pos = (context * Q[w]).sum(1) + b[w] - log_noise[w]
        neg = _product(context, Q[negative].T) + b[negative] - log_noise[negative]
        dpos = (1 / (1 + np.exp(-np.clip(pos, -30, 30))) - 1) / s.batch
        dneg = 1 / (1 + np.exp(-np.clip(neg, -30, 30))) / s.batch
        dcontext = dpos[:, None] * Q[w] + _product(dneg, Q[negative])
        pulled = sum(dneg[at : at + 128].T @ context[at : at + 128] for at in range(0, s.batch, 128))
        gQ = _spread(w, dpos[:, None] * context, width) + _spread(negative, pulled, width)
        gb = np.bincount(w, weights=dpos, minlength=width) + np.bincount(negative, weights=dneg.sum(0), minlength=width)
        gR = _spread(one, dcontext * C[0], width) + _spread(two, dcontext * C[1], width)
        grads = [gR, gQ, np.stack([(dcontext * r1).sum(0), (dcontext * r2).sum(0)]), gb]
        rate = 0.02 * (1 - 0.9 * step / steps)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    out = np.empty((width * width, width), np.float32)
    before = R * C[0]
    for two in range(width):
        scores = _product(before + R[two] * C[1], Q.T) + b
        scores[:, 0] = -np.inf  # nothing but a text's start has class 0
        top = scores.max(1, keepdims=True)
        out[two * width : (two + 1) * width] = (scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))) / math.log(10)
    return out


def lm_scores(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. train_rows: a condition on docs."""
    docs = plain(docs, id_col, text_col)
    text = F.col(text_col).cast("string")
    learned = docs.where(train_rows).select(text.alias("text"))
    buckets = parts_for(docs, s.bucket)
    counted = written(count_tokens(learned, buckets, s.piece), "token-counts")
    sums = counted.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    types, total = int(sums["types"] or 0), int(sums["tokens"] or 0)
    common, common_n = commonest(counted, s.common)

    own = common[: s.classes]
    own = own if END in own else np.r_[own[: max(0, s.classes - 1)], END]
    width = len(own) + 1 + SHAPES  # the start, the shapes and the own ones
    order = np.argsort(own)
    known, number = own[order], order.astype(np.int64) + 1 + SHAPES
    table = train(*count_trigrams(learned, known, number, width, s.piece), width, s)

    # What is left of each shape's class without the tokens that have their own, and one unseen type.
    shape_tokens, shape_types = shape_sums(counted)
    mine = np.isin(common, own)
    shape_tokens -= np.bincount((common[mine] % _U(SHAPES)).astype(np.int64), weights=common_n[mine], minlength=SHAPES)
    shape_types -= np.bincount((common[mine] % _U(SHAPES)).astype(np.int64), minlength=SHAPES)
    shape_norm = np.log10(shape_tokens + 0.5 * shape_types + 0.5)
    by_hash = np.argsort(common)
    common, common_n = common[by_hash], common_n[by_hash]
    model = docs.sparkSession.sparkContext.broadcast((table, common, common_n, known, number, shape_norm))

    def ask(batches):
        table, common, common_n, known, number, shape_norm = model.value
        task = TaskContext.get()
        part, pieces = (task.partitionId() if task else 0) << 24, 0
        ids, none, held_out, hashes, firsts, size = [], [], [], [], [0], 0

        def sent():
            tokens, first = np.concatenate(hashes), np.array(firsts, np.int64)
            classes = _classes(tokens, known, number)
            shared = classes <= SHAPES
            neural = table.ravel()[_trigrams(classes, first, width)] - np.where(shared, shape_norm[np.where(shared, classes - 1, 0)], 0.0)
            own_sum = np.add.reduceat(neural, first[:-1])
            at = np.searchsorted(common, tokens)
            at[at == len(common)] = 0
            is_common = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
            logs = np.where(is_common, np.log10((common_n[at] if len(common) else 0) + 0.5), 0.0)
            sums = [np.add.reduceat(x, first[:-1]) for x in (logs, np.where(shared, logs, 0.0), is_common.astype(np.int64))]
            rest = np.flatnonzero(~is_common)
            doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint32), np.diff(first))[rest]
            piece = part + pieces
            out = [(b, _pieces([np.array([piece], np.int64), tokens[rest[x]], doc[x]])) for b, x in _split(_bucket(tokens[rest], buckets))] if len(rest) else []
            about = _pieces([np.array([piece], np.int64), np.array(ids, np.int64), np.array(none, bool), np.array(held_out, bool), np.diff(first), own_sum, *sums])
            return _rows([*out, (-1 - piece % buckets, about)])

        for batch in batches:
            for row, last, tokens, first in _tokens(batch.column(1)):
                for i in range(row, last):
                    x = batch.column(0)[i].as_py()
                    ids.append(x or 0)
                    none.append(x is None)
                    held_out.append(not batch.column(2)[i].as_py())
                hashes.append(tokens)
                firsts.extend((first[1:] + size).tolist())
                size += len(tokens)
                if size >= s.piece:
                    yield sent()
                    pieces += 1
                    ids, none, held_out, hashes, firsts, size = [], [], [], [], [0], 0
        if ids:
            yield sent()

    def answer(key, rows):
        """Negative buckets hold what is known of a piece's texts, and pass."""
        out, asked, have = [], [], None
        for kind, payload in zip(rows.column("counted"), rows.column("payload")):
            if key[0].as_py() < 0:
                out.append((int(_unpack(payload.as_py(), (np.int64,))[0][0]), b"\0" + payload.as_py()))
            elif kind.as_py():
                have = _unpack(payload.as_py(), (_U, np.uint64))
            else:
                asked.append(_unpack(payload.as_py(), (np.int64, _U, np.uint32)))
        for piece, tokens, doc in asked:
            n = np.zeros(len(tokens), np.uint64)
            if have is not None and len(have[0]):
                at = np.searchsorted(have[0], tokens)
                at[at == len(have[0])] = 0
                n = np.where(have[0][at] == tokens, have[1][at], _U(0))
            out.append((int(piece[0]), b"\1" + _pieces([doc, np.minimum(n, 0xFFFFFFFF).astype(np.uint32)])))
        return pa.table({"piece": pa.array([x[0] for x in out], pa.int64()), "payload": pa.array([x[1] for x in out], pa.binary())})

    norm = math.log10(total + 0.5 * (types + 1))

    def finish(key, rows):
        payloads = [p.as_py() for p in rows.column("payload")]
        about = next(p for p in payloads if p[0] == 0)
        _, ids, none, held, n, own_sum, logs, shared_logs, n_known = _unpack(about[1:], (np.int64, np.int64, bool, bool, np.int64, np.float64, np.float64, np.float64, np.int64))
        more, known_more = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for p in payloads:
            if p[0] == 1:
                doc, count = _unpack(p[1:], (np.uint32, np.uint32))
                more += np.bincount(doc, weights=np.log10(count + 0.5), minlength=len(ids))
                known_more += np.bincount(doc, weights=count > 0, minlength=len(ids)).astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=none),
                "held_out": pa.array(held),
                "n_tokens": pa.array(n),
                "n_known": pa.array(n_known + known_more),
                "train_tokens": pa.array(np.full(len(ids), total, np.int64)),
                "base_score": pa.array(logs + more - n * norm),
                # Every token that is not common belongs to a shape's class.
                "score": pa.array(own_sum + shared_logs + more),
            }
        )

    asked = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train")).mapInArrow(ask, "bucket long, payload binary")
    both = asked.withColumn("counted", F.lit(False)).unionByName(counted.select("bucket", "payload", F.lit(True).alias("counted")))
    answered = both.groupBy("bucket").applyInArrow(answer, "piece long, payload binary")
    out = written(answered.groupBy("piece").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    release(counted)
    return out
