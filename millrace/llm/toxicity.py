"""Toxicity scores (operator 5): Levenshtein automata over a learned lexicon trie, with context windows.

The lexicon is learned from labelled rows: whole words, and stems (word beginnings), that toxic documents hold
far more often than clean ones.  The lexicon's trie is intersected with the Levenshtein automata of its words:
a state is the set of (trie node, edits) pairs that the characters read so far allow.  States are made
deterministic as texts need them, so a word costs one table step a character and most die after three or four.
Whole words of five letters and more match with up to one edit, stems match exactly.  Misspellings that clean
labelled documents hold are words of their own and do not count.

Each hit gets a context window: inside a pair of quotation marks, however far apart, or near a word that reports what
others said, it is a quotation.  Reporting words are a fixed few and those that labelled clean documents hold near
hits far more often than toxic ones.  A logistic model learns what direct hits, misspelt ones, quoted ones and further
direct ones are worth, and gives the score.

Bounds.  Lexicon and model are fitted on at most `sample` labelled rows, those with the smallest hash of their id;
all terms of these rows are judged, and every term is taken whose toxic documents, and whose different surroundings in
them, are more than chance.  Scoring is one pass over whole texts without a shuffle.

Defined cases: null text is empty; empty texts get the score of no hit.  Without toxic and clean labelled rows,
or a term that tells them apart, every score is the model's prior (0.1).  A document that has several labels counts as toxic if one says so; null
labels are none.  A null id counts as the empty string for the fold.  Rows that repeat an id are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, written

WORD = re.compile(r"\w+")
#: Words that report or mention what others said; more are learned.
REPORTING = frozenset("said says say saying quote quoted quotes called calls wrote writes word words term phrase shouted reported".split())
#: Quotation marks: single ones count at the edge of words only; an empty line ends what is open.
_MARKS = re.compile(r"[\"“”«»„‚‘]|(?<!\w)'(?=\w)|(?<=[^\s])['’](?!\w)|\n\s*\n")
_CLOSES = {'"': '"', "”": "“„", "“": "„", "»": "«", "'": "'", "’": "‘‚", "‘": "‚"}
_DEAD, _START = 0, 1


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    ignored: frozenset[str] = frozenset()
    reporting: frozenset[str] = REPORTING
    edits: int = 1
    fuzzy_from: int = 5


class Matcher:
    """The lazily determinised intersection of the trie and its Levenshtein automata."""

    def __init__(self, lexicon: Lexicon, cache: int = 100_000):
        self.lexicon, self.cache, self.known = lexicon, cache, {}
        self.children: list[dict[str, int]] = [{}]
        self.word_end: dict[int, str] = {}
        self.stem_end: set[int] = set()
        self.fuzzy: set[int] = set()  # nodes on the way to a word that may be misspelt
        for word in lexicon.words:
            node = self._insert(word, len(word) >= lexicon.fuzzy_from)
            self.word_end[node] = word
        for stem in lexicon.stems:
            self.stem_end.add(self._insert(stem, False))
        self.ids: dict[frozenset, int] = {frozenset(): _DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.accepts: list[int | None] = [None]
        self._state(self._closed({(0, 0)}))

    def _insert(self, word: str, fuzzy: bool) -> int:
        node = 0
        if fuzzy:
            self.fuzzy.add(0)
        for ch in word:
            node = self.children[node].setdefault(ch, len(self.children))
            if node == len(self.children):
                self.children.append({})
            if fuzzy:
                self.fuzzy.add(node)
        return node

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the letters of the lexicon that the text may leave out."""
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits < self.lexicon.edits and node in self.fuzzy:
                for child in self.children[node].values():
                    if child in self.fuzzy and (child, edits + 1) not in pairs:
                        pairs.add((child, edits + 1))
                        todo.append((child, edits + 1))
        return frozenset(pairs)

    def _state(self, pairs: frozenset) -> int:
        found = self.ids.get(pairs)
        if found is None:
            found = self.ids[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            ends = [e for n, e in pairs if n in self.word_end and (not e or n in self.fuzzy and len(self.word_end[n]) >= self.lexicon.fuzzy_from)]
            self.accepts.append(min(ends, default=None))
        return found

    def _step(self, state: int, ch: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(ch)
            if child is not None and (not edits or child in self.fuzzy):
                out.add((child, edits))
            if edits < self.lexicon.edits and node in self.fuzzy:
                out.add((node, edits + 1))
                out.update((c, edits + 1) for c in self.children[node].values() if c in self.fuzzy)
        to = self._state(self._closed(out))
        self.steps[state][ch] = to
        return to

    def match(self, word: str) -> int | None:
        """0: a word or stem of the lexicon; 1: a misspelt word; None: neither. word: lower case."""
        state = _START
        for ch in word:
            to = self.steps[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state == _DEAD:
                return None
            if self.stem_end and any(not e and n in self.stem_end for n, e in self.sets[state]):
                return 0
        found = self.accepts[state]
        return None if found and word in self.lexicon.ignored else found

    def lookup(self, word: str) -> int | None:
        known = self.known
        if word in known:
            return known[word]
        if len(known) > self.cache:
            known.clear()
        out = known[word] = self.match(word)
        return out


def quotations(text: str) -> list[tuple[int, int]]:
    """The spans between paired quotation marks, in one pass over the marks; marks without a partner are none."""
    out, opened = [], {}
    for m in _MARKS.finditer(text):
        mark = m.group()
        if mark[0] == "\n":
            opened.clear()
            continue
        if mark == "'" and text[m.end() : m.end() + 1].isalnum():  # before a word it can only open
            opened[mark] = m.start()
            continue
        starts = [opened[o] for o in _CLOSES.get(mark, "") if o in opened]
        if starts:
            out.append((max(starts), m.end()))
            for o in _CLOSES[mark]:
                opened.pop(o, None)
        elif mark not in "”»’'":
            opened[mark] = m.start()
    return out


def hits(text: str, matcher: Matcher, window: int = 6) -> list[tuple[int, int, bool]]:
    """(word number, edits, quoted) of every hit."""
    lower = text.lower()
    words = WORD.findall(lower)
    lookup = matcher.lookup
    if not any(lookup(w) is not None for w in set(words)):
        return []
    spans = quotations(lower)
    reporting = matcher.lexicon.reporting
    out = []
    for i, m in enumerate(WORD.finditer(lower)):
        edits = lookup(m.group())
        if edits is None:
            continue
        inside = any(a < m.start() and m.end() <= b for a, b in spans)
        near = not reporting.isdisjoint(words[max(0, i - window) : i + window + 1])
        out.append((i, edits, inside or near))
    return out


FEATURES = 5


def features(found: list[tuple[int, int, bool]], n_words: int) -> tuple[float, ...]:
    """Whether there is a direct hit, whether all of them are misspelt, the logarithms of the numbers of quoted hits and of
    direct ones, and the direct ones' density."""
    direct = sum(not q for _, _, q in found)
    spelt = sum(not e and not q for _, e, q in found)
    return float(direct > 0), float(direct > 0 and not spelt), math.log1p(len(found) - direct), math.log1p(direct), min(1.0, 10 * direct / max(1, n_words))


def measure(text: str, matcher: Matcher) -> tuple[list[tuple[int, int, bool]], tuple[float, ...]]:
    found = hits(text, matcher)
    return found, features(found, len(WORD.findall(text))) if found else (0.0,) * FEATURES


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=lambda: Lexicon([], []))
    weights: tuple[float, ...] = (0.0,) * FEATURES
    bias: float = math.log(0.1 / 0.9)

    def score(self, x) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(w * v for w, v in zip(self.weights, x))))))


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def _stems(word: str) -> list[str]:
    return [word[:n] for n in range(4, 9) if len(word) > n]


def _term_counts(batches):
    """Of a few hundred texts at a time: term (stems end in *), toxic and clean documents that hold it."""
    for batch in (b.slice(at, 300) for b in batches for at in range(0, b.num_rows, 300)):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1)):
            words = set(WORD.findall((text.as_py() or "").lower()))
            at = 0 if toxic.as_py() else 1
            for term in words | {f"{s}*" for w in words for s in _stems(w)}:
                counts.setdefault(term, [0, 0])[at] += 1
        terms = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[t][0] for t in terms], pa.int64()), pa.array([counts[t][1] for t in terms], pa.int64())], ["term", "toxic", "clean"])


def nats(a: int, b: int, base: float) -> float:
    """How much more likely a toxic and b clean documents are at their own share than at the share `base`."""
    p = a / (a + b)
    return a * math.log(p / base) + (b * math.log((1 - p) / (1 - base)) if b else 0.0)


def choose(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, n_terms: int, ratio: float = 40.0, margin: float = 2.0) -> tuple[list[str], list[str]]:
    """Words and stems whose share of the toxic documents is `ratio` times that of the clean ones, and that are not so
    by chance: of n_terms terms, less than exp(-margin) are expected to be by chance what they are."""
    base, evidence = n_toxic / (n_toxic + n_clean), math.log(max(1, n_terms)) + margin
    good = {t: a for t, a, b in rows if (a + 0.5) / (n_toxic + 1) >= ratio * (b + 0.5) / (n_clean + 1) or not b}
    good = {t: a for t, a, b in rows if t in good and nats(a, b, base) >= evidence}
    words = {t: a for t, a in good.items() if not t.endswith("*") and len(t) >= 3}
    best: dict[str, int] = {}
    for w, a in words.items():
        for s in _stems(w):
            best[s] = max(best.get(s, 0), a)
    # A stem is worth more than its words only if it finds documents that its commonest word does not.
    stems: list[str] = []
    for t in sorted((t[:-1] for t in good if t.endswith("*")), key=len):
        if good[f"{t}*"] >= 1.5 * best.get(t, 0) and not any(t.startswith(s) for s in stems):
            stems.append(t)
    return sorted(w for w in words if not any(w.startswith(s) for s in stems)), sorted(stems)


def _counted(rows: DataFrame, terms_in) -> DataFrame:
    """(term, toxic, clean): the documents that hold each of the terms that terms_in() finds in a text."""

    def count(batches):
        find = terms_in()
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1)):
                for t in find((text.as_py() or "").lower()):
                    seen.setdefault(t, [0, 0])[0 if toxic.as_py() else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["term", "toxic", "clean"])

    return rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, least: int = 5) -> Model:
    """train: which ids may be learned from, a condition on labels' id_col. sample: labelled ids that are learned from;
    least: toxic documents that a term must be in (fewer where there are few)."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if train is not None:
        marked = marked.where(train)
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` pairs of numbers, so they can be sent to every task; of rows that repeat an id one is learned from.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(marked), "_id")
    rows = rows.groupBy("_id").agg(F.max("_text").alias("_text"), F.max("_toxic").alias("_toxic")).select("_text", (F.col("_toxic") > 0).alias("_toxic"))
    rows = written(rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "labelled-texts")
    sizes = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()
    counted = rows.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = written(counted, "term-counts")
    n_terms = counted.count()
    # Whatever could pass in choose(): a term held by as many clean documents as toxic ones, in share, cannot.
    top = counted.where((F.col("toxic") >= min(least, max(1, n_toxic // 10))) & (F.col("toxic") * n_clean > 10 * F.col("clean") * n_toxic)).collect()
    release(counted)
    words, stems = choose([(r["term"], r["toxic"], r["clean"]) for r in top], n_toxic, n_clean, n_terms)
    known_words, known_stems = frozenset(words), frozenset(stems)

    # Copies of a text say nothing new: what counts in the end is in how many different surroundings a term occurs.
    def surroundings(batches):
        for batch in batches:
            seen: set[tuple[str, int, bool]] = set()
            for text, toxic in zip(batch.column(0), batch.column(1)):
                own = WORD.findall((text.as_py() or "").lower())
                for i, w in enumerate(own):
                    terms = [w] * (w in known_words) + [f"{x}*" for x in _stems(w) if x in known_stems]
                    if terms:
                        around = zlib.crc32(" ".join(own[max(0, i - 2) : i] + ["*"] + own[i + 1 : i + 3]).encode())
                        seen.update((t, around, toxic.as_py()) for t in terms)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["term", "around", "toxic"])

    found_in = rows.mapInArrow(surroundings, "term string, around long, toxic boolean").distinct()
    found_in = found_in.groupBy("term").agg(F.count(F.when(F.col("toxic"), 1)).alias("toxic"), F.count(F.when(~F.col("toxic"), 1)).alias("clean")).collect()
    words, stems = choose([(r["term"], r["toxic"], r["clean"]) for r in found_in], n_toxic, n_clean, n_terms)
    if not words and not stems:
        release(rows)
        return Model()
    found = Lexicon(words, stems)

    # Words one edit away that clean documents hold are no misspellings.
    def near():
        matcher = Matcher(found)
        return lambda text: {w for w in set(WORD.findall(text)) if matcher.lookup(w)}

    found.ignored = frozenset(r["term"] for r in _counted(rows, near).where("clean > 0 and toxic * 4 < clean * 5").collect())

    # Words near hits that clean documents hold far more often than toxic ones say that the hit is a quotation.
    def around():
        matcher = Matcher(found)

        def find(text):
            own = WORD.findall(text)
            return {w for i, _, _ in hits(text, matcher) for w in own[max(0, i - 6) : i + 7] if matcher.lookup(w) is None}

        return find

    beside = _counted(rows, around).where("clean >= 5 and clean > 10 * toxic").collect()
    found.reporting = REPORTING | {r["term"] for r in beside}

    def measured(batches):
        matcher = Matcher(found)
        for batch in batches:
            xs = [measure(t.as_py() or "", matcher)[1] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in xs], pa.float64()) for i in range(FEATURES)), batch.column(1)], [*_NAMES, "y"])

    # Equal feature rows count once with their number; what is collected is bounded by `sample`.
    data = rows.mapInArrow(measured, ", ".join(f"{n} double" for n in _NAMES) + ", y boolean").groupBy(*_NAMES, "y").agg(F.count(F.lit(1)).alias("n")).collect()
    release(rows)
    x = np.array([[r[n] for n in _NAMES] for r in data])
    return Model(found, *logistic(x, np.array([float(r["y"]) for r in data]), np.array([float(r["n"]) for r in data])))


_NAMES = [f"x{i}" for i in range(FEATURES)]


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[tuple[float, ...], float]:
    """Newton steps on weighted rows; a ridge keeps separable data finite."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (n * p * (1 - p))[:, None]) + penalty, z.T @ (n * (y - p)) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_hits, n_quoted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        matcher = Matcher(model.lexicon)
        for batch in batches:
            scores, n, quoted = [], [], []
            for t in batch.column(2):
                text = t.as_py() or ""
                found, x = measure(text, matcher)
                scores.append(model.score(x))
                n.append(len(found))
                quoted.append(sum(q for _, _, q in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= cutoff) for s in scores], pa.int32()), pa.array(n, pa.int64()), pa.array(quoted, pa.int64())], ["doc_id", "held_out", "score", "predicted", "n_hits", "n_quoted"])

    return docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits long, n_quoted long"
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """docs without the rows that score at or over the cutoff; no shuffle, all columns stay."""

    @F.pandas_udf("double")
    def scored(texts):
        matcher = _matcher(model.lexicon)
        return texts.map(lambda t: model.score(measure(t or "", matcher)[1])).astype("float64")

    return docs.where(scored(F.col(text_col)) < cutoff)


_matchers: dict[tuple, Matcher] = {}


def _matcher(lexicon: Lexicon) -> Matcher:
    key = (tuple(lexicon.words), tuple(lexicon.stems), lexicon.ignored, lexicon.reporting)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(lexicon)
    return _matchers[key]
