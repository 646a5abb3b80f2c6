"""Secret scan (operator 9): fixed patterns, and sliding-window Shannon entropy over candidate strings.

Patterns (leftmost, non-overlapping per kind): assignments to a secret-like name, access keys, long hex runs.
Entropy: every maximal run of key characters is a candidate.  It is split by character class (hex, lower case
and digits, all key characters); in each class's runs a window slides over the characters while the counts and
the sum of c*log2(c) are updated by the one character that enters and the one that leaves.  Windows at or over
the class's threshold merge to spans of kind `entropy`, unless the candidate is allow-listed.  Candidates that are
shorter than the window, down to `floor` characters, are judged as a whole, need letters and `digits` digits, and a
higher entropy for their length.

Defined cases: null is the empty text.  Rows are mapped one by one, so repeated ids, empty tables and further
columns need nothing special.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order that ties are listed in.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")


@lru_cache
def _candidates(floor: int) -> re.Pattern:
    return re.compile(f"[A-Za-z0-9+/_=-]{{{floor},}}")


@dataclass(frozen=True)
class Entropy:
    """window: characters; bits: lowest entropy that counts, by class; least kinds of characters a window needs."""

    window: int = 24
    floor: int = 16
    digits: int = 3
    short_bits: float = 3.4  # of at most log2(16) = 4
    hex_bits: float = 3.0
    lower_bits: float = 3.6
    key_bits: float = 4.0
    #: Candidates that match in full are no secrets: plain words, dashed words, paths, repeated rules.
    allow: tuple[str, ...] = (r"[A-Za-z]+", r"[A-Za-z]+([_/-][A-Za-z]+)+", r"[-=_+/]+", r"[0-9]+", r"(.{1,4})\1{5,}.{0,4}")


_CLASSES = (("hex", re.compile(r"[0-9a-f]+")), ("lower", re.compile(r"[0-9a-z]+")), ("key", re.compile(r"[A-Za-z0-9+/_=-]+")))


def hot_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal spans of run that are covered by windows of at least so many bits a character."""
    n = min(window, len(run))
    if n < window:
        return []
    xlog = [0.0] + [c * math.log2(c) for c in range(1, n + 2)]  # one more: a character enters before one leaves
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += xlog[c + 1] - xlog[c]
        counts[ch] = c + 1
        if i >= n:
            gone = run[i - n]
            c = counts[gone]
            total += xlog[c - 1] - xlog[c]
            counts[gone] = c - 1
        if i >= n - 1 and math.log2(n) - total / n >= bits:
            start = i - n + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str, rule: Entropy = Entropy()) -> list[tuple[int, int]]:
    allow = _allow(rule.allow)
    spans: set[tuple[int, int]] = set()
    for m in _candidates(min(rule.floor, rule.window)).finditer(text):
        word = m.group()
        if allow.fullmatch(word):
            continue
        if len(word) < rule.window:
            if len(word) >= rule.floor and sum(c.isdigit() for c in word) >= rule.digits and any(c.isalpha() for c in word) and hot_windows(word, len(word), rule.short_bits):
                spans.add(m.span())
            continue
        for name, pattern in _CLASSES:
            for run in pattern.finditer(word):
                found = run.group()
                if len(found) < rule.window or not any(c.isdigit() for c in found):
                    continue
                for a, b in hot_windows(found, rule.window, getattr(rule, f"{name}_bits")):
                    spans.add((m.start() + run.start() + a, m.start() + run.start() + b))
    # A span inside another is the same finding in a narrower class.
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


_compiled: dict[tuple[str, ...], re.Pattern] = {}


def _allow(patterns: tuple[str, ...]) -> re.Pattern:
    if patterns not in _compiled:
        # Each pattern keeps its own group numbers.
        parts, groups = [], 0
        for p in patterns:
            parts.append("(?:" + re.sub(r"\\(\d)", lambda m, g=groups: f"\\{int(m[1]) + g}", p) + ")")
            groups += re.compile(p).groups
        _compiled[patterns] = re.compile("|".join(parts) or r"(?!)")
    return _compiled[patterns]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # Matches of fewer characters fail, and a run has no second match: so only long ones are looked for.
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def scan(text: str, rule: Entropy = Entropy()) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind as listed."""
    out = base_spans(text) + [(a, b, "entropy") for a, b in entropy_spans(text, rule)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _join(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Entropy = Entropy()) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, digest, joined = {k: [] for k in KINDS}, [], []
            for t in batch.column(1):
                spans = scan(t.as_py() or "", rule)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in spans))
                digest.append(hashlib.sha256(_join(s for s in spans if s[2] != "entropy").encode()).hexdigest())
                joined.append(_join(spans))
            ints = [pa.array(counts[k], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ints[:3], pa.array(digest, pa.string()), pa.array(joined, pa.string()), ints[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
