"""Strings that defeat weak hashes, clashing column names, empty tables, repeated rows, and the registered queries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, common, decontamination, exact_dedup, jaccard_join, lm, queries, secrets, substring_dedup, suffix_dedup, toxicity
from test_corpus import DOCS, by_id, empty, frame, near, passages, sample, toxic_rows


def thue_morse(n, a, b):
    """Two different strings of 2^n symbols that every polynomial hash modulo 2^64 confuses from 2^11 on."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_thue_morse_strings_apart():
    a, b = thue_morse(12, b"a", b"b")
    data = np.frombuffer(a + b" " + b, np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    one, two = common.word_hashes(data, starts, ends)
    assert one != two
    x, y = thue_morse(12, [1], [2])
    prefix = common.prefix_hash(np.array(x + y, np.uint64), common._WORD_BASE)
    assert common.span_hash(prefix, np.array([0]), np.array([4096]), common._WORD_BASE) != common.span_hash(prefix, np.array([4096]), np.array([8192]), common._WORD_BASE)


def test_sums_modulo_the_prime():
    rng, p = np.random.default_rng(1), (1 << 61) - 1
    a, b = rng.integers(0, p, 500, dtype=np.uint64), rng.integers(0, p, 500, dtype=np.uint64)
    a[:3], b[:3] = [p - 1, p - 1, 0], [p - 1, 1, p - 1]
    assert [int(x) * int(y) % p for x, y in zip(a, b)] == common.mulmod(a, b).tolist()


def test_operators_tell_thue_morse_words_apart(spark):
    a, b = thue_morse(11, "a", "b")
    rest = " ".join(f"w{k}" for k in range(30))
    texts = {1: f"{a} {rest}", 2: f"{b} {rest}", 3: a, 4: b, 5: f"{rest} {a}"}
    rows = list(texts.items())
    got = by_id(substring_dedup.substring_dedup(frame(spark, texts)))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == substring_dedup.brute(rows)
    got = by_id(jaccard_join.jaccard_join(frame(spark, texts)))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == jaccard_join.brute(rows)
    got = by_id(lm.lm_scores(frame(spark, texts), F.col("doc_id").isin(3, 5)))
    assert (got[4]["n_known"], got[3]["n_known"], got[2]["n_known"]) == (1, 2, 31)
    got = by_id(suffix_dedup.suffix_dedup(frame(spark, texts)))
    assert {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")) for i, r in got.items()} == suffix_dedup.brute(rows)


# ---------------------------------------------------------------- clashing names, empty tables


ODD = ["_key", "_row", "_text", "component", "rep", "name", "n_blocks", "norm", "__key", "size", "bucket"]


def odd_frame(spark, texts):
    df = frame(spark, texts)
    for k, c in enumerate(ODD):
        df = df.withColumn(c, F.col("doc_id") * 10 + k)
    return df


def whole(rows):
    return {r["doc_id"]: tuple(r[c] for c in ODD) for r in rows}


def test_filters_keep_clashing_columns(spark):
    texts = {i: t for i, t in sample(4).items()} | {500 + k: t for k, t in enumerate(near(5, 4, 3))}
    item = " ".join(f"bench{k}" for k in range(20))
    texts[600] = "x " + item
    df = odd_frame(spark, texts)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    for kept in (exact_dedup.drop_copies(df), jaccard_join.keep_one(df), decontamination.drop_contaminated(df, bench), toxicity.keep_clean(df, model)):
        rows = kept.collect()
        assert kept.columns == df.columns and rows
        assert whole(rows) == {i: tuple(i * 10 + k for k in range(len(ODD))) for i in whole(rows)}
    assert 600 not in by_id(decontamination.drop_contaminated(df, bench))
    assert toxicity.toxicity(df, model).count() == len(texts)
    assert bpe.digests(df, *queries.tokenizer()).count() == len(texts)
    assert secrets.secret_scan(df).count() == len(texts)


def test_filters_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, None), (8, ""), (None, None)]
    df = frame(spark, rows).withColumn("_key", F.lit("mine"))
    assert exact_dedup.drop_copies(df).count() == 2 and jaccard_join.keep_one(df).count() == 4
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    left = decontamination.drop_contaminated(df, bench)
    assert left.count() == 3 and {r["_key"] for r in left.collect()} == {"mine"}
    assert len(decontamination.contamination(df, bench.unionByName(bench)).collect()) == 6


def test_row_keys_are_unique_and_in_order_of_ids(spark):
    df = frame(spark, [(3, "c"), (None, "x"), (1, "a"), (1, "b"), (None, "y")])
    rows = sorted((r["_key"], r["doc_id"]) for r in common.with_key(df, "doc_id").collect())
    assert [i for _, i in rows] == [1, 1, 3, None, None] and len({k for k, _ in rows}) == 5


def test_stages_of_the_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_frame(spark, {})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    none = empty(spark)
    assert lm.lm_scores(none, F.lit(True)).count() == 0 and toxicity.toxicity(none, toxicity.Model()).count() == 0
    assert decontamination.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert suffix_dedup.repeat_groups(none).count() == 0


# ---------------------------------------------------------------- op1: adaptive prefixes


def test_prefixes_are_shortened_as_far_as_the_recall_needs():
    f = jaccard_join.Forest(group=50)
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (400, f.trees * f.depth), dtype=np.uint64).astype(np.uint32)
    sig[:300, : 9 * f.depth] = sig[0, : 9 * f.depth]  # 300 texts share all of nine trees
    crowded = []
    for k in range(f.shortest, f.depth + 1):
        prefixes, n = np.unique(np.concatenate([jaccard_join._labels(sig, t, k, f)[0] for t in range(f.trees)]), return_counts=True)
        crowded.append(jaccard_join.Crowds(prefixes[n > f.group], n[n > f.group], f.group))
    stops = jaccard_join.levels(sig, crowded, f)
    assert (stops[300:] == f.shortest).all() and (stops[:300, :9] > f.shortest).any() and (stops[:300, 9:] == f.shortest).all()
    # Whatever two texts meet, the trees that both leave short enough reach the recall.
    for a, b in rng.integers(0, 400, (200, 2)):
        missed = sum(f.missed(int(k)) for k in np.maximum(stops[a], stops[b]))
        assert 1 - np.exp(missed) >= f.recall - 1e-12
    assert 1 - np.exp(f.trees * f.missed(f.shortest)) >= f.recall


def test_recall_in_a_crowded_family(spark):
    rng = random.Random(21)
    words = [f"q{k}" for k in range(5000)]
    passage = [rng.choice(words) for _ in range(120)]
    texts = {}
    for i in range(150):  # families of two, at similarities around 0.8, all around one passage
        own = passage + [rng.choice(words) for _ in range(90)]
        other = list(own)
        for at in rng.sample(range(120, 210), 3):
            other[at] = rng.choice(words)
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(other)
    want = jaccard_join.brute(list(texts.items()))
    got = by_id(jaccard_join.jaccard_join(frame(spark, texts), f=jaccard_join.Forest(group=20, piece=90)))
    links, found = sum(w[1] for w in want.values()), sum(r["n_links"] for r in got.values())
    assert links >= 100 and found >= 0.9 * links
    assert all(r["n_links"] <= want[i][1] for i, r in got.items())


# ---------------------------------------------------------------- op2: edits


def test_bpe_edits_of_long_pieces_are_local():
    ranks, pattern = queries.tokenizer()
    v = bpe.Vocabulary(bpe.load_ranks(ranks), pattern)
    rng = random.Random(31)
    data = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    p = bpe.Prefixes(v, data)
    for _ in range(40):
        a = rng.randrange(len(p.data))
        b = min(len(p.data), a + rng.randrange(6))
        p.replace(a, b, bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(6))))
        assert p.last == bpe.Prefixes(v, p.data).last
    p.replace(len(p.data), len(p.data), b"tail")
    p.replace(0, 3, b"")
    assert p.tokens() == bpe.Prefixes(v, p.data).tokens() and v.decode(p.tokens()) == p.data


# ---------------------------------------------------------------- the registered queries against brute force


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    rng = random.Random(41)
    texts = sample(6)
    for k, t in enumerate(near(6, 8, 4)):
        texts[300 + k] = t
    for i, t, _ in toxic_rows(160):
        texts[1000 + i] = t
    pieces = ["password=", "SECRET: ", "api_key='", "token = \"", "apikey:", "AKIA" + "Q" * 18, "AKIA" + "7" * 15, "deadbeef" * 4, "0" * 23, "f" * 24, "abcdef", "Zz9/Yq+8Xw", "x", " ", "\n", "é", "_", "\"'", "passwd :  short", "A1b2C3d4E5f6G7h8"]
    for i in range(60):
        texts[2000 + i] = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
    texts[3000], texts[3001] = "é" * 500, None
    frame(spark, texts).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, y) for i, _, y in toxic_rows(160)], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    pages = [(i, f"u{i}", (t or "")[:300] if i % 3 else t) for i, t in texts.items()]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(out / "pages.parquet"))
    return str(out), texts


def run(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0])


def test_query_op1(spark, tables):
    want = jaccard_join.brute(list(tables[1].items()))
    assert {i: (r["class_id"], r["n_links"]) for i, r in by_id(run(spark, tables, "op1_jaccard_join")).items()} == want


def test_query_op2(spark, tables):
    import tiktoken

    ranks, pattern = queries.tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    for i, r in by_id(run(spark, tables, "op2_byte_bpe")).items():
        ids = enc.encode_ordinary(tables[1][i] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((tables[1][i] or "").encode()).hexdigest()


def test_query_op4(spark, tables):
    import base64

    payload = {i: ((t or "")[:300] if i % 3 else (t or "")).encode() for i, t in tables[1].items()}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    got = {r["page_id"]: r for r in run(spark, tables, "op4_warc").collect()}
    assert set(got) == set(payload)
    for i, r in got.items():
        other = first[payload[i]] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload[i]), base64.b32encode(hashlib.sha1(payload[i]).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[payload[i]]) if other else ("response", None))


def test_query_op5(spark, tables):
    """Scores are those of a plain search of the fitted lexicon: whole words, stems, one edit by dynamic programming."""
    labels = spark.read.parquet(f"{tables[0]}/labels.parquet")
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    lexicon = toxicity.fit(docs, labels, toxicity.remainder(F.col("doc_id")) != 0)
    words, stems = lexicon.lexicon.words, tuple(lexicon.lexicon.stems)

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]

    got = by_id(run(spark, tables, "op5_toxicity"))
    assert set(got) == set(tables[1]) and words
    hit = 0
    for i, r in got.items():
        found = []
        for w in re.findall(r"\w+", (tables[1][i] or "").lower()):
            if w in words or (stems and w.startswith(stems)):
                found.append((0, 0, False))
            elif w not in lexicon.lexicon.ignored and any(len(t) >= 5 and one_edit(w, t) for t in words):
                found.append((0, 1, False))
        n = len(re.findall(r"\w+", tables[1][i] or ""))
        x = toxicity.features(found, n) if found else (0.0,) * toxicity.FEATURES
        assert r["n_hits"] == len(found) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["n_quoted"] or abs(r["score"] - lexicon.score(x)) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.5)
        hit += r["predicted"]
    assert hit > 20


def test_query_op6(spark, tables):
    import math
    from collections import Counter

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in tables[1].items()}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in train for w in words[i])
    total = sum(counts.values())
    got = by_id(run(spark, tables, "op6_lm"))
    held = {True: [0.0, 0.0, 0], False: [0.0, 0.0, 0]}
    for i, r in got.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in words[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(words[i]), sum(counts[w] > 0 for w in words[i]), total)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base)) and r["score"] < 0
        for k, x in enumerate((r["score"], r["base_score"], r["n_tokens"])):
            held[r["held_out"]][k] += x
    assert held[False][0] > held[False][1]


def test_query_op8(spark, tables):
    want = substring_dedup.brute(list(tables[1].items()))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(run(spark, tables, "op8_substring_dedup")).items()} == want


def test_query_op9(spark, tables):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = (("assign", assign, lambda m: len(m.group(2)) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24))
    some = 0
    for i, r in by_id(run(spark, tables, "op9_secret_scan")).items():
        t = tables[1][i] or ""
        spans = [(m.start(), n, kind, m.end()) for n, (kind, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m)]
        base = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        listed = r["spans"].split(",") if r["spans"] else []
        assert [s for s in listed if not s.startswith("entropy")] == base
        at = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])) for s in listed]
        assert at == sorted(at)
        some += len(base)
    assert some > 50


def test_query_op10(spark, tables):
    want = suffix_dedup.brute(list(tables[1].items()))
    got = by_id(run(spark, tables, "op10_suffix_dedup"))
    assert {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")) for i, r in got.items()} == want


# ---------------------------------------------------------------- op5, op9: further cases


def test_quotations_of_any_length():
    q = toxicity.quotations
    long = '"' + "word " * 200 + '"'
    assert q(long) == [(0, len(long))]
    assert q("a “b\nc” d «e» „f” 'g h' don't dogs' \" open") == [(2, 7), (10, 13), (14, 17), (18, 23)]
    assert q('"one\n\n two" three') == []


def test_toxicity_of_odd_rows(spark):
    rows = toxic_rows(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (None, 1), (5000, 1), (6, None)], "doc_id long, toxic int")
    texts = [(i, t) for i, t, _ in rows] + [(3, "word1"), (3, "word7 word9"), (None, "moron"), (9001, ""), (9002, None), (9003, "word2 " * 50_000 + "moron")]
    docs = odd_frame(spark, texts)
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] in (9001, 9002)} == {0}
    assert [r["n_hits"] for r in got if r["doc_id"] == 9003] == [1]


def test_runs_of_one_character_longer_than_the_window():
    assert secrets.entropy_spans("x1-" + "7" * 60 + "-z") == [] and secrets.hot_windows("a" * 30, 24, 3.0) == []


def test_short_random_keys_are_found():
    spans = secrets.entropy_spans("key aG7x9Qp2Lm4Zt8Vw end, internationalisation 2024-01-01T00-00 0000000000000000")
    assert spans == [(4, 20)]


# ---------------------------------------------------------------- long texts (chunks: see test_corpus)


def test_texts_beyond_a_slice(spark):
    rng = np.random.default_rng(51)
    words = np.array([f"{k:05d}" for k in range(90_000)])
    long = " ".join(words[rng.integers(0, len(words), 110_000)])
    assert len(long) > common.SLICE
    texts = {1: long, 2: long + " tail of its own", 3: "short one", 4: long.replace(" ", "\n ")}
    df = frame(spark, texts)
    ten = by_id(suffix_dedup.suffix_dedup(df))
    assert [(ten[i]["n_bytes"], ten[i]["n_removed"], ten[i]["n_spans"]) for i in (1, 2, 3, 4)] == [(len(long), len(long), 1), (len(texts[2]), len(long), 1), (9, 0, 0), (len(texts[4]), 0, 0)]
    eight = by_id(substring_dedup.substring_dedup(df))
    assert [(eight[i]["n_words"], eight[i]["n_removed"]) for i in (1, 2, 3, 4)] == [(110_000, 0), (110_004, 110_000), (2, 0), (110_000, 110_000)]
    three = by_id(exact_dedup.exact_dedup(df))
    assert [three[i]["keep_id"] for i in (1, 2, 3, 4)] == [4, 2, 3, 4] and three[1]["group_size"] == 2
    one = by_id(jaccard_join.jaccard_join(df))
    assert [(one[i]["class_id"], one[i]["copy_id"], one[i]["n_links"]) for i in (1, 2, 3, 4)] == [(1, 1, 1), (1, 2, 1), (3, 3, 0), (1, 1, 1)]
    six = by_id(lm.lm_scores(df, F.col("doc_id") == 1))
    assert [(six[i]["n_tokens"], six[i]["n_known"]) for i in (1, 2, 3, 4)] == [(110_001, 110_001), (110_005, 110_001), (3, 1), (110_001, 110_001)]
