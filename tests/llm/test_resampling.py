"""Importance resampling, token alignment and the BPE automaton against brute force and the libraries."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from docfacts.llm import alignment, importance
from docfacts.llm import bpe_automaton as A

BYTES_BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", "a<|endoftext|>b <|endoftext|>", "  \n\n x", "don't 'LL ' ' 's'", "\x1c\x1d a\x00", "aaaaaaaaaaaaaaa", "-" * 500, " " * 300 + "x", " \xa0a　b", "՘a", "\U00018e00" + "1a", "😀é日本", "▁x", "<s> <0x41>", "ab" * 300, "x " * 9, "a b"]


def odd_texts(n, letters="aeinorst hlcd \n.é日😀0'▁", seed=5):
    rng = random.Random(seed)
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES_BPE)


def test_encoder_equals_library(library):
    e, rng = A.encoder(BYTES_BPE), random.Random(4)
    anything = ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for t in [*odd_texts(2000), *anything, *("a" * i for i in range(70))]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert e.encode(t).tolist() == ids, repr(t)
        assert e.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(t)


def test_words_equal_those_of_the_library_for_every_character():
    from tokenizers.pre_tokenizers import ByteLevel

    e, theirs = A.encoder(BYTES_BPE), ByteLevel(add_prefix_space=False, use_regex=True)
    for i in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if not 0xD800 <= i < 0xE000:
            c = chr(i)
            t = f"a{c}1{c}!{c} b{c}{c}z"
            assert e._split(t) == [t[a:b] for _, (a, b) in theirs.pre_tokenize_str(t)], hex(i)


def gadgets(letters, merges):
    """The automaton as explicit states and arcs, built gadget by gadget: (arcs of each state, state that each token leads to)."""
    arcs, leads = [set(letters)], dict.fromkeys(letters, 0)
    for u, v, w in merges:
        if u not in leads or v not in leads or w in leads or v not in arcs[leads[u]]:
            continue
        after = leads[v]
        arcs.append(arcs[leads[u]] - {v})
        leads[u] = len(arcs) - 1
        for a in arcs:
            if u in a:
                a.add(w)
        leads[w] = after
    return arcs, leads


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_explicit_gadgets_and_merging(seed):
    rng = random.Random(seed)
    label = {i: bytes([97 + i]) for i in range(3)}
    merges = []
    while len(merges) < 25:
        u, v = rng.choice(list(label)), rng.choice(list(label))
        if label[u] + label[v] not in label.values():
            label[len(label)] = label[u] + label[v]
            merges.append((u, v, len(label) - 1))
    automaton = A.Automaton(label, merges)
    arcs, leads = gadgets(range(3), merges)
    assert set(leads) == set(automaton.token.values())
    for u in leads:
        assert {t for t in leads if automaton.has_arc(u, automaton.now, t)} == arcs[leads[u]], u

    def merged(word):  # the merges one after the other, each from left to right
        ids = [b - 97 for b in word]
        for u, v, w in merges:
            i, out = 0, []
            while i < len(ids):
                if ids[i : i + 2] == [u, v]:
                    out.append(w)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    for _ in range(300):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        assert automaton.path(word) == merged(word), word


def test_round_trip_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in A.round_trip(docs, BYTES_BPE).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def edge_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "A b", "x", 2), (2, "A b", "x", 2), (3, "Word, é " * 30000, "y", 3), (3, "Word, é " * 30000, "y", 3), (4, "a<|endoftext|>b", None, None), (5, " ", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int")


def test_bpe_edge_cases(spark, library):
    docs = edge_rows(spark)
    made = A.encode(docs, BYTES_BPE)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in A.decode(made, BYTES_BPE).collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    assert {tuple(r["ids"]) for r in made.where("doc_id = 4").collect()} == {tuple(library.encode("a<|endoftext|>b").ids)}
    assert 50256 not in A.encode(docs.where("doc_id = 4"), BYTES_BPE, special=False).first()["ids"]
    assert A.round_trip(docs, BYTES_BPE).count() == 8
    assert A.round_trip(docs.limit(0), BYTES_BPE).count() == 0
    assert A.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), BYTES_BPE).first()["text"] is None


def brute_alignment(library, texts):
    """The contract's columns for each text, token by token."""
    import sentencepiece

    theirs, letters, ours = sentencepiece.SentencePieceProcessor(model_file=PIECES), A.byte_letters(), library
    ours.encode_special_tokens = True
    rows, count = [], collections.Counter()
    for t in texts:
        a, b = (ours.encode(" " + t, add_special_tokens=False).ids, theirs.encode(t)) if t else ([], [])
        la = [bytes(letters[c] for c in ours.id_to_token(i)) for i in a]
        lb = [bytes([int(theirs.id_to_piece(i)[3:5], 16)]) if theirs.is_byte(i) else theirs.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(la) == b"".join(lb) == (" " + t).encode():
            rows.append(([], [], []))
            continue
        ea, eb = ([len(b"".join(x[: i + 1])) for i in range(len(x))] for x in (la, lb))
        groups, last = [], 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(([x for x, e in zip(a, ea, strict=True) if last < e <= cut], [x for x, e in zip(b, eb, strict=True) if last < e <= cut]))
            last = cut
        rows.append((a, b, groups))
        count.update({(x, y) for g, h in groups for x in g for y in h})
    ours.encode_special_tokens = False
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups in rows:
        links = [(x, y) for g, h in groups for x in g for y in h]
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def aligned(spark, texts):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, pairs int").repartition(3)
    rows = {r["doc_id"]: r for r in alignment.align(spark, docs, BYTES_BPE, PIECES).collect()}
    return [tuple(rows[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for i in range(len(texts))]


def test_alignment_equals_brute_force(spark, library):
    texts = [None, *odd_texts(150), *odd_texts(40), "the same words " * 400, "日" * 300, None]
    assert aligned(spark, texts) == brute_alignment(library, texts)


def test_wide_groups_and_small_shards_change_nothing(library, monkeypatch):
    texts = [None, *odd_texts(60), "日本語" * 50]
    usual = alignment.Aligner(BYTES_BPE, PIECES).align(texts)
    monkeypatch.setattr(alignment, "WIDE", 2)
    for x, y in zip(usual, alignment.Aligner(BYTES_BPE, PIECES).align(texts), strict=True):
        assert x[:5] == y[:5] and x[5].tolist() == y[5].tolist() and x[6].tolist() == y[6].tolist()


def test_ends_rank_and_select():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        ends = np.flatnonzero(np.append(rng.random(size - 1) < 0.3, True)) + 1
        e = alignment.Ends.of(ends, size)
        at = np.arange(size + 1)
        assert e.select().tolist() == ends.tolist()
        assert e.rank(at).tolist() == [(ends <= x).sum() for x in at]


def test_alignment_edge_cases(spark):
    docs = edge_rows(spark)
    rows = alignment.align(spark, docs, BYTES_BPE, PIECES).collect()
    assert len(rows) == 8
    assert {(r["n_a"], r["groups_sha256"]) for r in rows if r["doc_id"] == 1} == {(0, "")}
    assert len({tuple(r) for r in rows if r["doc_id"] == 3}) == 1
    assert alignment.align(spark, docs.limit(0), BYTES_BPE, PIECES).count() == 0


def brute_resample(docs, target, buckets, runs, percent, least, seed):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    made = [(d, *features(t)) for d, t in docs]
    s, t = collections.Counter(x for _, _, f in made for x in f), collections.Counter(x for y in target for x in features(y)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for d, n, f in made:
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize(("buckets", "runs", "block"), [(10_000, 1, importance.BLOCK), (50, 3, 40), (65_536, 2, 1)])
def test_resample_equals_brute_force(spark, monkeypatch, buckets, runs, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    rng = random.Random(buckets)
    words = ["Alpha", "beta", "éa", "x1", "日本", "gamma", "İx", "the"]
    texts = [None, "", "!", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(200))]
    docs = [(i % 190 if i != 50 else None, t) for i, t in enumerate(texts)]
    target = ["beta gamma x1", None, "gamma, Gamma!"]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(3)
    made = importance.resample(spark, frame, spark.createDataFrame([(t,) for t in target], "text string"), buckets, runs, 30, 4, "s")
    assert collections.Counter(map(tuple, made.collect())) == brute_resample(docs, target, buckets, runs, 30, 4, "s")


def test_resample_edge_cases(spark):
    docs = edge_rows(spark)
    none = docs.limit(0)
    assert importance.resample(spark, none, docs).count() == 0
    rows = importance.resample(spark, docs, none, percent=100).collect()
    assert len(rows) == 8 and [r["rank"] for r in rows if r["doc_id"] == 3] in ([1, 2], [2, 1])
    assert {r["rank"] for r in rows if r["doc_id"] != 3} == {None}
