"""SentencePiece transducer and packing against the libraries and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from docfacts.llm import packing
from docfacts.llm import sentencepiece_wfst as W

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b", "a \nb", "\n\na\n", "▁x▁▁y", "é😀\x00z", "<s> <0x41>", "日本語", "\tx = 1", " \n", "x\n", "don't 12.3 A.B. <|endoftext|>", "ΟΔΟΣ Σας é"]


def test_wfst_equals_library():
    import sentencepiece

    ours, theirs = W.encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abehinorst  \n.é日😀▁") for _ in range(rng.randint(1, 50))) for _ in range(500)]
    for t in texts:
        ids = np.frombuffer(ours.encode(t), "<i4").tolist()
        assert ids == theirs.encode(t), t
        assert ours.decode(ids) == theirs.decode(ids)


def test_unigram_shortest_path_equals_brute_force():
    pieces = [("<unk>", 0.0, W.UNKNOWN), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -3.5, 1), ("ba", -3.2, 1), ("aba", -5.5, 1)]
    e = W.Encoder(W.Model(pieces, W.UNIGRAM))
    score = {t: s for t, s, k in pieces if k == 1}

    def best(t):
        return max(((score[t[:i]] + best(t[i:])) for i in range(1, len(t) + 1) if t[:i] in score), default=0.0 if not t else -1e9)

    for t in ("▁ababa", "▁a", "▁bab", "aab", "▁aabbaba"):
        assert sum(score[pieces[i][0]] for i in e.path(t)) == pytest.approx(best(t))
        assert "".join(pieces[i][0] for i in e.path(t)) == t


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    letters = "ab ▁ \t\u3000ﬁ①ＡｶﾞÅA\u030a가각\u1100\u1161é\u0301½x\u200b\u00adß"
    return ["", " ", "  a ▁ b  ▁ ", "▁", " ▁ a", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(n))]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize(("prefix", "strip", "escape"), [(True, True, True), (True, False, True), (False, True, True), (False, False, False)])
def test_normaliser_machine_equals_library(rule, prefix, strip, escape):
    import sentencepiece

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=strip, escape_whitespaces=escape)
    model = W.Model.parse(theirs.serialized_model_proto())
    assert (model.dummy_prefix, model.strip, model.escape) == (prefix, strip, escape)
    machine = W.Encoder(model).normaliser()
    for t in odd_texts(400):
        assert "".join(W.shortest(machine, t)[0]) == theirs.normalize(t), repr(t)


PIECE_SETS = [("<unk>", 0.0, W.UNKNOWN), *((t, -s, 1) for t, s in (("▁", 3.0), ("a", 2.0), ("b", 2.5), ("ab", 3.0), ("▁a", 3.5), ("ba", 3.2), ("aba", 5.5), ("bb", 4.9), ("▁ab", 5.2)))]
BYTES = [(f"<0x{i:02X}>", 0.0, W.BYTE) for i in range(256)]


@pytest.mark.parametrize("kind", [W.UNIGRAM, W.BPE])
@pytest.mark.parametrize("more", [[], BYTES])
def test_encoder_equals_the_whole_composition(kind, more):
    import sentencepiece

    charsmap = W.Model.parse(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).charsmap
    for options in ({}, {"strip": True}, {"dummy_prefix": False}, {"strip": True, "charsmap": charsmap}):
        e = W.Encoder(W.Model(PIECE_SETS + more, kind, **options))
        machine = e.machine()
        for t in [*odd_texts(60), *("".join(random.Random(i).choice("ab é") for _ in range(12)) for i in range(60))]:
            ids = list(W.shortest(machine, t)[0])
            ids = [x for i, x in enumerate(ids) if more or not (i and x == ids[i - 1] == e.unknown)]
            assert np.frombuffer(e.encode(t), "<i4").tolist() == ids, (repr(t), options)


def test_compositions_are_associative():
    e = W.Encoder(W.Model(PIECE_SETS + BYTES, W.BPE, strip=True))
    n, p, q = e.normaliser(), W.Pieces(e), W.Pairs(e)
    for t in odd_texts(80):
        assert W.shortest(W.compose(W.compose(n, p), q), t) == W.shortest(W.compose(n, W.compose(p, q)), t)


def test_real_model_equals_its_composition():
    e = W.encoder(PIECES)
    machine = e.machine()
    for t in [*ODD, "The quick brown fox, 12 x 7", "été à Zürich"]:
        assert np.frombuffer(e.encode(t), "<i4").tolist() == list(W.shortest(machine, t)[0]), t


def test_ids_come_from_the_composition(monkeypatch):
    """Encoding takes the ids of each word from the shortest path through pieces and pairs, and from nowhere else."""
    e, seen, real = W.Encoder(W.Model.load(PIECES)), [], W.first_path

    def watched(machine, inputs):
        seen.append((machine, inputs))
        return real(machine, inputs)

    monkeypatch.setattr(W, "first_path", watched)
    ids = np.frombuffer(e.encode("The hotel of é and 日"), "<i4").tolist()
    assert [x for _, x in seen] == ["▁The", "▁hotel", "▁of", "▁é", "▁and", "▁日"]
    assert all(m is e.pieces and isinstance(m.first, W.Pieces) and isinstance(m.second, W.Pairs) for m, _ in seen)
    assert ids == [i for _, x in seen for i in W.shortest(W.compose(W.Pieces(e), W.Pairs(e)), x)[0]]
    monkeypatch.setattr(W, "first_path", lambda machine, inputs: ((7,), 0.0))
    assert np.frombuffer(e.encode("never seen"), "<i4").tolist() == [7, 7]


def test_encode_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "a b", "x"), (3, "word " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = W.decode(W.encode(docs, PIECES), PIECES).collect()
    assert len(out) == 5 and all(r["round_trip"] for r in out if r["text"] is not None)
    assert [r["text"] for r in out if r["doc_id"] == 1] == [None]
    assert W.encode(docs.limit(0), PIECES).count() == 0


def test_word_encoder_equals_tokenizer():
    e = packing.WordEncoder(WORDS)
    for t, data in zip(ODD, e.batch(ODD), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_best_fit_equals_brute_force():
    rng, bins, rooms = random.Random(5), packing.BestFit(100), []
    for need in sorted((rng.randint(1, 100) for _ in range(1500)), reverse=True):
        window, offset = bins.put(need)
        fits = [r for r in rooms if r >= need]
        if fits:
            assert rooms[window] == min(fits) and offset == 100 - min(fits)
        else:
            assert window == len(rooms) and offset == 0
            rooms.append(100)
        rooms[window] -= need


def test_pack(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "word " * 9000)], "doc_id long, text string")
    docs = docs.union(extra)
    rows = packing.pack(docs, WORDS, shard_docs=64).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    enc = packing.WordEncoder(WORDS)
    for d in docs.collect():
        data = enc.batch([d["text"]])[0] + np.array([2], "<u4").tobytes()
        at = 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] * 4 == len(data)
            assert r["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at * 4 == len(data)
    assert packing.pack(docs.limit(0), WORDS).count() == 0
