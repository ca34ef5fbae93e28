import random
import zlib

import numpy as np
import pytest
import sentencepiece as sp
from tokenizers import Tokenizer

from cmdlens.llm import harmonic_pack, hd_langid, kd_shard, piece_fst

from .cases import awkward, frame, simple

tokenizers_dir = pytest.importorskip("public_tokenizers")


def test_shards_are_near_equal_and_gapless(spark):
    r = random.Random(1)
    pairs = [(i, "x" * r.randrange(200)) for i in range(3000)] + [(7, "same")] * 1500
    rows = kd_shard.shard(simple(spark, pairs), 24, per_task=100).collect()
    assert len(rows) == len(pairs)
    size, slots = {}, {}
    for x in rows:
        size[x.shard] = size.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
    assert sorted(size) == list(range(24)) and max(size.values()) - min(size.values()) < 0.05 * max(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shard_awkward_rows(spark):
    rows = awkward()
    out = kd_shard.shard(frame(spark, rows), 5).collect()
    want = sorted(str((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for d, t, *_ in rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in out) == want
    assert kd_shard.shard(frame(spark, []), 24).count() == 0
    assert {r.shard for r in kd_shard.shard(frame(spark, rows), 1).collect()} == {0}


def texts_of(lang, r, n):
    letters = {"aa": "abcdeilnorst ", "bb": "äöübcdeghiknt ", "cc": "αβγδεικλνο "}[lang]
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 300))) for _ in range(n)]


def test_language_profiles(spark):
    r = random.Random(2)
    rows, i = [], 0
    for lang in ("aa", "bb", "cc"):
        for t in texts_of(lang, r, 80):
            rows.append((i, t, lang, "s", None, 1, "", "", 0, None))
            i += 1
    rows += [(1000, None, "aa", "s", None, 1, "", "", 0, None), (1001, " 12 !", "bb", "s", None, 1, "", "", 0, None)]
    out = {x.doc_id: x for x in hd_langid.identify(frame(spark, rows)).collect()}
    right = [out[d].lang_pred == lang for d, t, lang, *_ in rows if t and t.strip() and d < 1000]
    assert sum(right) / len(right) > 0.95 and all(0 <= x.score <= 1 for x in out.values())
    assert (out[1000].lang_pred, out[1001].lang_pred, out[1001].score) == ("und", "und", 0.0)
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, x in out.items())


def test_bundles_are_bound_trigrams():
    """The blocked sums equal the definition, letter by letter."""
    texts = ["ab a", "", "Éa-b"]
    got = hd_langid.bundle(texts, np.arange(3), 3)
    v = {c: hd_langid.letter_vector(ord(c)).astype(int) for c in "ab é"}

    def tri(a, b, c):
        return np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    assert (got[0] == tri(" ", "a", "b") + tri("a", "b", " ") + tri(" ", "a", " ")).all() and not got[1].any()
    assert (got[2] == tri(" ", "é", "a") + tri("é", "a", " ") + tri(" ", "b", " ")).all()


def test_blocks_do_not_matter(monkeypatch):
    texts = ["abc def", "", "xyz", "a" * 50, "éa"] * 4
    blocks = list(hd_langid._text_blocks(texts))
    assert blocks == [(0, 20)]
    monkeypatch.setattr(hd_langid, "BLOCK_TEXTS", 3)
    assert [b - a for a, b in hd_langid._text_blocks(texts)] == [3] * 6 + [2]
    monkeypatch.setattr(hd_langid, "BLOCK_CHARS", 5)
    blocks = list(hd_langid._text_blocks(texts))
    assert [i for a, b in blocks for i in range(a, b)] == list(range(20))


def test_language_awkward_rows(spark):
    rows = awkward()
    whole = hd_langid.identify(frame(spark, rows)).collect()
    assert len(whole) == len(rows) and hd_langid.identify(frame(spark, [])).count() == 0
    unlabelled = [(*r[:2], None, *r[3:]) for r in rows]
    assert {x.lang_pred for x in hd_langid.identify(frame(spark, unlabelled)).collect()} == {"und"}


def byte_bpe():
    return Tokenizer.from_file(tokenizers_dir.path("byte_bpe_50k.json"))


def test_memoised_ids_are_the_tokenizers():
    t, r = byte_bpe(), random.Random(5)
    texts = ["a  b\n c<|endoftext|> d  <|endoftext|>  e   x \x1c y .\x1c z", "", " ", "  lead", "trail   ", "we'll it's 's", "日本語  。x",
             " \n", "a \n\n b", "é.\né, ü!? b.. c.,", "ʰa bʰ ɐɐ", "<|endoftext|>\nfoo<|endoftext|> <|endoftext|>", "a b c　 d"]
    bits = ["a", "be", " ", "\n", ".", " 's", "é", "\t", " ", "1", "日", "'t", "<|endoftext|>", "!", "\r", "\x1c", "\x85"]
    texts += ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    tokens = harmonic_pack._Tokens(tokenizers_dir.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, tokens(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("per_worker", [200_000, 40])
def test_packing(spark, per_worker):
    rows = awkward() + [(200 + i, "word " * (i * 7 % 900), None, None, None, 1, "", "", 0, None) for i in range(120)]
    out = harmonic_pack.pack(frame(spark, rows), per_worker=per_worker).collect()
    t = byte_bpe()
    ids = [np.array(t.encode(x[1] or "", add_special_tokens=False).ids + [0], "<u4") for x in rows]
    want = sorted(str((x[0], len(i))) for x, i in zip(rows, ids))
    assert sorted(str((p.doc_id, p.doc_tokens)) for p in out if p.start == 0) == want
    by_id = {(x[0], len(i)): i for x, i in zip(rows, ids)}
    sequences = {}
    for p in out:
        i = by_id[p.doc_id, p.doc_tokens]
        assert p.ids_crc32 == zlib.crc32(i[p.start:p.start + p.length].tobytes()) or p.doc_id is None
        sequences.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in out) == sum(map(len, ids))
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    full = [m for m in sequences.values() if m[0]["class"] < harmonic_pack.CLASSES]
    assert all(len(m) <= m[0]["class"] for m in full)


def test_cuts_fill_their_classes():
    for n in range(1, 4000):
        cut = harmonic_pack.cut_lengths(n)
        assert sum(cut) == n and all(1 <= x <= 1024 for x in cut)
        for x in cut:
            k = 1024 // x
            assert k >= harmonic_pack.CLASSES or k * x >= 0.96 * 1024


def test_pack_empty(spark):
    assert harmonic_pack.pack(frame(spark, [])).count() == 0


def machine_and_library(model):
    return piece_fst.PieceTransducer(model), sp.SentencePieceProcessor(model_proto=model)


def test_transducer_equals_the_library():
    with open(tokenizers_dir.path("piece_bpe_32k.model"), "rb") as f:
        m, lib = machine_and_library(f.read())
    r = random.Random(2)
    texts = ["", "  ", " a", "a  b   c\n\td", "日本語テスト▁x", "🙂🙂 é", "\x00\x01", "a" * 300, "            x", "---- ====", "⁇ <s> </s> <unk> <0x41>"]
    texts += ["".join(r.choice("ab the▁ in on \n1é語🙂-='") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ids = m.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t), t
        assert m.decode(ids) == lib.decode(lib.encode(t)), t
    for _ in range(500):
        ids = [r.choice([r.randrange(3, 259), r.randrange(3, 32000)]) for _ in range(r.randint(0, 8))]
        assert m.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids), ids


def test_unigram_weights():
    """A hand-made unigram model: the lightest path is the library's."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3.1, 1),
                               ("▁a", -3.3, 1), ("ba", -4.2, 1), ("aba", -6, 1), ("bb", -6.3, 1), ("▁ab", -5.25, 1)]:
        p = proto.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True
    m, lib = machine_and_library(proto.SerializeToString())
    r = random.Random(3)
    for _ in range(400):
        t = "".join(r.choice("aabb xx") for _ in range(r.randint(0, 14)))
        assert np.frombuffer(m.encode(t), "<u4").tolist() == lib.encode(t), t


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_normalisers_equal_the_library(rule):
    """Character maps, in models made by hand: rewritten text, ids and decoded text are the library's."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    normaliser = pb.ModelProto()
    normaliser.ParseFromString(sp.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    charsmap = normaliser.normalizer_spec.precompiled_charsmap
    assert len(piece_fst.character_rules(charsmap)) > 5000
    r = random.Random(rule)
    signs = list("aAbB  \t\n\u3000\u00a0éàﬁｱｶﾞ①½¨語한ﷺ\x00\x01\x7f\ufeff") + ["e\u0301", "\u0300", "\u1112\u1161\u11ab", "ｶﾞ", "\u1100", "\u1161", "🙂", "\u200b", "\u0344"]
    texts = ["", " ", "\x01", " \x01 ", "\u3000", "a\u0301\u0300", "  a \u3000 b  "]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(400)]
    for prefix, squeeze, suffix, fallback in [(True, True, False, True), (True, False, False, False), (False, True, False, True),
                                              (False, False, False, False), (True, True, True, True), (True, False, True, False)]:
        proto = pb.ModelProto()
        pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + ([(f"<0x{i:02X}>", 0, 6) for i in range(256)] if fallback else [])
        pieces += [(x, -2.3 - i / 7, 1) for i, x in enumerate("▁ abéàfiガ1語한" .replace(" ", ""))]
        pieces += [("▁a", -3.9, 1), ("ab", -4.4, 1), ("fi", -4.7, 1), ("a▁" if suffix else "▁b", -4.1, 1), ("한語", -6.9, 1)]
        for piece, score, kind in pieces:
            p = proto.pieces.add()
            p.piece, p.score, p.type = piece, score, kind
        proto.trainer_spec.model_type = 1
        proto.trainer_spec.byte_fallback = fallback
        proto.trainer_spec.treat_whitespace_as_suffix = suffix
        proto.normalizer_spec.precompiled_charsmap = charsmap
        proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
        m, lib = machine_and_library(proto.SerializeToString())
        for t in texts:
            ids = m.encode(t)
            assert m.normalise(t) == lib.normalize(t), (t, prefix, squeeze, suffix)
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t), (t, prefix, squeeze, suffix)
            assert m.decode(ids) == lib.decode(lib.encode(t)), (t, prefix, squeeze, suffix)


def test_encoding_awkward_rows(spark):
    rows = awkward()
    out = piece_fst.encode_documents(frame(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in out) == sorted(str((d, t or "")) for d, t, *_ in rows)
    assert piece_fst.encode_documents(frame(spark, [])).count() == 0
