import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from lociq.llm import codes, packing, pieces, tokens
from lociq.llm.text import pieces as cut
from tokenizers import Tokenizer


def ids_of(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: e.ids for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_joined_words_have_the_librarys_ids():
    """Whole texts, with words that the normaliser changes or splits and special strings in them, under a cache that must forget."""
    rng = random.Random(3)
    odd = ["don't", "İstanbul", "e\u0301t\u0301", "a\u00a0b\u3000c", "\u0301x", "ΣΑΣ", "ﬁn", "日本語", "😀😀", "x<|endoftext|>y", "<|startoftext|>", "\x1c", "\ufeff", "'s'll", "½³", "</w>", "a</w>b", "\x85", "Ǆ", "ß" * 40, ">\u0338", "<|endoftext|>\u0338"]
    texts = ["", " \n\t ", *odd]
    for _ in range(300):
        texts.append(" ".join(rng.choice(odd) if rng.random() < 0.03 else "".join(rng.choice("abcdeéñжд'-.1Z") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 80))))
    want = [x for _, x in sorted(ids_of(list(enumerate(texts))).items())]
    for most, joined in ((1 << 19, 1000), (50, 7), (400, 3)):
        encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most, joined)
        for _ in range(2):
            got = []
            for _, data, offs in cut(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), most=2000):
                ids, at = encoder.encode(data, offs)
                got += [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])]
            assert got == want


def test_codes_give_every_id():
    rng = np.random.default_rng(0)
    for top in (10, 300, 50_000, 2**31):
        ids = rng.integers(0, top, 3000).astype(np.uint32)
        c = codes.encode_ids(ids)
        assert (codes.decode_ids(c[0], c[1]) == ids).all() and all(codes.id_at(*c, k) == ids[k] for k in range(0, 3000, 7))


def test_token_files(plain_df, plain, hard, hard_rows, empty):
    want, start = ids_of(plain), 0
    for r in sorted(codes.token_files(plain_df).collect()):
        x = [*want[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), crc(x))
        start += len(x)
    by_text = {}
    for r in codes.token_files(hard).collect():
        by_text.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    expected = {}
    for i, t in hard_rows:
        x = [*ids_of([(0, t)])[0], 2]
        expected.setdefault(i, []).append((len(x), crc(x)))
    assert {i: sorted(v) for i, v in by_text.items()} == {i: sorted(v) for i, v in expected.items()} and codes.token_files(empty).count() == 0


def test_any_token_of_a_file(spark, plain_df, plain, tmp_path):
    """Direct access through the written files, beyond a document's end and without the document."""
    path, want = str(tmp_path / "codes"), ids_of(plain)
    codes.write_codes(plain_df.selectExpr("doc_id key", "coalesce(text, '') text"), path, shard_ids=500)
    asked = [(i, k) for i, x in want.items() for k in (0, len(x) // 2, len(x), len(x) + 1, -1)] + [(999, 0)]
    got = {(r.key, r.k): r.id for r in codes.token_at(spark, path, spark.createDataFrame(asked + asked[:3], "key long, k long")).collect()}
    assert got == {(i, k): ([*want[i], 2][k] if i in want and 0 <= k <= len(want[i]) else None) for i, k in asked}


def test_packing(plain_df, plain, hard, hard_rows, empty):
    want = ids_of(plain)
    rows = packing.pack(plain_df, capacity=64).collect()
    assert len(rows) == sum(-(-(len(x) + 1) // 64) for x in want.values())
    bins = {}
    for r in rows:
        x = [*want[r.doc_id], 1][r.start : r.start + 64]
        assert r.start == 64 * r.piece and (r.length, r.ids_crc32) == (len(x), crc(x))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    got, expected = {}, {}
    for r in packing.pack(hard, capacity=64).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, t in hard_rows:
        x = [*ids_of([(0, t)])[0], 1]
        expected.setdefault(i, []).extend((s, min(64, len(x) - s), crc(x[s : s + 64])) for s in range(0, len(x), 64))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in expected.items()} and packing.pack(empty).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    h = {}
    for _ in range(5000):
        n = min(4096, max(1, int(rng.lognormvariate(6.5, 1.2))))
        h[n] = h.get(n, 0) + 1
    slots = packing.plan(h)
    total = sum(k * v for k, v in h.items())
    assert sum(s[0] * s[2] for s in slots) == total
    assert max(s[3] + s[2] for s in slots) <= -(-total // 4096) + 3


def test_pieces_are_the_librarys(plain_df, plain, hard, hard_rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    texts = [t or "" for _, t in plain] + ["  two  spaces ", "tab\tand\nline", "a" * 300, "日本語 😀", "a▁b", "<s> </s>"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    encoder = pieces.PieceEncoder(pieces.default_path())
    got = []
    for _, data, offs in cut(iter([batch])):
        ids, at, score = encoder.encode(data, offs)
        got += [ids[0][s:e].tolist() for s, e in zip(at[0][:-1], at[0][1:])]
    assert got == [sp.encode(t) for t in texts]
    rows = pieces.digests(plain_df).collect()
    assert all(r.round_trip for r in rows)
    encoded = pieces.encode(plain_df)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in plain)
    assert pieces.encode(hard, method="viterbi").count() == hard.count() and pieces.digests(empty).count() == 0
    got = sorted((r.doc_id or -1, r.n_ids, r.ids_crc32) for r in pieces.digests(hard).collect())
    assert got == sorted((i or -1, len(x := sp.encode(t or "")), crc(x)) for i, t in hard_rows)


def test_viterbi_is_the_best_segmentation():
    m = pieces.PieceModel.of(pieces.default_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rng = random.Random(0)
    for _ in range(60):
        word = "▁" + "".join(rng.choice("theinganrzq▁漢") for _ in range(rng.randint(1, 9)))
        best = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                s = m.score_of.get(word[i:j], -np.inf)
                s = max(s, m.unknown) if np.isfinite(s) else m.unknown if j - i == 1 else s
                best[j] = max(best[j], best[i] + s)
        flats, _, score = m.encode_units([word])
        assert abs(score[0] - best[-1]) < 1e-6 * abs(best[-1]) and m.unknown > -1e6
        own, names = 0.0, {i: w for w, i in zip(m.score_of, map(sp.piece_to_id, m.score_of))}
        for i in flats[1].tolist():  # the score of the segmentation itself; bytes of a character without a piece count once
            own += max(m.score_of[names[i]], m.unknown) if i in names else m.unknown if i == flats[1][0] or 0xC0 <= int(sp.id_to_piece(i)[3:5], 16) or int(sp.id_to_piece(i)[3:5], 16) < 0x80 else 0.0
        assert abs(own - best[-1]) < 1e-6 * abs(best[-1])
