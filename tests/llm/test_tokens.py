"""Token stores and packing: exact round trips against the library."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from winnowry.llm import packing, repair, shared, token_store
from winnowry.llm.tokens import encoder
from winnowry.llm.words import flat

ODD = ["don't stop's 'tis I'll  they've--it's", "  two  spaces \n\n new\nline\t tab ", "café élan, naïve—dash “quote” x² ½ 3.14 10,000", "", "\n", "a", "日本語 テキスト。 x", "×5 ÷ 3 é× ÷é", "<|endoftext|> hi <|endoftext|>.", " nbsp x .　y", "'s 'S S's", "İstanbul ΣΑΣ. Σ.a", "é clair é, Á."]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, spaces):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice([*"ab'sStT .,\n-é×1 ", "ll", "́", "  ", "ñ"]) for _ in range(r.randint(0, 40))) for _ in range(500)]
    model = Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):  # the second time from memory
        ids, at = encoder(public_tokenizers.path(name), spaces).encode(*flat(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]


def thue_morse(letters: str, power: int) -> str:
    word = letters[0]
    for _ in range(power):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_that_share_a_hash_keep_their_own_ids(name, spaces, monkeypatch):
    from winnowry.llm import tokens

    model = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [thue_morse(x, k) for k in (10, 11, 12) for x in ("ab", "ba")] + ["alpha beta", "gamma, delta", "longer than sixteen letters inonepiecehere inonepiecethere"]
    plain = [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
    read = lambda e: (lambda ids, at: [ids[a:b].tolist() for a, b in zip(at, at[1:])])(*e.encode(*flat(pa.array(texts))))
    assert read(tokens.Encoder(public_tokenizers.path(name), spaces)) == plain
    # All pieces under a few hashes: each is told apart by its bytes.
    monkeypatch.setattr(tokens, "mix", lambda h: h & tokens.U64(1))
    one = tokens.Encoder(public_tokenizers.path(name), spaces)
    assert read(one) == plain and read(one) == plain


def test_repair_compresses_runs():
    for ids in (np.tile([5, 6], 40_000), np.full(3000, 5), np.tile([1, 2, 3], 2000)):
        ids = ids.astype(np.uint32)
        s, rules = repair.compress(ids, 10, 0)
        assert len(s) + len(rules) < 40
        assert (repair.Grammar(rules, repair.lengths(rules, 10), 10).expand(s) == ids).all()


def plain_repair(ids: list[int], terminals: int, end: int, least: int) -> tuple[int, int]:
    """Re-Pair a pair at a time, the most frequent first: symbols and rules it ends with."""
    rules = 0
    while True:
        count, i = Counter(), 0
        last = None
        for i in range(len(ids) - 1):
            pair = (ids[i], ids[i + 1])
            if end in pair or (pair == last and pair[0] == pair[1]):
                last = None
                continue
            count[pair] += 1
            last = pair
        if not count or count.most_common(1)[0][1] < least:
            return len(ids), rules
        pair, out, i = count.most_common(1)[0][0], [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == pair:
                out.append(terminals + rules)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids, rules = out, rules + 1


def test_repair_is_as_small_as_one_pair_at_a_time():
    r = np.random.default_rng(4)
    words = [r.integers(1, 60, r.integers(2, 7)) for _ in range(80)]
    ids = np.concatenate([words[min(int(r.exponential(12)), 79)] for _ in range(900)]).astype(np.uint32)
    s, rules = repair.compress(ids, 100, 0)
    symbols, plain = plain_repair(ids.tolist(), 100, 0, repair.LEAST)
    assert 3 * len(s) + 12 * len(rules) < 1.1 * (3 * symbols + 12 * plain)


def test_repair_round_trip():
    r = np.random.default_rng(0)
    ids = np.concatenate([r.integers(1, 30, 4000), np.tile([5, 6, 7, 5], 800), np.full(300, 9), [0]]).astype(np.uint32)
    symbols, rules = repair.compress(ids, 100, 0)
    g = repair.Grammar(rules, repair.lengths(rules, 100), 100)
    assert len(symbols) < len(ids) * 0.8 and len(rules)
    assert (g.expand(symbols) == ids).all()
    wide = np.append(symbols, np.uint32(1 << 30))
    assert (repair.unpacked(repair.packed(symbols), len(symbols)) == symbols).all() and (repair.unpacked(repair.packed(wide), len(wide), 5, 9) == wide[5:9]).all()
    assert (repair.unpacked(repair.packed(wide), len(wide)) == wide).all()
    for few in ([], [0], [3, 0]):
        s, rules = repair.compress(np.array(few, np.uint32), 100, 0)
        assert s.tolist() == few and not len(rules)


def test_store(spark, docs, rows, empty):
    path = shared.shared_path(spark, "tokens")
    token_store.write_store(docs, path)
    got = token_store.documents(token_store.read_store(spark, path)).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = [[*model.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]
    assert Counter((g.doc_id, tuple(g.ids), g.ids_crc32) for g in got) == Counter((r[0], tuple(p), zlib.crc32(np.array(p, "<u4").tobytes())) for r, p in zip(rows, plain))
    got.sort(key=lambda g: g.start)
    at = 0
    for a, b in zip(got, [*got[1:], None]):
        assert a.start == at and (b is None or (a.doc_id is None) or b.doc_id >= a.doc_id)
        at += a.n_tokens
    shard = spark.read.parquet(path).collect()[0]
    by = {g.start: list(g.ids) for g in got}
    before = token_store.read_store(spark, path).where(f"shard = {shard['shard']}").first()["before"]
    for n in (0, len(shard["doc_ids"]) // 2, len(shard["doc_ids"]) - 1):
        assert token_store.one_document(shard, n).tolist() == by[before + sum(shard["tokens"][:n])]
    path = shared.shared_path(spark, "tokens")
    token_store.write_store(empty, path)
    assert token_store.documents(token_store.read_store(spark, path)).count() == 0


@pytest.mark.parametrize(("capacity", "shard"), [(4096, 1 << 15), (50, 7)])
def test_packing(docs, rows, empty, monkeypatch, capacity, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    got = packing.pack_documents(docs, capacity, with_ids=True).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = Counter()
    for i, t, *_ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            plain[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32, tuple(g.ids)) for g in got) == plain
    bins = {}
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert g.offset == bins.get(g.sequence_id, 0)
        bins[g.sequence_id] = g.offset + g.length
    assert max(bins.values()) <= capacity
    assert len(bins) <= 1.1 * sum(bins.values()) / capacity + 3
    assert packing.pack_documents(empty).count() == 0


def test_sum_of_squares_takes_the_least_sum():
    """Each placement is checked against all others by recounting."""
    r = np.random.default_rng(3)
    sizes = r.integers(1, 12, 60)
    own, offset, fill = packing.sum_of_squares(sizes, 11)
    level = {}
    for s, b in zip(sizes.tolist(), own.tolist()):
        def total(bin_):
            after = {**level, bin_: level.get(bin_, 0) + s}
            return sum(n * n for n in Counter(11 - v for v in after.values() if v < 11).values())

        choices = [k for k, v in level.items() if v + s <= 11] + [max(level, default=-1) + 1]
        assert total(b) == min(map(total, choices))
        level[b] = level.get(b, 0) + s
    assert [level[k] for k in range(len(fill))] == fill.tolist()


def test_repair_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(9)
    passage, end = r.integers(0, 5000, 500), 5000
    ids = np.concatenate([np.append(passage, end) for _ in range(40)] + [np.append(r.integers(0, 5000, 50), end) for _ in range(20)] + [np.full(300, 7)])
    s, rules = repair.compress(ids, 5001, end)
    pairs, count = np.unique(np.stack([s[:-1], s[1:]]), axis=1, return_counts=True)
    assert not (count[(pairs != end).all(axis=0)] >= repair.LEAST).any()
    assert (s[:80:2] == s[0]).all() and repair.lengths(rules, 5001)[s[0] - 5001] == 500
    assert (repair.Grammar(rules, repair.lengths(rules, 5001), 5001).expand(s) == ids).all()
