"""Grammars and token files: exact round trips, random access, and the library's own ids."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import common, repair, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")


def sequences():
    rng = np.random.default_rng(0)
    yield from (np.zeros(n, np.uint32) for n in (0, 1, 2, 3, 64, 1000, 4097))
    yield from (rng.integers(0, k, n).astype(np.uint32) for k, n in ((2, 5000), (3, 9), (50_000, 3000), (2**31 - 1, 5), (100, 70_000)))
    phrase = rng.integers(0, 60_000, 37).astype(np.uint32)
    yield np.tile(phrase, 200)
    yield np.concatenate([np.tile(phrase[:5], 50), np.repeat(phrase[7], 999), np.tile(phrase, 30), phrase[:3]])


@pytest.mark.parametrize("least", [2, 5, 32])
def test_grammars_give_back_their_ids(least):
    rng = random.Random(1)
    for ids in sequences():
        g = repair.build(ids % (1 << 22), least)
        h, sums = repair.from_bytes(repair.to_bytes(g))
        for x in (g, h):
            assert np.array_equal(repair.expand(x, x.sequence), ids % (1 << 22))
        assert int(h.lengths[h.sequence].sum()) == len(ids)
        for k, (a, b) in enumerate(g.rules):  # a rule stands on what was there before it, and its length is theirs
            at = len(g.terminals) + k
            assert max(a, b) < at and h.lengths[at] == h.lengths[a] + h.lengths[b]
        for _ in range(30 if len(ids) else 0):
            start = rng.randrange(len(ids))
            stop = rng.choice([start + 1, min(len(ids), start + 2000), rng.randrange(start + 1, len(ids) + 1)])
            assert np.array_equal(repair.access(h, sums, start, stop), ids[start:stop] % (1 << 22))


def test_frequent_pairs_are_replaced():
    phrase = np.arange(64, dtype=np.uint32) + 1000
    g = repair.build(np.tile(phrase, 500))
    assert len(g.sequence) <= 500 and len(repair.to_bytes(g)) < 4000
    assert len(repair.build(np.full(1 << 12, 7, np.uint32)).sequence) == 1 << 6  # runs are halved in each of six rounds
    noise = np.random.default_rng(3).permutation(50_000).astype(np.uint32)
    assert len(repair.build(noise).rules) == 0  # no pair occurs twice


def pair_counts(seq):
    """Occurrences of each pair, those that overlap counted once."""
    n, taken = {}, {}
    for k, pair in enumerate(zip(seq, seq[1:])):
        if pair[0] != pair[1] or taken.get(pair) != k - 1:
            n[pair] = n.get(pair, 0) + 1
            taken[pair] = k
    return n


@pytest.mark.parametrize("seed", range(12))
def test_grammar_replaces_the_most_frequent_pair_until_none_occurs_twice(seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.2 + seed / 12, 900) % (3 + 4 * seed) if seed else np.concatenate([np.tile(rng.integers(0, 40, 17), 9), np.repeat([5, 6, 5], [33, 7, 12])])
    g = repair.build(ids.astype(np.uint32), least=2, rounds=None)
    seq = np.searchsorted(g.terminals, ids).tolist()
    for k, (a, b) in enumerate(g.rules.tolist()):
        counts = pair_counts(seq)
        assert counts[a, b] == max(counts.values()) >= 2
        out = []
        for x in seq:
            if out and (out[-1], x) == (a, b):
                out[-1] = len(g.terminals) + k
            else:
                out.append(x)
        seq = out
    assert seq == g.sequence.tolist() and max(pair_counts(seq).values(), default=0) < 2


def test_pairs_of_one_count_go_together():
    """Pairs of equal symbols, and pairs that share symbols but no place, take a round for each count, not one each."""
    rng = np.random.default_rng(6)
    twice = np.concatenate([[k, k, 1000 + 3 * k, 1001 + 3 * k, 7, 1002 + 3 * k] for k in rng.permutation(300)] + [[k, k, 3000 + k] for k in rng.permutation(300)])
    shared = np.concatenate([np.array([[900, 4000 + k, 5000 + 2 * k + n, 8000 + k, 900, 6000 + 2 * k + n] for k in range(200)]).ravel() for n in range(2)])
    for ids, most in ((twice, 3), (shared, 6)):
        pairs, rounds = repair.Pairs(np.unique(ids, return_inverse=True)[1], len(np.unique(ids)), 2), 0
        while len(pairs.next_round()):
            rounds += 1
        assert rounds <= most


def test_files_hold_whole_grammars():
    ids = np.random.default_rng(4).zipf(1.3, 5000).astype(np.uint32) % 300
    out = pa.BufferOutputStream()
    writer = token_files.Writer(out)
    writer.add(1, ids.tobytes())
    writer.close()
    g, _ = token_files.Reader(pa.BufferReader(out.getvalue())).shard(0)
    assert len(g.rules) and max(pair_counts(g.sequence.tolist()).values()) == 1


def test_wide_symbols_and_long_expansions():
    ids = np.concatenate([np.arange(70_000), np.arange(70_000), np.zeros(3000, int)]).astype(np.uint32)
    g = repair.build(ids, least=2, rounds=None)
    h, sums = repair.from_bytes(repair.to_bytes(g))
    assert g.lengths.max() == 70_000 and all(np.array_equal(x, y) for x, y in zip(g, h)) and np.array_equal(repair.expand(h, h.sequence), ids)
    assert np.array_equal(repair.access(h, sums, 69_990, 70_011), ids[69_990:70_011])


def test_encoder_gives_the_librarys_ids():
    rng, encoder = random.Random(2), token_files.Encoder(BPE)
    assert encoder.by_words
    signs = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "'ll", "1", "²", "½", ".", ",", "\x1c", "\x85", "\xa0", " ", "ж", "中", "😀", "́", "_", "<|endoftext|>", "ʼ", "ɐ", "\r\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", " ", "x" * 5000, "word " * 3000]
    encoder.words.most = encoder.parts.most = 50  # what is known is thrown out and learned again
    assert [b for k in range(0, len(texts), 100) for b in encoder.encode(texts[k : k + 100])] == encoder.library(texts)


def test_texts_cut_finely_give_the_librarys_ids():
    rng, encoder = random.Random(8), token_files.Encoder(BPE)
    signs = [*"abZ019.,'-_~ ", "'s", "'re", "'VE", " '", "''", "  ", "\n", "\n\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x00", *"é中ж²", "\u0301", *map(chr, (0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x200B, 0x2014, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0x3001, 0xA805, 0xE080, 0x20000))]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(20_000)]
    assert encoder.encode(texts) == encoder.library(texts)
    pieces = [t.encode() for t in set(texts) if t]
    assert encoder._learn(pieces) == encoder.library([p.decode() for p in pieces])
    data = np.frombuffer(b"word, can't 12ab!", np.uint8)
    assert [bytes(x) for x in np.split(data, token_files.cuts(data))] == [b"word", b",", b" can", b"'t", b" 12", b"ab", b"!"]


def test_words_of_letters_go_to_the_model():
    encoder, rng = token_files.Encoder(BPE), random.Random(4)
    words = [w.encode() for w in ("a", " a", " Straße", "ñu", "ɏɿ", "Ž")]
    others = [w.encode() for w in ("", " ", "  a", "a b", "×", "a÷", "a1", "a.", "'s", "ж", "ʀ", "中", "\na", "\u00b5", "\u0301", "a\u2014")]
    assert token_files.are_letters(words + others).tolist() == [True] * len(words) + [False] * len(others)
    words += [("" if rng.random() < 0.5 else " ").encode() + "".join(rng.choice("abcdefghijéüßñœ") for _ in range(rng.randrange(1, 40))).encode() for _ in range(2000)]
    assert encoder._words(words) == encoder.library([w.decode() for w in words])
    mixed = rng.sample(words + others[1:], len(words) + len(others) - 1)
    assert encoder._learn(mixed) == encoder.library([w.decode() for w in mixed]) and encoder._learn([]) == []


def test_letters_and_lines_are_cut():
    def cut(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [bytes(x).decode() for x in np.split(data, token_files.cuts(data))]

    assert cut("né,à1\nAb\n\nc\r\nd") == ["né", ",", "à", "1", "\n", "Ab", "\n\nc", "\r\nd"]
    assert cut("a×b ÷\nc\n é") == ["a×b", " ÷", "\nc", "\n é"]


def test_long_texts_are_cut_at_borders(monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 50)
    rng, encoder = random.Random(3), token_files.Encoder(BPE)
    texts = ["".join(rng.choice(["ab", "'s", " ", "\n", "  ", "é", "12", "."]) for _ in range(900)) for _ in range(20)] + ["n" * 400]
    assert encoder.encode(texts) == encoder.library(texts)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.Encoder(path)
    assert not encoder.by_words
    texts = ["Some  Words here", "", "ÉTÉ 12"]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert encoder.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def brute(rows):
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    out, at = [], 0
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]
    for i, own in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    return out


def documents(n, seed=5):
    rng = random.Random(seed)
    rows = [(k * 3, " ".join(rng.choice(["the", "café", "naïve,", "of\n", "x1", "don't"]) for _ in range(rng.randrange(80)))) for k in range(n)]
    rng.shuffle(rows)
    return rows + [(1, None), (2, ""), (None, "no id"), (4, "a long one " * 9000)]


@pytest.mark.parametrize(("parts", "sizes"), [(1, {}), (7, {"file_ids": 500, "shard": 64}), (3, {"file_ids": 1, "shard": 1}), (4, {"file_ids": 100_000, "shard": 333})])
def test_round_trip_equals_brute_force(spark, parts, sizes):
    rows = documents(20 if sizes.get("shard") == 1 else 120)
    if sizes.get("shard") == 1:
        rows = rows[:-1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumns({c: F.lit("clash") for c in ("key", "th", "tie", "file", "start", "part")})
    got = sorted(map(tuple, token_files.round_trip(df, BPE, **sizes).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(7, f"text {k % 3}") for k in range(50)] + [(None, "n"), (None, "n"), (8, "last")]
    got = sorted(token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), BPE, file_ids=20).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(BPE)
    size = {x: len(t.encode(x or "").ids) + 1 for _, x in rows}
    assert [r["doc_id"] for r in got] == [None] * 2 + [7] * 50 + [8] and sum(r["n_tokens"] for r in got) == sum(size[x] for _, x in rows)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_all_rows_of_large_batches_are_written(spark):
    rows = [(k, f"row {k}") for k in range(2 * token_files.SLICE + 77)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, token_files.round_trip(df, BPE).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == sorted(brute(rows))


def test_any_range_of_a_file_is_read_alone(spark):
    rows = documents(60)
    path = common.shared_dir(spark, "tokens")
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    files = common.stored(token_files.write_files(df, path, BPE, shard=256, file_ids=1 << 30), "tokens-manifest").collect()
    (name,) = glob.glob(path.removeprefix("file://") + "/*.tok") if len(files) == 1 else (None,)
    source = pa.OSFile(name)
    assert files[0]["bytes"] == source.size() and files[0]["docs"] == len(rows)
    reader, rng = token_files.Reader(source), random.Random(1)
    whole = np.concatenate([p for _, _, pieces in reader.documents() for p in pieces])
    assert len(whole) == files[0]["ids"]
    for _ in range(200):
        a = rng.randrange(len(whole))
        b = rng.randrange(a, min(len(whole), a + 2000) + 1)
        assert np.array_equal(reader.ids(a, b), whole[a:b])
    t = Tokenizer.from_file(BPE)
    text = dict(rows)
    for k in rng.sample(range(len(rows)), 20):
        _, key, start, n = reader.docs[k].tolist()
        key = reader.keys()[k]
        assert reader.ids(start, start + n).tolist() == t.encode(text[key] or "").ids + [2]
    with pytest.raises(ValueError):
        token_files.Reader(pa.BufferReader(b"x" * 50))
