"""Operators 3 and 9 against the tokenizers library and by invariants."""
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_data import frame, odd_docs
from rewardlake.llm import bpe, packing, queries

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", " \n", "\n\n", " the", "ing.",
         "aaaa", "!!!!", "1234", "　", "\x00", "😀", "👨‍👩‍👧", "é", "İ.", "Σ.", "क़", "\x1c", "\x85"]
LETTERS = " \n\t'abcdefst ABZ019éß中́\xa0!?.,-_<|>*$"


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) if rng.random() < .75 else rng.choice(PARTS)
                    for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_prefix_dp_equals_library():
    enc, lib = bpe.PrefixEncoder(BYTE), library(BYTE)
    rng = random.Random(5)
    texts = random_texts(3000, 1) + ["", "".join(rng.choice("ab") for _ in range(5000)),
                                     *[t for _, t, *_ in odd_docs() if t]]
    for t, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(enc.encode(t), "<u4").tolist()
        assert ids == want.ids, t[:80]
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False) == t


def test_every_token_encodes_to_itself_or_is_left_out():
    enc, lib = bpe.PrefixEncoder(BYTE), library(BYTE)
    rng = random.Random(2)
    for i in rng.sample(range(50_256), 400):
        raw = enc.bytes_of[i]
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == lib.encode(
            text, add_special_tokens=False).ids


def test_caches_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 8)
    small, big = bpe.PrefixEncoder(BYTE), None
    monkeypatch.undo()
    big = bpe.PrefixEncoder(BYTE)
    for t in random_texts(400, 9):
        assert small.encode(t) == big.encode(t)


def test_bpe_query_columns(spark):
    lib = library(BYTE)
    rows = odd_docs()
    got = sorted(map(tuple, bpe.digests(frame(spark, extra=True), BYTE).collect()), key=str)
    want = []
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe.encode(frame(spark), BYTE).collect()
    assert all(r.text == (t or "") for r, (_, t, *_) in zip(
        sorted(full, key=lambda r: (str(r.doc_id), r.text)),
        sorted(rows, key=lambda r: (str(r[0]), r[1] or ""))))
    assert bpe.digests(frame(spark, []), BYTE).count() == 0


def test_word_ids_equal_library():
    enc, lib = packing.WordIds(WORD), library(WORD)
    texts = random_texts(3000, 3) + [t or "" for _, t, *_ in odd_docs()]
    for t, got, want in zip(texts, enc(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, t[:80]


def test_word_ids_learn_each_word_once():
    """A batch goes word by word only through what it brings new, words with marks included; what is
    kept stays bounded, long words are not kept."""
    enc, lib = packing.WordIds(WORD, 600), library(WORD)
    sizes, learn = [], enc._learn
    enc._learn = lambda fresh: sizes.append(len(fresh)) or learn(fresh)
    texts = ["One, two. three! four", "naïve, two. " + "q" * 300 + "! " + "r" * 300]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in enc(texts)] == want
    assert sizes == [7, 2] and max(map(len, enc.young)) <= packing.KEPT_CHARS
    for i in range(20):
        batch = [" ".join(f"w{j}." for j in range(100 * i, 100 * i + 150))]
        assert np.frombuffer(enc(batch)[0], "<u4").tolist() == lib.encode(
            batch[0], add_special_tokens=False).ids
        assert len(enc.young) + len(enc.old) <= 1200


def brute_places(lengths, budget):
    """The restricted rule written out: longest first, all open sequences compared."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    gaps = []
    for i in order:
        size, best = lengths[i], None
        for g in sorted({g for g in gaps if g >= size}):
            count = collections.Counter(x for x in gaps if x)
            count[g] -= 1
            if g > size:
                count[g - size] += 1
            key = sum(v * v for v in count.values())
            if best is None or key < best[0]:
                best = (key, g)
        if best is None:
            gaps.append(budget - size)
        else:
            gaps[gaps.index(best[1])] -= size
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_rule(seed):
    rng = random.Random(seed)
    budget = rng.choice([10, 37, 64])
    lengths = [rng.randint(1, budget) for _ in range(80)]
    seq, offset = packing.sum_of_squares(lengths, budget)
    assert seq.max() + 1 == brute_places(lengths, budget)
    at = collections.defaultdict(list)
    for s, o, n in zip(seq, offset, lengths):
        at[s].append((o, n))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= budget


def test_pieces_and_places(spark):
    lib = library(WORD)
    docs = frame(spark, extra=True)
    got = packing.pack_documents(docs, WORD, budget=256, with_ids=True).collect()
    want = collections.Counter()
    for d, t, *_ in odd_docs():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 256)):
            part = ids[s:s + 256]
            want[(d, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()),
                  tuple(part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids))
                               for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 256
    total = sum(r.length for r in got)
    assert len(seqs) <= total / 256 * 1.05 + 2
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0


def test_wide_pieces_are_packed_in_their_tasks(spark, monkeypatch):
    """Same pieces as the narrow form, hardly more sequences, and no wide row in a group."""
    monkeypatch.setattr(packing, "TOKENS_PER_GROUP", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    wide = packing.pack_documents(docs, WORD, with_ids=True).collect()
    narrow = packing.pack_documents(docs, WORD).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)        # noqa: E731
    assert sorted(map(key, wide)) == sorted(map(key, narrow))
    seqs = collections.defaultdict(list)
    for r in wide:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048
    assert len(seqs) <= len({r.sequence_id for r in narrow}) + 2


def test_packing_query_is_tight(spark):
    got = queries.op3_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = len({r.sequence_id for r in got})
    assert n <= -(-sum(r.length for r in got) // 2048) + 2
