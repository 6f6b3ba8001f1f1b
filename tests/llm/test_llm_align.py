"""Operator 13 against a plain merge of each document."""
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_data import frame, odd_docs
from rewardlake.llm import token_align as ta
from rewardlake.llm.bpe import byte_alphabet

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["<|endoftext|>", "a▁b", "<0x41> <s> <unk>", "\x00", "\r\n\t", "😀👨‍👩‍👧", "ﬁ①", "é", "　\x85", "x", " ",
       " " * 5000 + "x", "\n" * 3000, "中文" * 50, "naïve  Ünïcode   end "]


def libraries():
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    lib.no_truncation()
    lib.no_padding()
    return lib, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text, lib, sp):
    """Ids, links and groups by comparing byte ranges one after another."""
    if not text:
        return None
    back = byte_alphabet()
    a, b = lib.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    ta_, tb = [bytes(back[c] for c in lib.id_to_token(i)) for i in a], []
    for i in b:
        p = sp.id_to_piece(i)
        tb.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
    want = (" " + text).encode()
    if b"".join(ta_) != want or b"".join(tb) != want:
        return None

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out
    sa, sb = spans(ta_), spans(tb)
    links, j0 = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < e:
            links.append((i, j))
            j += 1
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, at = [], [0, 0]
    for c in cuts:
        sides = []
        for k, (ids, spans_) in enumerate(((a, sa), (b, sb))):
            to = at[k]
            while to < len(ids) and spans_[to][0] < c:
                to += 1
            sides.append(",".join(map(str, ids[at[k]:to])))
            at[k] = to
        groups.append("|".join(sides))
    return a, b, links, groups


def brute(rows):
    lib, sp = libraries()
    done = [(d, plain(t, lib, sp)) for d, t in rows]
    count = collections.Counter((r[0][i], r[1][j]) for _, r in done if r for i, j in r[2])
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for d, r in done:
        if r is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        ns = [(count[r[0][i], r[1][j]], r[1][j]) for i, j in r[2]]
        out.append((d, len(r[0]), len(r[1]), len(r[3]), len(ns),
                    sum(n == best[y] for n, y in ns), sum(n for n, _ in ns),
                    hashlib.sha256(";".join(r[3]).encode()).hexdigest()))
    return out


def all_rows():
    return [(d, t) for d, t, *_ in odd_docs()] + [(100 + i, t) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("block_chars", [1, 5000, ta.BLOCK_CHARS])
def test_equals_plain_merge(spark, block_chars):
    rows = all_rows()
    df = frame(spark, [(d, t, None, None, None) for d, t in rows], extra=True).repartition(3)
    got = [tuple(r) for r in ta.link_statistics(df, A, B, block_chars=block_chars).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_query_equals_plain_merge(spark):
    from rewardlake.llm import queries
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(brute([tuple(r) for r in docs.collect()]))


@pytest.mark.parametrize("lane", [1, 7, 512, 10 ** 9])
def test_lanes_do_not_change_the_merge(lane):
    rng = random.Random(lane)
    for _ in range(30):
        docs, ends_a, ends_b, at = [0], [], [], 0
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 5, 200])
            for ends in (ends_a, ends_b):
                cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 60)))) if n > 1 else []
                ends += [at + c for c in cuts] + ([at + n] if n else [])
            at += n
            docs.append(at)
        a, b = np.array(ends_a, np.int64), np.array(ends_b, np.int64)
        li, lj, ci, cj = ta.lockstep(a, b, np.array(docs), lane)
        start_a, start_b = [0, *ends_a], [0, *ends_b]
        want = [(i, j) for i in range(len(a)) for j in range(len(b))
                if max(start_a[i], start_b[j]) < min(a[i], b[j])]
        assert list(zip(li.tolist(), lj.tolist())) == want
        both = sorted(set(ends_a) & set(ends_b))
        assert [ends_a[i] for i in ci] == both == [ends_b[j] for j in cj]


def test_real_outputs(spark):
    lib, sp = libraries()
    rows = all_rows()
    df = frame(spark, [(d, t, None, None, None) for d, t in rows])
    got = sorted(ta.align(df, A, B).collect(), key=str)
    want = []
    for d, t in rows:
        r = plain(t, lib, sp)
        want.append((d, *(r[:3] if r else ([], [], []))))
    assert sorted(((r.doc_id, r.a_ids, r.b_ids, [tuple(x) for x in r.links]) for r in got),
                  key=str) == sorted(want, key=str)
    assert ta.align(frame(spark, []), A, B).count() == 0
    assert ta.link_statistics(frame(spark, []), A, B).count() == 0


def test_very_long_text(spark):
    """One long document is as many lanes, not as many steps."""
    import time
    text = odd_docs()[15][1] * 8                     # about 3 MB
    pair = ta.loaded(A, B)
    al = ta.Aligned(pair, [text, None, "x"])
    t0 = time.perf_counter()
    docs = np.concatenate([[0], np.cumsum(pair.len_a[al.a])])[al.first_a]
    ta.lockstep(np.cumsum(pair.len_a[al.a]), np.cumsum(pair.len_b[al.b]), docs)
    assert time.perf_counter() - t0 < 5
    assert al.n_links[0] >= max(al.n_a[0], al.n_b[0]) and al.n_links[1] == 0
