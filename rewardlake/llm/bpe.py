"""Operator 9: byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token the last token of its encoding is unique. All vocabulary
tokens that end at a position come from an automaton with suffix links; the one whose
predecessor (the last token of the shorter prefix) forms a *compatible* pair with it is the
last token of this prefix. Back-pointers from the end give the exact ids. Two tokens are
compatible if encoding their joined bytes gives just these two again.

Null texts count as empty: no ids. Texts of any length are encoded whole, in time linear in
the length. Repeated rows give repeated results; other input columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rewardlake.llm.common import F, run_arrow, text_of

# Entries each cache of a worker may hold before it starts anew (bounds memory, not results).
CACHE_ENTRIES = 1_200_000

# The fixed split pattern of byte-level BPE vocabularies; \p{White_Space} is what \s means there.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the printable alphabet in which the vocabulary file writes bytes:
    printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


MARKS = ".,!?;:*$#&%|"


class Recent:
    """A cache of bounded size that keeps what is in use: when the young half is full it becomes
    the old half, and what is met again moves back to the young one."""

    def __init__(self, entries: int):
        self.half, self.new, self.old = entries // 2, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old = dict(self.new)
            self.new.clear()            # the same object: callers may hold it
        self.new[key] = value


class PrefixEncoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = {t: bytes(back[c] for c in t) for t in spec["model"]["vocab"]
               if all(c in back for c in t)}
        ids = {t: i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {ids[t]: b for t, b in raw.items()}
        self.special = {}
        for a in spec.get("added_tokens", []):
            self.special[a["content"]] = a["id"]
            self.bytes_of[a["id"]] = a["content"].encode("utf-8")
        self.special_re = (re.compile("(" + "|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special else None)
        # merge (left, right) -> rank, and for each made token its parts and rank
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair = (ids[left], ids[right])
            self.rank_of_pair.setdefault(pair, r)
            made = ids[left + right]
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, r
        self._automaton({b: ids[t] for t, b in raw.items()
                         if b and ids[t] not in set(self.special.values()) and self._whole(ids[t])})
        self.split = regex.compile(SPLIT)
        self.fits: dict[int, bool] = {}
        self.words = Recent(CACHE_ENTRIES)
        self.spans = Recent(CACHE_ENTRIES // 4)
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def _automaton(self, vocab: dict[bytes, int]) -> None:
        """States are the prefixes of the tokens; ``fall`` leads to the longest proper suffix that
        is a state, ``found`` holds the longest token that ends in a state, and ``shorter`` the
        next token that ends at the same place."""
        self.step: dict[int, int] = {}
        ends, parent = {}, [(0, 0)]
        for b, token in vocab.items():
            at = 0
            for c in b:
                key = at << 8 | c
                to = self.step.get(key)
                if to is None:
                    to = self.step[key] = len(parent)
                    parent.append((at, c))
                at = to
            ends[at] = token
        depth = [0] * len(parent)
        for state in range(1, len(parent)):         # a parent has a smaller number
            depth[state] = depth[parent[state][0]] + 1
        self.fall, self.found = [0] * len(parent), [-1] * len(parent)
        self.shorter, self.size = {}, {t: len(b) for b, t in vocab.items()}
        trie = dict(self.step)
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            up, c = parent[state]
            back = 0
            if up:
                back = self.fall[up]
                while back and (back << 8 | c) not in trie:
                    back = self.fall[back]
                back = trie.get(back << 8 | c, 0)
            self.fall[state] = back
            token = ends.get(state)
            if token is None:
                self.found[state] = self.found[back]
            else:
                self.found[state] = token
                self.shorter[token] = self.found[back]

    def _next(self, state: int, c: int) -> int:
        """Transition that falls back to suffixes; kept for the next time."""
        at = state
        while at and (at << 8 | c) not in self.step:
            at = self.fall[at]
        to = self.step.get(at << 8 | c, 0)
        self.step[state << 8 | c] = to
        return to

    def _whole(self, token: int) -> bool:
        """Whether the bytes of ``token`` encode to just ``token``."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._compatible(left, right, self.rank[token])

    def _compatible(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether no merge crosses the seam between ``a`` and ``b`` (before merge ``until``).

        Merges of either side are undone in the reverse of the order in which they happen (by
        rank, the left one of equals first). Each state of the seam thus met existed; a merge
        over the seam would have happened in it if its rank comes before that of the merge
        that ended the state."""
        rank, parts, pairs = self.rank, self.parts, self.rank_of_pair
        # merges below `end` come before the state ended; a seam merge of equal rank happens
        # before the right side's own merge but not before the left side's.
        end = (until if until is not None else len(pairs) + 1) * 2
        while True:
            seam = pairs.get((a, b))
            if seam is not None and seam * 2 < end:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                end, a = ra * 2, parts[a][1]
            else:
                end, b = rb * 2 + 1, parts[b][0]

    def pretoken(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        last = [-1]                     # last token of the encoding of each prefix
        step, found, size, shorter, fits = self.step, self.found, self.size, self.shorter, self.fits
        state, here = 0, 0
        for c in piece:
            here += 1
            to = step.get(state << 8 | c)
            state = self._next(state, c) if to is None else to
            token = found[state]
            while True:
                if token < 0:
                    raise ValueError("the vocabulary lacks a byte of the text")
                start = here - size[token]
                if not start:
                    break
                key = last[start] << 32 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= 2 * CACHE_ENTRIES:
                        fits.clear()
                    ok = fits[key] = self._compatible(last[start], token)
                if ok:
                    break
                token = shorter[token]
            last.append(token)
        out = []
        while here:
            out.append(last[here])
            here -= size[last[here]]
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        """Packed ids of a pre-token, from the cache if it is short and was met before."""
        got = self.words.get(word)
        if got is None:
            got = array("I", self.pretoken(word.encode("utf-8"))).tobytes()
            if len(word) <= 64:
                self.words.put(word, got)
        return got

    def _span(self, text: str) -> bytes:
        """Packed ids of a span that the split pattern can be applied to by itself."""
        return b"".join([self._word(p) for p in self.split.findall(text)])

    def _after_space(self, p: str) -> bytes:
        """Packed ids of a space and ``p``, which begins with a non-space."""
        if p.isalpha():
            return self._word(" " + p)
        stem = p.rstrip(MARKS)
        if stem.isalpha():
            return self._word(" " + stem) + self._word(p[len(stem):])
        got = self.spans.get(p)
        if got is None:
            got = self._span(" " + p)
            if len(p) <= 64:
                self.spans.put(p, got)
        return got

    def _plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens.

        A space before a non-space always begins a pre-token, so the text may be cut before
        each such space; the stretches (one word and its marks) are looked up one by one."""
        if _ODD_SPACE.search(text):
            return self._span(text)
        first, *rest = text.split(" ")
        words, slow = self.words.new, self._after_space
        return self._span(first) + b"".join([words.get(" " + p) or slow(p) for p in rest])

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as packed little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_re and "<" in text:
            out = []
            for part in self.special_re.split(text):
                if part in self.special:
                    out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                elif part:
                    out.append(self._plain(part))
            return b"".join(out)
        return self._plain(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


# A space that is not followed by a non-space.
_ODD_SPACE = re.compile(r" (?:[\s\x85]|\Z)")

_LOADED: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixEncoder(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids, text``: the token ids of every whole text and the text decoded from them."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer_path)
        ids = [np.frombuffer(enc.encode(t), dtype="<u4") for t in b.column("text").to_pylist()]
        flat = np.concatenate(ids).astype("int32")
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("int32")
        texts = [enc.decode(x.tolist()) for x in ids]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
             pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run_arrow(src, rows, f"doc_id {kind}, ids array<int>, text string")


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document: the digests of what
    :func:`encode` returns, taken where the ids are made, so that ids and texts are not sent
    through another stage."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer_path)
        n, a, d = [], [], []
        for t in b.column("text").to_pylist():
            packed = enc.encode(t)
            back = enc.decode(np.frombuffer(packed, dtype="<u4").tolist())
            n.append(len(packed) // 4)
            a.append(hashlib.sha256(packed).hexdigest())
            d.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()),
             pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run_arrow(src, rows,
                     f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
