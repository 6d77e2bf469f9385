"""Duplicates of new batches against everything accepted before.

A store is a folder that outlives the session. Its manifest, one small file per committed load, names what belongs to
it; a load that fails half-way leaves a folder that no manifest names. ``ingest`` takes the next batch:

1. Equal word sets of the batch are collapsed; the earliest text stands for the others.
2. Each set gets content fingerprints: of every WINDOW consecutive SHINGLE-word shingles the smallest hash (winnowing),
   and prefix keys made of its rarest words (``prefix_keys``). Texts that share SHINGLE + WINDOW - 1 words in a row meet
   by the former; the latter miss no pair over the threshold, whatever the order of its words.
3. Fingerprints fall into parts, and parts into buckets. One Bloom filter per part tells which may be in the store. Those
   that occur neither there nor twice in the batch are dropped, and only buckets with a positive are read from the store.
4. New and stored fingerprints meet part by part. Signatures of the word sets discard most pairs as they are made.
5. Candidates are verified on the word sets themselves (64-bit hashes of the words): shared words over all words.
6. Texts are accepted in order. A text is rejected as soon as one earlier text that it matches is accepted, and accepted
   once all earlier ones that it matches are rejected.
7. The word sets, which of them were refused, the fingerprints and the changed filters are written, then the manifest.

Fingerprints of the history are read from the buckets that are hit, never computed again. A batch of a few texts hits a
few buckets; one that is a twentieth of the history hits all.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.words import is_blank, words
from gleaner.operators.skew import BROADCAST_KEYS, block_pairs, crossed
from gleaner.runtime import file_names, get_text, put_text, remove

SHINGLE = 5
WINDOW = 8
#: Both sets of a pair of which one has at most 10 words have at most 14 at 0.7; such sets get single words as keys.
SHORT = 14
#: Bits of Bloom filter for each fingerprint, and probes; about one false positive in a hundred.
BLOOM_BITS = 10
BLOOM_PROBES = 6
#: Fingerprints that one Bloom filter is made for; a part that has more gets another filter.
SLICE_ROWS = 262_144
#: Buckets of a part: what is read from the store together.
BUCKETS = 16
#: A prefix key is a word, or as many words together, up to DEPTH, as are expected in at most RARE texts of the first batch.
RARE = 4096
DEPTH = 3
#: Sets of more words get single words as prefix keys, since they would have too many combinations.
LONG = 64
#: Words, at most, whose frequency in the first batch is kept; they order the words of all batches, others come first.
ORDER_WORDS = 65_536
#: Bits of a word set's signature; the eight bits above hold its size.
SIGNATURE_BITS = 56
#: Sizes from here on are not told apart, and such sets are never pruned.
LARGE_SET = 255
#: Texts of one prefix key that meet in one task; larger keys are paired in blocks.
MEET_ROWS = 16_384
#: A prefix key of so many texts of one Arrow batch, and of that share of it, bypasses the parts.
HOT_ROWS = 500
HOT_SHARE = 0.1
#: Open links, at most, that one task settles; more are settled in rounds.
SETTLE_LINKS = 200_000
#: After so many loads the driver's garbage is collected, and with it the shuffle files of past loads.
CLEAN_LOADS = 2
#: Pairs that are tested at once; keys with as many pairs are tested in blocks.
CHUNK = 2_000_000
BLOCK = 16_384
#: Records of either side whose pairs are counted at once.
TILE = (256, 512)

_WORD = re.compile("[a-z0-9]+")
#: One fingerprint of one text: the hash (its lowest bit is 1 in prefix keys), the text's node, its set's size and signature.
PRINT = np.dtype([("fp", "<u8"), ("node", "<i8"), ("sig", "<u8")])


class _Hashes(dict):
    """64-bit word hashes, remembered while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@dataclass
class WordOrder:
    """The texts of the first batch and how many of them have each word (by its hash). It never changes in a store."""

    texts: int
    counts: dict[int, int]


def word_order(texts: DataFrame) -> WordOrder | None:
    """Counted on all texts; only the ORDER_WORDS most frequent words come to the driver."""
    n = texts.count()
    if n == 0:
        return None
    counts = texts.select(F.explode(F.array_distinct(words("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(ORDER_WORDS).collect()
    return WordOrder(n, {xxhash.xxh3_64_intdigest(r["word"]): r["n"] for r in top})


# ---- fingerprints


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signature(ws: set[int]) -> int:
    bits = 0
    for h in ws:
        bits |= 1 << (h % SIGNATURE_BITS)
    return bits | min(len(ws), LARGE_SET) << SIGNATURE_BITS


def _short(threshold: float) -> int:
    """Sets of up to so many words have single words as keys; others share at least DEPTH words with all they match."""
    return max(SHORT, math.floor(DEPTH / threshold**2))


def _prefixes(owner: np.ndarray, h: np.ndarray, n: np.ndarray, sizes: np.ndarray, threshold: float, order: WordOrder, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of all prefix keys of many sets: ``owner`` and ``h`` are the words of each set in order, ``n`` the texts
    that have them, ``sizes`` the words of each set. See ``prefix_keys``."""
    most = _short(threshold)
    at = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    m = sizes[owner]
    spare = m - np.ceil(m * threshold - 1e-9).astype(np.int64)
    first = at <= spare
    short, long = first & (m <= most), first & (m >= threshold * (LONG + 1) - 1e-6)
    which, keys = [owner[short], owner[long]], [h[short] ^ np.uint64(0x5851F42D4C957F2D), h[long] ^ np.uint64(0x2545F4914F6CDD1D)]
    last = np.flatnonzero(first & (m >= threshold * (most + 1) - 1e-6) & (m <= LONG))  # the last word taken
    key, expected = np.ones(len(last), np.uint64), np.full(len(last), float(order.texts))
    for depth in range(1, DEPTH + 1):
        both, seen = (key ^ h[last]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth), expected * n[last] / order.texts
        done = (seen <= rare) | (depth == DEPTH)
        which.append(owner[last[done]])
        keys.append(both[done])
        last, both, seen = last[~done], both[~done], seen[~done]
        following = np.minimum(spare[last] + depth, m[last] - 1) - at[last]
        by = np.repeat(np.arange(len(last)), following)
        last = last[by] + 1 + np.arange(len(by)) - (np.cumsum(following) - following)[by]
        key, expected = (both ^ (both >> np.uint64(29)))[by], seen[by]
    return np.concatenate(which), np.concatenate(keys)


def _ranked(owner: np.ndarray, flat: np.ndarray, order: WordOrder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, texts that have it) of the distinct words of each owner, the rarest first."""
    values, inverse = np.unique(flat, return_inverse=True)
    n = np.array([order.counts.get(x, 0) for x in values.tolist()], dtype=np.int64)
    by = np.argsort(n, kind="stable")  # ties by the hash
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    at = np.sort(owner * max(len(values), 1) + rank[inverse])
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    owner, taken = at // max(len(values), 1), by[at % max(len(values), 1)]
    return owner, values[taken], n[taken]


def prefix_keys(ws: set[int], threshold: float, order: WordOrder, rare: int = RARE) -> list[int]:
    """Keys of which two sets over the threshold always have one in common.

    Words are taken in one order for all texts, the rarest first. A set of m words shares at least a = ceil(threshold * m)
    with each set that it matches, so the d-th word shared is among the first m - a + d words of both. The key is the first
    shared word if it is rare, else the first and the second, and so on. Short sets, which may not share DEPTH words, meet
    one another by the first shared word alone; sets of a size in between have both.
    """
    flat = np.array(list(ws), dtype=np.uint64)
    return _prefixes(*_ranked(np.zeros(len(flat), np.int64), flat, order), np.array([len(flat)]), threshold, order, rare)[1].tolist()


def fingerprints(nodes: list[int], texts: list[str], threshold: float, order: WordOrder, rare: int = RARE, hashes: dict[str, int] | None = None) -> np.ndarray:
    """The PRINT records of texts: winnowed shingle hashes and prefix keys, each once per text."""
    hashes = _Hashes() if hashes is None else hashes
    seqs = [[hashes[w] for w in _WORD.findall(t.lower())] for t in texts]
    flat = np.array([h for s in seqs for h in s], dtype=np.uint64)
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    of, words_of, n = _ranked(owner, flat, order)
    sizes = np.bincount(of, minlength=len(seqs))
    sig = np.minimum(sizes, LARGE_SET).astype(np.uint64) << np.uint64(SIGNATURE_BITS)
    np.bitwise_or.at(sig, of, np.uint64(1) << words_of % np.uint64(SIGNATURE_BITS))
    which, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    span = SHINGLE + WINDOW - 1
    if len(flat) >= span:
        k = len(flat) - SHINGLE + 1
        sh = np.zeros(k, dtype=np.uint64)
        for i in range(SHINGLE):
            sh = sh * np.uint64(0x100000001B3) + flat[i : i + k]
        sh = _mix(sh)
        low = sh[: k - WINDOW + 1].copy()
        for i in range(1, WINDOW):
            low = np.minimum(low, sh[i : k - WINDOW + 1 + i])
        whole = owner[: len(flat) - span + 1] == owner[span - 1 :]
        which.append(owner[: len(whole)][whole])
        found.append(low[whole] & ~np.uint64(1))
    by, keys = _prefixes(of, words_of, n, sizes, threshold, order, rare)
    which.append(by)
    found.append(_mix(keys) | np.uint64(1))
    at, fp = np.concatenate(which), np.concatenate(found)
    out = np.empty(len(fp), PRINT)
    out["fp"], out["node"], out["sig"] = fp, np.asarray(nodes, dtype=np.int64)[at], sig[at]
    return _ordered(out)


def _ordered(prints: np.ndarray) -> np.ndarray:
    """The records by hash and node, each pair of them once."""
    fp, node = prints["fp"], prints["node"]
    if np.all((fp[1:] > fp[:-1]) | ((fp[1:] == fp[:-1]) & (node[1:] > node[:-1]))):
        return prints
    prints = prints[np.lexsort((prints["node"], prints["fp"]))]
    fresh = (prints["fp"][1:] != prints["fp"][:-1]) | (prints["node"][1:] != prints["node"][:-1])
    return prints[np.concatenate([[True], fresh])] if len(prints) else prints


def pack(prints: np.ndarray) -> bytes:
    """PRINT records, in order, as bytes: each hash once, nodes as distances, byte by byte so that they compress."""
    prints = _ordered(prints)
    fp, counts = np.unique(prints["fp"], return_counts=True)
    far = np.diff(prints["node"], prepend=0).view(np.uint8).reshape(-1, 8).T
    return np.array([len(fp), len(prints)], "<u4").tobytes() + fp.tobytes() + prints["sig"].tobytes() + far.tobytes() + counts.astype("<u4").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The records of a pack."""
    keys, n = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    fp, counts = np.frombuffer(blob, "<u8", keys, 8), np.frombuffer(blob, "<u4", keys, 8 + 8 * keys + 16 * n)
    out = np.empty(n, PRINT)
    out["fp"] = np.repeat(fp, counts)
    out["sig"] = np.frombuffer(blob, "<u8", n, 8 + 8 * keys)
    out["node"] = np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, 8 + 8 * keys + 8 * n).reshape(8, n).T).view("<i8").ravel())
    return out


def _load(blobs, wanted: np.ndarray | None = None) -> np.ndarray:
    """The records of many packs, by hash; with ``wanted`` (sorted hashes) only those of hashes among them.

    All packs are taken apart together, since a part holds hundreds of small ones.
    """
    blobs = list(blobs)
    if not blobs:
        return np.empty(0, PRINT)
    keys, n = np.array([np.frombuffer(b, "<u4", 2) for b in blobs], dtype=np.int64).T
    sizes = list(zip(blobs, keys.tolist(), n.tolist()))
    fp = np.concatenate([np.frombuffer(b, "<u8", k, 8) for b, k, _ in sizes])
    counts = np.concatenate([np.frombuffer(b, "<u4", k, 8 + 8 * k + 16 * m) for b, k, m in sizes])
    sig = np.concatenate([np.frombuffer(b, "<u8", m, 8 + 8 * k) for b, k, m in sizes])
    far = np.concatenate([np.frombuffer(b, np.uint8, 8 * m, 8 + 8 * k + 8 * m).reshape(8, m) for b, k, m in sizes], axis=1)
    node = np.cumsum(np.ascontiguousarray(far.T).view("<i8").ravel())
    ends = np.cumsum(n)
    node -= np.repeat(np.concatenate([[0], node[ends[:-1] - 1]]) * (ends > n), n)  # distances begin anew in every pack
    at = np.repeat(np.arange(len(fp)), counts)
    if wanted is not None:
        hit = wanted[np.minimum(np.searchsorted(wanted, fp), len(wanted) - 1)] == fp if len(wanted) else np.zeros(len(fp), bool)
        go = np.flatnonzero(hit[at])
        at, sig, node = at[go], sig[go], node[go]
    by = np.argsort(fp[at], kind="stable")
    out = np.empty(len(by), PRINT)
    out["fp"], out["node"], out["sig"] = fp[at[by]], node[by], sig[by]
    return out


def _bucket(fp: np.ndarray, parts: int) -> np.ndarray:
    return ((fp >> np.uint64(8)) % np.uint64(parts * BUCKETS)).astype(np.int64)


def packed(texts: DataFrame, parts: int, threshold: float, order, rare: int, hot_rows: int) -> DataFrame:
    """(part, bucket, data): the fingerprints of (node, text) rows, packed by bucket.

    Prefix keys that many texts of an Arrow batch share go into packs of their own with the bucket -1 - bucket, so that
    no part grows with them.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            got = fingerprints(list(pdf["node"]), list(pdf["text"]), threshold, order.value, rare, hashes)
            at = _bucket(got["fp"], parts)
            _, inverse, counts = np.unique(got["fp"], return_inverse=True, return_counts=True)
            hot = (counts >= max(hot_rows, HOT_SHARE * len(pdf)))[inverse] & ((got["fp"] & np.uint64(1)) == 1)
            at = np.where(hot, -1 - at, at)
            by = np.argsort(at, kind="stable")
            at, got = at[by], got[by]
            cut = np.flatnonzero(np.diff(at)) + 1
            rows = [(int(b[0] if b[0] >= 0 else -1 - b[0]) // BUCKETS, int(b[0]), pack(p)) for b, p in zip(np.split(at, cut), np.split(got, cut)) if len(b)]
            yield pd.DataFrame(rows, columns=["part", "bucket", "data"])

    return texts.mapInPandas(scan, "part int, bucket int, data binary")


ROWS = "fp long, node long, sig long"


def unpacked(packs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["data"]:
                p = unpack(blob)
                yield pd.DataFrame({"fp": p["fp"].copy().view(np.int64), "node": p["node"], "sig": p["sig"].copy().view(np.int64)})

    return packs.mapInPandas(scan, ROWS).distinct()


# ---- Bloom filters


def _probes(fp: np.ndarray, bits: int) -> np.ndarray:
    a = (fp ^ (fp >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    b = ((fp ^ (fp >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(BLOOM_PROBES)])


def bloom_add(filter_bits: np.ndarray, fp: np.ndarray) -> None:
    """Sets the probes of ``fp`` in an array of bytes."""
    at = _probes(fp, len(filter_bits) * 8).ravel()
    np.bitwise_or.at(filter_bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def bloom_test(filter_bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = _probes(fp, len(filter_bits) * 8)
    return np.all((filter_bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1, axis=0).astype(bool)


#: kind 0: new fingerprints that go on; 1: the part's buckets to be read, as bits of seq; 2: a filter, its number in the part and its fill.
SCREENED = "part int, kind int, seq int, n long, sealed boolean, data binary"
FILTERS = "part int, seq int, n long, sealed boolean, data binary"


def _hot(rows: pd.DataFrame) -> np.ndarray:
    """The hot keys among rows of two kinds; the column holds no null, which would turn it into inexact doubles."""
    return rows.loc[rows["data"].isna(), "hot"].to_numpy(dtype=np.int64).view(np.uint64)


def _screen(parts: int, slice_rows: int):
    size = (slice_rows * BLOOM_BITS + 7) // 8

    def task(key, new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        hot, kept = _hot(filters), filters[filters["data"].notna()].sort_values("seq")
        p = _ordered(_load(new["data"]))  # rows of one id may have come twice
        values, inverse, counts = np.unique(p["fp"], return_inverse=True, return_counts=True)
        seen = np.zeros(len(values), dtype=bool)
        for b in kept["data"]:
            seen |= bloom_test(np.frombuffer(b, np.uint8), values)
        go = ((counts > 1) | seen | np.isin(values, hot))[inverse]
        rows = [(key[0], 0, 0, int(go.sum()), False, pack(p[go]))] if go.any() else []
        hit = np.unique(_bucket(values[seen | np.isin(values, hot)], parts) % BUCKETS)
        rows.append((key[0], 1, int(sum(1 << int(b) for b in hit)), 0, False, None))
        fresh = np.union1d(values[~seen], hot)
        last = kept[~kept["sealed"].astype(bool)].tail(1)
        seq, n, bits = (int(last["seq"].iloc[0]), int(last["n"].iloc[0]), np.frombuffer(last["data"].iloc[0], np.uint8).copy()) if len(last) else (len(kept), 0, np.zeros(size, np.uint8))
        while True:
            take, fresh = fresh[: slice_rows - n], fresh[slice_rows - n :]
            bloom_add(bits, take)
            n += len(take)
            rows.append((key[0], 2, seq, n, n >= slice_rows, bits.tobytes()))
            if n < slice_rows:
                break
            seq, n, bits = seq + 1, 0, np.zeros(size, np.uint8)
        return pd.DataFrame(rows, columns=["part", "kind", "seq", "n", "sealed", "data"])

    return task


# ---- meeting


def may_match(threshold: float) -> Column:
    """False only where two word sets cannot reach the threshold: every bit that one signature has alone is a word that
    the other set lacks."""
    xm, ym = (F.shiftrightunsigned(f"{p}_sig", SIGNATURE_BITS) for p in "xy")
    xs, ys = (F.col(f"{p}_sig").bitwiseAND(F.lit(2**SIGNATURE_BITS - 1)) for p in "xy")
    shared = F.least(xm - F.bit_count(xs.bitwiseAND(F.bitwise_not(ys))), ym - F.bit_count(ys.bitwiseAND(F.bitwise_not(xs))))
    return (F.greatest(xm, ym) >= LARGE_SET) | (shared >= F.lit(threshold) * (xm + ym - shared) - 1e-9)


class _Side:
    """The signatures, sizes and numbers of bits of PRINT records."""

    def __init__(self, p: np.ndarray):
        self.node, self.bits = p["node"], p["sig"] & np.uint64(2**SIGNATURE_BITS - 1)
        self.size = (p["sig"] >> np.uint64(SIGNATURE_BITS)).astype(np.int16)
        self.ones = np.bitwise_count(self.bits).astype(np.int16)


def _able(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray, both: np.ndarray, threshold: float) -> np.ndarray:
    """Whether records i of x and j of y, which share ``both`` bits, may reach the threshold; see ``may_match``."""
    xm, ym = x.size[i], y.size[j]
    shared = np.minimum(xm - x.ones[i], ym - y.ones[j]) + both
    return (np.maximum(xm, ym) >= LARGE_SET) | (shared >= threshold * (xm + ym - shared) - 1e-9)


def _listed(x: _Side, y: _Side, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of record at[k] of x with records lo[k]..hi[k] of y that may match, CHUNK pairs at a time."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        m = n[start:stop]
        i = np.repeat(at[start:stop], m)
        j = np.repeat(lo[start:stop] - (np.cumsum(m) - m), m) + np.arange(len(i))
        both = np.bitwise_count(x.bits[i] & y.bits[j]).astype(np.int16)
        ok = _able(x, y, i, j, both, threshold)
        yield np.stack([x.node[i[ok]], y.node[j[ok]]], axis=1)
        start = stop


def _marked(flags: np.ndarray) -> np.ndarray:
    """Where a boolean array of a multiple of eight entries, few of them true, is true; eight are looked at together."""
    some = np.flatnonzero(flags.view(np.uint64))
    at = np.flatnonzero(flags.reshape(-1, 8)[some])
    return some[at >> 3] * 8 + (at & 7)


def _blocks(x: _Side, y: _Side, a: tuple[int, int], b: tuple[int, int], threshold: float, same: bool) -> Iterator[np.ndarray]:
    """Pairs of records a of x and b of y that may match; with ``same`` x is y, a is b and each pair comes once."""
    # a pair over the threshold has at most (xm + ym) * (1 - threshold) / (1 + threshold) words that one set has alone, and
    # each bit that one signature has alone is such a word; each side's share of that is made a whole number upwards
    lone = (1 - threshold) / (1 + threshold)
    most = lambda s, r: np.where(s.size[r] >= LARGE_SET, SIGNATURE_BITS, np.minimum(np.ceil(s.size[r] * lone + 1e-9), SIGNATURE_BITS)).astype(np.uint8)
    xl, yl = most(x, slice(*a)), most(y, slice(*b))
    # tiles are small and their memory is used again, since allocation costs more than the counting; hits are tested together
    shape, hits, n = (0, 0), [], 0
    for i in range(a[0], a[1], TILE[0]):
        k = slice(i, min(i + TILE[0], a[1]))
        for j in range(i if same else b[0], b[1], TILE[1]):
            c = slice(j, min(j + TILE[1], b[1]))
            if shape != (k.stop - i, c.stop - j):
                shape = (k.stop - i, c.stop - j)
                alone, apart, limit = (np.empty(shape, kind) for kind in (np.uint64, np.uint8, np.uint8))
                flags = np.zeros(-(-alone.size // 8) * 8, bool)
                fits = flags[: alone.size].reshape(shape)
            np.bitwise_xor(x.bits[k, None], y.bits[None, c], out=alone)
            np.bitwise_count(alone, out=apart)
            np.add(xl[i - a[0] : k.stop - a[0], None], yl[None, j - b[0] : c.stop - b[0]], out=limit)
            np.less_equal(apart, limit, out=fits)
            at = _marked(flags)
            r, q = at // shape[1] + i, at % shape[1] + j
            hits.append((r, q, np.bitwise_count(x.bits[r] & y.bits[q]).astype(np.int16)))
            n += len(at)
            if n >= CHUNK or c.stop == b[1] and k.stop == a[1]:
                r, s, bits = (np.concatenate(h) for h in zip(*hits))
                ok = _able(x, y, r, s, bits, threshold)
                if same:
                    ok &= r < s
                yield np.stack([x.node[r[ok]], y.node[s[ok]]], axis=1)
                hits, n = [], 0


MEETINGS = "a long, b long, past boolean, fp long, node long, sig long"


def _meet(threshold: float, limit: int):
    """Pairs (a, b) of one part, ``past`` if a is of the store; texts of prefix keys with more than ``limit`` rows, and of
    those in ``hot``, come out as (fp, node, sig) to be paired elsewhere. Shingles of as many texts make no pair: they
    are stock phrases, and what matches has a prefix key in common."""

    def task(key, new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        hot = _hot(held)
        p = _load(new["data"])
        q = _load(held["data"].dropna(), np.union1d(p["fp"], hot))
        fps, start, count = np.unique(p["fp"], return_index=True, return_counts=True)
        lo, hi = np.searchsorted(q["fp"], fps, "left"), np.searchsorted(q["fp"], fps, "right")
        prefix = (fps & np.uint64(1)) == 1
        apart = (count + hi - lo > limit) | np.isin(fps, hot)
        wide = ~apart & (count * (count + hi - lo) >= BLOCK)
        group = np.repeat(np.arange(len(fps)), count)
        few = np.flatnonzero((~apart & ~wide)[group])
        x, y = _Side(p), _Side(q)
        near = list(_listed(x, x, few, few + 1, (start + count)[group][few], threshold))
        older = [f[:, ::-1] for f in _listed(x, y, few, lo[group][few], hi[group][few], threshold)]
        for k in np.flatnonzero(wide):
            own = (int(start[k]), int(start[k] + count[k]))
            near += _blocks(x, x, own, own, threshold, True)
            if hi[k] > lo[k]:
                older += (f[:, ::-1] for f in _blocks(x, y, own, (int(lo[k]), int(hi[k])), threshold, False))
        frames = []
        for past, found in ((False, [np.sort(f, axis=1) for f in near]), (True, older)):
            found = [f for f in found if len(f)]
            if found:
                got = pd.DataFrame(np.concatenate(found), columns=["a", "b"]).drop_duplicates()
                got = got if past else got[got["a"] != got["b"]]
                frames.append(got.assign(past=past, fp=None, node=None, sig=None))
        out = fps[apart & prefix]
        for past, rows in ((False, p[np.isin(p["fp"], out)]), (True, q[np.isin(q["fp"], np.union1d(out, hot))])):
            if len(rows):
                frames.append(pd.DataFrame({"a": None, "b": None, "past": past, "fp": rows["fp"].copy().view(np.int64), "node": rows["node"], "sig": rows["sig"].copy().view(np.int64)}))
        frames = [f.astype({c: "Int64" for c in ("a", "b", "fp", "node", "sig")}) for f in frames]
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c.split()[0]: [] for c in MEETINGS.split(", ")})

    return task


# ---- the store


@dataclass
class HistoryStore:
    """A store in ``path``: its fixed parameters, the word order, and the folders of its committed loads."""

    spark: SparkSession
    path: str
    parts: int
    threshold: float = 0.7
    rare: int = RARE
    slice_rows: int = SLICE_ROWS
    loads: list[str] = field(default_factory=list)
    hot: list[str] = field(default_factory=list)
    order: WordOrder | None = None
    meet_rows: int = MEET_ROWS
    hot_rows: int = HOT_ROWS
    _shared: object = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected_rows: int, threshold: float = 0.7) -> HistoryStore:
        """``expected_rows``: about how many texts the store will hold; it only sizes the parts."""
        return cls(spark, path, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(expected_rows * 20 / SLICE_ROWS)), threshold)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HistoryStore:
        """The store as its last committed load left it."""
        names = [n for n in file_names(spark, f"{path}/manifest") if n.endswith(".json")]
        if not names:
            raise ValueError(f"no store in {path}")
        m = json.loads(get_text(spark, f"{path}/manifest/{max(names)}"))
        store = cls(spark, path, m["parts"], m["threshold"], m["rare"], m["slice_rows"], m["loads"], m["hot"])
        if m["texts"]:
            rows = spark.read.parquet(f"{path}/{m['order']}").collect()
            store.order = WordOrder(m["texts"], {r["hash"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows})
        return store

    def commit(self, load: str, hot: bool) -> None:
        """Makes a load part of the store, by one rename. It fails if another load was committed meanwhile."""
        texts = self.order.texts if self.order else 0
        m = {"parts": self.parts, "threshold": self.threshold, "rare": self.rare, "slice_rows": self.slice_rows, "texts": texts, "order": "order", "loads": [*self.loads, load], "hot": [*self.hot, *([load] if hot else [])]}
        put_text(self.spark, f"{self.path}/manifest/{len(m['loads']):06d}.json", json.dumps(m))
        self.loads, self.hot = m["loads"], m["hot"]

    def table(self, name: str, schema, loads: list[str] | None = None) -> DataFrame | None:
        """A table of the given loads, or of all that have it; a load of an empty first batch has no filters."""
        loads = self.loads if loads is None else loads
        if "/" in name:
            loads = [x for x in loads if file_names(self.spark, f"{self.path}/{x}/{name}")]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}/{name}" for x in loads]) if loads else None

    def ordered(self, texts: DataFrame):
        """The word order as a broadcast value; the first load that has texts makes it."""
        if self.order is None:
            self.order = word_order(texts)
            if self.order is None:
                return self.spark.sparkContext.broadcast(WordOrder(1, {}))
            signed = [(h - 2**64 if h >= 2**63 else h, n) for h, n in self.order.counts.items()]
            self.spark.createDataFrame(signed, "hash long, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order")
        if self._shared is None:
            self._shared = self.spark.sparkContext.broadcast(self.order)
        return self._shared


def ingest(store: HistoryStore, batch: DataFrame, id_col: str, text_col: str, order_cols: list[str]) -> DataFrame:
    """Matches of a batch, one row ``(accepted_id, packet_id)`` for each case and each accepted text before it that it matches.

    Null and blank texts are passed over; repeated ids count once; a text without any word matches nothing. Ties in
    ``order_cols`` are broken by the id. An id of an earlier load is never matched with itself. Other columns, whatever
    their names, are ignored. An empty batch gives no rows. The result is a table of the store.
    """
    spark, t = store.spark, store.threshold
    load = f"load-{len(store.loads):06d}-{uuid.uuid4().hex[:8]}"

    counts: dict[str, int] = {}

    def kept(df: DataFrame, name: str, block: int = 128 << 20, by: list[str] = [], **count: Column) -> DataFrame:  # noqa: B006
        """Writes a table of the load; ``counts`` gets the sum of each of ``count`` (conditions or numbers) over its rows, without another pass."""
        path, seen = f"{store.path}/{load}/{name}", Observation()
        if count:
            df = df.observe(seen, *[F.sum(c.cast("long")).alias(k) for k, c in count.items()])
        df.write.option("compression", "zstd").option("parquet.block.size", str(block)).partitionBy(*by).parquet(path)
        if count:
            counts.update({k: v or 0 for k, v in seen.get.items()})
        return spark.read.schema(df.schema).parquet(path)

    temporary = lambda df, name, **count: kept(df, f"scratch/{name}", **count)
    orders = [f"o{i}" for i in range(len(order_cols))]
    rows = batch.where(~is_blank(text_col)).select(F.col(id_col).alias("id"), *[F.col(c).alias(o) for c, o in zip(order_cols, orders)], F.col(text_col).alias("text"))
    sk = F.unhex(F.md5(F.array_join(F.sort_array(F.array_distinct(words("text"))), " ")))
    rows = rows.where(F.lower("text").rlike("[a-z0-9]")).select("id", F.struct(*orders, F.col("id").alias("oid")).alias("ord"), sk.alias("sk"), "text")
    rows = temporary(rows, "rows")  # read twice, and the keys of the sets cost more than writing them
    # one node per word set; the earliest text stands for the set. Sets of several ids keep their key for the last step
    nodes = rows.groupBy("sk").agg(F.min(F.struct("ord", "text")).alias("m"), (F.min("id") < F.max("id")).alias("many"))
    word_set = F.transform(F.array_distinct(words("m.text")), lambda w: F.xxhash64(w))
    sets = kept(nodes.select(F.col("m.ord.oid").alias("node"), F.col("m.ord").alias("ord"), F.when(F.col("many"), F.col("sk")).alias("sk"), word_set.alias("ws"), F.col("m.text").alias("text")), "sets", many=F.col("sk").isNotNull())
    order = store.ordered(sets)
    prints = kept(packed(sets.select("node", "text"), store.parts, t, order, store.rare, store.hot_rows).sortWithinPartitions("bucket"), "prints", 8 << 20, hot_packs=F.col("bucket") < 0)

    past = store.table("prints", prints.schema)
    new_hot = counts["hot_packs"] > 0
    has_hot = new_hot or bool(store.hot)
    hot = spark.sql("select 0 part, 0 seq, 0L n, false sealed, cast(null as binary) data, 0L hot where false")
    if has_hot:
        apart = unpacked(prints.where("bucket < 0")).select(F.lit(False).alias("past"), "*")
        if store.hot:
            apart = apart.unionByName(unpacked(store.table("prints", prints.schema, store.hot).where("bucket < 0")).select(F.lit(True).alias("past"), "*"))
        apart = temporary(apart, "apart")
        part = F.floor(F.pmod(F.shiftrightunsigned("fp", 8), F.lit(store.parts * BUCKETS)) / BUCKETS).cast("int")
        hot = apart.select("fp").distinct().select(part.alias("part"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("sealed"), F.lit(None).cast("binary").alias("data"), F.col("fp").alias("hot"))
    filters = hot
    last = store.table("screened/kind=2", FILTERS, store.loads[-1:])
    if last is not None:
        done, last = store.table("screened/kind=2", FILTERS).where("sealed"), last.where("not sealed")
        filters = done.unionByName(last).select("part", "seq", "n", "sealed", "data", F.lit(0).cast("long").alias("hot")).unionByName(hot)
    screened = prints.where("bucket >= 0").groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(_screen(store.parts, store.slice_rows), SCREENED)
    screened = kept(screened, "screened", by=["kind"], going=F.when(F.col("kind") == 0, F.col("n")).otherwise(0))

    held = spark.sql("select 0 part, cast(null as binary) data where false")
    if past is not None:
        held = past.where("bucket >= 0")
        if counts["going"] <= 2 * store.parts * BUCKETS:  # else nearly all buckets are hit
            masks = screened.where("kind = 1").select("part", "seq").collect()  # a mask of BUCKETS bits for each part at most
            held = held.where(F.col("bucket").isin([r["part"] * BUCKETS + k for r in masks for k in range(BUCKETS) if r["seq"] >> k & 1]))
    held = held.select("part", "data", F.lit(0).cast("long").alias("hot")).unionByName(hot.select("part", "data", "hot"))
    met = screened.where("kind = 0").select("part", "data").groupBy("part").cogroup(held.groupBy("part")).applyInPandas(_meet(t, store.meet_rows), MEETINGS)
    met = temporary(met, "met", pairs=F.col("a").isNotNull(), large=F.col("a").isNull())
    pairs = met.where("a is not null").select("a", "b", "past")
    large = met.where("a is null").select("past", "fp", "node", "sig")
    if has_hot or counts["large"]:
        large = temporary((large.unionByName(apart) if has_hot else large).distinct(), "large")
        new, old = (large.where("past" if p else "not past").select("fp", "node", "sig") for p in (False, True))
        sized = new.join(new.groupBy("fp").agg(F.count(F.lit(1)).cast("int").alias("n")), "fp")
        near = block_pairs(sized, "fp", "node", F.col("n"), ("sig",), may_match(t)).withColumn("past", F.lit(False))
        grid = crossed(old.select("fp", F.col("node").alias("a"), F.col("sig").alias("x_sig")), new.select("fp", F.col("node").alias("b"), F.col("sig").alias("y_sig")), "fp", "a", "b")
        pairs = temporary(pairs.unionByName(near).unionByName(grid.where(may_match(t)).select("a", "b", F.lit(True).alias("past"))), "pairs", pairs=F.lit(True))

    every = sets.withColumn("past", F.lit(False))
    if store.loads:
        every = every.unionByName(store.table("sets", sets.schema).withColumn("past", F.lit(True)))
    links = verified(pairs, counts["pairs"], every, sets, t)
    if store.loads:
        links = links.join(store.table("refused", "node long").select(F.col("node").alias("a"), F.lit(True).alias("past")), ["a", "past"], "left_anti")
    links = temporary(links, "links", links=F.lit(True))
    few = counts["links"] <= SETTLE_LINKS
    near = links.where("not past").select(F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("dst"))
    rejected = links.where("past").select(F.col("b").alias("node"))
    refused = kept(settle_few(near, rejected) if few else settle(near, rejected.distinct(), temporary), "refused")
    refused_keys = F.broadcast(refused) if few else refused  # each is the end of a link

    # what each word set matches among the accepted ones: accepted before it, accepted between it and a later copy, or itself
    side = lambda acc, node: links.where("not past").select(F.col(acc).alias("acc"), F.col(f"{acc}o").alias("acc_ord"), F.col(node).alias("case"), F.col(f"{node}o").alias("case_ord"), F.col(f"{node}_sk").alias("sk"))
    own = sets.where("sk is not null").select(F.col("node").alias("acc"), F.col("ord").alias("acc_ord"), F.col("node").alias("case"), F.col("ord").alias("case_ord"), "sk")
    hits = side("a", "b").unionByName(side("b", "a")).unionByName(own).join(refused_keys.withColumnRenamed("node", "acc"), "acc", "left_anti").withColumn("past", F.lit(False))
    hits = hits.unionByName(links.where("past").select(F.col("a").alias("acc"), F.col("bo").alias("acc_ord"), F.col("b").alias("case"), F.col("bo").alias("case_ord"), F.col("b_sk").alias("sk"), F.lit(True).alias("past")))
    found = hits.where("sk is null").drop("sk")
    if counts["many"]:
        # every text of a repeated set is a case of its own, however many they are; rows of one id may have come twice
        several, members = hits.where("sk is not null").drop("case", "case_ord"), rows.select("sk", F.col("id").alias("case"), F.col("ord").alias("case_ord"))
        each = members.join(F.broadcast(several), "sk") if 2 * counts["links"] + counts["many"] <= BROADCAST_KEYS else crossed(several, members, "sk", "acc", "case")
        found = found.unionByName(each.select(found.columns).dropDuplicates(["acc", "case"]))
    found = found.where("case <> acc and (past or acc_ord < case_ord)").select(F.col("acc").alias("accepted_id"), F.col("case").alias("packet_id"))
    result = kept(found, "found")
    store.commit(load, new_hot)
    for name in ("scratch", "screened/kind=0", "screened/kind=1"):
        remove(spark, f"{store.path}/{load}/{name}")
    # shuffle files of the load go with the driver's objects that stand for them
    del nodes, sets, hot, filters, screened, held, met, pairs, every, links, near, rejected, refused, refused_keys, hits, found
    if len(store.loads) % CLEAN_LOADS == 0:
        spark.sparkContext._jvm.System.gc()
    return result


def verified(pairs: DataFrame, n_pairs: int, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, past) whose sets really share ``threshold`` of their words, each once, with the places of both in
    the order, which comes ``first``, and the keys of sets of several ids.

    Word sets come from (node, ord, sk, ws) tables, the left one with ``past``. While the ``n_pairs`` are few they are sent
    to the left sets, so that the history's sets are not moved; only those with a pair are.
    """
    few = n_pairs <= BROADCAST_KEYS
    pairs = pairs.distinct()  # a pair meets once for each part that has a key of both
    x = left.select(F.col("node").alias("a"), "past", F.col("ord").alias("ao"), F.col("sk").alias("a_sk"), F.col("ws").alias("aw")).join(F.broadcast(pairs) if few else pairs, ["a", "past"])
    y = right.select(F.col("node").alias("b"), F.col("ord").alias("bo"), F.col("sk").alias("b_sk"), F.col("ws").alias("bw"))
    shared = F.size(F.array_intersect("aw", "bw"))
    # shared >= threshold * (all words of both - shared), with the costly term once
    met = x.join(y, "b").where(shared * F.lit(1 + threshold) >= F.lit(threshold) * (F.size("aw") + F.size("bw")) - 1e-9)
    return met.select("a", "b", "past", "ao", "bo", "a_sk", "b_sk", (F.col("ao") < F.col("bo")).alias("first")).dropDuplicates(["a", "b", "past"])


def settled(links: list[tuple[int, int]], rejected: set[int]) -> set[int]:
    """The nodes refused: those in ``rejected``, and each other one with an earlier accepted node linked (earlier, later) to it."""
    before: dict[int, list[int]] = {}
    for src, dst in links:
        before.setdefault(dst, []).append(src)
        before.setdefault(src, [])
    refused, known = set(rejected), set(rejected)
    todo = list(before)
    while todo:
        node = todo[-1]
        waiting = [] if node in known else [s for s in before[node] if s not in known]
        if waiting:
            todo += waiting
            continue
        todo.pop()
        if node not in known:
            known.add(node)
            if any(s not in refused for s in before[node]):
                refused.add(node)
    return refused


def settle_few(links: DataFrame, rejected: DataFrame) -> DataFrame:
    """As ``settle``, in one task; for link tables of a counted size."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, gone = [], set()
        for pdf in batches:
            past = pdf["past"].astype(bool)
            gone |= set(pdf.loc[past, "dst"])
            pairs += zip(pdf.loc[~past, "src"], pdf.loc[~past, "dst"])
        got = settled(pairs, gone)
        yield pd.DataFrame({"node": np.array(sorted(got), dtype=np.int64)})

    rows = links.select("src", "dst", F.lit(False).alias("past")).unionByName(rejected.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("past")))
    return rows.coalesce(1).mapInPandas(scan, "node long")


def settle(links: DataFrame, rejected: DataFrame, temporary) -> DataFrame:
    """Nodes (node) refused when each is accepted unless an earlier accepted one is linked to it, or it is in ``rejected``.

    ``links`` (src, dst) run from the earlier to the later node. Each round accepts all open nodes without an open
    predecessor and refuses their successors; the open part shrinks until nothing is left.
    """
    rejected = temporary(rejected, "rejected")
    todo = links.join(rejected, links.src == rejected.node, "left_anti").join(rejected, links.dst == rejected.node, "left_anti")
    todo, refused, k = temporary(todo, "open"), [rejected], 0
    while not todo.isEmpty():
        heads = todo.select(F.col("src").alias("node")).distinct().join(todo.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        out = temporary(todo.join(heads, todo.src == heads.node, "left_semi").select(F.col("dst").alias("node")).distinct(), f"refused-{k}")
        refused.append(out)
        rest = todo.join(heads, todo.src == heads.node, "left_anti").join(out, todo.src == out.node, "left_anti")
        todo = temporary(rest.join(out, rest.dst == out.node, "left_anti"), f"open-{k}")
        k += 1
    return reduce(DataFrame.unionByName, refused).distinct()
