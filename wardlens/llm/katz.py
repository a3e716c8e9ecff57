"""LM scoring (operator 9): Katz backoff with Good-Turing discounts, over words, of any order (the query's is 3).

P_n(w | h) = d_n(c(h w)) c(h w) / c(h) where the n-gram was seen, else alpha(h) P_{n-1}(w | h'), h' being h without its first word,
and alpha(h) = (1 - sum of the seen) / (1 - sum of P_{n-1} over the words seen after h), so that every context's distribution
sums to one over the vocabulary and one unknown word; P_1(w) = d_1(c(w)) c(w) / N, and what the discounts leave is the unknown
word's. A text's first word has the text's start as its context, the second the start and the first word, and so on;
the last word is the end. Each token is evaluated from the unigram upwards, which is the recursion read from its end.

Counts cover all training rows, and nothing has a cap. Texts are read once, in chunks of about ``CHUNK`` bytes, whose words
are numbered within the chunk (table ``chunks``). Then one round trip for each order: each chunk sends its distinct n-grams,
packed by target partition, and gets back what it needs to know about them, in the same order:

* words go to the partition of their hash, and come back with a global number and count;
* n-grams go to the partition of their context, and come back with their count, whether another chunk has them too, whether the
  context has any count that is discounted, and, where the chunk has a held-out token after it, the context's sums: how many words
  were seen after it 1 ... K times or oftener, and the same by their counts after h'. All are whole numbers, so the weights are
  exactly normalised whatever order they are added in. A training token is never unseen and needs no weight.

An n-gram of which the context, or all but the first word, is in no other chunk is not sent: its chunk knows its count. What such
n-grams add to the sums of contexts that others have too is sent in their place. A context with more than a partition's
share of all tokens is spread over several partitions by word; its partial sums, at most two a partition in all, are added up
on the driver. The number of partitions grows with the number of chunks, so what a task holds doesn't grow. Discounts
need only the numbers of items with counts 1 ... K + 1; where those are too bumpy for Good-Turing, a log-linear fit takes their place.

Edge cases: a null or empty text is the end token alone; a very long text is a chunk of its own; repeated rows count as often
as they come; a null doc_id has crc32 0 and so is held out; without training rows all probabilities fall to one unknown word,
of probability 1, and base scores are log10(0.1 / 0.1); an empty table gives no rows; columns besides ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, crc_mod, hash64, mix64, parts, release, scratch, split_words, table, written

CHUNK = 5_000_000
K = 5  # counts up to K are discounted
ORDER = 3
CHUNKS_A_PART = 4
MESSAGE = "chunk long, part int, blob binary"
#: Shuffle files go when the query that wrote them ends. Until the driver's garbage is collected, which may take until after the next
#: round, they would lie beside that round's.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers in one blob: each byte plane by itself, compressed where that is shorter."""
    out = []
    for a in arrays:
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes, full = np.empty((width, len(a)), np.uint8), np.ascontiguousarray(a.astype("<u8", copy=False)).view(np.uint8)
        for k in range(width):
            planes[k] = full[k::8]
        raw = planes.tobytes()
        z = _ZSTD.compress(raw, asbytes=True) if len(raw) > 40 else raw
        short = len(z) < len(raw)
        out += [struct.pack("<bii", width, len(a), len(z) if short else -1), z if short else raw]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        width, n, z = struct.unpack_from("<bii", blob, at)
        at += 9
        size = z if z >= 0 else width * n
        raw = blob[at : at + size]
        at += size
        if z >= 0:
            raw = _ZSTD.decompress(raw, decompressed_size=width * n, asbytes=True)
        planes = np.frombuffer(raw, np.uint8).reshape(width, n)
        if width <= 3:
            full = planes[-1].astype("<u8")
            for k in range(width - 2, -1, -1):
                full <<= np.uint64(8)
                full |= planes[k]
        else:
            full = np.zeros((n, 8), np.uint8)
            for k in range(width):
                full[:, k] = planes[k]
            full = full.reshape(-1).view("<u8")
        out.append(full)
    return out


def smoothed(n: list[int]) -> np.ndarray | None:
    """Gale's log-linear smoothing of the numbers of items: exp(a + b log r) for r = 1 ... K + 1, each number that isn't 0 averaged
    over the gap of zeros around it. None if they fall no faster than 1 / r: then Good-Turing raises counts."""
    r = np.array([i + 1 for i, x in enumerate(n) if x], float)
    if len(r) < 2:
        return None
    gap = np.append(r[1:], 2 * r[-1] - r[-2]) - np.append(0, r[:-1])
    b, a = np.polyfit(np.log(r), np.log(2 * np.array([x for x in n if x]) / gap), 1)
    return np.exp(a + b * np.log(np.arange(1, K + 2))) if b < -1 else None


def discounts(n: list[int]) -> np.ndarray:
    """d(0) ... d(K) from the numbers of items with counts 1 ... K + 1: Katz's from the numbers as they are, or where one of those
    is no discount, Katz's from the smoothed numbers; absolute ones only where Good-Turing has none at all."""
    d, r = np.ones(K + 1), np.arange(1, K + 1)
    for m in (np.array(n, float) if all(n) else None, smoothed(n)):
        if m is None or (K + 1) * m[K] >= m[0]:
            continue
        common = (K + 1) * m[K] / m[0]
        d[1:] = ((r + 1) * m[1:] / m[:K] / r - common) / (1 - common)
        if ((d[1:] > 0) & (d[1:] < 1)).all():
            return d
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d[1:] = (r - cut) / r
    return d


class Unigrams:
    """P(w) of a count, and the base of the contract."""

    def __init__(self, n: list[int], total: int, distinct: int, seen_mass_counts: np.ndarray):
        """``seen_mass_counts``: number of distinct words with counts 1 ... K."""
        self.total, self.distinct, self.d = total, distinct, discounts(n)
        r = np.arange(1, K + 1)
        lost = float(((1 - self.d[1:]) * r * seen_mass_counts).sum())
        self.plain = lost <= 0  # nothing was discounted: one token is set aside for the unknown word
        self.scale = total + 1 if self.plain else total
        self.unknown = 1.0 / self.scale if self.plain else lost / total

    def prob(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        d = np.ones(len(c)) if self.plain else np.where(c <= K, self.d[np.minimum(c, K)], 1.0)
        return np.where(c > 0, d * c / self.scale, self.unknown)


def make_chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, and a blob each of the texts' lengths and folds, the token numbers and the words' hashes. Token 0 is the end."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in byte_slices(batch.column(1), size):
                flat, off = split_words(batch.column(1).slice(a, b - a))
                enc = flat.dictionary_encode()
                codes = enc.indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
                count = np.bincount(codes, minlength=len(enc.dictionary))
                order = np.argsort(-count, kind="stable")  # frequent words get small numbers
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(1, len(order) + 1)
                n = np.diff(off)
                train = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task << 32 | seq], pa.int64()),
                        pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                        pa.array([pack(n.astype(np.uint64), train.astype(np.uint64))], pa.binary()),
                        pa.array([pack(number[codes].astype(np.uint64))], pa.binary()),
                        pa.array([hash64(enc.dictionary)[order].astype("<u8").tobytes()], pa.binary()),
                    ],
                    ["chunk", "docs", "texts", "tokens", "words"],
                )
                seq += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod("doc_id", 10) != 0).alias("train"))
    return rows.mapInArrow(run, "chunk long, docs array<long>, texts binary, tokens binary, words binary")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse. Whole numbers that leave room for their places are sorted together with those, as numbers: several
    times faster than sorting places by them."""
    bits = max(1, len(keys) - 1).bit_length()
    if not len(keys) or int(keys.max()) >> (64 - bits) or int(keys.min()) < 0:
        return np.unique(keys, return_inverse=True)
    s = np.sort(keys.astype(np.uint64) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
    at = (s & np.uint64((1 << bits) - 1)).astype(np.int64)
    s >>= np.uint64(bits)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    which = np.empty(len(s), np.int64)
    which[at] = np.cumsum(new) - 1
    return s[new].astype(keys.dtype), which


def _by_part(part: np.ndarray, p: int) -> np.ndarray:
    """The stable order by partition. Numpy sorts 16-bit numbers by radix."""
    return np.argsort(part.astype(np.uint16 if p <= 1 << 16 else np.int64), kind="stable")


class _Grams:
    """The n-grams of one order in a chunk. ``tok``: tokens that have one; ``of``: the n-gram that ends at each token, or -1."""

    def __init__(self, tok, ctx, w, width, train, n_ctx):
        bits = max(1, width - 1).bit_length()
        keys, which = distinct(ctx << bits | w[tok])
        self.tok, self.ctx, self.n_ctx = tok, ctx, n_ctx
        self.of = np.full(len(w), -1, np.int64)
        self.of[tok] = which
        self.h = keys >> bits
        self.w = keys & ((1 << bits) - 1)
        self.own = np.bincount(which, weights=train[tok], minlength=len(keys)).astype(np.int64)
        self.asks = np.zeros(n_ctx, bool)  # contexts of held-out tokens: theirs alone are the words not seen
        self.asks[ctx[train[tok] == 0]] = True
        self.row = np.cumsum(self.asks) - 1
        self.at = np.zeros(len(keys), np.int64)  # some token where each stands
        self.at[which] = tok

    def parts(self):
        """(partition, contexts named to it, whether it is their own, their numbers of n-grams sent, those n-grams)."""
        cuts = np.flatnonzero(np.diff(self.to, prepend=-1, append=-1))
        ends = np.concatenate([[0], np.cumsum(self.runs)])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(self.to[i]), self.named[i:j], self.home[i:j], self.runs[i:j], self.sent[ends[i] : ends[j]]


class Chunk:
    """A chunk's texts as numbers, and what the round trips have brought back so far, order by order."""

    def __init__(self, texts: bytes, tokens: bytes, hashes: bytes):
        n, train = (x.astype(np.int64) for x in unpack(texts))
        (t,) = unpack(tokens)
        ends = np.cumsum(n + 1) - 1
        w = np.zeros(len(t) + len(n), np.int64)
        inner = np.ones(len(w), bool)
        inner[ends] = False
        w[inner] = t.astype(np.int64)
        self.w, self.texts = w, len(n)
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.pos = np.arange(len(w)) - (ends - n)[self.doc]
        self.is_train = train
        self.train = train[self.doc]
        self.hashes = np.frombuffer(hashes, "<u8")
        self.grams: dict[int, _Grams] = {}

    def word_rows(self, p: int) -> list[tuple]:
        c = np.bincount(self.w, weights=self.train, minlength=len(self.hashes) + 1)[1:].astype(np.uint64)
        part = (self.hashes % np.uint64(p)).astype(np.int64)
        order = _by_part(part, p)
        cuts = np.searchsorted(part[order], np.arange(p + 1))
        return [(k, self.hashes[order[i:j]], c[order[i:j]]) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]

    def take_words(self, back: list, p: int, ends: int) -> None:
        """Global numbers and counts of the words; word 0 is the end, and as a context the start."""
        n = len(self.hashes) + 1
        self.gid, self.count, self.shared = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.ones(n, bool)
        self.count[0] = ends
        order = _by_part(self.hashes % np.uint64(p), p)
        if back:
            self.gid[1:][order] = np.concatenate([b[0] for b in back])
            self.count[1:][order] = np.concatenate([b[1] for b in back]).astype(np.int64)
            self.shared[1:][order] = np.concatenate([b[2] for b in back]) > 0

    def build(self, n: int, p: int, total: int) -> _Grams:
        """The n-grams of order ``n``, and in which order the sent ones go to which partitions. Lower orders must be there."""
        if n == 2:
            tok = np.arange(len(self.w))
            ctx = np.where(self.pos > 0, np.concatenate([[0], self.w[:-1]]), 0) if len(self.w) else tok
            g = _Grams(tok, ctx, self.w, len(self.gid), self.train, len(self.gid))
            g.total, shared, g.words = self.count, np.ones(len(self.gid), bool), self.gid[None, :]
            g.lower, g.suffix, below = self.count[g.w], np.zeros(len(self.gid), np.int64), self.shared[g.w]
        else:
            low = self.grams[n - 1]
            tok = np.flatnonzero(self.pos >= n - 2)
            g = _Grams(tok, low.of[tok - 1], self.w, len(self.gid), self.train, len(low.h))
            g.total, shared = low.count, low.shared
            g.words = np.concatenate([low.words[:, low.h], self.gid[None, low.w]])
            end = low.of[g.at]
            g.lower, below = low.count[end], low.shared[end]
            place = np.full(len(self.w), -1, np.int64)
            place[low.tok] = low.ctx
            g.suffix = np.zeros(g.n_ctx, np.int64)  # each context without its first word, as a context of the order below
            g.suffix[g.ctx] = place[tok]
        g.hot = g.total * p > total
        asked = shared & (g.total > 0)
        g.local = asked[g.h] & ~below
        g.sent = np.flatnonzero(asked[g.h] & below)
        h, asked = g.h[g.sent], np.flatnonzero(asked)
        x, base = np.zeros(len(asked), np.uint64), np.zeros(g.n_ctx, np.int64)
        for column in g.words:
            x = mix64(x + column[asked] + np.uint64(1))
        base[asked] = x % np.uint64(p)
        at, hot = base[h], g.hot[h]
        k = np.flatnonzero(hot)
        spread = (-(-g.total[h[k]] * p // max(1, total)) + 1).astype(np.uint64)
        at[k] = (x[np.searchsorted(asked, h[k])] + mix64(self.gid[g.w[g.sent[k]]] + np.uint64(1)) % spread) % np.uint64(p)
        order = _by_part(at, p)
        g.sent, g.part, hot = g.sent[order], at[order], hot[order]
        # Which contexts are named to which partitions: each to its own, a hot one also where its n-grams go.
        asked = asked[_by_part(base[asked], p)]
        names = base[asked] * g.n_ctx + asked
        away, many = np.unique(g.part[hot] * g.n_ctx + g.h[g.sent[hot]], return_counts=True)
        g.runs = np.bincount(g.h[g.sent[~hot]], minlength=g.n_ctx)[asked]
        if len(away):
            into = np.searchsorted(names, away)
            fresh = np.append(names, -1)[into] != away
            new, into = away[fresh], into[fresh]
            names, g.runs = np.insert(names, into, new), np.insert(g.runs, into, 0)
            g.runs[np.searchsorted(names, away)] += many
        g.to = names // max(1, g.n_ctx)
        g.named = names - g.to * g.n_ctx
        g.home = base[g.named] == g.to
        self.grams[n] = g
        return g

    def gram_rows(self, n: int) -> tuple[list[tuple], np.ndarray]:
        """What goes to each partition, and how many of the n-grams that aren't sent have counts 1 ... K + 1."""
        g, rows = self.grams[n], []
        own = np.flatnonzero(g.local)
        seen, below = _sums(g.h[own], g.own[own], g.lower[own], g.n_ctx)
        for part, hs, home, runs, keys in g.parts():
            ws, wi = distinct(g.w[keys])
            more = [np.where(home, x[hs], 0) for x in (*seen.T, *below.T)]
            rows.append((part, *[c[hs] for c in g.words], g.hot[hs], runs, g.asks[hs], *more, self.gid[ws], wi, g.own[keys], g.lower[keys]))
        rest = np.ones(len(g.h), bool)
        rest[g.sent] = False
        return rows, np.bincount(np.minimum(g.own[rest], K + 2), minlength=K + 3)[1 : K + 2]

    def take_grams(self, n: int, back: list, hot: dict) -> None:
        """Counts, whether contexts are ``plain``: nothing after them is discounted, and the sums of those that ask: ``seen`` by the
        n-grams' counts, ``below`` by their counts one order lower."""
        g = self.grams[n]
        g.count, g.shared = g.own.copy(), np.zeros(len(g.h), bool)
        g.count[g.total[g.h] == 0] = 0
        asked = np.flatnonzero(g.asks[g.h])
        g.seen, g.below = _sums(g.row[g.h[asked]], g.count[asked], g.lower[asked], int(g.asks.sum()))
        g.plain = np.ones(g.n_ctx, bool)
        g.plain[g.h[(g.count > 0) & (g.count <= K)]] = False
        for b, (_, hs, _, _, keys) in zip(back, g.parts(), strict=True):
            g.count[keys], g.shared[keys], g.plain[hs] = b[0].astype(np.int64), b[1] > 0, b[2] > 0
            rows = g.row[hs[g.asks[hs]]]
            g.seen[rows] = np.stack(b[3 : K + 4], 1)
            g.below[rows] = np.stack(b[K + 4 :], 1)
        for k in np.flatnonzero(g.hot).tolist() if hot else []:
            got = hot.get(tuple(g.words[:, k].tolist()))
            if got is not None:
                g.plain[k] = not got[:K].any()
                if g.asks[k]:
                    g.seen[g.row[k]], g.below[g.row[k]] = got[: K + 1], got[K + 1 :]

    def log_probs(self, uni: "Unigrams", ds: dict[int, np.ndarray]) -> np.ndarray:
        """log10 P of each token: from the highest order down, to where its n-gram was seen."""
        out, need, r = np.zeros(len(self.w)), np.ones(len(self.w), bool), np.arange(1, K + 1)
        # Where nothing was discounted, one token is set aside for the words not seen.
        scales = {n: np.maximum(g.total + g.plain, 1).astype(float) for n, g in self.grams.items()}
        for n in sorted(self.grams, reverse=True):
            g, d, scale = self.grams[n], ds[n], scales[n]
            tok, ctx = (g.tok, g.ctx) if need.all() else (g.tok[need[g.tok]], g.ctx[need[g.tok]])
            c = g.count[g.of[tok]]
            seen, new = np.flatnonzero(c), np.flatnonzero(c == 0)
            c, h = c[seen], ctx[seen]
            disc = np.where((c <= K) & ~g.plain[h], d[np.minimum(c, K)], 1.0)
            out[tok[seen]] += np.log10(np.maximum(disc * c / scale[h], 1e-300))
            need[tok[seen]] = False
            asks = np.flatnonzero(g.asks)
            d_low = ds.get(n - 1, np.ones(K + 1) if uni.plain else uni.d)
            scale_low = scales[n - 1][g.suffix[asks]] if n > 2 else float(uni.scale)
            left = np.where(g.plain[asks], 1.0, g.seen[:, :K] @ (r * (1 - d[1:]))) / scale[asks]
            mass = (g.below[:, :K] @ (r * d_low[1:]) + g.below[:, K]) / scale_low
            alpha = np.where(g.total[asks] > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
            out[tok[new]] += np.log10(alpha)[g.row[ctx[new]]]
        need = np.flatnonzero(need)
        out[need] += np.log10(uni.prob(self.count))[self.w[need]]
        return out


def _sums(h: np.ndarray, c: np.ndarray, lower: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By context: how many of its seen n-grams have counts 1 ... K and the sum of the larger; the same by ``lower``."""
    if not c.all():
        some = np.flatnonzero(c)
        h, c, lower = h[some], c[some], lower[some]
    out, at = [], h * (K + 1) - 1
    for x in (c, lower):
        grid = np.bincount(at + np.minimum(x, K + 1), minlength=n * (K + 1)).reshape(n, K + 1)
        many = np.flatnonzero(x > K)
        grid[:, K] = np.bincount(h[many], weights=x[many], minlength=n)
        out.append(grid)
    return out[0], out[1]


def _number(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of several columns, and each row's number among them."""
    idx = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        u, inv = distinct(c)
        _, idx = distinct(idx * max(1, len(u)) + inv)
    some = np.zeros(int(idx.max()) + 1 if len(idx) else 0, np.int64)
    some[idx] = np.arange(len(idx))
    return [c[some] for c in columns], idx


def _round(sent: DataFrame, count, url: str, p: int) -> list[list[np.ndarray]]:
    """Send, count, bring back: one file for each chunk in the shared folder, blobs in order of their partitions. Returns the
    counting tasks' summaries, one each."""
    back = sent.repartitionById(p, "part").mapInArrow(count, MESSAGE)
    ordered = back.repartition(p, "chunk").sortWithinPartitions("chunk", "part")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(url)
        now, blobs = None, []

        def close():
            name = f"{root}/{now}.{TaskContext.get().taskAttemptId()}.tmp"
            with fs.open_output_stream(name) as f:
                f.write(np.array([len(blobs), *map(len, blobs)], "<i8").tobytes() + b"".join(blobs))
            fs.move(name, f"{root}/{now}.blobs")

        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if chunk < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])
                    continue
                if chunk != now:
                    if now is not None:
                        close()
                    now, blobs = chunk, []
                blobs.append(blob)
        if now is not None:
            close()

    fs, root = pafs.FileSystem.from_uri(url)
    fs.create_dir(root)
    conf = sent.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return [unpack(r.blob) for r in ordered.mapInArrow(run, "blob binary").collect()]  # one row a counting task
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _read_blobs(url: str, chunk: int) -> list[list[np.ndarray]]:
    fs, root = pafs.FileSystem.from_uri(url)
    try:
        with fs.open_input_stream(f"{root}/{chunk}.blobs") as f:
            raw = f.read()
    except FileNotFoundError:  # it sent nothing
        return []
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 8 * n, []
    for s in np.frombuffer(raw, "<i8", n, 8).tolist():
        out.append(unpack(raw[at : at + s]))
        at += s
    return out


def _count_words(p: int):
    def run(batches):
        chunk_of, xs, cs, own = [], [], [], 0
        for batch in batches:
            for chunk, part, blob in zip(*[c.to_pylist() for c in batch.columns]):
                x, c = unpack(blob)
                chunk_of.append(chunk)
                xs.append(x)
                cs.append(c)
                own = part
        if not xs:
            return
        uniq, which = distinct(np.concatenate(xs))
        c = np.bincount(which, weights=np.concatenate(cs).astype(float), minlength=len(uniq)).astype(np.int64)
        rank = np.empty(len(uniq), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(uniq))
        gid = 1 + rank * p + own
        shared = (np.bincount(which, minlength=len(uniq)) > 1).astype(np.int64)
        cuts = np.cumsum([0, *map(len, xs)])
        for chunk, i, j in zip(chunk_of, cuts[:-1], cuts[1:]):
            yield _packed(chunk, [(own, gid[which[i:j]], c[which[i:j]], shared[which[i:j]])])
        few = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]
        yield _packed(-1, [(own, np.array([c.sum(), (c > 0).sum(), *few]))])

    return run


def _count_grams(n: int, last: bool):
    """Counts of order ``n`` in one partition. A negative chunk brings the numbers of the n-grams that weren't sent."""

    def run(batches):
        chunk_of, ctx, runs, hots, asking, more, ws, W, C, L, own = [], [], [], [], [], [], [], [], [], [], 0
        few = np.zeros(K + 1, np.int64)
        for batch in batches:
            for chunk, part, blob in zip(*[c.to_pylist() for c in batch.columns]):
                got, own = unpack(blob), part
                if chunk < 0:
                    few += got[0].astype(np.int64)
                    continue
                chunk_of.append(chunk)
                ctx.append(got[: n - 1])
                hot, run_, ask, *sums, w, wi, c, low = got[n - 1 :]
                for to, x in ((hots, hot), (asking, ask > 0), (more, np.stack(sums, 1).astype(np.int64)), (runs, run_.astype(np.int64)), (ws, w), (W, wi.astype(np.int64)), (C, c), (L, low)):
                    to.append(x)
        if chunk_of:
            contexts, number = _number([np.concatenate([c[k] for c in ctx]) for k in range(n - 1)])
            h = np.repeat(number, np.concatenate(runs))
            words, place = distinct(np.concatenate(ws))
            place = np.split(place, np.cumsum([len(x) for x in ws])[:-1])
            keys, which = distinct(h * len(words) + np.concatenate([x[i] for x, i in zip(place, W)]))
            c = np.bincount(which, weights=np.concatenate(C).astype(float), minlength=len(keys)).astype(np.int64)
            shared = np.zeros(len(keys), np.int64) if last else (np.bincount(which, minlength=len(keys)) > 1).astype(np.int64)
            low = np.zeros(len(keys), np.int64)
            low[which] = np.concatenate(L).astype(np.int64)
            of, more, hots, asking = keys // max(1, len(words)), np.concatenate(more), np.concatenate(hots) > 0, np.concatenate(asking)
            plain = np.ones(len(contexts[0]), bool)
            plain[of[(c > 0) & (c <= K)]] = False
            plain[number[more[:, :K].any(1)]] = False
            asks = np.zeros(len(plain), bool)  # a hot context's partial sums are asked for by the driver
            asks[number[asking | hots]] = True
            row = np.cumsum(asks) - 1
            some = np.flatnonzero(asks[of])
            seen, below = _sums(row[of[some]], c[some], low[some], int(asks.sum()))
            some = np.flatnonzero(asks[number])
            for k, x in enumerate(more[some].T):
                (seen if k <= K else below)[:, k % (K + 1)] += np.bincount(row[number[some]], weights=x, minlength=len(seen)).astype(np.int64)
            cuts, ends = np.cumsum([0, *map(len, W)]), np.cumsum([0, *map(len, runs)])
            for chunk, i, j, a, b in zip(chunk_of, cuts[:-1], cuts[1:], ends[:-1], ends[1:]):
                s = number[a:b]
                told = row[s[asking[a:b]]]
                yield _packed(chunk, [(own, c[which[i:j]], shared[which[i:j]], plain[s], *seen[told].T, *below[told].T)])
            few += np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]
            s = np.unique(number[hots])
            yield _packed(-1, [(own, few, *[x[s] for x in contexts], *seen[row[s]].T, *below[row[s]].T)])
        elif few.any():
            yield _packed(-1, [(own, few)])

    return run


def score(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    if order < 2:
        raise ValueError("the order must be 2 at least")
    spark = docs.sparkSession
    chunks = written(make_chunks(docs, chunk_bytes), "chunks")
    p = max(1, parts(spark), -(-chunks.count() // CHUNKS_A_PART))
    urls = {n: scratch(spark, f"grams-{n}") for n in range(1, order + 1)}
    ends = docs.where(crc_mod("doc_id", 10) != 0).count()

    def send_words(batches):
        for batch in batches:
            for chunk, _, *blobs in zip(*[c.to_pylist() for c in batch.columns]):
                yield _packed(chunk, Chunk(*blobs).word_rows(p))

    stats = [s[0].astype(np.int64) for s in _round(chunks.mapInArrow(send_words, MESSAGE), _count_words(p), urls[1], p)]
    release(spark)
    stats = np.sum([*stats, np.zeros(K + 3, np.int64)], axis=0)
    total, distinct, few = int(stats[0]) + ends, int(stats[1]) + (ends > 0), stats[2:].copy()
    if 0 < ends <= K + 1:
        few[ends - 1] += 1
    uni = Unigrams(few.tolist(), total, distinct, few[:K]) if total else None

    def loaded(chunk, blobs, upto, hot):
        """A chunk with what came back for the orders below ``upto``, and the n-grams of that order."""
        made = Chunk(*blobs)
        made.take_words(_read_blobs(urls[1], chunk), p, ends)
        for n in range(2, upto + 1):
            made.build(n, p, total)
            if n < upto:
                made.take_grams(n, _read_blobs(urls[n], chunk), hot[n])
        return made

    def sender(n, hot):
        def send(batches):
            for batch in batches:
                for chunk, _, *blobs in zip(*[c.to_pylist() for c in batch.columns]):
                    rows, rest = loaded(chunk, blobs, n, hot).gram_rows(n)
                    out = _packed(chunk, rows)
                    del rows  # before the next chunk is loaded
                    yield out
                    yield _packed(-1, [(chunk % p, rest)])

        return send

    ds, hot = {}, {}
    for n in range(2, order + 1) if total else []:
        few, sums = np.zeros(K + 1, np.int64), {}
        # One summary a partition, with two hot contexts in it on average at most.
        for got in _round(chunks.mapInArrow(sender(n, dict(hot)), MESSAGE), _count_grams(n, n == order), urls[n], p):
            few += got[0].astype(np.int64)
            for row in zip(*[x.tolist() for x in got[1:]]):
                key = row[: n - 1]
                sums[key] = sums.get(key, 0) + np.array(row[n - 1 :], np.int64)
        ds[n], hot[n] = discounts(few.tolist()), sums
        release(spark)

    def finish(batches):
        for batch in batches:
            for chunk, doc_ids, *blobs in zip(*[c.to_pylist() for c in batch.columns]):
                made = loaded(chunk, blobs, order if uni else 1, hot)
                if uni:
                    made.take_grams(order, _read_blobs(urls[order], chunk), hot[order])
                c, doc, n = made.count[made.w], made.doc, made.texts
                base = np.log10((made.count + 0.1) / (total + 0.1 * (distinct + 1)))[made.w]
                logp = made.log_probs(uni, ds) if uni else np.zeros(len(c))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(made.is_train == 0),
                        pa.array(np.bincount(doc, minlength=n)),
                        pa.array(np.bincount(doc[c > 0], minlength=n)),
                        pa.array(np.full(n, total)),
                        pa.array(np.bincount(doc, weights=base, minlength=n)),
                        pa.array(np.bincount(doc, weights=logp, minlength=n)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del made, c, doc, base, logp  # before the next chunk is loaded

    return chunks.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _packed(chunk: int, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([pack(*r[1:]) for r in rows], pa.binary())],
        ["chunk", "part", "blob"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
