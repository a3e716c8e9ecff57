"""MinHash near-dedup (operator 10): circulant signatures, banding, exact verification, connected components.

1. Sketch. A document's set of word shingles (64-bit hashes) is digested as a whole (128 bits), and its signature is
   made of two permutations of a universe of ``2**BITS``: the first, sigma, places a shingle; coordinate k is the least value
   of the second, pi, shifted by k, over the set. A shingle's values for all coordinates are one run of pi, so a signature is
   a column-wise minimum of runs.
2. Equal sets fall together by digest; the least doc_id stands for them from there on.
3. Bands of the signature name buckets. In a bucket every document is paired with the least one only; each document's first
   such partner is verified, and components of the links are taken. After that only buckets whose documents are in different
   components are left. Their documents are brought together with their texts, once a bucket instead of once a pair, and
   common shingles of all pairs are counted at once, as a matrix product; only links that join components are returned. So no
   link between different components is missed that banding finds. A bucket of more than ``BLOCK`` shingles is dealt out in
   blocks, and each two blocks are compared by themselves.
4. Links are verified on full sets, recomputed from the texts. The texts of candidates, which a bitmap of fixed size picks
   out of the scan, are written once.

Nothing is collected but counts. Hot buckets, digests and ids are combined before shuffles or split by adaptive joins.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words than a
shingle make one shingle; rows that share a doc_id are one node, whatever their texts, and each row is returned with its own set's size;
ties go to the least doc_id; very long texts are a slice of their own and used whole; a null doc_id is never linked,
has a null component and is kept; an empty table gives no rows; columns besides those named are ignored by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, byte_slices, hash64, mix64, parts, resident, split_words, table, tidied, written
from .components import components
from .encoding import _runs

BITS = 22
BITMAP = 24
ROWS = 5
BLOCK = 2_000_000


def _permutations(coordinates: int):
    """(sigma, runs of pi): the same in every worker."""

    def make():
        rng = np.random.default_rng(20250101)
        sigma = rng.permutation(1 << BITS).astype(np.uint32)
        pi = rng.permutation(1 << BITS).astype(np.uint32)
        pi = np.concatenate([pi, pi[:coordinates]])
        return sigma, np.lib.stride_tricks.sliding_window_view(pi, coordinates)

    return resident(("permutations", coordinates), make)


def shingle_sets(texts: pa.Array, size: int):
    """Yields each text's set as sorted distinct 64-bit hashes."""
    flat, off = split_words(texts)
    enc = flat.dictionary_encode()
    words = hash64(enc.dictionary)[enc.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    n = np.diff(off)
    acc = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        acc = mix64(acc * np.uint64(31) + words[j : j + len(acc)])
    count = np.maximum(n - size + 1, 0)
    hashes = acc[_runs(off[:-1], count)]
    ends = np.concatenate([[0], np.cumsum(count)])
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if b > a:
            yield np.unique(hashes[a:b])
        elif n[i]:
            whole = np.uint64(int(n[i]))
            for w in words[off[i] : off[i + 1]]:
                whole = mix64(np.array([whole * np.uint64(31) + w]))[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    sigma, runs = _permutations(coordinates)
    at = sigma[(s >> np.uint64(64 - BITS)).astype(np.int64)]
    out = runs[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        np.minimum(out, runs[at[i : i + 4096]].min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), bands (bucket names)."""

    def run(batches):
        for whole in batches:
            for a, b in byte_slices(whole.column(1), 4_000_000):
                counts, digests, sigs, full = [], [], [], []
                with np.errstate(over="ignore"):
                    for i, s in enumerate(shingle_sets(whole.column(1).slice(a, b - a), size)):
                        counts.append(len(s))
                        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                        if len(s):
                            full.append(i)
                            sigs.append(signature(s, bands * ROWS))
                    keys = np.zeros((len(full), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    if full:
                        sig = np.stack(sigs).reshape(len(full), bands, ROWS).astype(np.uint64)
                        for r in range(ROWS):
                            keys = mix64(keys * np.uint64(31) + sig[:, :, r])
                off = np.zeros(len(counts) + 1, np.int32)
                off[np.array(full, np.int64) + 1] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(off).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with a column ``maybe``: false only if their doc_id is not among ``ids``.

    A bitmap of 2**BITMAP bits, in at most 2**(BITMAP - 6) rows, is broadcast. Its size doesn't follow the data; when it fills
    up, more rows are true, and the joins that follow still decide."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP))
    bits = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits"))
    out = docs.withColumn("h", h).withColumn("word", F.shiftright("h", 6)).join(F.broadcast(bits), "word", "left")
    return out.select(*docs.columns, F.expr("coalesce(bits & shiftleft(1L, cast(h & 63 AS int)), 0L) <> 0").alias("maybe"))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last: tuple = (None, None)
        for whole in batches:
            for i, j in byte_slices(whole.column(3), 4_000_000):
                part = whole.slice(i, j - i)
                left, right = part.column(2), part.column(3)
                ok = []
                with np.errstate(over="ignore"):
                    for row, s in enumerate(shingle_sets(right, size)):
                        key = left[row].as_py()
                        if last[0] != key:  # rows of one a mostly come together
                            last = (key, next(shingle_sets(pa.array([key], pa.string()), size)))
                        both = len(np.intersect1d(s, last[1], assume_unique=True))
                        ok.append(100 * both >= percent * (len(s) + len(last[1]) - both) and both > 0)
                part = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

    return both.mapInArrow(tidied(run), "a long, b long").distinct()


def _common(rows: np.ndarray, dense: np.ndarray, doc: np.ndarray, col: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each of ``rows`` has in common with each of ``n`` documents: frequent shingles are columns of ``dense``, of
    the others the documents ``doc`` stand by shingle ``col``, each from ``starts`` on."""
    out = np.zeros((len(rows), n))
    width = max(16, min(512, 4_000_000 // n))
    for c in range(0, dense.shape[1], width):
        part = dense[:, c : c + width].astype(np.float32)
        out += part[rows] @ part.T
    at = np.full(n, -1)
    at[rows] = np.arange(len(rows))
    own = np.flatnonzero(at[doc] >= 0)
    many = np.diff(starts)[col[own]]
    cuts = np.append(np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), 2_000_000)), len(own))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        e, m = own[i:j], many[i:j]
        out += np.bincount(np.repeat(at[doc[e]], m) * n + doc[_runs(starts[col[e]], m)], minlength=out.size).reshape(out.shape)
    return out


def joining(sets: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) with 100 * intersection >= percent * union that join components, given as ``roots``, as all such links do."""
    n, size = len(sets), np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), size)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    for _ in range(3):  # who has too few shingles that any other has is linked with nothing
        freq = np.bincount(col)
        shared = freq[col] > 1
        stay = 100 * np.bincount(doc[shared], minlength=n) >= percent * size
        keep = shared & stay[doc]
        if keep.all():
            break
        doc, col = doc[keep], col[keep]
    if not len(doc):
        return []
    here, doc = np.unique(doc, return_inverse=True)
    size, label, n = size[here], np.unique(roots[here], return_inverse=True)[1], len(here)
    freq = np.bincount(col)
    often = freq * 8 > n
    number = np.cumsum(often) - 1
    dense = np.zeros((n, int(often.sum())), np.uint8)
    frequent = often[col]
    dense[doc[frequent], number[col[frequent]]] = 1
    doc, col = doc[~frequent], col[~frequent]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    starts = np.searchsorted(col, np.arange(len(freq) + 1))
    out, most = [], np.bincount(label).argmax()
    others = np.flatnonzero(label != most)  # of two components, one isn't the largest
    step = max(1, 4_000_000 // n)
    for k in range(0, len(others), step):
        rows = others[k : k + step]
        both = _common(rows, dense, doc, col, starts, n)
        linked = (both > 0) & ((100 + percent) * both.astype(np.int64) >= percent * (size[rows][:, None] + size[None, :]))
        while True:
            new = linked & (label[rows][:, None] != label[None, :])
            found = np.flatnonzero(new.any(1))
            if not len(found):
                break
            for r, c in zip(rows[found].tolist(), new[found].argmax(1).tolist()):
                if label[r] != label[c]:
                    out.append((int(here[r]), int(here[c])))
                    label[label == label[r]] = label[c]
    return out


def joined(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b), a < b, that join the components of each bucket's ``members`` (key, doc_id, n_shingles, root)."""
    blocks = members.groupBy("key").agg(F.ceil(F.sum(F.col("n_shingles") + 100) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("block", F.expr("pmod(xxhash64(doc_id), blocks)"))
    dealt = dealt.withColumn("with", F.explode(F.expr("if(blocks = 1, array(0L), filter(sequence(0L, blocks - 1L), x -> x <> block))")))
    dealt = dealt.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "doc_id", "root")
    group = ["key", "lo", "hi"]
    rows = dealt.join(texts, "doc_id").select(*group, "doc_id", "root", "text").repartition(parts(members.sparkSession), *group).sortWithinPartitions(*group)

    def run(batches):
        now, ids, roots, sets = None, [], [], []

        def close():
            links = joining(sets, np.array(roots), percent) if len(set(roots)) > 1 else []
            pairs = sorted({(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in links})
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for whole in batches:
            for i, j in byte_slices(whole.column(5), 4_000_000):
                part = whole.slice(i, j - i)
                keys = zip(*[part.column(k).to_pylist() for k in range(3)])
                with np.errstate(over="ignore"):
                    for key, doc_id, root, s in zip(keys, part.column(3).to_pylist(), part.column(4).to_pylist(), shingle_sets(part.column(5), size)):
                        if key != now:
                            if len(ids) > 1:
                                yield close()
                            now, ids, roots, sets = key, [], [], []
                        ids.append(doc_id)
                        roots.append(root)
                        sets.append(s)
        if len(ids) > 1:
            yield close()

    return rows.mapInArrow(tidied(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 30) -> DataFrame:
    """doc_id, n_shingles, digest, component_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = written(sketches(docs, size, bands), "sketches")
    known = sk.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # Repeated rows are combined before the shuffle; both keys together spread a digest that many doc_ids have.
    reps = known.dropDuplicates(["doc_id", "digest"]).join(classes.select("digest", F.col("rep").alias("doc_id")), ["doc_id", "digest"], "left_semi")
    buckets = reps.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("other")).where("leader <> other")
    buckets = written(buckets.join(sizes.select("key", "leader"), "key"), "buckets")
    texts = marked(docs, buckets.select("doc_id").distinct()).where("maybe").select("doc_id", "text")
    texts = written(texts.dropDuplicates(["doc_id", "text"]), "candidates")
    # A doc_id whose rows have different sets is one node all the same: its classes are linked.
    several = written(known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id"), "several")
    own = known.join(several, "doc_id").join(classes, "digest").select("doc_id", "rep").distinct()
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    tied = written(own.join(least, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct(), "tied")
    # First every document with the least of its buckets' leaders: most near copies end in one component with it.
    first = buckets.where("leader < doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    links = written(verified(first, texts, size, percent).unionByName(tied).distinct(), "links1")
    roots = components(links)
    tagged = buckets.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = tagged.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = written(tagged.join(mixed, "key").select("key", "doc_id", "n_shingles", "root"), "mixed")
    more = written(joined(open_, texts, size, percent), "links2")
    roots = components(links.unionByName(more).distinct())
    out = sk.join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", "digest", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 30) -> DataFrame:
    """One document of each component, with its own columns; of rows with equal doc_id and text one stays.

    Only rows that a bitmap of the doc_ids in question lets through are shuffled; the rest are passed on where they are."""
    names = docs.columns
    inner = docs.select(F.col("doc_id"), F.col("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in ("doc_id", "text")])
    found = near_duplicates(inner.select("doc_id", "text"), size, percent, bands)
    found = written(found.where("doc_id IS NOT NULL").select("doc_id", "component_id"), "found")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    flagged = marked(inner, gone.unionByName(again))
    clear = flagged.where("NOT maybe OR doc_id IS NULL").drop("maybe")
    asked = flagged.where("maybe AND doc_id IS NOT NULL").drop("maybe")
    out = clear.unionByName(asked.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]))
    return out.select(*[F.col(c if c in ("doc_id", "text") else f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85, bands=20)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def sql(size: int = 3, percent: int = 85) -> str:
    """DuckDB SQL of ``query``: every pair that shares a shingle is compared on whole sets; labels spread along the links."""
    return f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT r, doc_id, x FROM (
    SELECT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(list_slice(w, i, i + {size - 1}), ' ')) END) AS x FROM w)),
sz AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS h FROM sh GROUP BY r),
cl AS (SELECT h, min(r) AS r, min(n) AS n FROM sz WHERE doc_id IS NOT NULL GROUP BY h),
cs AS (SELECT cl.r, cl.n, sh.x FROM cl JOIN sh USING (r)),
pr AS (
  SELECT a.r AS a, b.r AS b FROM cs a JOIN cs b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
nd AS (SELECT DISTINCT 'c' || cl.r AS c, 'd' || sz.doc_id AS d FROM sz JOIN cl USING (h) WHERE doc_id IS NOT NULL),
ed AS MATERIALIZED (SELECT 'c' || a AS a, 'c' || b AS b FROM pr UNION SELECT 'c' || b, 'c' || a FROM pr UNION SELECT c, d FROM nd UNION SELECT d, c FROM nd),
rc AS (SELECT DISTINCT c AS s, c AS t FROM nd UNION SELECT rc.s, ed.b FROM rc JOIN ed ON rc.t = ed.a),
lo AS (SELECT s, min(CAST(substr(t, 2) AS BIGINT)) AS root FROM rc WHERE t LIKE 'd%' GROUP BY s),
co AS (SELECT sz.r, root FROM sz JOIN cl USING (h) JOIN lo ON lo.s = 'c' || cl.r WHERE doc_id IS NOT NULL)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(w.doc_id = coalesce(root, w.doc_id), true) AS kept
FROM w LEFT JOIN (SELECT r, n FROM sz) z ON z.r = w.r LEFT JOIN co ON co.r = w.r"""
