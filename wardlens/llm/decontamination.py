"""Benchmark decontamination (operator 7): one Aho-Corasick automaton over the normalised benchmark texts.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and non-ASCII characters; a window is 13
consecutive words of an item, or all of a shorter item. Each document is scanned once; hit words are mapped back to
code-point offsets of the original text.

The automaton's keys are an item's blocks of 7 words, one after the other: any 13 consecutive words hold one of them whole. Where
a block occurs, the run of words that agree with the item is followed to both sides, and counts if it has 13 words or more.
So the automaton grows with the benchmark's words, not 13 times as fast: about 0.3 KB a word in a worker. Benchmarks of more than
``MOST_WORDS`` words are refused with an error, not scanned in part. The items go to the shared folder; the driver lists the
files, and a task that can't read one fails. Nothing is shuffled or broadcast.

Edge cases: a null or empty text has no words and no hits; a very long text is a slice of its own and scanned whole; benchmark rows
without words or without an item_id are left out; items that share an item_id count once; repeated documents are judged each for
itself; an empty benchmark hits nothing; columns besides those named, whatever their names, are ignored by the query and passed
through by ``drop_contaminated``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import UPPER, byte_slices, resident, scratch, table, tidied

N = 13
MOST_WORDS = 3_000_000
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULT = "hits struct<n_words:long,n_hit:long,n_items:long,item_ids:array<string>,longest:long,spans:array<struct<start:int,end:int>>>"


def normalise(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def write_items(benchmark: DataFrame) -> list[str]:
    """Normalise the items and write them to the shared folder; the files' addresses."""
    spark = benchmark.sparkSession
    path = scratch(spark, "benchmark")

    def words(batches):
        for b in batches:
            w = [[x.decode("latin-1") for x in normalise(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(x) for x in w], pa.string()), pa.array(list(map(len, w)), pa.int64())], ["item_id", "words", "n"])

    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    items = items.mapInArrow(words, "item_id string, words string, n long").where("n > 0").distinct()
    items.coalesce(8).write.parquet(path)
    back = spark.read.schema(items.schema).parquet(path)
    total = back.agg(F.sum("n")).first()[0] or 0
    if total > MOST_WORDS:
        raise ValueError(f"the benchmark has {total} words, more than {MOST_WORDS}: scan it in parts")
    return sorted(back.inputFiles())


class Windows:
    """The automaton and what its keys stand for."""

    def __init__(self, items: list[tuple[str, list[str]]], n: int):
        import ahocorasick

        self.n, self.items, block = n, items, (n + 1) // 2
        places: dict[str, list] = {}  # key -> (item, first word) of its places
        sizes: dict[str, int] = {}
        for k, (_, w) in enumerate(items):
            step = block if len(w) >= n else len(w)  # a shorter item is one key
            for at in range(0, len(w) - step + 1, step):
                key = f" {' '.join(w[at : at + step])} "
                places.setdefault(key, []).append((k, at))
                sizes[key] = step
        self.auto = ahocorasick.Automaton()
        for key, where in places.items():
            self.auto.add_word(key, (len(key), sizes[key], where))
        if places:
            self.auto.make_automaton()
        else:
            self.auto = None

    def find(self, norm: str) -> tuple[set, list[tuple[int, int]]]:
        """(item_ids, runs of hit words as (first, last + 1)) of a normalised text: words between single spaces."""
        found = list(self.auto.iter(norm)) if self.auto is not None else []
        if not found:
            return set(), []
        words, ids, runs = norm[1:-1].split(" "), set(), []
        spaces = np.cumsum(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
        reached: dict[tuple[int, int], int] = {}  # (item, shift) -> where the last run on it ended
        for end, (chars, size, where) in found:
            first = int(spaces[end + 1 - chars]) - 1
            for k, at in where:
                name, w = self.items[k]
                if len(w) < self.n:
                    ids.add(name)
                    runs.append((first, first + size))
                    continue
                if reached.get((k, first - at), -1) >= first + size:
                    continue
                i, j, a, b = first, first + size, at, at + size
                while i and a and words[i - 1] == w[a - 1]:
                    i, a = i - 1, a - 1
                while j < len(words) and b < len(w) and words[j] == w[b]:
                    j, b = j + 1, b + 1
                reached[k, first - at] = j
                if j - i >= self.n:
                    ids.add(name)
                    runs.append((i, j))
        return ids, runs


def _windows(files: list[str], n: int) -> Windows:
    """The windows of all files; a worker makes them once. A file that isn't there is an error."""

    def make():
        items = []
        for url in files:
            fs, path = pafs.FileSystem.from_uri(url)
            t = pq.read_table(path, filesystem=fs)
            items += zip(t.column("item_id").to_pylist(), [x.split(" ") for x in t.column("words").to_pylist()])
        return Windows(items, n)

    return resident(("automaton", tuple(files), n), make)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", spans: bool = True) -> DataFrame:
    """The rows of ``docs`` with a struct column ``hits``: counts, item_ids, longest run and hit spans in code points."""
    files = write_items(benchmark)
    names = docs.columns
    at = names.index(text)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = StructType([*inner.schema.fields, *StructType.fromDDL(RESULT).fields])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())), ("longest", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        for whole in batches:
            for a, b in byte_slices(whole.column(at), 32_000_000):
                batch, out = whole.slice(a, b - a), []
                for t in batch.column(at).to_pylist():
                    w = normalise(t)
                    ids, runs = _windows(files, n).find((b" %s " % b" ".join(w)).decode("latin-1"))
                    row = {"n_words": len(w), "n_hit": 0, "n_items": len(ids), "item_ids": sorted(ids), "longest": 0, "spans": []}
                    if runs:
                        mark = np.zeros(len(w) + 1, np.int64)
                        for i, j in runs:
                            mark[i] += 1
                            mark[j] -= 1
                        hit = np.cumsum(mark)[:-1] > 0
                        row |= {"n_hit": int(hit.sum()), "longest": max(j - i for i, j in runs)}
                        if spans:
                            row["spans"] = [{"start": s, "end": e} for s, e in _spans(t, hit)]
                    out.append(row)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*[f"c{i}" for i in range(len(names))], "hits"])

    out = inner.mapInArrow(tidied(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "hits")


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) code points of the original text."""
    out: list[tuple[int, int]] = []
    before = False
    for m, h in zip(WORD.finditer(text), hit.tolist()):
        if h and before:
            out[-1] = (out[-1][0], m.end())
        elif h:
            out.append(m.span())
        before = h
    return out


def contaminated(hits: str = "hits") -> Column:
    """At least a twentieth of the words lie in windows of the benchmark."""
    h = F.col(hits)
    return (h["n_hit"] > 0) & (20 * h["n_hit"] >= h["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with no run of 13 benchmark words or more, however long they are, and no twentieth of words in shorter items."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)])
    out = scan(inner, benchmark, text=f"d{names.index('text')}", spans=False).where(~contaminated() & (F.col("hits")["longest"] < N))
    return out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), spans=False)
    h = F.col("hits")
    return out.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        h["n_items"].alias("n_items"),
        F.sha2(F.array_join(h["item_ids"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT item, {N} AS k, array_to_string(list_slice(w, p, p + {N - 1}), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - {N} + 2)) AS p FROM i WHERE len(w) >= {N})
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND {N - 1}),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, p, dw.k, item FROM dw JOIN iw USING (k, win)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM (SELECT DISTINCT r, p, k FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
