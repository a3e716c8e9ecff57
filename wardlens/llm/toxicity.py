"""Toxicity (operator 3): weak supervision.

1. Voters. Seven are built in: a list for each of four languages, two hits of any of them, shouting, and an insult at the reader
   ("you", "du", "tu" next to a listed word). The other eighteen are lexicons of terms that labelled training rows tie to the label
   (log odds with their standard error): one of words, five of words' first 4 to 8 letters, each with one, two and four hits.
2. Label model. A latent two-class model of the voters' patterns is fitted by expectation maximisation: each voter's rate of
   firing in either class (its accuracies, with beta priors), and the correlations that remain given the class, by which the weight of
   voters that repeat each other is shared. The rows' own labels set where it starts and the priors of the voters' rates; no label
   votes, and the posteriors come from the voters alone.
3. Classifier. Logistic regression on the terms, with the label model's posteriors as soft labels; its scores are then calibrated
   (two numbers) on the training rows.

The fit uses at most ``SAMPLE`` labelled rows (those with the least hash of doc_id), so its cost and what is broadcast (at most
``TERMS`` terms with weights) are the same at any size; every text is scored whole, in the task that reads it. What can be
chosen here (``PRIOR``, ``HITS``, ``STEMS``, the thresholds) was chosen by four folds inside the training rows.

Edge cases: a null or empty text has no terms and gets the score of the intercept; a very long text is a slice of its own and
counted whole; ties among terms are broken by kind and spelling, so no order of rows matters; repeated rows get equal scores; labels
of unknown documents are ignored, several labels of one document count as toxic if one is; without labelled rows
the built-in lists alone decide; an empty table gives no rows; other columns are ignored. A null doc_id counts as the
text '' in the fold test.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, crc_mod, split_words, table

SAMPLE, TERMS = 20_000, 4_096
LEAST_DOCS, LEAST_Z, LEAST_LOG_ODDS = 4, 2.5, 2.5
STEMS = (4, 5, 6, 7, 8)
HITS = (1, 2, 4)
PRIOR = 10.0
LEXICONS = [
    "idiot idiots moron morons stupid loser losers pathetic worthless scum trash garbage clown disgusting imbecile dumbass bastard "
    "bitch asshole retard retarded vermin subhuman filth filthy whore slut crap bullshit fuck fucking shit dickhead jerk scumbag",
    "dumm dummkopf idioten trottel arschloch scheiße scheisse abschaum wertlos widerlich versager drecksack hurensohn schlampe",
    "stupide imbécile connard connasse salaud salope merde ordure pathétique dégoûtant minable crétin abruti débile pourriture",
    "estúpido estúpida imbécil basura escoria patético asqueroso perdedor inútil gilipollas cabrón puta mierda payaso tarado",
]
LEXICONS = [frozenset(x.split()) for x in LEXICONS]
LEXICON = frozenset().union(*LEXICONS)
READER = frozenset("you your youre you're u du dich dir dein deine tu toi te ton ta vous tú eres usted".split())
BUILT_IN = len(LEXICONS) + 3
TRIM = ".,;:!?\"'()[]{}<>«»“”‘’…-—*_|"


def term_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words without outer punctuation, their codes in order, the texts' offsets)."""
    flat, off = split_words(texts)
    enc = flat.dictionary_encode()
    words = pc.utf8_lower(pc.utf8_trim(enc.dictionary, TRIM))
    return words, enc.indices.to_numpy() if len(flat) else np.zeros(0, np.int64), off


def kinds(words: pa.Array) -> dict[str, pa.Array]:
    """Each word as a term of every kind; null where it is too short for the stem."""
    out = {"w": words}
    long = pc.utf8_length(words)
    for k in STEMS:
        out[f"s{k}"] = pc.if_else(pc.greater_equal(long, k), pc.utf8_slice_codeunits(words, 0, k), pa.scalar(None, words.type))
    return out


class Terms:
    """Which terms count, and each text's hits of them."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.terms = terms
        self.sets = {k: [(i, t) for i, (kind, t) in enumerate(terms) if kind == k] for k in ("w", *(f"s{k}" for k in STEMS))}

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, term, count), and texts by built-in voters: 1 where one fires."""
        words, codes, off = term_rows(texts)
        n = len(off) - 1
        doc = np.repeat(np.arange(n), np.diff(off))
        keys = []
        by = kinds(words)
        for kind, own in self.sets.items():
            if own and len(words):
                at = pc.fill_null(pc.index_in(by[kind], value_set=pa.array([t for _, t in own], words.type)), -1).to_numpy(zero_copy_only=False)
                at = np.where(np.equal(pc.is_null(by[kind]).to_numpy(zero_copy_only=False), True), -1, at)
                ids = np.append(np.array([i for i, _ in own]), -1)[at][codes]
                keys.append(doc[ids >= 0] * len(self.terms) + ids[ids >= 0])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        keys, count = np.unique(keys, return_counts=True)
        fired = np.zeros((n, BUILT_IN), np.int8)
        among = lambda own: pc.is_in(words, value_set=pa.array(sorted(own), words.type)).to_numpy(zero_copy_only=False)[codes] if len(words) else np.zeros(0, bool)
        listed = np.zeros(len(codes), bool)
        for k, own in enumerate(LEXICONS):
            here = among(own)
            fired[:, k] = np.bincount(doc[here], minlength=n) > 0
            listed |= here
        fired[:, -3] = np.bincount(doc[listed], minlength=n) > 1
        fired[:, -2] = _loud(texts)
        near = among(READER)
        beside = np.flatnonzero((near[1:] & listed[:-1] | near[:-1] & listed[1:]) & (doc[1:] == doc[:-1]))
        fired[doc[beside], -1] = 1
        width = max(1, len(self.terms))
        return np.stack([keys // width, keys % width, count], 1), fired


def _voters(terms: list[tuple[str, str]], doc: np.ndarray, term: np.ndarray, times: np.ndarray, fired: np.ndarray) -> np.ndarray:
    """Texts by voters: the built-in ones, then each kind of term with as many hits as HITS says."""
    kind, out = np.array([k for k, _ in terms]), [fired]
    for k in ("w", *(f"s{k}" for k in STEMS)):
        own = kind[term] == k
        total = np.bincount(doc[own], weights=times[own], minlength=len(fired))
        out += [(total >= least)[:, None] for least in HITS]
    return np.concatenate(out, 1).astype(np.int8)


def calibrated(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the logistic regression of y on z, by Newton's method with a small ridge."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        w -= np.linalg.solve((x * p * (1 - p)) @ x.T + 1e-3 * np.eye(2), x @ (p - y) + 1e-3 * (w - [1, 0]))
    return float(w[0]), float(w[1])


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posteriors of the latent class for each row, and the fitted rates and correlations.

    ``start``: where the class is taken to be 1 at first. It sets the first rates and the class's share; after that only votes count."""
    patterns, which, count = np.unique(np.column_stack([votes, start]), axis=0, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    x, post, c = patterns[:, :-1].astype(float), np.clip(patterns[:, -1].astype(float), 0.02, 0.98), count.astype(float)
    prior = np.clip((c @ post) / c.sum(), 0.001, 0.999)
    # Beta priors of the rates: those of the start, worth PRIOR times the rows, and kept off 0 and 1.
    first = np.stack([c * (1 - post), c * post])
    a, b = PRIOR * (first @ x) + np.array([[0.5], [1.0]]), PRIOR * first.sum(1) + 10
    share = np.ones(x.shape[1])
    rates = corr = None
    for step in range(rounds):
        w1, w0 = c * post, c * (1 - post)
        rates = np.stack([(w0 @ x + a[0]) / (w0.sum() + b[0]), (w1 @ x + a[1]) / (w1.sum() + b[1])])
        if step % 10 == 0:
            corr = np.zeros((x.shape[1], x.shape[1]))
            for r, w in ((rates[0], w0), (rates[1], w1)):
                d = x - r
                s = np.sqrt(np.maximum(w @ (d * d), 1e-9))
                corr += (d.T * w) @ d / np.outer(s, s) * (w.sum() / c.sum())
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.clip(corr, 0, 1).sum(1))
        fires, quiet = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + (x * fires + (1 - x) * quiet) @ share, -30, 30)))
        done, post = step > 20 and np.abs(new - post).max() < 1e-6, new
        if done:
            break
    return post[which], {"rates": rates, "correlations": corr, "share": share}


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, width: int, target: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the intercept) of an L2 logistic regression with soft targets, by accelerated gradient descent."""
    w = np.zeros(width + 1)
    ahead, before = w.copy(), w.copy()
    peak = np.bincount(rows, weights=values**2, minlength=n).max() if len(rows) else 0
    step = 4.0 / (1 + peak)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=values * ahead[cols], minlength=n) + ahead[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.append(np.bincount(cols, weights=values * g[rows], minlength=width) + ridge / n * ahead[:-1] * 0.1, g.sum())
        new = ahead - step * grad
        ahead = new + (t - 1) / (t + 2) * (new - before)
        before = new
    return before


def sample(docs: DataFrame, labels: DataFrame, column: str, fold: int, held: int, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows outside the held-out fold; which ones depends on doc_id alone."""
    y = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    y = y.where(crc_mod("doc_id", fold) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "y")  # at most ``most`` rows


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list, np.ndarray]:
    """(terms, weights): the weights of the terms, of the built-in voters, and the intercept."""
    known = sample(docs, labels, "toxic", 5, 0, SAMPLE)

    def count(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(0), 8_000_000):
                y = batch.column(1).slice(a, b - a).to_numpy()
                words, codes, off = term_rows(batch.column(0).slice(a, b - a))
                n = len(off) - 1
                doc = np.repeat(np.arange(n), np.diff(off))
                for kind, terms in kinds(words).items():
                    enc = pc.fill_null(terms, "").dictionary_encode()
                    at = enc.indices.to_numpy()[codes] if len(words) else np.zeros(0, np.int64)
                    seen = np.unique(doc * max(1, len(enc.dictionary)) + at)
                    d, t = seen // max(1, len(enc.dictionary)), seen % max(1, len(enc.dictionary))
                    pos = np.bincount(t[y[d] == 1], minlength=len(enc.dictionary))
                    every = np.bincount(t, minlength=len(enc.dictionary))
                    keep = every > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * int(keep.sum()), pa.string()), enc.dictionary.filter(pa.array(keep)).cast(pa.string()), pa.array(pos[keep], pa.int64()), pa.array((every - pos)[keep], pa.int64())],
                        ["kind", "term", "pos", "neg"],
                    )

    sizes = known.groupBy("y").count().collect()
    n1 = sum(r["count"] for r in sizes if r.y == 1)
    n0 = sum(r["count"] for r in sizes if r.y == 0)
    terms: list = []
    if n1 and n0:
        found = known.mapInArrow(count, "kind string, term string, pos long, neg long").where("term <> ''").groupBy("kind", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
        z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
        top = found.where(F.col("pos") >= LEAST_DOCS).select("kind", "term", odds.alias("odds"), z.alias("z")).where((F.col("odds") > LEAST_LOG_ODDS) & (F.col("z") > LEAST_Z))
        terms = [(r.kind, r.term) for r in top.orderBy(F.desc("z"), "kind", "term").limit(TERMS).collect()]
    if not terms:
        return [], np.array([3.0] * (BUILT_IN - 2) + [0.0, 3.0, -2.5])
    use = Terms(terms)

    def rows(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(0), 8_000_000):
                hits, fired = use.hits(batch.column(0).slice(a, b - a))
                ends = np.searchsorted(hits[:, 0], np.arange(len(fired) + 1))
                lists = [pa.array([hits[i:j, k].tolist() for i, j in zip(ends[:-1], ends[1:])], pa.list_(pa.int32())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([r.tobytes() for r in fired], pa.binary()), batch.column(1).slice(a, b - a)], ["terms", "times", "fired", "y"])

    got = known.mapInArrow(rows, "terms array<int>, times array<int>, fired binary, y int").toArrow()  # at most SAMPLE rows
    lens = pc.list_value_length(got.column("terms")).to_numpy()
    n = len(lens)
    doc, (term, times) = np.repeat(np.arange(n), lens), (got.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "times"))
    y = got.column("y").to_numpy()
    fired = np.frombuffer(b"".join(got.column("fired").to_pylist()), np.int8).reshape(n, BUILT_IN)
    post, _ = label_model(_voters(terms, doc, term, times, fired), y)
    width = len(terms) + BUILT_IN
    r, c = np.nonzero(fired)
    r, c = np.concatenate([doc, r]), np.concatenate([term, len(terms) + c])
    w = logistic(r, c, np.ones(len(r)), n, width, post)
    slope, shift = calibrated(w[-1] + np.bincount(r, weights=w[c], minlength=n), y)
    w = w * slope
    w[-1] += shift
    return terms, w


def _loud(texts: pa.Array) -> np.ndarray:
    """More than half of the ASCII letters are capitals, of at least 20."""
    texts = pc.fill_null(texts, "")
    upper = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False)
    lower = pc.count_substring_regex(texts, "[a-z]").to_numpy(zero_copy_only=False)
    return (upper > lower) & (upper + lower >= 20)


def score(docs: DataFrame, terms: list, weights: np.ndarray) -> DataFrame:
    """doc_id and score for every row. The model, at most TERMS terms, travels with the task."""
    use = Terms(terms)

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1), 8_000_000):
                texts = batch.column(1).slice(a, b - a)
                hits, fired = use.hits(texts)
                z = weights[-1] + fired @ weights[-1 - BUILT_IN : -1]
                if len(hits):
                    z += np.bincount(hits[:, 0], weights=weights[hits[:, 1]], minlength=len(fired))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms, weights = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, terms, weights)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
