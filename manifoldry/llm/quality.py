"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic heads, fitted on a bounded sample of labelled rows, give each document the evidence of its own text: one for low quality, over frequencies of word shapes
and words, and one for toxic language, over the presence of words and of their beginnings, which inflected and compound forms share. Grouped sums of this evidence by host and by path then give each site a posterior mean:
a path is shrunk towards its host and a host towards the global prior, the more the fewer documents it has, with prior weights found by the method of moments from
the spread between groups. A document's own evidence is left out of its site's before the two are combined on the log-odds scale.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SEPARATOR, U64, append_columns, bytes_of, cut, slices, splitmix, trim, word_hashes, word_spans

#: Hashed weights of each head; bound of the labelled sample, in whole documents; how many of its documents share a feature that is used, and by how many deviations its label's count stands out.
WEIGHTS = 1 << 18
SAMPLE = 6000
SEEN, SURPRISE = 4, 4.0
ROUNDS, RATE, DECAY = 30, 0.5, 1e-4
#: Bytes of a word's beginnings.
BEGINNINGS = (5, 7)
#: Prior weights stay within these bounds; the site's log-odds count this much.
LEAST, MOST = 2.0, 1e6
SITE = 0.5
#: A document whose toxic evidence reaches this is not kept; toxic documents are rare, so it lies under a half.
TOXIC = 0.35

#: Classes of bytes for a word's shape: letters, capitals, digits, bytes of longer characters, or themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and index of every word and of its beginnings; then row and index of every word's shape. An index is a hashed weight."""
    data, at = bytes_of(column)
    data, at = data[at[0] : at[-1]], at - at[0]
    starts, ends, first = word_spans(data, at)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    # a word's letters alone, so that marks at its ends don't hide it
    letters = np.where(_NO_LETTER[LOWER[data]], np.uint8(32), LOWER[data])
    s2, e2, f2 = word_spans(letters, at)
    of = np.repeat(np.arange(len(n)), np.diff(f2))
    plain, rows = [(word_hashes(letters, s2, e2) >> U64(20)).astype(np.int64) % WEIGHTS], [of]
    for k in BEGINNINGS:
        longer = e2 - s2 > k
        plain.append((splitmix(word_hashes(letters, s2[longer], s2[longer] + k) + U64(k)) >> U64(20)).astype(np.int64) % WEIGHTS)
        rows.append(of[longer])
    shape = _SHAPE[data]
    # runs of a class count once: a byte that repeats the one before it is taken out, with its place
    same = np.zeros(len(shape), dtype=bool)
    same[1:] = (shape[1:] == shape[:-1]) & ~SEPARATOR[data[1:]]
    keep = ~same
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    short = shape[keep]
    kinds = (splitmix(word_hashes(short, place[starts], place[ends]) + U64(1)) >> U64(20)).astype(np.int64) % WEIGHTS
    return np.concatenate(rows), np.concatenate(plain), row, kinds


_NO_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])


class Head:
    """A logistic model over hashed features: shares of a document's features, or their presence."""

    def __init__(self, presence: bool):
        self.presence, self.bias = presence, 0.0
        self.weights = np.zeros(WEIGHTS)

    def design(self, row: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, times = np.unique(row * WEIGHTS + index, return_counts=True)
        row, index = key // WEIGHTS, key % WEIGHTS
        total = np.maximum(np.bincount(row, times, minlength=n), 1)
        return row, index, np.ones(len(key)) if self.presence else 4 * np.sqrt(times / total[row])

    def fit(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, truth: np.ndarray) -> Head:
        n = len(truth)
        # a lexicon: features whose documents differ from the rest by more than chance among so many
        seen = np.bincount(index, minlength=WEIGHTS)
        rate = np.clip(truth.mean(), 1e-3, 1 - 1e-3)
        chance = np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
        use = ((seen >= SEEN) & (np.abs(np.bincount(index, truth[row], minlength=WEIGHTS) - seen * rate) >= SURPRISE * chance))[index]
        row, index, value = row[use], index[use], value[use]
        sums = np.full(WEIGHTS, 1e-8)
        self.bias, b_sum = float(np.log(rate / (1 - rate))), 1e-8
        for _ in range(ROUNDS * 10):
            z = self.bias + np.bincount(row, self.weights[index] * value, minlength=n)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth) / n
            step = np.bincount(index, g[row] * value, minlength=WEIGHTS) + DECAY * self.weights
            sums += step * step
            self.weights -= RATE * step / np.sqrt(sums)
            b_sum += g.sum() ** 2
            self.bias -= RATE * g.sum() / np.sqrt(b_sum)
        return self

    def logits(self, row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        row, index, value = self.design(row, index, n)
        return self.bias + np.bincount(row, self.weights[index] * value, minlength=n)


class Classifier:
    """The two heads; p of a text is the probability that it is neither poor nor toxic."""

    def __init__(self):
        self.poor, self.toxic = Head(False), Head(True)

    def _rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        return *_features(column), len(column)

    def fit(self, texts: pa.Array, poor: np.ndarray, toxic: np.ndarray) -> Classifier:
        parts: dict[bool, list] = {False: [], True: []}
        _, at = bytes_of(texts)
        for lo, hi in slices(at, 1 << 20):
            wr, w, sr, s, n = self._rows(texts.slice(lo, hi - lo))
            for head, row, index in ((self.poor, sr, s), (self.toxic, wr, w)):
                row, index, value = head.design(row, index, n)
                parts[head.presence].append(((row + lo).astype(np.int32), index.astype(np.int32), value.astype(np.float32)))
        for head, truth in ((self.poor, poor), (self.toxic, toxic)):
            head.fit(*(np.concatenate(x) for x in zip(*parts.pop(head.presence))), truth.astype(float))
        return self

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wr, w, sr, s, n = self._rows(column)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return sigmoid(self.poor.logits(sr, s, n)), sigmoid(self.toxic.logits(wr, w, n))


def train_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """docs: ids and texts; labels: doc_id, quality (0 or 1), toxic (0 or 1). None if no text has a label.

    Of the distinct labelled texts the `sample` of least hash are learned from, whole, however long; a text with several labels counts once with each. Ids meet labels first,
    with hashes in place of texts, so a text moves only if it is in the sample; labels without a document, null ids and null texts take no place in it.
    """
    i = F.col(f"`{id_col}`").cast("long").alias("doc_id")
    texts = docs.select(i, F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")).where("doc_id is not null and text is not null")
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("poor"), (F.col("toxic") == 1).alias("toxic")).distinct()
    key = ["h", "poor", "toxic"]
    # told apart before the limit, and each task keeps its least alone
    known = cut(texts.select("doc_id", "h").distinct().join(marked, "doc_id").select(*key).distinct().orderBy(*key).limit(sample), "sample")
    # at most `sample` rows of 10 bytes: a proven bound
    rows = texts.select("text", "h").join(F.broadcast(known), "h").dropDuplicates(key).toArrow().sort_by([(c, "ascending") for c in key])
    if not rows.num_rows:
        return None
    flags = [rows.column(c).to_numpy() for c in ("poor", "toxic")]
    made = Classifier().fit(rows.column("text").combine_chunks(), *flags)
    trim()
    return made


def _weight(between: Column, groups: Column, noise: Column, apart: Column) -> Column:
    """Prior weight by moments, the noise inside groups over the variance of groups' means: between, the groups' sum of squares, is expected to be
    `groups` (their degrees of freedom) times the noise, and `apart` times that variance. Without any sign of such a variance, MOST."""
    variance = (between - groups * noise) / apart
    return F.greatest(F.least(F.when((apart > 0) & (variance > 0), noise / variance).otherwise(MOST), F.lit(MOST)), F.lit(LEAST))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """One row a site: host, path, path_n and path_total, host_n and host_total (counts and sums of p), and the same in all rows: prior, host_weight, path_weight. scored: host, path, p."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("path_n"), F.sum("p").alias("path_total"), F.sum(F.col("p") * F.col("p")).alias("path_squares"))
    hosts = paths.groupBy("host").agg(
        F.sum("path_n").alias("n"), F.sum("path_total").alias("total"), F.sum("path_squares").alias("squares"), F.count(F.lit(1)).cast("double").alias("n_paths"),
        F.sum(F.col("path_total") * F.col("path_total") / F.col("path_n")).alias("explained"), F.sum(F.col("path_n") * F.col("path_n")).alias("path_n_squares"),
    )
    n, of_host = F.col("n"), F.col("total") * F.col("total") / F.col("n")
    # one row of sums; each sum of squares has the degrees of freedom of its level: hosts less one, paths less hosts, documents less paths
    world = hosts.agg(
        F.sum("n").alias("N"), F.sum("total").alias("T"), F.count(F.lit(1)).cast("double").alias("H"), F.sum("n_paths").alias("P"), F.sum("squares").alias("squares"),
        F.sum("explained").alias("by_path"), F.sum(of_host).alias("by_host"), F.sum(n * n).alias("host_n_squares"), F.sum(n - F.col("path_n_squares") / n).alias("paths_apart"),
    )
    N, T, H, P = (F.col(c) for c in "NTHP")
    in_host = F.when(N > H, (F.col("squares") - F.col("by_host")) / (N - H)).otherwise(0.0)
    in_path = F.when(N > P, (F.col("squares") - F.col("by_path")) / (N - P)).otherwise(0.0)
    world = world.select(
        (T / N).alias("prior"),
        _weight(F.col("by_host") - T * T / N, H - 1, in_host, N - F.col("host_n_squares") / N).alias("host_weight"),
        _weight(F.col("by_path") - F.col("by_host"), P - H, in_path, F.col("paths_apart")).alias("path_weight"),
    )
    known = hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total"))
    return paths.drop("path_squares").join(known, "host").join(F.broadcast(world))


QUALITY = "doc_id long, host string, path string, p_poor double, p_toxic double, p double"


def score_quality(docs: DataFrame, classifier: Classifier | None, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_poor, p_toxic, p (own evidence), host_posterior, path_posterior, quality (combined, 0 to 1) and keep (boolean) of every row.

    Null text: no words, judged as an empty text. Texts of any length are judged whole. Null host or path: the group of the empty name. Without a classifier (no labels): p is 0.5 for all
    and all are kept. keep asks for a combined quality of a half and more (a tie at a half stays), and toxic evidence under TOXIC. Repeated rows come back as often, each with the same evidence.
    Other columns are not read. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(column: pa.Array) -> list[pa.Array]:
        _, at = bytes_of(column)
        poor, toxic = [np.zeros(0)], [np.zeros(0)]
        for lo, hi in slices(at, 1 << 20):
            a, b = shared.value.evidence(column.slice(lo, hi - lo)) if shared.value else (np.full(hi - lo, 0.5), np.full(hi - lo, 0.0))
            poor.append(a)
            toxic.append(b)
        poor, toxic = np.concatenate(poor), np.concatenate(toxic)
        return [pa.array(poor), pa.array(toxic), pa.array((1 - poor) * (1 - toxic))]

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("text"))
    scored = cut(append_columns(named, "text", "p_poor double, p_toxic double, p double", run, keep=["doc_id", "host", "path"]), "evidence")
    # a written table: its size is known, and a site that holds a third of all rows is split by the adaptive join where it is too large to be sent
    sites = cut(site_posteriors(scored), "sites")
    joined = scored.join(sites, ["host", "path"])
    clip = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    logit = lambda x: F.log(clip(x) / (1 - clip(x)))
    host_mean = (F.col("host_total") - F.col("p") + F.col("host_weight") * F.col("prior")) / (F.col("host_n") - 1 + F.col("host_weight"))
    path_mean = (F.col("path_total") - F.col("p") + F.col("path_weight") * F.col("host_posterior")) / (F.col("path_n") - 1 + F.col("path_weight"))
    joined = joined.withColumn("host_posterior", host_mean).withColumn("path_posterior", path_mean)
    z = logit(F.col("p")) + SITE * (logit(F.col("path_posterior")) - logit(F.col("prior")))
    joined = joined.withColumn("quality", 1 / (1 + F.exp(-z)))
    keep = (F.col("quality") >= 0.5) & (F.col("p_toxic") < TOXIC)
    return joined.select("doc_id", "p_poor", "p_toxic", "p", "host_posterior", "path_posterior", "quality", keep.alias("keep"))
