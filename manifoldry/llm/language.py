"""Language identification with a linear-chain conditional random field over the words of a text.

Each word has scores from affixes, byte n-grams and a lexicon of word identities, all hashed into one table of weights; learned transitions join
neighbouring words. The field is trained, by the exact gradient of the likelihood, on sequences in which pieces of documents of several languages follow each
other, as in code-switched text.
Forward-backward gives each word's probabilities; a document's language is the one with the largest mean. Blocks of words pass small transfer
matrices to each other, so a text of any length takes bounded memory and few steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, append_columns, bytes_of, cut, slices, splitmix, trim, word_hashes, word_spans

#: Hashed weights of a language, fewer where those of all languages would be more than so many; n-gram lengths; affix lengths.
WEIGHTS, ALL_WEIGHTS = 1 << 18, 1 << 24
GRAMS, AFFIXES = (2, 3, 4), (1, 2, 3, 4)
#: Bounds of the training sample, in whole documents: of each language, and of all (one a language at least).
DOCS, ALL_DOCS = 400, 8000
#: Rounds of training, pieces of text drawn in a round, sequences in a step, step size, and words in a block of the decoder.
ROUNDS, DRAWN, BATCH, RATE, BLOCK = 4, 20_000, 64, 0.3, 64
#: With more languages than this, the transfer matrices of blocks cost more than they save.
FEW = 32
UNKNOWN = "und"

#: ASCII bytes that are no letter part words.
_NO_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the lower-cased words of all rows, and each row's first word."""
    data, at = bytes_of(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    data = np.where(_NO_LETTER[data], np.uint8(32), data)
    return data, *word_spans(data, at)


class Features:
    """Indices into the weights for distinct words: a list of (first position of each word, index at each position)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: int):
        size = ends - starts
        n = len(starts)
        # the words one after another, each between a mark at its start and one at its end
        begin = np.concatenate([[0], np.cumsum(size + 2)])
        text = np.ones(int(begin[-1]) + max(GRAMS), dtype=U64)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(begin[:-1] + 1, size) + inside] = data[np.repeat(starts, size) + inside]
        left = np.repeat(begin[1:], size + 2) - np.arange(int(begin[-1]))
        length = int(begin[-1])
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

        def gram(at: np.ndarray, k: int) -> np.ndarray:
            key = np.zeros(len(at), dtype=U64)
            for i in range(k):
                key = (key << U64(8)) | text[at + i]
            return key

        def slot(key: np.ndarray, kind: int, valid: np.ndarray) -> np.ndarray:
            return np.where(valid, (splitmix(key + U64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(8)).astype(np.int64) % (weights - 1) + 1, 0)

        everywhere = np.arange(length)
        for k in GRAMS:
            self.parts.append((begin[:-1], slot(gram(everywhere, k), k, left >= k)))
        words = np.arange(n)
        for k in AFFIXES:
            self.parts.append((words, slot(gram(begin[:-1] + 1, min(k, max(GRAMS))), 16 + k, size >= k)))
            self.parts.append((words, slot(gram(np.maximum(begin[1:] - 1 - k, 0), min(k, max(GRAMS))), 32 + k, size >= k)))
        self.parts.append((words, slot(word_hashes(text[:length].astype(np.uint8), begin[:-1] + 1, begin[1:] - 1), 64, np.ones(n, dtype=bool))))
        self.n = n
        self.of_position = np.repeat(words, size + 2)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), dtype=np.float32)
        if self.n:
            for first, index in self.parts:
                out += np.add.reduceat(weights[index], first, axis=0) if len(index) > self.n else weights[index]
        return out

    def scatter(self, gradient: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Adds each word's gradient to its weights; returns the touched weights."""
        touched = []
        for _, index in self.parts:
            np.add.at(into, index, gradient[self.of_position] if len(index) > self.n else gradient)
            touched.append(index)
        into[0] = 0
        return np.unique(np.concatenate(touched))


def posteriors(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many rows of words at once: the probability of every language for every word.

    scores: a row of log scores a word; first: each row's first word (n + 1 values). Exact for any length: blocks of words are joined by
    their transfer matrices, and nothing grows with the longest row but the number of its blocks. With many languages a row is one block.
    pairs: also the expected number of transitions between all neighbouring words, a matrix from language to language.
    """
    total, k = scores.shape
    n = np.diff(first)
    length = BLOCK if k <= FEW else max(1, int(n.max(initial=0)))
    blocks = -(-n // length)
    base = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(base[-1])
    if not nb:
        return (np.zeros((0, k)), np.zeros((k, k))) if pairs else np.zeros((0, k))
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(transition - transition.max())
    row = np.repeat(np.arange(len(n)), blocks)
    number = np.arange(nb) - base[row]
    at = first[row] + number * length
    size = np.minimum(length, first[row + 1] - at)
    opening = number == 0
    several = int(blocks.max()) > 1
    m = np.broadcast_to(np.eye(k), (nb if several else 0, k, k)).copy()
    for t in range(int(size.max()) if several else 0):
        on = np.flatnonzero(size > t)
        x = m[on]
        y = (x.reshape(-1, k) @ a).reshape(-1, k, k) if t else np.where(opening[on, None, None], x, (x.reshape(-1, k) @ a).reshape(-1, k, k))
        y *= e[at[on] + t][:, None, :]
        m[on] = y / y.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((nb, k)), np.empty((nb, k))
    now = np.broadcast_to(np.exp(start - start.max()), (len(n), k)).copy()
    for i in range(int(blocks.max())):
        on = np.flatnonzero(blocks > i)
        b = base[on] + i
        enter[b] = now[on]
        if several:
            y = np.einsum("ni,nij->nj", now[on], m[b])
            now[on] = y / y.sum(axis=1, keepdims=True)
    now = np.ones((len(n), k))
    for i in range(int(blocks.max()) - 1, -1, -1):
        on = np.flatnonzero(blocks > i)
        b = base[on] + i
        leave[b] = now[on]
        if several:
            y = np.einsum("nij,nj->ni", m[b], now[on])
            now[on] = y / y.sum(axis=1, keepdims=True)
    forward = np.empty((total, k))
    now = enter
    for t in range(int(size.max())):
        on = np.flatnonzero(size > t)
        y = now[on] @ a if t else np.where(opening[on, None], now[on], now[on] @ a)
        y = y * e[at[on] + t]
        now[on] = y / y.sum(axis=1, keepdims=True)
        forward[at[on] + t] = now[on]
    now = leave
    alpha = forward.copy() if pairs else None
    # of each word: what it says itself times the message from behind it
    behind = np.empty((total, k)) if pairs else None
    for t in range(int(size.max()) - 1, -1, -1):
        on = np.flatnonzero(size > t)
        w = at[on] + t
        forward[w] *= now[on]
        said = now[on] * e[w]
        if pairs:
            behind[w] = said
        y = said @ a.T
        now[on] = y / y.sum(axis=1, keepdims=True)
    marginal = forward / forward.sum(axis=1, keepdims=True)
    if not pairs:
        return marginal
    inner = np.ones(total, dtype=bool)
    inner[first[:-1][n > 0]] = False
    t = np.flatnonzero(inner)
    # alpha before, the transition, and what comes from the word and from behind it, normalised pair by pair
    z = np.einsum("ni,ij,nj->n", alpha[t - 1], a, behind[t])
    return marginal, a * ((alpha[t - 1] / z[:, None]).T @ behind[t])


class Field:
    """A trained field: languages (in order of their names), feature weights, transitions and start scores."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.weights = np.zeros((min(WEIGHTS, max(1 << 10, ALL_WEIGHTS // max(k, 1))), k), dtype=np.float32)
        self.transition, self.start = np.zeros((k, k)), np.zeros(k)

    def train(self, texts: list[tuple[str, str]], seed: int = 3) -> Field:
        """texts: (language, whole text). Maximises the likelihood of mixed sequences by AdaGrad; their pieces are drawn anywhere in the texts."""
        index = {x: i for i, x in enumerate(self.languages)}
        rng = np.random.default_rng(seed)
        data, starts, ends, first = _words(pa.array([t for _, t in texts], pa.large_string()))
        k = len(self.languages)
        # where the words of each language lie, as runs: its texts one after another
        of = np.array([index[x] for x, _ in texts], dtype=np.int64)
        runs = [(first[:-1][of == c], np.concatenate([[0], np.cumsum(np.diff(first)[of == c])])) for c in range(k)]
        known = [c for c in range(k) if runs[c][1][-1]]
        if not known:
            return self
        sums, step_t, step_s = np.full_like(self.weights, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
        each = max(50, DRAWN // len(known))
        for _ in range(ROUNDS):
            # pieces of a few to 24 words, as many of each language, strung together by one to four
            pieces = []
            for c in known:
                heads, place = runs[c]
                word = rng.integers(0, place[-1], each)
                text = np.searchsorted(place, word, side="right") - 1
                lo = heads[text] + word - place[text]
                hi = np.minimum(lo + rng.integers(4, 24, each), heads[text] + place[text + 1] - place[text])
                pieces.append(np.stack([lo, hi, np.full(each, c)], axis=1))
            drawn = rng.permutation(np.concatenate(pieces))
            cuts = np.cumsum(rng.integers(1, 5, len(drawn)))
            strings = np.split(drawn, cuts[cuts < len(drawn)])
            for i in range(0, len(strings), BATCH):
                batch = strings[i : i + BATCH]
                p = np.concatenate(batch)
                size = p[:, 1] - p[:, 0]
                word = np.repeat(p[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                truth = np.repeat(p[:, 2], size)
                ends_of = np.cumsum([len(x) for x in batch])
                heads = np.concatenate([[0], np.cumsum(size)[ends_of - 1]])
                f = Features(data, starts[word], ends[word], len(self.weights))
                g, g_t, g_s = self.gradient(f.scores(self.weights).astype(np.float64), heads, truth)
                into = np.zeros_like(self.weights)
                touched = f.scatter(g.astype(np.float32) / len(batch), into)
                g = into[touched]
                sums[touched] += g * g
                self.weights[touched] += RATE * g / np.sqrt(sums[touched] + 1e-4)
                g_t, g_s = g_t / len(batch), g_s / len(batch)
                step_t += g_t * g_t
                step_s += g_s * g_s
                self.transition += RATE * g_t / np.sqrt(step_t + 1e-4)
                self.start += RATE * g_s / np.sqrt(step_s + 1e-4)
        return self

    def gradient(self, scores: np.ndarray, heads: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log likelihood of the true languages of rows of words, by scores, transitions and start: true counts less expected ones."""
        p, expected = posteriors(scores, heads, self.transition, self.start, pairs=True)
        g = -p
        g[np.arange(len(truth)), truth] += 1
        inner = np.ones(len(truth), dtype=bool)
        inner[heads[:-1]] = False
        t = np.flatnonzero(inner)
        g_t = -expected
        np.add.at(g_t, (truth[t - 1], truth[t]), 1)
        return g, g_t, g[heads[:-1]].sum(axis=0)

    def label(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of every row: the language, its mean probability, that of the next language, and the number of words."""
        data, starts, ends, first = _words(column)
        n = np.diff(first)
        k = len(self.languages)
        if len(starts):
            _, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            scores = Features(data, starts[at], ends[at], len(self.weights)).scores(self.weights)[which]
            p = posteriors(scores, first, self.transition, self.start)
            sums = np.concatenate([np.zeros((1, k)), np.cumsum(p, axis=0)])
            mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)[:, None]
        else:
            mean = np.zeros((len(n), k))
        best = mean.argmax(axis=1)
        row = np.arange(len(n))
        score = np.clip(mean[row, best], 0, 1)
        rest = mean.copy()
        rest[row, best] = 0
        names = np.array(self.languages, dtype=object)[best]
        # words without an ASCII letter may hold no letter at all
        ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        _, offsets = bytes_of(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
        for i in np.flatnonzero(ascii_letter[offsets[1:]] == ascii_letter[offsets[:-1]]).tolist():
            if not any(map(str.isalpha, column[i].as_py() or "")):
                names[i], score[i], rest[i], n[i] = UNKNOWN, 0.0, 0.0, 0
        return names.tolist(), score, rest.max(axis=1, initial=0), n


def training_texts(labelled: DataFrame, docs: int = DOCS, total: int = ALL_DOCS) -> list[tuple[str, str]]:
    """A bounded sample of labelled whole texts (columns text, lang): of each language the `docs` distinct texts of least hash, fewer with so many languages that this makes over `total`.

    Texts are told apart before they are counted, so a language of few texts that repeat has all of them in the sample. How many a language has sets a hash below which half
    as many again as are wanted lie, far more than chance can take away; those alone are ranked, so a frequent language is counted but never gathered.
    """
    marked = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    seen = cut(marked.select("lang", "h").distinct(), "seen")
    # a row a language, in written tables: their size is known, and decides how they are joined
    counts = cut(seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = max(1, min(docs, total // max(1, counts.count())))
    some = 1.5 * each + 40
    limits = counts.select("lang", F.when(F.col("n") <= some, F.lit((1 << 63) - 1)).otherwise((F.lit(some) / F.col("n") * 2.0**64 - 2.0**63).cast("long")).alias("most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = cut(seen.join(limits, "lang").where("h <= most").withColumn("r", rank).where(F.col("r") <= each).select("lang", "h"), "sample")
    picked = marked.join(least, ["lang", "h"]).dropDuplicates(["lang", "h"])
    return sorted((r.lang, r.text) for r in picked.select("lang", "text").collect())


def train_field(labelled: DataFrame, docs: int = DOCS) -> Field:
    texts = training_texts(labelled, docs)
    field = Field(sorted({x for x, _ in texts})).train(texts)
    trim()
    return field


LABELS = "lang_pred string, score double, second_score double, n_words long"


def identify(docs: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (its mean word probability, 0 to 1), second_score (of the next language) and n_words, from the whole text alone.

    Null texts and texts without a letter: lang_pred "und", score 0. Of languages of equal mean probability, the first by name. Texts of any length are read whole, in blocks.
    Repeated rows are labelled alike. Other columns are kept (or those in keep); those with the new names are replaced. A field of no language (nothing to learn from): "und" for all.
    Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(column: pa.Array) -> list[pa.Array]:
        field, got = shared.value, []
        if not field.languages:
            n = len(column)
            return [pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([0.0] * n), pa.array([0] * n, pa.int64())]
        _, at = bytes_of(column)
        # a word has a number for each language, and with few of them a block has one for each pair
        for lo, hi in slices(at, max(1 << 12, (1 << 21) // max(4, len(field.languages)))):
            got.append(field.label(column.slice(lo, hi - lo)))
        names, *numbers = zip(*got) if got else ((), (), (), ())
        kinds = (pa.float64(), pa.float64(), pa.int64())
        return [pa.array([x for part in names for x in part], pa.string()), *(pa.array(np.concatenate(x) if x else [], t) for x, t in zip(numbers, kinds))]

    return append_columns(docs, text_col, LABELS, run, keep)
