"""Problem 10: the language of every document, and of every stretch of a mixed one.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows, then
calibrated by a temperature. A document is cut into sentences and lines; their scores are sums over
words, so a word is scored once and then looked up. Neighbouring units are joined by the cheapest
path through the languages, and runs too short to be a stretch go to the text around them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LANGUAGES = ("en", "fr", "de", "es", "pt", "it", "nl", "am")
#: Labelled rows of each language that are used for training, and characters of each; the only sample taken.
ROWS_PER_LANGUAGE = 250
CHARS_PER_ROW = 1_500
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
MIN_WORDS = 12
SWITCH = 4.0
_CHARS_AT_ONCE = 2_000_000

# Notations of the languages' labels besides the two-letter code.
LABELS = {
    "en": "eng english anglais englisch ingles inglés inglese engels", "fr": "fra fre french francais français französisch franzoesisch", "de": "deu ger german deutsch allemand",
    "es": "spa spanish espanol español castellano spanisch espagnol", "pt": "por portuguese portugues português", "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "am": "amh amharic አማርኛ",
}
_NOTATION = {name: code for code, names in LABELS.items() for name in [code, *names.split()]}

# A few words of each language, so that one without a labelled row is still known.
SEED_WORDS = {
    "en": "the of and to in is was were that with for on as by at from this which are has have had its it be or not an all",
    "fr": "le la les des du de et un une en est a été ont pour dans sur avec que qui ce cette au aux par sans pas plus",
    "de": "der die das den dem des und ein eine einen ist war hat haben wurde mit für auf von zu im am nicht auch nach bei",
    "es": "el la los las de del y un una en es fue ha han para con que por se su sus al lo no como más pero sin sobre",
    "pt": "o a os as de do da dos das e um uma em no na nos foi com que por para se seu sua ao não como mais mas",
    "it": "il lo la i gli le di del della dei delle e un una in è stato ha hanno con che per si suo sua al alla non come più",
    "nl": "de het een en van in is was heeft hebben met voor op te dat die niet ook naar bij uit om zoals over wat",
    "am": "እና ነው ውስጥ ላይ ግን ወደ ይህ ያለ ነበር ሁሉ በዚህ ከ ለ በ የ አዲሱ መሠረት ጋራ በፊት በኋላ",
}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_UNIT = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]+|[.!?;:\u2026][\"'\u00bb\u201d\u2019)\\]]*\\s+|[\u1362\u1364]\\s*")
_FENCE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)")
_TABLE = re.compile(r"(?m)^[ \t]*\|.*$")
_BRACKET = re.compile(r"\([^()\n]{0,60}\d[^()\n]{0,20}\)")
_INITIALS = re.compile(r"\b[^\W\d_]{3,} [^\W\d_]\.(?=[,;\s]|$)")
_TAG = re.compile(r"<[^<>\n]{1,200}>|https?://\S+|\S+@\S+|\[[^\[\]\n]{0,40}\]")


def label_code(label: Column) -> Column:
    """Two-letter code of a language label in any notation; null if it names none of the languages."""
    name = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^[\s\[\(]+|[\s\]\)]+$", ""))
    whole = F.create_map(*[x for k, v in _NOTATION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(whole[name], whole[F.regexp_extract(name, r"^([a-z]{2,3})[-_ ]", 1)])


def blank(text: str) -> str:
    """The text with code, tables, tags, dated brackets and initialled names blanked out, every character in its place."""

    def spaces(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m.group())

    if "```" in text or "~~~" in text:
        text = _FENCE.sub(spaces, text)
    if "|" in text:
        text = _TABLE.sub(spaces, text)
    if "(" in text:
        text = _BRACKET.sub(spaces, text)
    if "<" in text or "@" in text or "[" in text or "://" in text:
        text = _TAG.sub(spaces, text)
    if "., " in text or ".; " in text:
        text = _INITIALS.sub(spaces, text)
    return text


def units_of(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and lines."""
    spans, start = [], 0
    for m in _UNIT.finditer(text):
        if m.end() > start:
            spans.append((start, m.end()))
        start = m.end()
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, number of the word of each), grouped by n; a word is framed by its borders."""
    codes = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            inside = owner[:m] == owner[n - 1 :]
            h = np.full(m, np.uint64(n) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
            for i in range(n):
                h = (h ^ codes[i : i + m]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            if n == 1:  # the borders alone say nothing
                inside = inside & (codes > 3)
            buckets.append((h[inside] & np.uint64(BUCKETS - 1)).astype(np.int64))
            owners.append(owner[:m][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Ftrl:
    """Multinomial logistic regression, follow-the-regularised-leader proximal (McMahan et al., 2013)."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.05):
        self.z = np.zeros((BUCKETS, classes))
        self.n = np.zeros((BUCKETS, classes))
        self.bias = np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, example: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray) -> None:
        """One step over a small batch in coordinate form; ``example`` counts from 0."""
        used, at = np.unique(feature, return_inverse=True)
        w = self.weights(used)
        logits = np.zeros((len(label), w.shape[1]))
        for c in range(w.shape[1]):
            logits[:, c] = np.bincount(example, weights=w[at, c] * value, minlength=len(label))
        p = softmax(logits + self.bias)
        p[np.arange(len(label)), label] -= 1
        self.bias -= 0.05 * p.mean(0)
        for c in range(w.shape[1]):
            g = np.bincount(at, weights=p[example, c] * value, minlength=len(used))
            n = self.n[used, c]
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
            self.z[used, c] += g - sigma * w[:, c]
            self.n[used, c] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    """Weights times inverse document frequency by bucket, bias, temperature and held-out accuracy."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    languages: tuple[str, ...]
    accuracy: float
    nonzero: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row a word: the sum of the weights of its n-grams by language, and their number."""
        bucket, owner = word_grams(words)
        out = np.zeros((len(words), len(self.languages) + 1), dtype=np.float32)
        for c in range(len(self.languages)):
            out[:, c] = np.bincount(owner, weights=self.weights[bucket, c], minlength=len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def log_probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated log-probabilities of texts from the sums over their words' rows."""
        logits = (sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1)) + self.bias) / self.temperature
        logits = logits - logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(example, bucket, term frequency over the root of the length) in coordinate form."""
    words, owner = [], []
    for i, text in enumerate(texts):
        found = _WORD.findall(text.lower())
        words += found
        owner += [i] * len(found)
    bucket, word = word_grams(words)
    example = np.asarray(owner, dtype=np.int64)[word]
    key, count = np.unique(example * BUCKETS + bucket, return_counts=True)
    example, bucket = key // BUCKETS, key % BUCKETS
    total = np.bincount(example, weights=count, minlength=len(texts))
    return example, bucket, count / np.sqrt(np.maximum(total[example], 1)), len(texts)


def train(rows: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, epochs: int = 2, rounds: int = 2, folds: int = 3, seed: int = 7) -> LanguageModel:
    """Fit on (label, text) rows; wrong labels are dropped where a first fit contradicts them."""
    rng = np.random.default_rng(seed)
    texts, labels, held, fold, source = [], [], [], [], []
    for number, (label, text) in enumerate(rows):
        test, part = rng.random() < 0.2, int(rng.integers(folds))
        clean = blank(text[:CHARS_PER_ROW])
        for a, b in units_of(clean):
            if len(_WORD.findall(clean, a, b)) >= 4:
                texts.append(clean[a:b])
                labels.append(languages.index(label))
                held.append(test)
                fold.append(part)
                source.append(number)
    for i, lang in enumerate(languages):
        for _ in range(3):
            texts.append(SEED_WORDS[lang])
            labels.append(i)
            held.append(False)
            fold.append(-1)
            source.append(len(rows) + i)
    label, held, fold, source = np.asarray(labels), np.asarray(held), np.asarray(fold), np.asarray(source)
    example, bucket, value, n = _features(texts)
    df = np.bincount(bucket, minlength=BUCKETS)
    idf = np.log((1 + n) / (1 + df)) + 1
    value = value * idf[bucket]
    starts = np.searchsorted(example, np.arange(n + 1))

    def fit(use: np.ndarray, passes: int) -> Ftrl:
        model = Ftrl(len(languages))
        for _ in range(passes):
            order = rng.permutation(use)
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                sizes = starts[some + 1] - starts[some]
                take = np.repeat(starts[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                model.learn(np.repeat(np.arange(len(some)), sizes), bucket[take], value[take], label[some])
        return model

    def logits(model: Ftrl) -> np.ndarray:
        w = model.weights()
        return np.stack([np.bincount(example, weights=w[bucket, c] * value, minlength=n) for c in range(len(languages))], 1) + model.bias

    # a row whose label the other folds contradict is dropped, and so are its stretches in another language
    agree = np.ones(n, dtype=bool)
    for _ in range(rounds):
        votes = np.zeros((n, len(languages)))
        for part in range(folds):
            votes[fold == part] = np.log(softmax(logits(fit(np.nonzero((fold != part) & agree)[0], 1))) + 1e-6)[fold == part]
        whole = np.stack([np.bincount(source, weights=votes[:, c]) for c in range(len(languages))], 1).argmax(1)
        agree = ((whole[source] == label) & (votes.argmax(1) == label)) | (fold < 0)
    model = fit(np.nonzero(~held & agree)[0], epochs)
    scores = logits(model)
    test = held & agree if (held & agree).any() else agree
    grid = np.geomspace(0.5, 4, 60)
    loss = [-np.log(np.maximum(softmax(scores[test] / t)[np.arange(test.sum()), label[test]], 1e-12)).mean() for t in grid]
    weights = model.weights()
    accuracy = float((scores[test].argmax(1) == label[test]).mean())
    return LanguageModel((weights * idf[:, None]).astype(np.float32), model.bias.copy(), float(grid[int(np.argmin(loss))]), languages, accuracy, float((weights != 0).mean()))


def fit_model(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Train on at most ``rows_per_language`` labelled rows of each language, chosen by a hash of the row."""
    labelled = documents.select(label_code(F.col("lang")).alias("code"), F.substring("text", 1, CHARS_PER_ROW).alias("text"), F.xxhash64("doc_id", "text").alias("h")).filter("code is not null and text is not null")
    picked = labelled.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).filter(F.col("r") <= rows_per_language)
    rows = sorted((r.code, r.text) for r in picked.select("code", "text").collect())  # bounded by the parameters
    return train(rows)


def cheapest_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each unit where a change costs ``switch``."""
    n, k = scores.shape
    back = np.zeros((n, k), dtype=np.int64)
    total = scores[0].copy()
    for i in range(1, n):
        best = int(total.argmax())
        moved = total[best] - switch
        back[i] = np.where(total >= moved, np.arange(k), best)
        total = np.maximum(total, moved) + scores[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(total.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def join_short(path: np.ndarray, words: np.ndarray, scores: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """Runs (language, first unit, end unit) of at least ``least`` words; shorter ones join a neighbour."""
    runs: list[list[int]] = []
    for i, lang in enumerate(path):
        if runs and runs[-1][0] == lang:
            runs[-1][2] = i + 1
            runs[-1][3] += int(words[i])
        else:
            runs.append([int(lang), i, i + 1, int(words[i])])
    while len(runs) > 1:
        at = min(range(len(runs)), key=lambda i: runs[i][3])
        if runs[at][3] >= least:
            break
        around = [i for i in (at - 1, at + 1) if 0 <= i < len(runs)]
        lang, a, b, _ = runs[at]
        into = max(around, key=lambda i: (scores[a:b, runs[i][0]].sum(), runs[i][3]))
        runs[into] = [runs[into][0], min(runs[into][1], a), max(runs[into][2], b), runs[into][3] + runs[at][3]]
        del runs[at]
        at = 1
        while at < len(runs):
            if runs[at][0] == runs[at - 1][0]:
                runs[at - 1][2] = runs[at][2]
                runs[at - 1][3] += runs[at][3]
                del runs[at]
            else:
                at += 1
    return [(r[0], r[1], r[2]) for r in runs]


_SEGMENT = "doc_id long, label string, segment_no int, segments int, lang string, confidence double, start int, end int, words int"


def _segment(model_of) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = model_of.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages) + 1), dtype=np.float32)
        for batch in batches:
            ids, labels, texts = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size < _CHARS_AT_ONCE or to == at):
                    size += len(texts[to])
                    to += 1
                spans, counts, words = [], [], []
                for text in texts[at:to]:
                    lower = blank(text)
                    own = units_of(lower)
                    lower = lower.lower()
                    shifted = len(lower) != len(text)
                    for a, b in own:
                        found = _WORD.findall(blank(text)[a:b].lower()) if shifted else _WORD.findall(lower, a, b)
                        counts.append(len(found))
                        words += found
                    spans.append(own)
                fresh = list({w for w in words if w not in known})
                if len(known) + len(fresh) > 400_000:
                    known, fresh, table = {}, list(set(words)), table[:0]
                if fresh:
                    for w in fresh:
                        known[w] = len(known)
                    table = np.concatenate([table, model.word_scores(fresh)])
                index = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                yield _segment_batch(model, table, index, np.asarray(counts, dtype=np.int64), spans, ids[at:to], labels[at:to])
                at = to

    return run


def _segment_batch(model: LanguageModel, table: np.ndarray, index: np.ndarray, counts: np.ndarray, spans: list, ids: list, labels: list) -> pa.RecordBatch:
    k = len(model.languages)
    sums = np.zeros((len(counts), k + 1))
    some = counts > 0
    if some.any():
        sums[some] = np.add.reduceat(table[index], (np.cumsum(counts) - counts)[some], axis=0)
    logs = model.log_probabilities(sums)
    best = logs.argmax(1)
    rows: tuple[list, ...] = tuple([] for _ in range(9))
    first = 0

    def add(doc: int, label: str | None, runs: list[tuple[int, int, int]], base: int, own: list[tuple[int, int]]) -> None:
        for no, (lang, a, b) in enumerate(runs, 1):
            pooled = model.log_probabilities(sums[base + a : base + b].sum(0, keepdims=True))[0]
            values = (doc, label, no, len(runs), model.languages[lang], float(np.exp(pooled[lang])), own[a][0], own[b - 1][1], int(counts[base + a : base + b].sum()))
            for c, x in zip(rows, values):
                c.append(x)

    for doc, label, own in zip(ids, labels, spans):
        last = first + len(own)
        n = counts[first:last]
        if n.sum():
            clear = best[first:last][n >= 3]
            if len(clear) and (clear == clear[0]).all():
                runs = [(int(clear[0]), 0, len(own))]
            else:
                runs = join_short(cheapest_path(np.where(n[:, None] > 0, logs[first:last], 0.0)), n, logs[first:last])
            if len(runs) == 1:
                pooled = model.log_probabilities(sums[first:last].sum(0, keepdims=True))[0]
                runs = [(int(pooled.argmax()) if n.sum() < MIN_WORDS else runs[0][0], 0, len(own))]
            add(doc, label, runs, first, own)
        first = last
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[c.split()[0] for c in _SEGMENT.split(", ")])


def language_segments(documents: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``(doc_id, label, segment_no, segments, lang, confidence, start, end, words)``: the stretches of every document.

    ``label`` is the document's label as a two-letter code or null. A document with words has at least one
    stretch, however short; null, blank and wordless texts have none. ``start`` and ``end`` are
    character positions.
    """
    spark = documents.sparkSession
    model = model or fit_model(documents)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows of one weight a language
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), label_code(F.col("lang")).alias("label"), "text").filter("doc_id is not null and text is not null")
    return rows.mapInArrow(_segment(shared), _SEGMENT)


def mislabelled(segments: DataFrame) -> DataFrame:
    """``(doc_id, segment_no, lang)`` of documents whose label is missing or wrong, or which have several stretches."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("segments") > 1)
    return segments.filter(wrong).select("doc_id", "segment_no", "lang").distinct()
