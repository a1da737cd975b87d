"""Language identification of mixed texts: script ranges, word scores and Viterbi decoding.

Words are runs of letters. The script of a word, from fixed code-point ranges, leaves as candidates the languages
that were seen in that script. A word's score for a candidate is the log-probability of its letter trigrams, from
counts of labelled documents. Viterbi decoding over the words of a document, with a penalty for each change of
language, labels spans. The document's language is the one with most letters; its score is the mean probability of
that language over the letters of the text.

The counts come from at most about ``most_docs`` labelled documents (all of them where there are fewer), chosen by
the hash of the id; decoding covers every word of every text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled documents every text
with a letter is ``und`` with score 0; documents without a label are not learned from; ties go to the language whose
name sorts first; ids may be null or repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import hold

BINS = 1 << 16
UND = "und"

#: First code points of runs of one script; fixed values of the character standard, coarse.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFF20, "Latin"), (0xFF60, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x31350, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
NAMES = sorted({n for _, n in SCRIPTS})
_CODES = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points of the first two planes are letters."""
    return np.array([chr(c).isalpha() for c in range(0x20000)], bool)


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """For the words of all texts: document, first letter and end (places among all letters), script; and for each
    letter the bin of the trigram around it."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in low], np.int64)
    letters = _letters()
    is_letter = letters[np.minimum(points, 0x1FFFF)]
    if len(points) and points.max() > 0x1FFFF:
        far = np.flatnonzero(points > 0x1FFFF)
        is_letter[far] = [chr(c).isalpha() for c in points[far]]
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = np.where(is_letter, points, 0)
    mixed = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA6B) + padded[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(is_letter)
    bins = (mixed[at] >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1) if len(at) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(at)) if len(first) else first
    doc = np.searchsorted(np.cumsum(sizes + 1), at[first], side="right")
    script = _CODES[np.searchsorted(_STARTS, points[at[first]], side="right") - 1]
    return doc, first, ends, script, bins


class Model:
    """Log-probabilities of trigram bins and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, least_share: float = 0.01, switch: float = 6.0):
        self.langs, self.switch = langs, switch
        smooth = counts + 0.05
        self.logp = np.ascontiguousarray((np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).T.astype(np.float32)) if langs else np.zeros((BINS, 0), np.float32)
        total = np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = (scripts / total >= least_share).T if langs else np.zeros((len(NAMES), 0), bool)

    def word_scores(self, first: np.ndarray, script: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Relative log-scores; languages that the script rules out are far below, unless it rules out all."""
        scores = np.add.reduceat(self.logp[bins], first, axis=0) if len(first) else np.zeros((0, len(self.langs)), np.float32)
        allowed = self.allowed[script]
        scores[~allowed.any(axis=1)] = 0
        scores = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, scores.min(axis=1, keepdims=True) - 50)
        return scores - scores.max(axis=1, keepdims=True)

    def label(self, doc: np.ndarray, scores: np.ndarray, n_docs: int) -> np.ndarray:
        """The label of each word by Viterbi decoding. All documents go forward together, a word at a time, the
        longest first, so those that have a word at a place are the first ones."""
        n_words = np.bincount(doc, minlength=n_docs)
        rank = np.empty(n_docs, np.int64)
        rank[np.argsort(-n_words, kind="stable")] = np.arange(n_docs)
        longest = int(n_words.max(initial=0))
        active = np.append(n_docs - np.searchsorted(np.sort(n_words), np.arange(longest), side="right"), 0)
        base = np.append(0, np.cumsum(active))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        slot = base[place] + rank[doc]
        s = np.empty_like(scores)
        s[slot] = scores
        came = np.zeros(s.shape, np.int16)
        ends = np.zeros(len(doc), np.int64)
        own = np.arange(len(self.langs))
        v = s[: active[0]]
        for t in range(longest):
            if t:
                best = v.argmax(axis=1)
                top = v[np.arange(len(v)), best][:, None] - self.switch
                came[base[t] : base[t + 1]] = np.where(top > v, best[:, None], own)
                v = np.maximum(v, top) + s[base[t] : base[t + 1]]
            ends[base[t] + active[t + 1] : base[t + 1]] = v[active[t + 1] :].argmax(axis=1)
            v = v[: active[t + 1]]
        out, now = np.zeros(len(doc), np.int64), np.zeros(0, np.int64)
        for t in range(longest - 1, -1, -1):
            before = came[base[t + 1] + np.arange(len(now)), now]
            now = np.concatenate([before, ends[base[t] + len(now) : base[t + 1]]]).astype(np.int64)
            out[base[t] : base[t + 1]] = now
        return out[slot]


def detect(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[str, int]]]]:
    """(language, score, spans as language and number of words) of each text."""
    doc, first, ends, script, bins = words_of(texts)
    if not model.langs or not len(doc):
        return [(UND, 0.0, [])] * len(texts)
    scores = model.word_scores(first, script, bins)
    labels = model.label(doc, scores, len(texts))
    n, letters = len(model.langs), (ends - first).astype(np.float64)
    weight = np.bincount(doc * n + labels, letters, len(texts) * n).reshape(-1, n)
    best = weight.argmax(axis=1)
    chance = np.exp(scores)
    chance /= chance.sum(axis=1, keepdims=True)
    total = np.maximum(1.0, np.bincount(doc, letters, len(texts)))
    score = np.bincount(doc, letters * chance[np.arange(len(doc)), best[doc]], len(texts)) / total
    starts = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    spans: list[list[tuple[str, int]]] = [[] for _ in texts]
    for i, k in zip(starts.tolist(), np.diff(np.append(starts, len(doc))).tolist(), strict=True):
        spans[doc[i]].append((model.langs[labels[i]], k))
    return [(model.langs[b], min(1.0, float(s)), sp) if sp else (UND, 0.0, []) for b, s, sp in zip(best, score, spans, strict=True)]


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` code points, so that no batch grows with long texts more than it must."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_docs: int = 20_000, order: Column | None = None, **params) -> Model:
    """A model of the languages of ``labelled``. order: a hash that picks the rows where there are too many."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.xxhash64(F.col(text_col)) if order is None else order).alias("h"))
    rows = known.select("lang").count()
    if rows > most_docs:
        known = known.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * most_docs / rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for run in _slices([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    _, first, _, script, bins = words_of(run)
                    n, m = np.bincount(bins, minlength=BINS), np.bincount(script, minlength=len(NAMES))
                    key = np.append(np.flatnonzero(n), BINS + np.flatnonzero(m))
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(key), pa.string()), "bin": pa.array(key, pa.int32()), "n": pa.array(np.append(n[n > 0], m[m > 0]), pa.int64())})

    seen = known.select("lang", "text").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(seen["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BINS + len(NAMES)))
    counts[[at[x] for x in seen["lang"].to_pylist()], seen["bin"].to_numpy()] = seen["n"].to_numpy()
    return Model(langs, counts[:, :BINS], counts[:, BINS:], **params)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), spans: bool = True) -> DataFrame:
    """The columns ``keep`` of each document with lang_pred, score and, if asked for, lang_spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bins, whatever the corpus
    fields = [docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())]))))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language_id")
        for b in batches:
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            done = [x for part in _slices(texts) for x in detect(part, shared.value)]
            cols = [*(b.column(i) for i in range(len(keep))), pa.array([x for x, *_ in done], pa.string()), pa.array([s for _, s, _ in done], pa.float64())]
            if spans:
                cols.append(pa.array([[{"lang": x, "words": k} for x, k in sp] for *_, sp in done], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, T.StructType(fields))


def held_out(id_col: str = "doc_id", fold: int = 1, folds: int = 3) -> Column:
    """True for the documents that must not be learned from: crc32 of the id as text leaves ``fold``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
