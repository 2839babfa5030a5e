"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of the code a binary n-gram
classifier tells the languages with a 1 from those with a 0.  The classifiers
are multinomial log-odds over hashed byte trigrams of the lower-cased text,
every language weighing the same on its side.  Decoding adds, over the bits,
the logistic loss of the classifier's margin against a codeword's bit, weighted
by how well the bit's two sides are apart, and takes the codeword with the
least loss.  A document whose bits agree with no codeword better than with
another, or whose runner-up is almost as likely, is flagged as ambiguous.

Training reads at most about ``train_docs`` labelled documents (a stated bound;
chosen by a hash of the id, evenly over languages), and what reaches the driver
is one count for each language and trigram bucket.  Prediction reads the whole
text of every document; language, source and id are no inputs.

Defined results: null text, or text without a letter, is ``und`` with score 0;
with no labelled row everything is ``und``; with one language everything else
is that language with score 1; null ids count as held out; repeated rows get
equal predictions; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import documents

BUCKETS = 1 << 16
TRAIN_DOCS = 20_000
MOST_LANGUAGES = 4096
FOLDS = 5
UNKNOWN = "und"
AMBIGUOUS_BELOW = 0.6
_CHUNK = 1 << 20


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 0


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


# ----------------------------------------------------------------- trigrams


def hashed_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram that begins at each byte, first and end of each text's trigrams)."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    key = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    bucket = (key * np.uint32(2654435761)) >> np.uint32(16)
    ends = np.cumsum(sizes)
    return bucket, ends - sizes, ends - 2


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a megabyte."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _count(batches: Iterator[pa.RecordBatch], languages: dict[str, int]):
    counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
    for batch in batches:
        langs = np.array([languages[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
        for n in range(0, batch.num_rows, 512):
            texts = batch.column("text").slice(n, 512).to_pylist()
            for a, z in _grouped(texts):
                bucket, first, end = hashed_trigrams(texts[a:z])
                for lang, s, e in zip(langs[n + a : n + z], first, end, strict=True):
                    found, n_found = np.unique(bucket[s:e], return_counts=True)
                    counts[lang, found] += n_found
    lang, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])],
        names=["lang", "bucket", "n"],
    )


# -------------------------------------------------------------------- codes


def codewords(k: int) -> np.ndarray:
    """k codewords (rows of 0 and 1), far apart: all splits for few languages, else the best of random codes."""
    if k < 2:
        return np.zeros((k, 0), dtype=np.int8)
    if k <= 5:
        splits = [[(s >> j) & 1 for j in range(k)] for s in range(1, 1 << (k - 1))]
        return np.array(splits, dtype=np.int8).T
    bits, rng, best, best_distance = int(np.ceil(10 * np.log2(k))), np.random.default_rng(7), None, -1
    for _ in range(50 if k <= 64 else 4):
        code = rng.integers(0, 2, (k, bits), dtype=np.int8)
        code[0, code.sum(axis=0) == 0] = 1
        code[0, code.sum(axis=0) == k] = 0
        signs = 2.0 * code - 1
        agree = signs @ signs.T
        np.fill_diagonal(agree, -bits)
        if (distance := bits - agree.max()) > best_distance:
            best, best_distance = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, 0 or 1
    weights: np.ndarray  # bits x buckets: log-odds of a trigram
    importance: np.ndarray  # of a bit in decoding


def fit(counts: np.ndarray, languages: list[str], smoothing: float = 0.5) -> Model:
    code = codewords(len(languages))
    share = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])
    weights, apart = [], []
    for bit in code.T:
        one, zero = share[bit == 1].mean(axis=0), share[bit == 0].mean(axis=0)
        log_odds = np.log(one) - np.log(zero)
        weights.append(log_odds)
        apart.append(((one - zero) * log_odds).sum())
    importance = np.array(apart) / max(1e-12, np.sum(apart)) if apart else np.zeros(0)
    return Model(languages, code, np.array(weights, dtype=np.float32).reshape(code.shape[1], counts.shape[1]), importance)


def decode(model: Model, sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, ambiguous) from the summed log-odds (texts x bits) of texts with so many trigrams."""
    margins = sums / np.sqrt(np.maximum(sizes, 1))[:, None]
    signs = 2.0 * model.code - 1
    loss = np.zeros((len(sums), len(model.languages)))
    for j, signed in enumerate(signs):
        loss[:, j] = (np.logaddexp(0, -margins * signed) * model.importance).sum(axis=1)
    likely = np.exp(-signs.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    best = likely.argmax(axis=1)
    score = likely[np.arange(len(best)), best]
    bits = (margins > 0).astype(np.int8)
    distance = (bits[:, None, :] != model.code[None, :, :]).sum(axis=2)
    nearest = np.sort(distance, axis=1)
    tied = nearest[:, 0] == nearest[:, 1] if nearest.shape[1] > 1 else np.zeros(len(best), dtype=bool)
    return best, score, tied | (score < AMBIGUOUS_BELOW)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    names, scores, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model.languages else []
    if len(model.languages) == 1:
        for k in known:
            names[k], scores[k] = model.languages[0], 1.0
        return names, scores, ambiguous
    for a, z in _grouped([texts[k] for k in known]):
        rows = known[a:z]
        bucket, first, end = hashed_trigrams([texts[k] for k in rows])
        edges = np.stack([first, end], axis=1).ravel()
        edges[-1] = min(edges[-1], len(bucket))
        tail = np.append(bucket, np.uint32(0))  # so that the last end is a place, too
        sums = np.stack([np.add.reduceat(w[tail], edges)[::2] for w in model.weights], axis=1).astype(np.float64)
        best, score, doubt = decode(model, sums, end - first)
        for k, lang in zip(rows, best, strict=True):
            names[k] = model.languages[lang]
        scores[rows], ambiguous[rows] = score, doubt
    return names, scores, ambiguous


# ---------------------------------------------------------------- operators


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled documents that aren't held out; see the module's text for the bound."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(per) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(per)
    if len(languages) < 2:
        return fit(np.zeros((len(languages), BUCKETS)), languages)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, train_docs / len(languages) / per[k]))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter((draw < share[F.col("lang")]) & F.col("text").isNotNull()).select("text", "lang")
    count = functools.partial(_count, languages={k: i for i, k in enumerate(languages)})
    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return fit(counts, languages)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def batches(source: Iterator[pa.RecordBatch]):
        for batch in source:
            for n in range(0, batch.num_rows, 512):
                part = batch.slice(n, 512)
                lang, score, doubt = predict(shared.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)],
                    names=[*names, "_factloom_lang_pred", "_factloom_lang_score", "_factloom_lang_ambiguous"],
                )

    added = [T.StructField("_factloom_lang_pred", T.StringType()), T.StructField("_factloom_lang_score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added, T.StructField("_factloom_lang_ambiguous", T.BooleanType())])
    return docs.mapInArrow(batches, schema)


def keep_identified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told; those without any letter go."""
    found = identify(docs, train(docs, text_col=text_col), text_col)
    return found.filter(F.col("_factloom_lang_pred") != UNKNOWN).select(*docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_factloom_lang_pred").alias("lang_pred"),
        F.col("_factloom_lang_score").alias("score"),
        F.col("_factloom_lang_ambiguous").alias("ambiguous"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
