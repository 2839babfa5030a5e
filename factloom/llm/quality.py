"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text (lengths, character classes, repetition, line
and word shapes, byte entropy) are binned by quantiles; trees of fixed depth
are grown level by level from gradient histograms under the logistic loss.  The
trained trees are complete binary trees flattened into arrays, and scoring
walks all trees of a batch of rows at once in numpy.

Training reads at most ``train_rows`` labelled documents (a stated bound: those
whose ids hash lowest), broadcast as (id, label); only their statistics reach
the driver.  Labels come only from rows that aren't held out.

Defined results: null text counts as empty and is scored like any text; with no
label, or one class only, the score is the constant share of label 1 (0.5 with
no label); null ids count as held out; of several labels of one id the rounded
mean counts; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, id_and_text
from factloom.llm.language import held_out

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BINS = 64

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "stops", "blanks", "line_breaks",
    "high_bytes", "distinct_words", "top_word", "repeated_neighbours", "distinct_pairs", "repeated_lines", "line_length", "short_words",
    "ending_marks", "entropy", "top_symbol", "capitalised", "longest_word", "lower",
)


def _byte_class(chars: bytes) -> np.ndarray:
    found = np.zeros(256)
    found[list(chars)] = 1
    return found


_UPPER = _byte_class(bytes(range(65, 91)))
_LOWER = _byte_class(bytes(range(97, 123)))
_DIGIT = _byte_class(bytes(range(48, 58)))
_STOP = _byte_class(b".,")
_BLANK = _byte_class(b" \t\n\r\x0b\x0c")
_BREAK = _byte_class(b"\n")
_HIGH = _byte_class(bytes(range(128, 256)))
_SYMBOL = 1 - _UPPER - _LOWER - _DIGIT - _STOP - _BLANK - _HIGH
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _STOP, _BLANK, _BREAK, _HIGH, _LOWER])


def statistics(text: str) -> list[float]:
    """The values named in STATISTICS, of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, digit, symbol, stop, blank, breaks, high, lower = _CLASSES @ counts / n
    share = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    tally = Counter(words)
    pairs = set(zip(words, words[1:]))
    same = sum(a == b for a, b in zip(words, words[1:])) if len(pairs) < len(words) - 1 else len(tally) == 1 < len(words)
    lines = [x for x in text.split("\n") if x]
    n_lines = max(1, len(lines))
    ends = sum(x[-1:] in ".,;:!?" for x in words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()), upper, digit, symbol, stop, blank, breaks,
        high, len(tally) / w, max(tally.values(), default=0) / w, float(same) / w, len(pairs) / max(1, len(words) - 1),
        1 - len(set(lines)) / n_lines, np.log1p(len(text) / n_lines), float((sizes <= 2).mean()),
        ends / w, float(-(share * np.log2(share)).sum()), float((counts * _SYMBOL).max() / n),
        sum(map(str.istitle, words)) / w, np.log1p(float(sizes.max())), lower,
    ]


# --------------------------------------------------------------------- trees


@dataclass
class Trees:
    """Complete trees: node i of a tree has the children 2i+1 and 2i+2; the last level holds values."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; above it goes right
    value: np.ndarray  # trees x leaves
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of statistics, all trees at once."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total[at : at + 1024] += self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0
) -> Trees:
    """Grow the trees from histograms of gradients; rows of x are binned by quantiles first."""
    inner, leaves, f = 2**depth - 1, 2**depth, x.shape[1] if x.ndim == 2 else len(STATISTICS)
    mean = min(1 - 1e-6, max(1e-6, float(y.mean()))) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    out = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    if len(set(y.tolist())) < 2:
        return out
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw, grown = np.full(len(y), base), []
    cell = binned + np.arange(f) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (f * BINS) + cell).ravel()
            sums = [np.bincount(place, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS) for v in (g, h)]
            gl, hl = (np.cumsum(s, axis=2) for s in sums)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, cut = divmod(int(b), BINS)
                if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(base, *(np.stack(v) for v in zip(*grown, strict=True)), depth)


# ----------------------------------------------------------------- operators


def _measure(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [statistics(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "x"])


def _score(batches: Iterator[pa.RecordBatch], model, keep: list[str]):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = np.array([statistics(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(model.value.score(x))], names=[*keep, "score"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on the texts of at most ``train_rows`` labelled ids that aren't held out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    got = rows.mapInArrow(_measure, "quality int, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T)  # the same model whatever order the rows arrive in
    return fit(x[order], got["quality"].to_numpy().astype(np.float64)[order])


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_score, model=shared, keep=["doc_id"]), f"doc_id {kind}, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = score_quality(docs, train(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
