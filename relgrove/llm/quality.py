"""Quality classifier: gradient-boosted trees over statistics of a document's text (operator 6).

The trees are fitted on the driver on at most ``SAMPLE`` labelled documents,
those with the least hash of their id, so the sample does not depend on the
order of rows. Held-out documents (crc32 of the id as text, mod 4, is 2) are
never in it. Scoring is one pass over the table without a shuffle: statistics
of each whole text by numpy, then a vectorised walk down the flattened trees.
Label, language, source and id are no inputs of a score.

Defined results: null text counts as empty and gets a score like any other.
Rows without doc_id are not held out and never in the sample. Of repeated
labels the greatest counts, of rows that share a labelled id the least text is
fitted on; null labels count as missing. Without labels of
both classes, each score is the labels' (smoothed) share of 1, 0.5 without any.
Repeated rows get equal scores. An empty table gives an empty result; extra
columns are ignored by ``scores``, passed through by ``keep_good``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.llm.boosting import Trees, fit

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.7

STATISTICS = (
    "bytes words lines mean_word long_words short_words unique_words unique_lines repeated_line_bytes letters_upper digits blanks non_ascii punctuation symbols pipes ends_of_sentence words_upper words_without_letters bytes_a_line distinct_bytes entropy longest_word top_word".split()
)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_PUNCT, _ENDS = [ord(c) for c in ",;:'\"-()"], [ord(c) for c in ".!?"]
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    distinct_lines = set(lines)
    p = count[count > 0] / n
    letters = int(count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum())
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        float(sizes.mean()),
        float((sizes > 12).sum() / k),
        float((sizes <= 2).sum() / k),
        len(seen) / k,
        len(distinct_lines) / len(lines),
        1 - sum(map(len, distinct_lines)) / n,
        float(count[_UPPER].sum() / max(1, letters)),
        float(count[_DIGIT].sum() / n),
        float((count[32] + count[9:14].sum()) / n),
        float(count[128:].sum() / n),
        float(count[_PUNCT].sum() / n),
        float(count[_SYMBOLS].sum() / n),
        float(count[124] / n),
        float(count[_ENDS].sum() / k),
        sum(map(bytes.isupper, words)) / k,
        1 - sum(map(_has_letter, words)) / k,
        float(np.log1p(n / len(lines))),
        float((count > 0).sum()),
        float(-(p * np.log2(p)).sum()),
        float(np.log1p(sizes.max())),
        max(seen.values(), default=0) / k,
    ]


def _has_letter(word: bytes) -> bool:
    return word[0] >= 65 or word[-1] >= 65 or any(b >= 65 for b in word)


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, **options) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents that aren't held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(~_held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.max("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text")).select("y", "text")  # one row for each id

    def run(batches):
        for b in batches:
            x = matrix(t.as_py() for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    rows = texts.mapInArrow(run, "y int, x array<double>").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T, y))  # independent of the order in which tasks end
    return fit(x[order], y[order], **options)


def scores(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            s = trees.score(matrix(t.as_py() for t in b.column(1)))
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, that score the threshold or more."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(trees.score(matrix(t.as_py() for t in b.column(at))) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
