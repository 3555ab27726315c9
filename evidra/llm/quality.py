"""Quality rules: fixed rules over word statistics, then gradient-boosted trees over document statistics.

Words are runs of characters other than space and U+0009 to U+000D. Null and empty texts have no words and fail the
fixed rules. Rows are judged one by one, so repeated rows have equal results, an empty table gives an empty result and
extra columns don't matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import boosting
from evidra.llm.common import id_text, map_batches, sample_ids, session, spread

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 4096
#: Share of the sample's good documents that the threshold keeps.
KEEP_GOOD = 0.998
#: No document goes unless its probability of being good is below this.
SURELY_BAD = 0.1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics that trees see, and the direction in which they may move the score of good quality.
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "upper_share", "distinct_share", "punct_share", "line_words", "long_word_share", "other_share")
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
_DIGIT, _UPPER, _PUNCT, _OTHER = (bytes(b for b in range(256) if f(b)) for f in (lambda b: 48 <= b <= 57, lambda b: 65 <= b <= 90, lambda b: chr(b) in ".,;:!?'\"()-", lambda b: b < 128 and not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()- \t\n\x0b\x0c\r"))


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if n_distinct < 1 << 20:
        key = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:  # pairs first, so that three ids fit
        pair = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * n_distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts and the features of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text) - sum(map(text.count, _SPACES))
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    repeat = repeated_words(ids, len(first))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    symbols = sum(map(text.count, _SYMBOLS))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / max(chars, 1)
    long_words = sum(len(w) > 20 for w in words)
    features = [np.log1p(n), chars / max(n, 1), symbols / max(n, 1), dup / max(len(lines), 1), repeat / max(n, 1), share(_DIGIT), share(_UPPER), len(first) / max(n, 1), share(_PUNCT), n / max(len(lines), 1), long_words / max(n, 1), share(_OTHER)]
    return [n, chars, symbols, dup, repeat], features


def fails_rules(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def fit(docs: DataFrame, labels: DataFrame) -> tuple[boosting.Trees, float]:
    """Trees and the threshold below which a document goes, from at most SAMPLE labelled documents (those with the
    smallest id hashes; conflicting labels of one document count as their minimum, null ones not at all)."""
    session(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.join(F.broadcast(sample_ids(known, SAMPLE)), "doc_id")  # at most SAMPLE rows
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id")

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "quality": batch.column(2).cast(pa.int32()), "failed": pa.array([fails_rules(c[0], c[4]) for c, _ in found], pa.bool_()), "x": pa.array([f for _, f in found], pa.list_(pa.float64()))})

    got = sorted(map(tuple, map_batches(rows, measured, "doc_id long, quality int, failed boolean, x array<double>").limit(2 * SAMPLE).collect()))
    used = [r for r in got if not r[2]]  # the fixed rules decide on the others
    x = np.array([r[3] for r in used]).reshape(-1, len(FEATURES))
    y = np.array([r[1] > 0 for r in used], float)
    constraints = {FEATURES.index(k): v for k, v in MONOTONE.items()}
    trees = boosting.fit(x, y, constraints)
    held = np.zeros(len(y))
    for k in range(4):  # the threshold comes from held-out scores
        out = np.arange(len(y)) % 4 == k
        if out.any() and not out.all():
            held[out] = boosting.fit(x[~out], y[~out], constraints).probability(x[out])
    good = held[y > 0]
    threshold = min(SURELY_BAD, float(np.quantile(good, 1 - KEEP_GOOD))) if len(good) and len(trees.leaf) else 0.0
    return trees, threshold


def _judged(texts: list, model: tuple[boosting.Trees, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, whether the fixed rules fail, probabilities of being good, and verdicts."""
    trees, threshold = model
    found = [statistics(t or "") for t in texts]
    counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
    prob = trees.probability(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
    failed = np.array([fails_rules(c[0], c[4]) for c, _ in found], bool)
    return counts, failed, prob, ~failed & (prob >= threshold)


def score(docs: DataFrame, model: tuple[boosting.Trees, float]) -> DataFrame:
    """doc_id, the counts, base_failed, quality_score (probability of being good) and kept."""
    session(docs.sparkSession)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, prob, kept = _judged(batch.column(1).to_pylist(), model)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {c: pa.array(counts[:, i]) for i, c in enumerate(COUNTS)} | {"base_failed": pa.array(failed), "quality_score": pa.array(prob), "kept": pa.array(kept)})

    return map_batches(id_text(docs), scored, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality_score double, kept boolean")


def keep_good(docs: DataFrame, model: tuple[boosting.Trees, float]) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns and whatever these are called."""
    session(docs.sparkSession)
    at = docs.columns.index("text")
    return map_batches(spread(docs), lambda b: b.filter(pa.array(_judged(b.column(at).to_pylist(), model)[3])), docs.schema)
