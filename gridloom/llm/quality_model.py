"""Quality scores by regularised quadratic discriminant analysis over statistics of whole texts.

Statistics are counts of byte classes, words and lines, taken from prefix sums over whole batches; logarithms and arc sines
of square roots bring them near normal. Each class has its mean and a covariance shrunk towards its own diagonal and that
of both classes together; its Cholesky factor is inverted once and shipped. A score is the logistic of the difference of Mahalanobis log-densities plus
the log prior ratio, tempered, since the statistics are not quite normal.

Statistics are kept in steps of 2^-20, so sums for means and covariances are sums of integers: exact, and the same whatever the order in
which partitions are added by one groupBy. The driver gets two small matrices.

Defined results: null and empty texts have zero statistics and get a score like any other; rows without a label, or whose id
is in the held-out fold, teach nothing; an id with several labels teaches with each; with fewer than two classes every score is
the share of label 1 (0.5 with no label at all); very long texts count whole; repeated rows teach and are scored each; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.quality_rules import STOP_WORDS
from gridloom.llm.schema import held_out
from gridloom.llm.shared import stage
from gridloom.llm.textarrays import ALNUM, LOWER, NONSPACE, bounds, pieces, span_hashes, utf8, words


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _STOPS, _COMMA, _LOUD = _class("#*$%&|<>"), _class("."), _class(",;:"), _class("!?")
_OTHER = _class("()[]{}\"'=+_/\\@^~`-")
_LINE = np.ones(256, bool)
_LINE[10] = False

#: Statistics are multiples of 1 / UNIT; none reaches 32.
UNIT = 1 << 20

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "stops", "commas", "loud", "other", "stop_words", "distinct", "top_word", "lines", "repeated_lines")


def _stop_hashes() -> np.ndarray:
    b = [w.encode() for w in sorted(set(STOP_WORDS))]
    return np.sort(words(np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]))[0])


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(off) - 1
    per = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off]).astype(float)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))
    starts, _, first = bounds(NONSPACE[buf], off)
    n_words = np.diff(first).astype(float)
    chars = per(NONSPACE[buf] & ((buf & 0xC0) != 0x80))
    letters = per(ALNUM[LOWER[buf]] & ((buf & 0xC0) != 0x80))
    hashes, wfirst, _, _ = words(buf, off)
    n_plain = np.diff(wfirst).astype(float)
    stop = _stop_hashes()
    is_stop = stop[np.minimum(np.searchsorted(stop, hashes), len(stop) - 1)] == hashes
    doc = np.repeat(np.arange(n), np.diff(wfirst))
    n_stop = np.bincount(doc, weights=is_stop, minlength=n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    runs = np.diff(np.r_[at, len(h)])
    distinct = np.bincount(d[at], minlength=n).astype(float) if len(at) else np.zeros(n)
    top = np.zeros(n)
    if len(at):
        np.maximum.at(top, d[at], runs)
    ls, le, lfirst = bounds(_LINE[buf], off)
    n_lines = np.diff(lfirst).astype(float)
    ldoc = np.repeat(np.arange(n), np.diff(lfirst))
    lh = span_hashes(buf, ls, le)
    order = np.lexsort((lh, ldoc))
    x, y = lh[order], ldoc[order]
    same = np.r_[False, (x[1:] == x[:-1]) & (y[1:] == y[:-1])] if len(x) else np.zeros(0, bool)
    repeated = np.bincount(y[same], minlength=n).astype(float)
    # Heaps' law bends the share of distinct words down for long texts; the exponent brings lengths together.
    return np.stack(
        [
            np.log1p(n_words), np.log1p(chars / np.maximum(n_words, 1)), share(per(_UPPER[buf]), letters), share(per(_DIGIT[buf]), chars), share(per(_SYMBOL[buf]), chars),
            share(per(_STOPS[buf]), n_words), share(per(_COMMA[buf]), n_words), share(per(_LOUD[buf]), n_words), share(per(_OTHER[buf]), chars), share(n_stop, n_plain),
            np.log1p(distinct) / np.log1p(np.maximum(n_plain, 1)), share(top, n_plain), np.log1p(n_lines) / np.log1p(np.maximum(n_words, 1)), share(repeated, n_lines),
        ],
        axis=1,
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(FEATURES)
    for batch in batches:
        buf, off = utf8(batch.column(2))
        for i, j in pieces(off):
            x = np.rint(statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) * UNIT) / UNIT
            rows = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), rows], names=["doc_id", "held_out", "x"])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(FEATURES))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class and run of rows: rows, sum and sum of outer products, flat, in integers of 1, 1/UNIT and 1/UNIT^2."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):  # 4096 squares of at most 2^25 stay below 2^63
            part = batch.slice(i, 4096)
            x, y = np.rint(_rows(part.column(1)) * UNIT).astype(np.int64), part.column(0).to_numpy()
            sums = {c: np.concatenate([[int((y == c).sum())], x[y == c].sum(axis=0), (x[y == c].T @ x[y == c]).ravel()]) for c in np.unique(y).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["label", "sums"])


@dataclass(frozen=True)
class Model:
    """prior: share of label 1; means, inverse Cholesky factors and half log-determinants by class (None with one class)."""

    prior: float
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    half_log_det: np.ndarray | None = None
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - d for m, w, d in zip(self.means, self.whiten, self.half_log_det, strict=True)]
        z = self.temper * (density[1] - density[0]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(sums: dict[int, np.ndarray], own_diagonal: float = 0.1, pooled: float = 0.05, floor: float = 1e-4, temper: float = 0.5) -> Model:
    """Shrinkage: (1 - own_diagonal - pooled) of the class covariance, own_diagonal of its diagonal, pooled of the diagonal of all rows; floor is added."""
    p = len(FEATURES)
    n = {c: float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)}
    if min(n.values()) < 2:
        total = sum(n.values())
        return Model(n[1] / total if total else 0.5)
    both = sums[0] + sums[1]
    mean = both[1 : p + 1] / both[0]
    all_var = np.maximum(np.diag(both[p + 1 :].reshape(p, p)) / both[0] - mean**2, 0)
    means, whiten, half = [], [], []
    for c in (0, 1):
        m = sums[c][1 : p + 1] / n[c]
        cov = sums[c][p + 1 :].reshape(p, p) / n[c] - np.outer(m, m)
        cov = (1 - own_diagonal - pooled) * cov + own_diagonal * np.diag(np.maximum(np.diag(cov), 0)) + pooled * np.diag(all_var) + floor * np.eye(p)
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        means.append(m)
        whiten.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
    return Model(n[1] / (n[0] + n[1]), np.array(means), np.array(whiten), np.array(half), temper)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return stage(own.mapInArrow(_features, "doc_id long, held_out boolean, x array<double>"), "features")


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learns from labelled rows outside the held-out fold, all of them."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("label IN (0, 1)")
    rows = features.filter("NOT held_out").join(known, "doc_id").select("label", "x")
    parts = rows.mapInArrow(_sums, "label int, sums array<long>").select("label", F.posexplode("sums").alias("at", "v"))
    sums: dict[int, np.ndarray] = {}
    width = len(FEATURES)
    unit = [1, *[UNIT] * width, *[UNIT**2] * (width * width)]
    for r in parts.groupBy("label", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # bounded: two rows per entry of the sums
        sums.setdefault(r.label, np.zeros(1 + width + width * width))[r["at"]] = int(r.v) / unit[r["at"]]
    return fit(sums)


def score(features: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.round(model.score(_rows(batch.column(2))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
