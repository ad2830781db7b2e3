"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other with confident pseudo-labels.

For each target (quality, toxic), both views are fitted to the labelled rows; in each round a view adds to the other's rows the
unlabelled ones that it is surest of, then both are fitted anew. On labelled rows held out from that, each view is calibrated
and the two are combined. The combination then scores all documents, one pass, with weights of a fixed size.

Fitting uses at most `most_labelled` labelled rows, taken by a hash of doc_id, and `most_bytes` of features at a time. Pseudo-labels
are chosen from all unlabelled rows; scoring covers every row.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_settled, encoded, lean, settle
from .fmindex import words_of

SIZE = 1 << 17
#: Distinct words a worker remembers the place of.
CACHE = 300_000
#: Steps of a logit by which rows are ranked.
GRADES = 64


def _bucket(x: float, steps: tuple[float, ...]) -> int:
    return sum(x > s for s in steps)


_SHARE = (0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)


class Features:
    """Places of a document's features in either view; both views are sets of yes-or-no features hashed to SIZE places."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def place(self, name: bytes) -> int:
        at = self.known.get(name)
        if at is None:
            if len(self.known) > CACHE:
                self.known.clear()
            at = self.known[name] = zlib.crc32(name) % SIZE
        return at

    def text(self, text: str | None) -> np.ndarray:
        raw = encoded(text)
        words, n = words_of(text), max(1, len(raw))
        shape = raw.split()
        m = max(1, len(shape))
        distinct = set(words)
        upper = n - len(raw.translate(None, bytes(range(65, 91))))
        style = {
            "symbols": _bucket((n - len(raw.translate(None, b"#*$%&|<>"))) / m, _SHARE),
            "loud": _bucket((n - len(raw.translate(None, b"!?"))) / m, _SHARE),
            "upper": _bucket(upper / n, (0.0, 0.02, 0.05, 0.1, 0.3, 0.6)),
            "digits": _bucket((n - len(raw.translate(None, b"0123456789"))) / n, (0.0, 0.01, 0.05, 0.2)),
            "stops": _bucket((n - len(raw.translate(None, b"."))) / m, _SHARE),
            "again": _bucket(sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, _SHARE),
            "varied": _bucket(len(distinct) / max(1, len(words)), (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)),
            "words": _bucket(len(shape), (0, 3, 10, 20, 50, 200, 1000)),
        }
        names = [self.place(w) for w in distinct] + [self.place(f"\0{k}={v}".encode()) for k, v in style.items()]
        return np.unique(np.array(names, np.int32))

    def meta(self, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
        size = "none" if n_chars is None else str(max(0, n_chars).bit_length())
        return np.unique(np.array([self.place(x.encode("utf-8", "replace")) for x in (f"lang={lang}", f"source={source}", f"size={size}", f"both={lang}|{source}")], np.int32))


class Logistic:
    """Sparse logistic regression over yes-or-no features, fitted by FTRL-proximal steps with L1 to those that tell the classes apart."""

    def __init__(self, l1: float = 1.5, l2: float = 0.5, rate: float = 0.3, rounds: int = 4, batch: int = 32, least_steps: int = 600) -> None:
        self.l1, self.l2, self.rate, self.rounds, self.batch, self.least_steps = l1, l2, rate, rounds, batch, least_steps
        self.w, self.b = np.zeros(SIZE), 0.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> Logistic:
        z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
        telling = _telling(rows, y)
        rows = [np.append(r[telling[r]], SIZE) for r in rows]
        # Few rows are gone through more often.
        for k in range(max(self.rounds, -(-self.least_steps * self.batch // max(1, len(rows))))):
            order = np.random.default_rng(k).permutation(len(rows))
            for at in range(0, len(rows), self.batch):
                pick = order[at : at + self.batch]
                flat = np.concatenate([rows[i] for i in pick])
                own = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
                places, inverse = np.unique(flat, return_inverse=True)
                zz, nn = z[places], n[places]
                l1 = np.where(places == SIZE, 0.0, self.l1)
                w = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1 + np.sqrt(nn)) / self.rate + self.l2))
                p = _sigmoid(np.bincount(own, w[inverse], minlength=len(pick)))
                g = np.bincount(inverse, (p - y[pick])[own], minlength=len(places))
                z[places] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / self.rate * w
                n[places] += g * g
        l1 = np.append(np.full(SIZE, self.l1), 0.0)
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / self.rate + self.l2))
        self.w, self.b = w[:SIZE], float(w[SIZE])
        return self

    def logit(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[r].sum() + self.b for r in rows])


def _telling(rows: list[np.ndarray], y: np.ndarray, least: int = 3, z: float = 4.0) -> np.ndarray:
    """Which features differ between the classes by z standard errors of the share at least, and occur `least` times."""
    flat, own = np.concatenate(rows), np.repeat(y > 0, [len(r) for r in rows])
    ones, zeros = np.bincount(flat[own], minlength=SIZE), np.bincount(flat[~own], minlength=SIZE)
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y <= 0).sum()))
    share = (ones + zeros) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return (np.abs(ones / n1 - zeros / n0) >= z * error) & (ones + zeros >= least)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _platt(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a small logistic regression of y on the columns of x and 1, with a weak pull to 0, by Newton's method."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.1
        step = np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Combined:
    """Two fitted views and how their calibrated logits add up."""

    text: Logistic
    meta: Logistic
    text_fit: np.ndarray
    meta_fit: np.ndarray
    both: np.ndarray

    def probability(self, text: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
        a, b = self.calibrated(text, meta)
        return _sigmoid(self.both[0] * a + self.both[1] * b + self.both[2])

    def calibrated(self, text: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return self.text_fit[0] * self.text.logit(text) + self.text_fit[1], self.meta_fit[0] * self.meta.logit(meta) + self.meta_fit[1]


class CoTraining:
    """One target's two views while they teach each other. A fifth of the labelled rows is held out to calibrate them."""

    def __init__(self, text: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray) -> None:
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        self.y, self.rows, self.train = y, {"text": text, "meta": meta}, np.flatnonzero(~held)
        self.test = np.flatnonzero(held) if held.any() else self.train
        #: For each view, the rows that the other one was sure of: doc_id to features and label.
        self.given: dict[str, dict[int, tuple[np.ndarray, float]]] = {"text": {}, "meta": {}}
        self.fitted: dict[str, Logistic] = {}
        self.fits: dict[str, np.ndarray] = {}

    def fit(self) -> CoTraining:
        for view, own in self.rows.items():
            extra = list(self.given[view].values())
            labels = np.concatenate([self.y[self.train], np.array([v for _, v in extra], np.float64)])
            self.fitted[view] = Logistic().fit([own[i] for i in self.train] + [f for f, _ in extra], labels)
            self.fits[view] = _platt(self._held(view)[:, None], self.y[self.test])
        return self

    def _held(self, view: str) -> np.ndarray:
        return self.fitted[view].logit([self.rows[view][i] for i in self.test])

    def calibrated(self, view: str, rows: list[np.ndarray]) -> np.ndarray:
        return self.fits[view][0] * self.fitted[view].logit(rows) + self.fits[view][1]

    def combined(self) -> Combined:
        a, b = (self.fits[v][0] * self._held(v) + self.fits[v][1] for v in ("text", "meta"))
        return Combined(self.fitted["text"], self.fitted["meta"], self.fits["text"], self.fits["meta"], _platt(np.column_stack([a, b]), self.y[self.test]))


_DOC = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns used, those that docs lacks as nulls."""
    kinds = dict(zip(_DOC, ("long", "string", "string", "string", "long"), strict=True))
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _featured(docs: DataFrame) -> DataFrame:
    """doc_id, t, m: the features of both views of each row with a doc_id, as int32 arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                i, text, lang, source, n = (whole.slice(at, 1000).column(c).to_pylist() for c in _DOC)
                t, m = [f.text(x).tobytes() for x in text], [f.meta(*x).tobytes() for x in zip(lang, source, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "t", "m"])

    return docs.where("doc_id IS NOT NULL").select(*_DOC).mapInArrow(lean(run), "doc_id long, t binary, m binary")


def _collected(featured: DataFrame, ids: list[int], most_bytes: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features of the rows with the given doc_ids, those with the smallest hashes, up to most_bytes."""
    if not ids:
        return {}
    wanted = featured.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = featured.join(F.broadcast(wanted), "doc_id", "left_semi").withColumn("size", F.length("t") + F.length("m"))
    before = Window.orderBy(_order(), "t", "m").rowsBetween(Window.unboundedPreceding, 0)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.withColumn("total", F.sum("size").over(before)).where(F.col("total") <= most_bytes).select("doc_id", "t", "m").toLocalIterator():
        out.setdefault(r[0], (np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int32)))
    return out


def _order() -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(8))


def _pseudo_labels(featured: DataFrame, marks: DataFrame, targets: dict[str, CoTraining], most: int, sure: float, most_bytes: int) -> None:
    """Give each view the unlabelled rows of which the other view is surest, up to `most` for either label, out of all there are.

    All rows are scored; a histogram of the logits tells where the surest ones begin, so only about as many as asked for are
    sorted. Equal ones go by a hash of doc_id.
    """
    keys = [(t, v) for t in targets for v in ("text", "meta")]
    shared = featured.sparkSession.sparkContext.broadcast(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = {"text": [np.frombuffer(x, np.int32) for x in whole.column("t").to_pylist()], "meta": [np.frombuffer(x, np.int32) for x in whole.column("m").to_pylist()]}
            grades = [np.clip(shared.value[t].calibrated(v, rows[v]) * GRADES, -9999, 9999).astype(np.int32) for t, v in keys]
            yield pa.RecordBatch.from_arrays([whole.column("doc_id"), *map(pa.array, grades)], names=["doc_id", *(f"g{k}" for k in range(len(keys)))])

    scores = featured.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"g{k} int" for k in range(len(keys)))).join(marks.select("doc_id"), "doc_id", "left_anti")
    scores = settle(scores, "view-scores")
    spread = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("g")) for k in range(len(keys)))))
    least = int(np.log(sure / (1 - sure)) * GRADES) + 1
    counts = scores.select(spread.alias("x")).select("x.k", "x.g").where(F.abs("g") >= least).groupBy("k", "g").count().collect()
    lists: list[DataFrame] = []
    for k in range(len(keys)):
        for sign in (1, -1):
            many, cut = 0, None
            for g, n in sorted(((sign * r[1], r[2]) for r in counts if r[0] == k and sign * r[1] > 0), reverse=True):
                many, cut = many + n, g
                if many >= most:
                    break
            if cut is not None:
                g = sign * F.col(f"g{k}")
                lists.append(scores.where(g >= cut).orderBy(g.desc(), _order()).limit(most).select("doc_id", F.lit(k).alias("k"), F.lit(float(sign > 0)).alias("value")))
    if not lists:
        return
    found = functools.reduce(DataFrame.unionByName, lists).collect()
    got = _collected(featured, sorted({r[0] for r in found}), most_bytes)
    for i, k, value in sorted(map(tuple, found)):
        target, view = keys[k]
        other = "meta" if view == "text" else "text"
        if i in got:
            targets[target].given[other].setdefault(i, (got[i][other == "meta"], value))
    shared.destroy()
    drop_settled(scores)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 12_000, most_bytes: int = 256 << 20, rounds: int = 3, sure: float = 0.98, per_round: int = 500) -> dict[str, Combined | float]:
    """Classifiers of `quality` and `toxic`, or the share of ones where the labels hold fewer than two of either class.

    Labels without a document, or with a null in a target, do not count for it.
    """
    docs = _documents(docs)
    featured = settle(_featured(docs), "features", "zstd")
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL")
    chosen = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).join(featured.select("doc_id"), "doc_id", "left_semi").orderBy(_order()).limit(most_labelled)
    labelled = {r[0]: (r[1], r[2]) for r in chosen.collect()}
    got = _collected(featured, list(labelled), most_bytes)
    out: dict[str, Combined | float] = {}
    targets: dict[str, CoTraining] = {}
    for k, target in enumerate(("quality", "toxic")):
        use = [i for i in labelled if i in got and labelled[i][k] is not None]
        y = np.array([float(labelled[i][k] > 0) for i in use])
        if min(int(y.sum()), int(len(y) - y.sum())) < 2:
            out[target] = float(y.mean()) if len(y) else 0.5
        else:
            targets[target] = CoTraining([got[i][0] for i in use], [got[i][1] for i in use], y).fit()
    for r in range(rounds if targets else 0):
        _pseudo_labels(featured, marks, targets, per_round * (r + 1), sure, most_bytes)
        for t in targets.values():
            t.fit()
    drop_settled(featured)
    return out | {k: t.combined() for k, t in targets.items()}


def scored(docs: DataFrame, models: dict[str, Combined | float], threshold: float = 0.5, rows_too: bool = False) -> DataFrame:
    """doc_id, quality_score, toxic_score, accepted, row for row; accepted: quality at least, and toxicity below, the threshold.

    rows_too adds the other columns of documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, both = Features(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                i, text, lang, source, n = (batch.column(c).to_pylist() for c in _DOC)
                t, m = [f.text(x) for x in text], [f.meta(*x) for x in zip(lang, source, n, strict=True)]
                p = {k: c.probability(t, m) if isinstance(c, Combined) else np.full(len(i), c) for k, c in both.items()}
                known = {k: isinstance(c, Combined) for k, c in both.items()}
                good = np.ones(len(i), bool)
                if known["quality"]:
                    good &= p["quality"] >= threshold
                if known["toxic"]:
                    good &= p["toxic"] < threshold
                more = _DOC[1:] if rows_too else ()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int64()), pa.array(p["quality"]), pa.array(p["toxic"]), pa.array(good), *(batch.column(c) for c in more)], names=["doc_id", "quality_score", "toxic_score", "accepted", *more]
                )

    return _documents(docs).mapInArrow(lean(run), "doc_id long, quality_score double, toxic_score double, accepted boolean" + (", text string, lang string, source string, n_chars long" if rows_too else ""))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows_too: bool = False, **bounds: int) -> DataFrame:
    """Fit on the labels, score every document.

    Null and blank texts are scored by what is left, their metadata and the style of an empty text. Without labels of both
    classes a target has the share of ones (0.5 without labels) as every score and rejects nothing. Labels given twice count
    as the worse one. Repeated rows are scored alike; columns that docs lacks are nulls, further ones are not read. Of a very long
    text all distinct words count, hashed to SIZE places, so its features are bounded.
    """
    return scored(docs, fit(docs, labels, **bounds), threshold, rows_too)
