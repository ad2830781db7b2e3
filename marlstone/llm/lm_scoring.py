"""Stupid-backoff scores of documents under n-gram counts of all other documents.

For each order in turn, the corpus' n-grams are exploded from packed batches of documents into the hash buckets of that order's
count table, partial counts first, and the table is joined back to the exploded n-grams (see lookup). An order's shuffles are done
with before the next one begins. The counts of all orders meet at their batch, and the logs are summed per document. A
document's own counts are taken off, so its score tells how well the rest of the corpus predicts it.

For a word w after the context h, with counts c of the other documents and N their words: S(w | h) = c(h w) / c(h) if c(h w) > 0,
else backoff * S(w | shorter h); with no context S(w) = c(w) / N if c(w) > 0, else backoff / (N + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, free_shuffles, ids_array, pack_documents, rows_of, settle, unpacked
from .lookup import bucket_bits, mix, told_totals, totals

_SALT = np.uint64(0xD6E8FEB86659FD93)


class _Grams:
    """The n-grams of a packed batch: for each order, the key of the n-gram that ends at each word (0 where none does)."""

    def __init__(self, row: dict, order: int) -> None:
        from xxhash import xxh64_intdigest

        self.ids, lengths, blob = unpacked(row)
        seen: dict[bytes, int] = {}
        counts, number, at = [], [], 0
        for n in lengths.tolist():
            words = blob[at : at + n].translate(LOWER).split()
            number += [seen.setdefault(w, len(seen)) for w in words]
            counts.append(len(words))
            at += n
        self.counts = np.array(counts, np.int64)
        word = np.fromiter(map(xxh64_intdigest, seen), np.uint64, len(seen))[np.array(number, np.int64)]
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        self.place = np.arange(len(word)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        gram = mix(word ^ _SALT)
        self.grams = [gram]
        for k in range(1, order):
            longer = np.zeros(len(word), np.uint64)
            longer[1:] = mix(self.grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(word[1:] + np.uint64(k)))
            longer[self.place < k] = 0
            self.grams.append(longer)

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams of k + 1 words, which of them ends at each word that has one, and how often each occurs."""
        return np.unique(self.grams[k][self.place >= k], return_inverse=True, return_counts=True)


def backoff_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score (null without words), row for row.

    Words are runs of other than ASCII white space, A-Z as a-z. Null and blank texts have no words and the score 0. Rows of the
    same doc_id are documents of their own. Other columns are not read.
    """
    packed = settle(pack_documents(docs), "packed")
    bits = bucket_bits(packed)

    def keys_of(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        keys, _, counts = _Grams(row, k + 1).keys(k)
        return keys, counts

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = _Grams(row, order)
            # Own counts: how often the same n-gram is in the same document.
            others = []
            n_docs = len(g.counts)
            for k, gram in enumerate(g.grams):
                corpus, live, key = told_totals(row[f"told{k}"]), np.flatnonzero(g.place >= k), g.keys(k)[1]
                _, same, own = np.unique(key * n_docs + g.doc[live], return_inverse=True, return_counts=True)
                rest = np.zeros(len(gram), np.int64)
                rest[live] = corpus[key] - own[same]
                others.append(rest)
            rest_words = (n_words_total - g.counts[g.doc]).astype(np.float64)
            p = np.where(others[0] > 0, others[0] / np.maximum(rest_words, 1), backoff / (rest_words + 1))
            for k in range(1, order):
                context = np.zeros(len(p), np.int64)
                context[1:] = others[k - 1][:-1]
                p = np.where(g.place >= k, np.where(others[k] > 0, others[k] / np.maximum(context, 1), backoff * p), p)
            total = np.bincount(g.doc, np.log(p), minlength=n_docs).astype(np.float64)
            mean = np.divide(total, g.counts, out=np.zeros(n_docs), where=g.counts > 0)
            yield pa.RecordBatch.from_arrays([ids_array(g.ids), pa.array(g.counts), pa.array(total), pa.array(mean, mask=g.counts == 0)], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, _, blob = unpacked(row)
            yield pa.RecordBatch.from_arrays([pa.array([row["m"]]), pa.array([_n_words(row, blob)])], names=["m", "n"])

    n_words_total = packed.select("m", "n_bytes", "ids", "lengths", "blob").mapInArrow(count, "m long, n long").groupBy().sum("n").first()[0] or 0
    rows = packed
    for k in range(order):
        counted = settle(totals(packed, lambda row, k=k: keys_of(row, k), bits), f"gram-totals-{k}", "zstd")
        free_shuffles(docs.sparkSession)
        rows = rows.join(counted.withColumnRenamed("told", f"told{k}"), "m", "left")
    return rows.mapInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")


def _n_words(row: dict, blob: bytes) -> int:
    """Words in all texts of a packed row; texts may touch, so each counts on its own."""
    n, at = 0, 0
    for size in np.frombuffer(row["lengths"], np.int64).tolist():
        n += len(blob[at : at + size].split())
        at += size
    return n


#: The same scores by position, for order 3 and a backoff of 0.4.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
p AS (SELECT rid, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
o1 AS (SELECT rid, g1, count(*) AS o FROM p GROUP BY ALL), o2 AS (SELECT rid, g2, count(*) AS o FROM p WHERE i > 1 GROUP BY ALL), o3 AS (SELECT rid, g3, count(*) AS o FROM p WHERE i > 2 GROUP BY ALL),
r1 AS (SELECT rid, g1, sum(o) OVER (PARTITION BY g1) - o AS c FROM o1), r2 AS (SELECT rid, g2, sum(o) OVER (PARTITION BY g2) - o AS c FROM o2), r3 AS (SELECT rid, g3, sum(o) OVER (PARTITION BY g3) - o AS c FROM o3),
n AS (SELECT rid, count(*) AS n, (SELECT count(*) FROM p) - count(*) AS rest FROM p GROUP BY rid),
c AS (SELECT p.rid, i, r1.c AS c1, r2.c AS c2, r3.c AS c3, lag(r1.c) OVER w AS h1, lag(r2.c) OVER w AS h2, n, rest FROM p JOIN n USING (rid) JOIN r1 USING (rid, g1) LEFT JOIN r2 USING (rid, g2) LEFT JOIN r3 USING (rid, g3) WINDOW w AS (PARTITION BY p.rid ORDER BY i)),
s AS (SELECT *, CASE WHEN c1 > 0 THEN c1 / greatest(rest, 1)::DOUBLE ELSE 0.4::DOUBLE / (rest + 1) END AS s1 FROM c),
t AS (SELECT *, CASE WHEN i = 1 THEN s1 WHEN c2 > 0 THEN c2 / greatest(h1, 1)::DOUBLE ELSE 0.4::DOUBLE * s1 END AS s2 FROM s),
u AS (SELECT *, CASE WHEN i <= 2 THEN s2 WHEN c3 > 0 THEN c3 / greatest(h2, 1)::DOUBLE ELSE 0.4::DOUBLE * s2 END AS s3 FROM t),
a AS (SELECT rid, any_value(n) AS n, sum(ln(s3)) AS x FROM u GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / n, 6) AS mean_log_score FROM d LEFT JOIN a USING (rid)
"""
