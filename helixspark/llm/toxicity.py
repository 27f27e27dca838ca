"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm._common import _SPACE, as_bytes, id_text, pieces, table, text_pieces, tidy, words

#: At most so many labelled rows train the model. Features are words and their first bytes, of several lengths: those in
#: enough of the rows whose labels differ from the mean by so many standard deviations; at most so many.
TRAIN_ROWS, LEAST_DOCS, LEAST_LIFT, FEATURES = 6000, 4, 4.0, 6000
HEADS = (4, 5, 6, 7, 8, 10)
STEPS, RATE, DECAY, BIAS = 250, 0.15, 2e-4, -6.0
#: The bias where nothing could be learnt: so low that no number of sentences adds up to a score.
UNTRAINED = -60.0
#: Bytes of texts whose features are made at once: these take about 80 times as much memory, in each worker.
CHUNK = 125_000
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True
#: Words are runs of letters, digits and bytes over 127: ASCII punctuation parts them.
_PART = _SPACE.copy()
_PART[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and sentence of each feature; of each sentence its text, start and end (of its words). ``. ! ?`` and line ends part."""
    hashes, where, begins, ends, heads = words(texts, _PART, HEADS)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return hashes, none, none, none, none
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    stops = np.cumsum(_ENDS[buffer], dtype=np.int64)[begins + offsets[where]]
    new = np.append(True, (stops[1:] != stops[:-1]) | (where[1:] != where[:-1]))
    first = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    each = heads != 0
    features = np.concatenate([hashes, *(h[e] for h, e in zip(heads, each, strict=True))])
    return features, np.concatenate([sentence, *(sentence[e] for e in each)]), where[first], begins[first], ends[np.append(first[1:], len(hashes)) - 1]


def distinct(sentence: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(sentence.astype(np.int64) << 32 | feature)
    return both >> 32, both & 0xFFFFFFFF


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of hash, documents with it and toxic ones among them, as one: each hash once, sorted, its counts added up."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])[: rows.shape[1]])
    return np.stack([rows[0, first], *(np.add.reduceat(x, first) if len(first) else x for x in rows[1:])])


def train(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their weights; the last weight is the bias.

    A sentence is toxic with probability sigmoid(bias + sum of its words' weights); a document if any sentence is:
    1 - prod(1 - p). Full-batch Adam on the likelihood of the documents' labels, with decay.
    """
    # Features of all texts at once would take many times the texts' bytes, so they are made twice, a chunk at a time: to count the
    # documents that have each, and for the sentences' rows of the chosen ones.
    cuts = list(pieces(map(len, texts), CHUNK))
    counted = [np.zeros((3, 0), np.uint64)]
    for a, b in cuts:
        h, s, d, *_ = sentences(texts[a:b])
        found, index = np.unique(h, return_inverse=True)
        doc, word = distinct(d[s], index)
        hits = np.bincount(word, labels[a:b][doc], minlength=len(found))
        counted.append(np.stack([found, np.bincount(word, minlength=len(found)).astype(np.uint64), hits.astype(np.uint64)]))
        # Small parts wait until they are as many as what is there, so that each is merged a few times only.
        if sum(x.shape[1] for x in counted[1:]) > max(counted[0].shape[1], CHUNK):
            counted = [merged(counted)]
    vocabulary, seen, hits = merged(counted)
    if not len(vocabulary) or labels.min() == labels.max():
        return np.zeros(0, np.uint64), np.array([UNTRAINED])
    seen, hits = seen.astype(np.int64), hits.astype(float)
    share = labels.mean()
    lift = np.abs(hits - seen * share) / np.sqrt(seen * share * (1 - share))
    chosen = np.flatnonzero((seen >= LEAST_DOCS) & (lift >= LEAST_LIFT))
    chosen = np.sort(chosen[np.lexsort((vocabulary[chosen], -lift[chosen]))][:FEATURES])
    known = vocabulary[chosen]
    del counted, vocabulary, seen, hits, lift
    rows, docs, base = [(np.zeros(0, np.int64),) * 2], [], 0
    for a, b in cuts:
        h, s, d, *_ = sentences(texts[a:b])
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            sentence, feature = distinct(s[hit], at[hit])
            rows.append((sentence + base, feature))
        docs.append(d + a)
        base += len(d)
    s, f = (np.concatenate(x) for x in zip(*rows, strict=True))
    d = np.concatenate(docs)
    del rows, docs
    n, k = len(texts), len(known)
    w = np.zeros(k + 1)
    w[k] = BIAS
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(s, w[f], minlength=base) + w[k]
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(d, np.logaddexp(0, z), minlength=n))
        toxic = np.maximum(1 - clean, 1e-9)
        pull = np.where(labels == 1, -clean / toxic, 1.0)[d] * p
        g = np.append(np.bincount(f, pull[s], minlength=k), pull.sum()) / n
        g[:k] += DECAY * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return known, w


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Train on at most ``rows`` rows of ``doc_id, text, label``, the first by a hash of the id; rows without a label don't count.

    The rows' whole texts meet in one task, whose size ``rows`` bounds. Without rows, or with one label only, every score is near 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, t, y) for b in batches for d, t, y in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True)]
        got.sort()
        if got:
            h, w = train([t for _, t, _ in got], np.array([y for *_, y in got], float))
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()]), pa.array([w.tobytes()])], ["hashes", "weights"])

    some = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    # A first cut by the hash leaves few more than are wanted; of these the first are taken, in an order that any run finds again.
    n = some.count()
    if n > rows:
        some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.1 * rows / n)))
    model = some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).repartition(1).mapInArrow(tidy(run, "toxicity"), "hashes binary, weights binary").collect()
    if not model:
        return np.zeros(0, np.uint64), np.array([UNTRAINED])
    return np.frombuffer(model[0][0], np.uint64), np.frombuffer(model[0][1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, located: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score, predicted`` per row, and if ``located`` the offending sentences: start and end in bytes, and score.

    A text without words (null, empty) scores 0; a null id stays null; repeated rows give repeated results. The columns of
    ``docs`` named in ``keep`` go along as ``kept0, kept1, ...``; the text itself is sent to the workers once.
    """
    spans = "array<struct<start:bigint,end:bigint,score:double>>"
    schema = "doc_id bigint, score double, predicted int" + f", sentences {spans}" * located + "".join(f", kept{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(keep))
    more = [c for c in keep if c != text_col or dict(docs.dtypes)[c] != "string"]
    kept_at = [2 + more.index(c) if c in more else 1 for c in keep]
    known, w = model
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((known, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value
        k = len(known)
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(1), CHUNK):
                h, s, d, starts, ends = sentences(texts)
                z = np.full(len(d), w[k])
                if k and len(h):
                    at = np.minimum(np.searchsorted(known, h), k - 1)
                    hit = known[at] == h
                    s, f = distinct(s[hit], at[hit])
                    z += np.bincount(s, w[f], minlength=len(d))
                loss = np.logaddexp(0, z)
                total = 1 - np.exp(-np.bincount(d, loss, minlength=b - a))
                columns = [batch.column(0)[a:b], pa.array(total), pa.array((total >= threshold).astype(np.int32))]
                if located:
                    p = 1 - np.exp(-loss)
                    out: list[list[dict]] = [[] for _ in range(a, b)]
                    for i in np.flatnonzero(p >= threshold):
                        out[d[i]].append({"start": int(starts[i]), "end": int(ends[i]), "score": float(p[i])})
                    columns.append(pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
                columns += [batch.column(i)[a:b] for i in kept_at]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "sentences"][: 3 + located] + [f"kept{i}" for i in range(len(keep))])

    return id_text(docs, id_col, text_col, *(F.col(c).alias(f"kept{i}") for i, c in enumerate(more))).mapInArrow(tidy(run, "toxicity"), schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row's label is never learnt: crc32 of the id's text modulo 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, label`` of the rows that may be learnt from; where an id has several labels, the largest counts."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label")).where("label is not null")
    return id_text(docs, "doc_id", "text").where(~held_out()).join(known, "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model, located=False).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
