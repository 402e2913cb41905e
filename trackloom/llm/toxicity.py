"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (a run of letters, A-Z folded) has the sum of two hashed embeddings, one of
the word and one of its first bytes.  Filters of several widths slide over the
whole text, each keeps its greatest response, and a logistic layer weighs them.
The net is trained in numpy (Adam, balanced classes) on a sample of at most SAMPLE
labelled texts of at most SAMPLE_BYTES bytes together.  The threshold of each
language is then set on texts kept out of training, where those of other languages
count as POOL texts together, so that few texts move a threshold little; a score
of 0.5 stands for it.  A text's language is guessed from the
function words in it, so that nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc

SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH, RATE = 6000, 24_000_000, 12, 48, 0.01
WIDTHS, FILTERS, SIZE, BITS, STEM = (1, 2, 3), 12, 16, 15, 5
CALIBRATION_SHARE, POOL = 0.2, 40
# Frequent function words of some languages.
FUNCTION_WORDS = {
    "en": "the and of to in is that for was with are this from",
    "de": "der die und das ist nicht ein eine mit von sich auf den",
    "fr": "le les et des une est que dans pour qui pas avec du",
    "es": "el los y las que por una con para del es como",
    "it": "il di che gli per della sono non nel",
    "pt": "o os um uma que para com em dos nas",
    "nl": "het een van dat niet zijn voor met op",
}
_LANGS = ["other", *FUNCTION_WORDS]


def _function_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of function words and, for each, in which languages they are."""
    found: dict[int, np.ndarray] = {}
    for k, words in enumerate(FUNCTION_WORDS.values(), 1):
        for w in words.split():
            found.setdefault(tc.word_hash(w), np.zeros(len(_LANGS), np.float32))[k] = 1
    keys = np.array(sorted(found), tc.U64)
    return keys, np.array([found[int(k)] for k in keys])


_KEYS, _WHICH = _function_table()
_MAYBE = np.zeros(1 << 12, bool)
_MAYBE[(_KEYS & tc.U64((1 << 12) - 1)).astype(np.int64)] = True


class Words:
    """Hashed words of a block of texts, each text followed by WIDTHS[-1]-1 blanks (and at least one)."""

    def __init__(self, part: np.ndarray, offsets: np.ndarray):
        starts, ends, bounds = tc.word_spans(part, offsets, tc.IS_LETTER)
        whole = tc.span_hashes(part, starts, ends)
        stem = tc.span_hashes(part, starts, np.minimum(ends, starts + STEM))
        n, pad = len(bounds) - 1, max(WIDTHS) - 1
        self.lengths = np.maximum(np.diff(bounds), 1)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + pad)])
        place = np.arange(len(whole)) + (self.starts[:-1] - bounds[:-1]).repeat(np.diff(bounds))
        total = int(self.starts[-1])
        blank = 1 << BITS
        self.word, self.stem = np.full(total, blank, np.int32), np.full(total, blank, np.int32)
        self.word[place] = (whole >> tc.U64(64 - BITS)).astype(np.int32)
        self.stem[place] = (stem >> tc.U64(64 - BITS)).astype(np.int32)
        self.langs = np.zeros(n, np.int64)
        maybe = np.flatnonzero(_MAYBE[(whole & tc.U64((1 << 12) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(_KEYS, whole[maybe]), len(_KEYS) - 1)
        hit = _KEYS[at] == whole[maybe]
        if hit.any():
            votes = np.zeros((n, len(_LANGS)))
            np.add.at(votes, np.searchsorted(bounds, maybe[hit], "right") - 1, _WHICH[at[hit]])
            self.langs = np.where(votes.max(1) > 0, votes.argmax(1), 0)


class Net:
    """Parameters of the classifier and thresholds by language."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        blank = 1 << BITS
        self.words = r.normal(0, 0.3, (blank + 1, SIZE)).astype(np.float32)
        self.stems = r.normal(0, 0.3, (blank + 1, SIZE)).astype(np.float32)
        self.words[blank] = self.stems[blank] = 0
        self.kernels = [r.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(_LANGS))
        self.constant: float | None = None

    def _responses(self, vectors: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        n = len(vectors)
        out = vectors @ kernel[0]
        for j in range(1, len(kernel)):
            out[: n - j] += vectors[j:] @ kernel[j]
        return out

    def logits(self, words: Words) -> np.ndarray:
        """Raw scores of all texts of a block."""
        vectors = self.words[words.word]
        vectors += self.stems[words.stem]
        edges = np.empty(2 * len(words.lengths), np.int64)
        edges[0::2], edges[1::2] = words.starts[:-1], words.starts[:-1] + words.lengths
        if edges[-1] >= len(vectors):
            vectors = np.concatenate([vectors, np.zeros((1, SIZE), np.float32)])
        best = [np.maximum.reduceat(self._responses(vectors, k), edges, axis=0)[0::2] + s for k, s in zip(self.kernels, self.shifts)]
        return np.maximum(np.concatenate(best, 1), 0) @ self.out + self.bias[0]

    def scores(self, words: Words) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words.lengths), self.constant)
        z = self.logits(words).astype(np.float64) - self.thresholds[words.langs]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Adam over mini-batches; a filter's gradient flows to the words of its greatest response only."""
        r = np.random.default_rng(5)
        weight = np.where(labels > 0, 0.5 / max(1, (labels > 0).mean() * len(labels)), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        dense = [*self.kernels, *self.shifts, self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
        sparse = {id(p): (np.zeros_like(p), np.zeros_like(p)) for p in (self.words, self.stems)}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            order = r.permutation(len(docs))
            for b in range(0, len(order), BATCH):
                chosen = order[b : b + BATCH]
                step += 1
                grads = [np.zeros_like(p) for p in dense]
                rows: dict[int, list] = {id(self.words): [], id(self.stems): []}
                for i in chosen:
                    word, stem = docs[i]
                    vectors = self.words[word] + self.stems[stem]
                    n = len(word) - max(WIDTHS) + 1
                    tops, values = [], []
                    for k, s in zip(self.kernels, self.shifts):
                        z = self._responses(vectors, k)[:n]
                        at = z.argmax(0)
                        tops.append(at)
                        values.append(z[at, np.arange(FILTERS)] + s)
                    hidden = np.concatenate(values)
                    kept = np.maximum(hidden, 0)
                    p = 1 / (1 + np.exp(-np.clip(kept @ self.out + self.bias[0], -30, 30)))
                    g = np.float32((p - labels[i]) * weight[i] / len(chosen))
                    grads[-2] += g * kept
                    grads[-1] += g
                    back = g * self.out * (hidden > 0)
                    for w, width in enumerate(WIDTHS):
                        own = back[w * FILTERS : (w + 1) * FILTERS]
                        live = np.flatnonzero(own)
                        if not len(live):
                            continue
                        grads[len(WIDTHS) + w] += own
                        for j in range(width):
                            at = tops[w][live] + j
                            grads[w][j][:, live] += vectors[at].T * own[live]
                            push = own[live, None] * self.kernels[w][j][:, live].T
                            rows[id(self.words)].append((word[at], push))
                            rows[id(self.stems)].append((stem[at], push))
                keep1, keep2 = 1 - 0.9**step, 1 - 0.999**step
                for param, grad, (m, v) in zip(dense, grads, moments):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    param -= rate * (m / keep1) / (np.sqrt(v / keep2) + 1e-7)
                for table in (self.words, self.stems):
                    parts = rows[id(table)]
                    if not parts:
                        continue
                    at, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                    grad = np.zeros((len(at), SIZE), np.float32)
                    np.add.at(grad, place, np.concatenate([x for _, x in parts]))
                    m, v = sparse[id(table)]
                    m[at] += 0.1 * (grad - m[at])
                    v[at] += 0.001 * (grad * grad - v[at])
                    table[at] -= rate * (m[at] / keep1) / (np.sqrt(v[at] / keep2) + 1e-7)
                    table[1 << BITS] = 0
        # A word that never drove a filter says nothing: it must not get a score by the chance of its first values.
        for table in (self.words, self.stems):
            table[~sparse[id(table)][1].any(1)] = 0

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: np.ndarray) -> None:
        """For each language the threshold with the least weight of errors, in the middle of its gap.

        Texts of the language weigh 1 each, all others POOL together.  With one label only, nothing is known.
        """
        if not len(labels) or labels.min() == labels.max():
            return
        order = np.argsort(logits, kind="stable")
        z, y, langs = logits[order], labels[order], langs[order]
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        for k in range(len(_LANGS)):
            others = int((langs != k).sum())
            weight = np.where(langs == k, 1.0, POOL / max(1, others))
            wrong = np.concatenate([[0], np.cumsum(weight * (y == 1))]) + np.concatenate([np.cumsum((weight * (y == 0))[::-1])[::-1], [0]])
            # Equal sums may differ in their last digits.
            least = np.flatnonzero(wrong <= wrong.min() + 1e-9 * weight.sum())
            self.thresholds[k] = edges[least[len(least) // 2]]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tc.buffers(batch.column("text"))
        for i, j in tc.blocks(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cut = [slice(words.starts[k], words.starts[k + 1]) for k in range(j - i)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic")[i:j], "lang": pa.array(words.langs, pa.int64()), "word": pa.array([words.word[c].tobytes() for c in cut], pa.binary()), "stem": pa.array([words.stem[c].tobytes() for c in cut], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_bytes: int = SAMPLE_BYTES) -> Net:
    """A net from the rows of `docs` whose id has a label of 0 or 1.

    At most `sample` labelled ids are used, half of them of each label as far as
    there are any, chosen by a hash of the id.  Of their texts those are taken, in
    that order, that have at most `sample_bytes` bytes, half of them of each label;
    the first of a label always is.  An id with both labels counts as toxic.  A
    share CALIBRATION_SHARE of them sets the thresholds only.  Without texts of both labels, all scores are 1 or 0, as the label is
    (0 without any).
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.withColumn("pick", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    each = {y: min(n, max(sample // 2, sample - counts.get(1 - y, 0))) for y, n in counts.items()}
    net = Net()
    if not counts:
        net.constant = 0.0
        return net
    odds = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, 1.5 * each[y] / n + 0.001))])
    likely = marked.where((F.col("pick") / 2.0**64 + 0.5) < odds[F.col("toxic")])
    some = reduce(DataFrame.unionByName, [likely.where(F.col("toxic") == y).orderBy("pick", "doc_id").limit(n) for y, n in each.items()])
    # At most `sample` rows: bounded, so they may go to every executor.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some.select("doc_id", "toxic", "pick")), "doc_id").where("text is not null")
    order = Window.partitionBy("toxic").orderBy("pick", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("rank", F.count("*").over(order)).withColumn("bytes", F.sum(F.octet_length("text")).over(order)).where((F.col("rank") == 1) | (F.col("rank") <= sample) & (F.col("bytes") <= sample_bytes // 2))
    found = texts.select("toxic", "text").mapInArrow(_hashed, "toxic int, lang long, word binary, stem binary").toArrow()
    rows = sorted(zip(*(found[c].to_pylist() for c in ("toxic", "lang", "word", "stem"))))
    rows = [rows[k] for k in np.random.default_rng(3).permutation(len(rows))]
    y = np.array([r[0] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y[0]) if len(y) else 0.0
        return net
    langs = np.array([r[1] for r in rows])
    data = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)) for r in rows]
    kept = int(len(rows) * CALIBRATION_SHARE)
    net.fit(data[kept:], y[kept:])
    net.calibrate(np.array([net.logits(_single(d))[0] for d in data[:kept]]), y[:kept], langs[:kept])
    return net


def _single(doc: tuple[np.ndarray, np.ndarray]) -> Words:
    words = Words.__new__(Words)
    words.word, words.stem = doc
    words.starts = np.array([0, len(doc[0])])
    words.lengths = np.array([len(doc[0]) - max(WIDTHS) + 1])
    return words


def _score(shared, keep: list[str], text: str, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Net = shared.value
        for batch in batches:
            data, offsets = tc.buffers(batch.column(text))
            for i, j in tc.blocks(offsets):
                score = net.scores(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in keep), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, *names])

    return run


def classify(df: DataFrame, net: Net, text_col: str = "text", out_cols: tuple[str, str] = ("score", "predicted"), keep: list[str] | None = None) -> DataFrame:
    """`df` with a score from 0 to 1 for each whole text, and 1 where it is at least 0.5, else 0.

    Null counts as an empty text, which has a score like any other.  `keep` names
    the columns to carry (default: all); those named like a result are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in out_cols]
    shared = df.sparkSession.sparkContext.broadcast(net)
    need = df.select(*dict.fromkeys([*keep, text_col]))
    schema = need.select(*keep).schema.add(out_cols[0], "double").add(out_cols[1], "integer")
    return need.mapInArrow(_score(shared, keep, text_col, out_cols), schema)
