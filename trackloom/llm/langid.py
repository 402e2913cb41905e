"""Language identification in two steps: the family first, then the language within it.

Features are relative frequencies of byte n-grams (hashed, A-Z folded, other ASCII
characters counted as a blank) over the whole text.  One linear support vector
machine per family, against the rest, picks the family; within it, one linear
machine for each pair of languages votes.  All are trained here by dual coordinate
descent on a sample of at most SAMPLE labelled texts of at most SAMPLE_BYTES
bytes together, shared out evenly between languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc

SAMPLE, SAMPLE_BYTES, BITS, ORDERS, ROUNDS, PENALTY = 4000, 16_000_000, 16, (2, 3, 4), 12, 10.0
# Families of common language codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id jv ms tl",
    "hellenic": "el",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[tc.IS_LETTER] = tc.LOWER[tc.IS_LETTER]
_ASCII = np.zeros(256, bool)
_ASCII[: 0x80] = tc.IS_LETTER[: 0x80]


def family_of(lang: str) -> str:
    """Family of a language code; a code that is not listed is a family of its own."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only:{lang}")


def _grams(part: np.ndarray, ends: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram at each byte; those that leave a document get bucket 0, which has no weight."""
    folded = _FOLD[part].astype(np.uint32)
    n = len(part)
    key = np.zeros(n, np.uint32)
    for k in range(min(order, n)):
        key[: n - k] = key[: n - k] * np.uint32(257) + folded[k:] + np.uint32(1)
    key *= np.uint32(0x9E3779B1)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA77)
    key >>= np.uint32(32 - bits)
    key[key == 0] = 1
    for k in range(1, order):
        at = ends - k
        key[at[at >= 0]] = 0
    return key


def _features(bits: int):
    """Sparse n-gram counts of each text, for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 64):
                batch = whole.slice(first, 64)
                data, offsets = tc.buffers(batch.column("text"))
                places, weights = [], []
                for k in range(len(batch)):
                    part = data[offsets[k] : offsets[k + 1]]
                    ends = np.array([len(part)])
                    own_places, own_weights = [], []
                    for o, order in enumerate(ORDERS):
                        counts = np.bincount(_grams(part, ends, order, bits), minlength=1)
                        counts[0] = 0
                        at = np.flatnonzero(counts)
                        own_places.append((at + (o << bits)).astype(np.int32))
                        own_weights.append((counts[at] / max(1, len(part))).astype(np.float32))
                    places.append(np.concatenate(own_places))
                    weights.append(np.concatenate(own_weights))
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "places": pa.array(places, pa.list_(pa.int32())), "weights": pa.array(weights, pa.list_(pa.float32()))})

    return run


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent."""
    weights, bias, dual = np.zeros(width, np.float64), 0.0, np.zeros(len(rows))
    share = np.where(signs > 0, len(signs) / (2 * max(1, (signs > 0).sum())), len(signs) / (2 * max(1, (signs < 0).sum())))
    slack = 1 / (2 * PENALTY * share)
    squares = np.array([float(v @ v) for _, v in rows]) + 1 + slack
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            slope = signs[i] * (weights[at] @ value + bias) - 1 + slack[i] * dual[i]
            new = max(0.0, dual[i] - slope / squares[i])
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                weights[at] += step * value
                bias += step
                dual[i] = new
    return weights, bias


class Model:
    """Machines of the two steps."""

    def __init__(self, langs: list[str], columns: np.ndarray, biases: np.ndarray, families: list[str], members: list[list[int]], pairs: list[tuple[int, int]], bits: int):
        self.langs, self.columns, self.biases, self.families, self.members, self.pairs, self.bits = langs, columns, biases, families, members, pairs, bits

    @classmethod
    def trained(cls, labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]], bits: int) -> Model:
        langs = sorted(set(labels))
        families = sorted({family_of(x) for x in langs})
        members = [[k for k, x in enumerate(langs) if family_of(x) == f] for f in families]
        width = len(ORDERS) << bits
        # One scale for all texts, so that a score needs sums of weights only.
        scale = 1 / max(1e-9, float(np.mean([np.sqrt(v @ v) for _, v in rows]))) if rows else 1.0
        rows = [(a, v * scale) for a, v in rows]
        lang = np.array([langs.index(x) for x in labels])
        of = np.array([next(f for f, own in enumerate(members) if k in own) for k in lang]) if rows else np.zeros(0, int)
        columns, biases, pairs = [], [], []

        def add(chosen: np.ndarray, signs: np.ndarray) -> None:
            w, b = _machine([rows[i] for i in chosen], signs, width)
            columns.append((w * scale).astype(np.float32))
            biases.append(b)

        if len(families) > 1:
            for f in range(len(families)):
                add(np.arange(len(rows)), np.where(of == f, 1.0, -1.0))
        for own in members:
            for a, b in combinations(own, 2):
                chosen = np.flatnonzero((lang == a) | (lang == b))
                add(chosen, np.where(lang[chosen] == a, 1.0, -1.0))
                pairs.append((a, b))
        return cls(langs, np.array(columns, np.float32).reshape(len(columns), width), np.array(biases), families, members, pairs, bits)

    def margins(self, part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(document, machine) margins of the documents of one block."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.columns)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full) or not len(self.columns):
            return out + self.biases
        for o, order in enumerate(ORDERS):
            key = _grams(part, offsets[1:][full], order, self.bits).astype(np.int64)
            for c, column in enumerate(self.columns):
                out[full, c] += np.add.reduceat(column[o << self.bits : (o + 1) << self.bits][key], offsets[full], dtype=np.float64)
        return out / np.maximum(1, np.diff(offsets))[:, None] + self.biases

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores."""
        n, f = len(margins), len(self.families) if len(self.families) > 1 else 0
        if f:
            best = margins[:, :f].argmax(1)
            odds = np.exp(np.clip(3 * (margins[:, :f] - margins[:, :f].max(1, keepdims=True)), -50, 0))
            score = 1 / odds.sum(1)
        else:
            best, score = np.zeros(n, int), np.ones(n)
        lang = np.zeros(n, int)
        for k, own in enumerate(self.members):
            here = np.flatnonzero(best == k)
            if not len(here):
                continue
            votes, sure = np.zeros((len(here), len(own))), np.zeros((len(here), len(own)))
            for c, (a, b) in enumerate(self.pairs):
                if a in own:
                    p = 1 / (1 + np.exp(-np.clip(3 * margins[here, f + c], -50, 50)))
                    i, j = own.index(a), own.index(b)
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    sure[:, i] += p
                    sure[:, j] += 1 - p
            top = (votes + sure / (len(own) + 1)).argmax(1)
            lang[here] = np.array(own)[top]
            if len(own) > 1:
                score[here] *= sure[np.arange(len(here)), top] / (len(own) - 1)
        return lang, np.clip(score, 0, 1)


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS) -> Model:
    """A model from the rows of `docs` that have a text and a language.

    At most `sample` rows are used, as many of each language as that allows
    (at least one), chosen by a hash of `key` (default: the text).  Of them those
    are taken, in that order, whose texts have at most `sample_bytes` bytes, shared
    out alike; the first text of a language always is.  n-grams fall into
    2**`bits` buckets an order.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(key if key is not None else F.col(text_col)).alias("pick")).where("lang is not null and text <> ''")
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return Model([], np.zeros((0, 1), np.float32), np.zeros(0), [], [], [], 4)
    each = max(1, sample // len(counts))
    odds = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * each / r["count"] + 0.001))])
    some = rows.where((F.col("pick") / 2.0**64 + 0.5) < odds[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("pick", "text")
    some = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    some = some.withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("rank") == 1) | (F.col("bytes") <= sample_bytes // len(counts)))
    found = some.select("lang", "text").mapInArrow(_features(bits), "lang string, places array<int>, weights array<float>").toArrow()
    labels = found["lang"].to_pylist()
    data = [(np.asarray(p.values.to_numpy(), np.int64), np.asarray(v.values.to_numpy(), np.float64)) for p, v in zip(found["places"], found["weights"])]
    order = sorted(range(len(labels)), key=lambda k: (labels[k], len(data[k][0]), data[k][1].tobytes()))
    return Model.trained([labels[k] for k in order], [data[k] for k in order], bits)


def _predict(shared, keep: list[str], text: str, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            column = batch.column(text)
            data, offsets = tc.buffers(column)
            for i, j in tc.blocks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                letters = np.concatenate([[0], np.cumsum(_ASCII[part])])
                lettered = letters[at[1:]] > letters[at[:-1]]
                for k in np.flatnonzero(~lettered & (np.diff(at) > 0)):
                    lettered[k] = bool(_LETTER.search(column[i + int(k)].as_py()))
                if model.langs:
                    lang, score = model.predict(model.margins(part, at))
                else:
                    lang, score, lettered = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, bool)
                said = [model.langs[x] if ok else "und" for x, ok in zip(lang.tolist(), lettered)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in keep), pa.array(said, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=[*keep, *names])

    return run


def identify(df: DataFrame, model: Model, text_col: str = "text", out_cols: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """`df` with the predicted language of each whole text and a score from 0 to 1.

    The prediction is a learned language, or `und` with score 0 where the text is
    null or has no letter, or where no language was learned.  `keep` names the
    columns to carry (default: all); those named like a result are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in out_cols]
    shared = df.sparkSession.sparkContext.broadcast(model)
    need = df.select(*dict.fromkeys([*keep, text_col]))
    schema = need.select(*keep).schema.add(out_cols[0], "string").add(out_cols[1], "double")
    return need.mapInArrow(_predict(shared, keep, text_col, out_cols), schema)
