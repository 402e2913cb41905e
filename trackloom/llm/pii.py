"""Personal data by weak supervision.

Four kinds (email, ip, card, phone) have exact definitions; their spans are always
kept.  Further spans (secret, person, contact, account) come from candidates on which
four labelers vote: the regex labeler looks at a candidate's shape, the
gazetteer labeler at lists of known words and prefixes, the context labeler at cue
words before it, and the entropy labeler at how random it looks.  Votes of all
documents are counted by pattern; expectation-maximisation estimates how often each
labeler is right and how likely each pattern is personal data; a logistic span
classifier is trained on these likelihoods, over votes and features of the
span, and decides.  Patterns are counted over all candidates; the classifier is
fitted on at most SAMPLE candidates, chosen by a hash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "person", "contact", "account")
KINDS = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}
LABELERS = ("regex", "gazetteer", "context", "entropy")
SAMPLE, ROUNDS, CONTEXT = 20_000, 50, 40

# Gazetteers and cue words.
SECRET_PREFIXES = "AKIA ASIA ghp_ gho_ github_pat_ glpat- sk_live_ sk_test_ sk- xoxb- xoxp- AIza ya29. eyJ".split()
GIVEN_NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Maria Hans Klaus Sophie Pierre Marie Jean Jacques Carlos Juan Ana Luis Carmen Jose".split())
TITLES = "Mr Mrs Ms Dr Herr Frau Monsieur Madame Señor Señora".split()
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api key", "access key", "private key", "credential", "bearer"),
    "person": ("mr", "mrs", "ms", "dr", "name is", "name:", "named", "signed", "contact", "herr", "frau", "monsieur", "madame", "señor", "señora"),
    "contact": ("mail", "contact", "write to", "reach", "address"),
    "account": ("call", "tel", "phone", "mobile", "fax", "iban", "account", "card", "ssn", "social security", "passport"),
}
BENIGN = ("sha", "md5", "commit", "version", "isbn", "doi", "page", "chapter", "uuid", "checksum", "hash", "etag")

_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these begins where a run of digits does, so a look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])"),
    "person": re.compile(r"(?:" + "|".join(sorted(GIVEN_NAMES)) + r") [A-Z][a-z]+(?![^\W\d_])"),
    "contact": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63})+"),
    "account": re.compile(r"(?<![0-9A-Za-z.+-])(?:[A-Z]{2}[0-9]{2} ?)?[0-9](?:[ -]?[0-9]){6,30}(?![0-9A-Za-z-])"),
}

_TITLED = re.compile(r"(?:" + "|".join(TITLES) + r")\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?(?![^\W\d_])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four exact kinds, by start, then kind."""
    out = []
    if "@" in text:
        before = 0
        for m in _EMAIL.finditer(text):
            start = m.start()
            while start > before and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, "email", m.end()))
                before = m.end()
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), "phone", m.end()))
    out.sort(key=lambda x: (x[0], KINDS[x[1]]))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _cue(words: tuple[str, ...], before: str) -> bool:
    return any(w in before for w in words)


def votes(kind: str, span: str, before: str) -> tuple[int, int, int, int]:
    """What the four labelers say: 1 personal, -1 not, 0 nothing."""
    before = before.lower()
    letters, digits = sum(c.isalpha() for c in span), sum(c.isdigit() for c in span)
    if kind == "secret":
        mixed = digits >= 3 and letters >= 3
        shape = 1 if mixed and "--" not in span and "__" not in span and span.count("-") + span.count("_") <= 2 else -1
        listed = 1 if span.startswith(tuple(SECRET_PREFIXES)) else 0
        e = _entropy(span)
        random = 1 if e >= 3.2 and mixed else -1 if e < 2.8 or not digits else 0
    elif kind == "person":
        # A title, two names and a listed name are told apart by different labelers.
        words = span.split()
        titled = words[0].rstrip(".") in TITLES
        names = words[titled:]
        shape = 1 if len(names) > 1 and all(len(w) > 2 for w in names) else 0 if titled else -1
        listed, random = (1 if names[0] in GIVEN_NAMES else 0), 0
        before += " name: " * titled
    elif kind == "contact":
        shape, random = 1, 0
        listed = 1 if re.search(r"(?:com|org|net|edu|de|fr|es|uk|io)$", span, re.IGNORECASE) else 0
    else:
        shape = 1 if 7 <= digits <= 20 and (" " in span or "-" in span or letters) else 0
        listed = 1 if re.match(r"[A-Z]{2}[0-9]{2}", span) else 0
        random = -1 if len({c for c in span if c.isdigit()}) <= 2 else 0
    context = 1 if _cue(CUES[kind], before) else -1 if _cue(BENIGN, before) or kind in ("person", "account") else 0
    return shape, listed, context, random


def features(kind: str, span: str, said: tuple[int, ...]) -> list[float]:
    n = len(span)
    share = sum(c.isdigit() for c in span) / n
    return [1.0, *(float(v > 0) for v in said), *(float(v < 0) for v in said), math.log(n) / 4, share, sum(c.isupper() for c in span) / n, _entropy(span) / 5, *(float(kind == k) for k in MORE_KINDS)]


def _meets(taken: list[tuple[int, str, int]], at: int, start: int, end: int) -> bool:
    """Whether one of the spans from place `at` on (they ascend by start) meets start to end."""
    while at < len(taken) and taken[at][0] < end:
        if taken[at][2] > start:
            return True
        at += 1
    return False


def _places(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Places of a kind's candidates, in order; of persons that meet, the first."""
    spans = (m.span() for m in _CANDIDATES[kind].finditer(text))
    if kind != "person" or not (titled := [m.span() for m in _TITLED.finditer(text)]):
        yield from spans
        return
    last = 0
    for start, end in sorted([*spans, *titled]):
        if start >= last:
            yield start, end
            last = end


def candidates(text: str) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of all candidates outside the exact kinds."""
    taken = base_spans(text)
    has_digit = _DIGIT.search(text) is not None
    for kind in MORE_KINDS:
        if kind in ("secret", "account") and not has_digit or kind == "contact" and "at]" not in text and "at)" not in text:
            continue
        at = 0
        for start, end in _places(kind, text):
            if kind == "secret" and not _DIGIT.search(text, start, end) or kind == "person" and start and text[start - 1].isalpha():
                continue
            while at < len(taken) and taken[at][2] <= start:
                at += 1
            if _meets(taken, at, start, end):
                continue
            yield kind, start, end, votes(kind, text[start:end], text[max(0, start - CONTEXT) : start])


class Model:
    """How right each labeler is, by kind, and the span classifier."""

    def __init__(self) -> None:
        self.reliability: dict[str, dict[str, tuple[float, float]]] = {}
        self.weights: np.ndarray | None = None

    def estimate(self, counts: dict[tuple[str, tuple[int, ...]], int]) -> dict[tuple[str, tuple[int, ...]], float]:
        """Likelihood that a pattern of votes is personal data, by expectation-maximisation.

        A labeler that speaks is right with one probability on personal data and
        another elsewhere; both begin at 0.8 and 0.7 and are held by as many
        notional votes, so that few candidates cannot turn a labeler around.
        """
        out = {}
        for kind in sorted({k for k, _ in counts}):
            own = [(v, n) for (k, v), n in sorted(counts.items()) if k == kind]
            prior, right = 0.3, np.array([[0.8, 0.7]] * len(LABELERS))
            belief = np.zeros(len(own))
            for _ in range(ROUNDS):
                for i, (said, _) in enumerate(own):
                    yes, no = math.log(prior), math.log(1 - prior)
                    for j, v in enumerate(said):
                        if v:
                            yes += math.log(right[j, 0] if v > 0 else 1 - right[j, 0])
                            no += math.log(1 - right[j, 1] if v > 0 else right[j, 1])
                    belief[i] = 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))
                n = np.array([c for _, c in own], float)
                prior = min(0.9, max(0.01, (float(belief @ n) + 3) / (n.sum() + 10)))
                for j in range(len(LABELERS)):
                    v = np.array([said[j] for said, _ in own])
                    p, q = belief * n, (1 - belief) * n
                    right[j, 0] = min(0.98, max(0.55, (p[v > 0].sum() + 16) / (p[v != 0].sum() + 20)))
                    right[j, 1] = min(0.98, max(0.55, (q[v < 0].sum() + 14) / (q[v != 0].sum() + 20)))
            self.reliability[kind] = {name: (float(a), float(b)) for name, (a, b) in zip(LABELERS, right)}
            out |= {(kind, said): float(b) for (said, _), b in zip(own, belief)}
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on likelihoods, by Newton steps with a small ridge."""
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        self.weights = w

    def spans(self, text: str) -> list[tuple[int, str, int, bool]]:
        """(start, kind, end, whether exact) of all spans, by start, then kind; added ones overlap nothing."""
        base = base_spans(text)
        out = [(*s, True) for s in base]
        if self.weights is not None:
            more = []
            for kind, start, end, said in candidates(text):
                if float(np.array(features(kind, text[start:end], said)) @ self.weights) >= 0:
                    more.append((start, kind, end))
            last = -1
            for start, kind, end in sorted(more, key=lambda s: (s[0], KINDS[s[1]])):
                if start >= last:
                    out.append((start, kind, end, False))
                    last = end
        return sorted(out, key=lambda s: (s[0], KINDS[s[1]], s[2]))


def _pick(kind: str, said: tuple[int, ...], span: str) -> int:
    """A hash by which candidates are chosen; signed 64 bits."""
    return int.from_bytes(hashlib.blake2b(f"{kind}:{said}:{span}".encode(), digest_size=8).digest(), "little", signed=True)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind, votes, hash and features of all candidates; spans themselves, which may be long, stay behind."""
    for batch in batches:
        rows = [(kind, ",".join(map(str, said)), _pick(kind, said, span), features(kind, span, said)) for text in batch.column("text").to_pylist() if text for kind, start, end, said in candidates(text) for span in (text[start:end],)]
        yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.string()), "said": pa.array([r[1] for r in rows], pa.string()), "pick": pa.array([r[2] for r in rows], pa.int64()), "x": pa.array([r[3] for r in rows], pa.list_(pa.float64()))})


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """Reliabilities from all candidates of `docs`, and a classifier fitted on at most `sample` of them."""
    work = Scratch(docs.sparkSession, "pii")
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_collect, "kind string, said string, pick long, x array<double>")
    found = work.save(found, "candidates")
    model = Model()
    # At most one row for each kind and pattern of votes.
    counts = {(r["kind"], tuple(map(int, r["said"].split(",")))): r["count"] for r in found.groupBy("kind", "said").count().collect()}
    if counts:
        belief = model.estimate(counts)
        rows = found.orderBy("pick", "kind", "said", "x").limit(sample).collect()
        model.fit(np.array([r["x"] for r in rows]), np.array([belief[r["kind"], tuple(map(int, r["said"].split(",")))] for r in rows]))
    work.drop("candidates")
    return model


_SPANS = "array<struct<kind:string,start:long,end:long,exact:boolean>>"


def _detect(shared, keep: list[str], text: str, name: str, redacted: str | None):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [shared.value.spans(x or "") for x in texts]
            columns, names = [batch.column(c) for c in keep], list(keep)
            if redacted:
                columns.append(pa.array([None if x is None else mask(x, s) for x, s in zip(texts, found)], pa.string()))
                names.append(redacted)
            columns.append(pa.array([[{"kind": k, "start": a, "end": b, "exact": e} for a, k, b, e in s] for s in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, name])

    return run


def mask(text: str, spans: list[tuple[int, str, int, bool]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "pii", keep: list[str] | None = None, redacted_col: str | None = None) -> DataFrame:
    """`df` with an array of spans (kind, start, end, exact) of each whole text, by start, then kind.

    Places are code points, the end exclusive.  Null counts as an empty text.  With
    `redacted_col` the text with its spans masked is returned too (null stays
    null).  `keep` names the columns to carry (default: all); those named like a
    result are replaced.
    """
    results = [out_col, *[redacted_col] * bool(redacted_col)]
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]
    shared = df.sparkSession.sparkContext.broadcast(model)
    need = df.select(*dict.fromkeys([*keep, text_col]))
    schema = need.select(*keep).schema
    if redacted_col:
        schema = schema.add(redacted_col, "string")
    kind = df.sparkSession.createDataFrame([], f"x {_SPANS}").schema["x"].dataType
    return need.mapInArrow(_detect(shared, keep, text_col, out_col, redacted_col), schema.add(out_col, kind))
