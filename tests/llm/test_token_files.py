"""Chunks of token files, the cycle collector, and decoding from checkpoints."""

import gc
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trackloom.llm import ans
from trackloom.llm.queries import TOKENIZER


class Shared:
    """Stands for a broadcast value."""

    def __init__(self, value):
        self.value = value


def batches(rows, size):
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string())})


@pytest.fixture(scope="module")
def raw():
    with open(TOKENIZER, "rb") as f:
        return f.read()


def chunks_of(raw, rows):
    return [b for b in ans._tokenise(Shared(raw), 0)(batches(rows, 500))]


def test_shuffled_documents_make_few_chunks(raw, monkeypatch):
    monkeypatch.setattr(ans, "LEAST_TOKENS", 1000)
    rows = [(k, f"document number {k} " * 3) for k in range(3000)]
    assert len(chunks_of(raw, rows)) == 1
    random.Random(1).shuffle(rows)
    found = chunks_of(raw, rows)
    total = sum(b.column("n_tokens")[0].as_py() for b in found)
    assert len(found) <= total // 1000 + 1
    for b in found:
        ids = b.column("doc_ids")[0].as_py()
        assert ids == sorted(ids) and b.column("first_id")[0].as_py() == ids[0] and b.column("last_id")[0].as_py() == ids[-1]


def test_sorted_runs_one_after_the_other_stay_apart(raw, monkeypatch):
    monkeypatch.setattr(ans, "LEAST_TOKENS", 100)
    rows = [(k, "some words of a text") for k in [*range(500, 900), *range(0, 400)]]
    found = chunks_of(raw, rows)
    assert [(b.column("first_id")[0].as_py(), b.column("last_id")[0].as_py()) for b in found] == [(500, 899), (0, 399)]


def test_collector_is_on_again_however_the_task_ends(raw):
    assert gc.isenabled()
    run = ans._tokenise(Shared(raw), 0)(batches([(k, "x") for k in range(1000)], 10))
    next(run, None)
    run.close()
    assert gc.isenabled()

    def broken():
        yield from batches([(1, "x")], 1)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        list(ans._tokenise(Shared(raw), 0)(broken()))
    assert gc.isenabled()


def test_overlapping_sorted_partitions(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k}") for k in range(400)] + [(7, None), (7, "text 7"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as lengths", "2 as frame").repartition(4).sortWithinPartitions("doc_id")
    ans.write_tokens(df, f"file://{tmp_path}/t", TOKENIZER)
    got = sorted(ans.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(TOKENIZER)
    assert [r["doc_id"] for r in got] == sorted([d for d, _ in rows], key=lambda d: -1 if d is None else d)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    of = {(r["doc_id"], r["ids_crc32"]) for r in got}
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (d, zlib.crc32(np.array(ids, "<u4").tobytes())) in of


def test_a_very_long_text_is_one_document_of_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ans, "BLOCK_TOKENS", 1 << 14)
    long = " ".join(f"w{k}" for k in range(60_000))
    df = spark.createDataFrame([(1, "a"), (2, long), (3, "b")], "doc_id long, text string").coalesce(1)
    ans.write_tokens(df, f"file://{tmp_path}/t", TOKENIZER)
    got = sorted(ans.read_tokens(spark, f"file://{tmp_path}/t").collect())
    want = [*Tokenizer.from_file(TOKENIZER).encode(long, add_special_tokens=False).ids, 0]
    assert got[1]["n_tokens"] == len(want) and np.frombuffer(got[1]["ids"], "<u4").tolist() == want


@pytest.mark.parametrize("n", [1, 4095, 4096, 200_000])
def test_every_range_of_checkpoints(n, monkeypatch):
    monkeypatch.setattr(ans, "LANES", 64)
    monkeypatch.setattr(ans, "CHECKPOINT_STEPS", 32)
    ids = np.random.default_rng(n).zipf(1.4, n) % 3000
    table = ans.FrequencyTable.scaled(*np.unique(ids, return_counts=True))
    frame = ans.encode_frame(ids, table)
    marks, lanes = ans._HEAD.unpack_from(frame)[6], ans._HEAD.unpack_from(frame)[3]
    each = lanes * 32
    r = random.Random(n)
    for a, b in [(0, marks), *((x := r.randint(0, marks), r.randint(x, marks)) for _ in range(30))]:
        assert (ans.decode_frame(frame, table, a, b) == ids[a * each : b * each]).all()
