"""Split JSON documents against a whole parse, with ranges of every size."""

import io
import json
import random

import pytest

from trackloom.sources import documents as D


def value(r, depth=0):
    kind = r.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return r.choice([None, True, -1.5e-3, 12])
    if kind < 4:
        return "".join(r.choice(['"', "\\", "\\\\", "[", "{", "}", "]", ",", ":", "é", "😀", "a", "\n", " "]) for _ in range(r.randint(0, 12)))
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {f"k{r.randint(0, 9)}\"\\{i}": value(r, depth + 1) for i in range(r.randint(0, 4))}


def split(raw, size, member=None):
    """What ranges of `size` bytes find, states passed on as the operator does."""
    file = io.BytesIO(raw)
    read = D._reader(file)
    inside, depth, states = False, 0, []
    for start in range(0, len(raw), size):
        stop = min(start + size, len(raw))
        states.append((start, stop, inside, depth))
        quotes, out, in_ = D.summary(read, start, stop)
        depth += in_ if inside else out
        inside ^= quotes % 2 == 1
    assert not inside and depth == 0
    span = {}
    if member is not None:
        tops = [x for s in states for x in D._top_level({"path": "", "start": s[0], "stop": s[1], "inside": s[2], "depth": s[3]}, read)]
        tops.sort(key=lambda x: x["first"])
        at = [k for k, x in enumerate(tops) if x["key"] == member]
        if not at:
            return []
        span = {"first": tops[at[0]]["first"], "last": tops[at[0] + 1]["first"]}
    found = [D.keyed(text.decode()) for s in states for _, text in D.members(read, len(raw), *s, 1 if member is None else 2, **span)]
    return [(k, json.loads(v)) for k, v in found]


@pytest.mark.parametrize("window", [7, 64, 1 << 20])
@pytest.mark.parametrize("seed", range(12))
def test_ranges_find_what_a_whole_parse_finds(monkeypatch, seed, window):
    monkeypatch.setattr(D, "WINDOW", window)
    r = random.Random(seed)
    whole = {f"top{i}": value(r) for i in range(4)} | {"wanted": r.choice([[value(r, 1) for _ in range(9)], {f"x{i}": value(r, 1) for i in range(9)}, [], {}, "none", None]), "after": [1, 2]}
    raw = json.dumps(whole, ensure_ascii=seed % 2 == 0, indent=seed % 3 or None).encode()
    want = whole["wanted"]
    inner = list(want.items()) if isinstance(want, dict) else [(None, x) for x in want] if isinstance(want, list) else []
    for size in (len(raw), 200, 37, 11, 5):
        assert split(raw, size) == list(whole.items())
        assert split(raw, size, "wanted") == inner
        assert split(raw, size, "absent") == []
    items = [value(r) for _ in range(6)]
    raw = json.dumps(items).encode()
    for size in (len(raw), 13, 3):
        assert split(raw, size) == [(None, x) for x in items]


def test_documents_as_tables(spark, tmp_path):
    docs = [{"info": "x", "list": [{"id": 10 * d + k, "text": 'a "quoted", [text] \\'} for k in range(20)]} for d in range(3)]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc))
    (tmp_path / "empty.json").write_text("")
    for size in (1 << 20, 50):
        own = D.Documents(spark, f"file://{tmp_path}", size)
        rows = D.fields(own.items("list"), "id long, text string").select("v.*").collect()
        assert sorted(map(tuple, rows)) == sorted((x["id"], x["text"]) for d in docs for x in d["list"])
        assert sorted((r["key"], r["value"]) for r in own.items().where("key = 'info'").collect()) == [("info", '"x"')] * 3
    assert own.ranges.count() > 30
