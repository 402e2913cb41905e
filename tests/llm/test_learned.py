"""Language identification, toxicity, personal data and license scans."""

import random
import re

import pytest

from trackloom.llm import langid, licenses, pii, toxicity

WORDS = {
    "en": "the and house with water under through shop thing when".split(),
    "de": "der und haus mit wasser unter durch laden ding wenn".split(),
    "nl": "het en huis met water onder door winkel ding wanneer".split(),
    "fr": "le et maison avec eau sous par boutique chose quand".split(),
    "es": "el y casa con agua bajo por tienda cosa cuando".split(),
}


def sentences(n, seed):
    r = random.Random(seed)
    return [(lang, " ".join(r.choice(words) for _ in range(r.randint(4, 40)))) for _ in range(n) for lang, words in WORDS.items()]


def test_language_identification(spark):
    rows = [(k, text, lang, 1.0) for k, (lang, text) in enumerate(sentences(60, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.train(docs.where("doc_id % 4 <> 2"))
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 4
    got = langid.identify(docs, model).where("doc_id % 4 = 2").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the house"), (2, None), (3, ""), (4, "123 !!"), (None, "the"), (5, "中"), (6, "the house " * 5000)], "doc_id long, text string")
    only = langid.train(spark.createDataFrame([("the house", "en"), ("the house", "en"), (None, "de"), ("x", None)], "text string, lang string"))
    got = [(r["lang_pred"], r["score"]) for r in langid.identify(docs, only).collect()]
    assert got == [("en", 1.0), ("und", 0.0), ("und", 0.0), ("und", 0.0), ("en", 1.0), ("en", 1.0), ("en", 1.0)]
    nothing = langid.train(docs.select("text").where("false").selectExpr("text", "'en' as lang"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), only).collect() == []
    assert langid.family_of("xx") == "only:xx" and langid.family_of("en-GB") == "germanic"


def test_texts_shorter_than_an_n_gram(spark):
    rows = [(k, text, lang) for k, (text, lang) in enumerate([("a", "en"), ("ab", "de"), ("abc", "fr"), ("é", "es"), ("the house", "en"), ("das haus", "de")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    for n in range(1, len(rows) + 1):
        assert langid.identify(docs.limit(n), model).count() == n
    one_by_one = [langid.identify(docs.where(f"doc_id = {k}"), model).first()["lang_pred"] for k in range(len(rows))]
    assert one_by_one == [r["lang_pred"] for r in langid.identify(docs, model).collect()]


def toxic_rows(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = [r.choice(WORDS[r.choice(["en", "de"])]) for _ in range(r.randint(5, 60))]
        bad = k % 2
        if bad:
            words.insert(r.randint(0, len(words)), r.choice(["grobble", "snurk", "wazzle"]))
        out.append((k, " ".join(words), bad))
    return out


def test_toxicity(spark):
    rows = toxic_rows(600, 2)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(10**6, 1), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, net).collect()}
    held = [(d, y) for d, _, y in rows if d % 5 == 0]
    assert sum(got[d]["predicted"] == y for d, y in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    more = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "!!", 5), (4, "the " * 30_000 + "snurk", 5), (4, "the " * 30_000 + "snurk", 5)], "doc_id long, text string, score int")
    odd = toxicity.classify(more, net).collect()
    assert odd[0]["score"] == odd[1]["score"] == odd[2]["score"] and odd[3]["score"] == odd[4]["score"]
    assert toxicity.classify(more.limit(0), net).collect() == []


def test_toxicity_with_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        net = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["score"] for r in toxicity.classify(docs, net).collect()] == [want, want]


def plain_spans(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS[x[1]]))


def test_exact_spans_equal_regexes():
    r = random.Random(3)
    parts = list("a1b@.@.-+ 0()é٣") + ["4111111111111111", "255.", "1.2.3.4", "+1 (555) 555-1234", "a.b@c.de"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    key = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    rows = [(k, f'text {k} token = "{key[k % 7:]}{k}" and me{k}@mail.example.org') for k in range(40)]
    rows += [(100, None), (101, ""), (None, "x@y.org"), (102, "plain words only"), (102, "plain words only"), (103, "w " * 40_000 + "+1 (555) 555-1234")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pii", "2 as said")
    model = pii.train(docs)
    assert set(model.reliability) == {"secret"}
    got = pii.detect(docs, model, redacted_col="masked").collect()
    first = got[0]
    assert [s["kind"] for s in first["pii"]] == ["secret", "email"] and "@" not in first["masked"] and "[SECRET]" in first["masked"]
    assert got[40]["masked"] is None and got[40]["pii"] == [] and got[43]["masked"] == "plain words only"
    assert got[45]["pii"][0]["start"] == 80_000
    none = pii.train(docs.where("doc_id = 102"))
    assert none.weights is None and pii.detect(docs.limit(0), none).collect() == []


def test_labeler_reliability_follows_agreement():
    model = pii.Model()
    belief = model.estimate({("secret", (1, 1, 1, 1)): 500, ("secret", (-1, 0, -1, -1)): 500, ("secret", (1, 0, -1, 1)): 20})
    assert belief["secret", (1, 1, 1, 1)] > 0.95 > 0.05 > belief["secret", (-1, 0, -1, -1)]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_common_and_ascending():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
    same = licenses.words_of(licenses.TEMPLATES["mit-text"])[0]
    assert len(licenses.align(["x"] * 9 + same, same)) == len(same)


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit-text"]
    changed = mit.replace("free of charge", "gratis").replace("merge, publish,", "merge and publish,")
    line = licenses.TEMPLATES["mit-line"]
    rows = [(1, "word " * 3000 + changed + " word" * 3000), (2, f"{line}\n{line}\nmore"), (3, None), (4, ""), (5, "the license of the software is hereby granted"), (None, line), (2, f"{line}\n{line}\nmore")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license")).collect()
    found = {(r["doc_id"], r["license"]): r for r in got}
    assert set(found) == {(1, "mit-text"), (2, "mit-line"), (None, "mit-line")} and len(got) == 4
    assert 0.9 < found[1, "mit-text"]["coverage"] < 1 and found[1, "mit-text"]["start"] == 15_000
    hit = found[2, "mit-line"]
    assert hit["coverage"] == 1 and rows[1][1][hit["start"] : hit["end"]] == line.rstrip(".")
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_finds_itself(name):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    text = "some lines\nbefore it\n" + licenses.TEMPLATES[name] + "\nand after"
    assert (name, 1.0) in [(n, c) for n, c, *_ in scanner.scan(text)]
