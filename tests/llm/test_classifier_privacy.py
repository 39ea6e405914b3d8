"""Quality classifier on held-out rows, and personal data against plain regular expressions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import classifier, privacy


def quality_docs(spark, n=600, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice(["th", "an", "ing", "er", "o", "st", "re"]) for _ in range(r.randrange(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randrange(20, 120))]
        good = i % 4 != 0
        if not good:
            own = [w + r.choice(["***", "%%%", "$$$"]) for w in own] if i % 8 else [w for w in own[:8] for _ in range(12)]
        rows.append((i, " ".join(own), "en"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = quality_docs(spark)
    model = classifier.QualityModel.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r.p for r in model.score(docs, "p").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100
    assert sum((got[i] >= 0.5) == (truth[i] == 1) for i in held) / len(held) > 0.95


def test_context_sums_by_brute_force(spark):
    texts = ["a b c! a", None, "", "b b b b", "a b c! a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    at, sign = classifier.index_vectors()
    want = defaultdict(lambda: np.zeros(classifier.DIM))
    for t in texts:
        ids = [zlib.crc32(w) % classifier.BUCKETS for w in classifier.words_of(t)]
        for i, x in enumerate(ids):
            for j in range(max(0, i - classifier.NEAR), min(len(ids), i + classifier.NEAR + 1)):
                if j != i:
                    for k in range(classifier.NONZERO):
                        want[x][at[ids[j], k]] += sign[ids[j], k]
    got = {r.bucket: [r[f"v{i}"] for i in range(classifier.DIM)] for r in classifier.context_sums(docs, chunk=3).collect()}
    for b, v in want.items():
        assert got.get(b, [0] * classifier.DIM) == v.tolist()


def test_pooling_in_blocks_is_pooling_at_once():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(classifier.BUCKETS, classifier.DIM)).astype(np.float32)
    ids = rng.integers(0, classifier.BUCKETS, 1000)
    assert np.allclose(classifier.pooled(ids, vectors), classifier.pooled(ids, vectors, block=7), atol=1e-5)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = quality_docs(spark, n=200)
    flipped = labels.withColumn("quality", classifier.F.when(classifier.held_out(), 1 - classifier.F.col("quality")).otherwise(classifier.F.col("quality")))
    a = classifier.QualityModel.fit(docs, labels).score(docs, "p").collect()
    b = classifier.QualityModel.fit(docs.repartition(3), flipped).score(docs, "p").collect()
    assert {r.doc_id: r.p for r in a} == {r.doc_id: r.p for r in b}


def test_classifier_on_awkward_rows(spark, odd_docs, no_docs):
    _, labels = quality_docs(spark)
    rows = classifier.QualityModel.fit(odd_docs, labels).score(odd_docs, "p").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.p <= 1 for r in rows)
    model = classifier.QualityModel.fit(no_docs, labels.limit(0))
    assert model.score(no_docs, "p").count() == 0
    assert {r.p for r in model.score(odd_docs, "p").collect()} == {0.5}


PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and plain_luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_by_brute_force():
    r = random.Random(8)
    pieces = ["a", "b@", "c.d", "@", "1.2.3.4", "255.256.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "+", "0", "-", " ", ".", "x_y", "é", "007.008.009.010", "1.2.3.45.6.7.8", "a@b.c@d.e", "\n", "%"]
    for _ in range(6000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert privacy.base_spans(text) == plain_spans(text), repr(text)


def test_long_runs_stay_fast():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 100_000 + "@", "@" * 100_000, "+1" + "(" * 100_000, "1." * 100_000):
        privacy.base_spans(text)


def test_disclosing_terms(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(120):
        own = [r.choice(words) for _ in range(30)]
        if i < 6:
            own[10:10] = ["kingfisher", "jo@x.org", r.choice(words)]
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in privacy.find(docs).collect()}
    for i, text in rows:
        base = plain_spans(text)
        shown = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and got[i].n_email == (i < 6)
        at = text.find("kingfisher")
        assert (f"term:{at}:{at + 10}" in got[i].spans) == (i < 6)
        if i >= 6:
            assert got[i].spans == shown
    clean = {x.doc_id: x.text for x in privacy.sanitise(docs).collect()}
    assert all("jo@x.org" not in t and "kingfisher" not in t for t in clean.values()) and clean[50] == rows[50][1]
    check_information(rows, got)


def check_information(rows, got, near=8, share=0.9, support=3):
    n_e, n_t, n_b, seen = Counter(), Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        spans = plain_spans(text)
        n_t.update({privacy.term_of(w) for w in text.split()} - {None})
        n_e.update({privacy.entity_of(k, text[a:b]) for a, k, b in spans})
        found = privacy.contexts(text, spans, near)
        n_b.update({(e, t) for e, t, *_ in found})
        for e, t, _, _, c in found:
            seen[e, t].add(c)
    flagged = {k for k, n in n_b.items() if len(seen[k]) >= support and math.log2(n * len(rows) / (n_t[k[1]] * n_e[k[0]])) >= share * math.log2(len(rows) / n_e[k[0]])}
    for i, text in rows:
        want = {(a, b) for e, t, a, b, _ in privacy.contexts(text, plain_spans(text), near) if (e, t) in flagged}
        assert {(d.start, d.end) for d in got[i].disclosing} == want


def test_more_candidate_terms_than_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"kestrel a@b.org other{i} kestrel") for i in range(5)], "doc_id long, text string")
    terms = spark.createDataFrame([("kestrel",), ("other1",), ("absent",)], "term string")
    few = {tuple(r) for r in privacy.term_counts(docs, terms).collect()}
    monkeypatch.setattr(privacy, "BROADCAST_TERMS", 1)
    assert {tuple(r) for r in privacy.term_counts(docs, terms).collect()} == few == {("kestrel", 5), ("other1", 1)}


@pytest.mark.parametrize("text", [None, "", "a@b.c +1 555 010 9999"])
def test_sanitised(text):
    out = privacy.sanitised(text, privacy.base_spans(text or ""), [])
    assert out == (None if text is None else "[email] [phone]" if text else "")


def test_privacy_on_awkward_rows(odd_docs, no_docs):
    rows = privacy.find(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == "" for r in rows)
    assert privacy.find(no_docs).count() == 0
    assert privacy.sanitise(odd_docs).count() == odd_docs.count()


def test_terms_of_an_entity_in_one_document(spark):
    rows = [(i, f"plain words everywhere and here other{i % 10}") for i in range(100)]
    far = " ".join(["plain words everywhere and here"] * 5)
    rows += [(200, f"Zanzibar {far} jo@x.org"), (201, f"{far} kim@y.org then osprey {far} osprey")]
    got = {x.doc_id: x for x in privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(d.start, d.end) for d in got[200].disclosing} == {(0, 8)}
    assert {(d.start, d.end) for d in got[201].disclosing} == {m.span() for m in re.finditer("osprey|then", rows[101][1])} and got[201].n_term == 3
    assert all(x.n_term == 0 for i, x in got.items() if i < 200)


def test_terms_are_marked_in_documents_without_the_entity(spark):
    rows = [(i, f"plain words other{i % 10}") for i in range(1500)] + [(2000, "kestrel jo@x.org"), (2001, "a Kestrel")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in privacy.find(docs).collect() if x.spans}
    assert got == {2000: "term:0:7,email:8:16", 2001: "term:2:9"}
    clean = {x.doc_id: x.text for x in privacy.sanitise(docs).collect()}
    assert (clean[2000], clean[2001], clean[3]) == ("[word] [email]", "a [word]", rows[3][1])
