"""The shingle join and its components against brute force."""

import random
import re

from siltstone.llm import ngram_join
from siltstone.llm.common import Workspace
from siltstone.llm.components import components, stars

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    ids = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted(((doc, len(s), ids.get(find(i))) for i, (doc, s) in enumerate(sets)), key=str)


def edited(r, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = r.choice(vocabulary)
    return out


def documents(seed, groups, copies, length, alone):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(length)]
        texts += [edited(r, base, r.choice([0, 1, 1, 2, 3, 4, 5, 6, 8]), vocabulary) for _ in range(copies)]
        texts.append(base[: int(length * 0.8)])
        texts.append(base + [r.choice(vocabulary) for _ in range(length // 5)])
    for _ in range(alone):
        own = [r.choice(vocabulary) for _ in range(r.randrange(1, 200))]
        texts.append(own + passage if r.random() < 0.5 else own)
    r.shuffle(texts)
    return [(i, " ".join(t).title() if i % 5 == 0 else " ".join(t)) for i, t in enumerate(texts)]


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.near_duplicates(docs, **options).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == plain_components(rows)


def test_groups_of_near_copies(spark):
    check(spark, documents(1, groups=6, copies=12, length=90, alone=60))


def test_large_group_with_common_shingles(spark):
    check(spark, documents(2, groups=1, copies=220, length=120, alone=80))


def test_short_texts_and_shorter_prefixes(spark):
    check(spark, documents(3, groups=12, copies=6, length=14, alone=40), lengthen=0.01)


def test_awkward_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ngram_join.near_duplicates(odd_docs).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == plain_components(rows)
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 7, 8, 9, None]
    assert ngram_join.keep_one(no_docs).count() == 0


def test_rows_without_ids(spark):
    texts = ["one two three four five six seven", "other words that stand alone in here", "one two three four five six seven", "", ""]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(4, texts[1])], "doc_id long, text string")
    got = sorted((x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(docs).collect() if x.n_shingles and x.component_id)
    assert got == [(3, 4), (3, 4)]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, texts[0]), (4, texts[1]), (None, ""), (None, "")], key=str)


def test_components_of_paths_and_stars(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000), (9, 9)]
    edges = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in components(df, Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(201)}}
    assert components(df.limit(0), Workspace(spark, "test")).count() == 0


def test_maps_tell_sets_apart_that_are_half_alike(spark):
    r = random.Random(6)
    common = [r.choice(range(10**6)) for _ in range(480)]
    texts = [" ".join(map(str, common + [r.randrange(10**6) for _ in range(130)])) for _ in range(2)]
    words = ngram_join.word_hashes()
    sets = [ngram_join.shingles(t, words) for t in texts]
    own = ngram_join.NgramJoin(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    own.tokens = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, n long, tokens binary")
    a, b = ([v & (1 << 64) - 1 for v in row[1:]] for row in sorted(own.parity().collect()))
    apart, both = sum((u ^ v).bit_count() for u, v in zip(a, b)), sum(map(len, sets))
    assert apart <= len(set(sets[0].tolist()) ^ set(sets[1].tolist())) and 175 * apart > 25 * both


def test_large_group_in_two_halves_meets_once(spark):
    """Copies of a text and of its edited copy: leaders join them, so that they don't meet all-against-all."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [r.choice(vocabulary) for _ in range(400)]
    halves = [base, edited(r, base, 6, vocabulary)]
    rows = [(i, " ".join(edited(r, halves[i % 2], r.randrange(1, 5), vocabulary))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    own = ngram_join.NgramJoin(docs)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in own.result().collect()), key=str)
    assert got == plain_components(rows) and {x[2] for x in got} == {0}
    left = spark.read.parquet(own.ws.path("open"))
    assert left.select("node").distinct().count() < 40, left.select("node").distinct().count()


def test_components_end_with_stars_and_go_on_from_them(spark, monkeypatch):
    """Edges that are stars need no round; labels stand for the links behind them."""
    written, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    found = lambda edges: components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))
    labels = found([(i, i % 3) for i in range(3, 60)])
    assert written == ["cc-0"] and {x.node: x.component for x in labels.collect()} == {i: i % 3 for i in range(60)}
    more = stars(labels).unionByName(spark.createDataFrame([(58, 59), (70, 71)], "a long, b long"))
    got = {x.node: x.component for x in components(more, Workspace(spark, "test")).collect()}
    assert got == {**{i: min(i % 3, 1) for i in range(60)}, 70: 70, 71: 70}
