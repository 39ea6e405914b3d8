"""Quality rules, URL reputation and mixing against plain Python."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import mixing, registry, rules, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = P.path("piece_bpe_32k.model")


def plain_base(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_by_brute_force():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "cé ", "\n", "d|# ", "\x0b", "\x85", "\xa0"]) for _ in range(r.randrange(80)))
        assert rules.base_counts(text)[1] == plain_base(text), repr(text)
    many = " ".join(str(i % 90000) for i in range(95000))
    assert rules.base_counts(many)[1] == plain_base(many)


def test_repeats_with_many_different_words():
    ids = list(range(3_000_000)) + [5, 6, 7, 8, 9, 10]
    assert rules.repeated_words(ids) == 12


def test_fertility_measures():
    f = rules.Fertility(open(MODEL, "rb").read())
    n, chars, share, entropy = f.measure(["\U0001f9ff".encode()] * 4, 4)  # the mark and four bytes
    assert n == 20 and chars == 0.2 and share == pytest.approx(0.8) and entropy == pytest.approx(math.log2(5))
    assert f.measure([], 0) == (0, 0.0, 0.0, 0.0)


def test_judge_rejects_outliers_and_keeps_the_rest(spark):
    r = random.Random(4)
    words = ["".join(r.choice(["the", "an", "ing", "er", "o", "st"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    rows = [(i, "en", " ".join(r.choice(words) for _ in range(100))) for i in range(120)] + [(500, "en", "☃☄★☂ " * 60 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {x.doc_id: x for x in rules.judge(docs, MODEL).collect()}
    assert not got[500].kept and sum(x.kept for x in got.values()) == 120


def test_judge_on_awkward_rows(odd_docs, no_docs):
    got = rules.judge(odd_docs, MODEL).collect()
    assert len(got) == odd_docs.count()
    for row, doc in zip(sorted(got, key=lambda x: (x.doc_id is None, x.doc_id, x.n_words)), sorted(odd_docs.collect(), key=lambda x: (x.doc_id is None, x.doc_id, len(WORD.findall(x.text or ""))))):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == plain_base(doc.text or "")
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
        assert not (row.base_failed and row.kept)
    assert rules.judge(no_docs, MODEL).count() == 0


def test_urls(spark):
    rows = [
        (1, "HTTP://Sub.Example.ORG/es/x?y#z"), (2, "http://a.example.org/en/1x"), (3, "http://org/q"), (4, "http://www.b.com/de/"),
        (5, None), (6, "no scheme"), (7, "http://borg/de"), (8, "http://bad.net/p"), (9, "http://c.org"), (10, "://x.com/fr/?a=://"), (8, "http://bad.net/p"),
    ]
    rows += [(100 + i, "http://bad.net/p%d" % i) for i in range(60)] + [(300 + i, "http://good.net/p%d" % i) for i in range(60)]
    pages = spark.createDataFrame([(*r, "h", "x") for r in rows], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(300 + i, 1) for i in range(60)] + [(300, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = {r.page_id: r for r in urls.filter_urls(pages, labels, registry.URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("sub.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block")
    assert (got[3].rule, got[4].rule, got[10].rule) == ("org/", "com/de/", "com/fr/")
    assert (got[5].host, got[5].path, got[5].rule, got[6].host) == ("", "", None, "")
    assert got[7].rule is None and (got[9].path, got[9].rule) == ("", None)
    assert got[8].verdict == "block" and got[300].verdict == "allow"
    assert urls.filter_urls(pages, labels, []).count() == len(rows)
    assert urls.filter_urls(pages.limit(0), labels.limit(0), registry.URL_RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, labels.limit(0), []).collect()} == {"allow"}


def test_registered_domains(spark):
    want = {
        "www.bbc.co.uk": ("bbc.co.uk", "co.uk"), "bbc.co.uk:8080": ("bbc.co.uk", "co.uk"), "a.b.example.com": ("example.com", "com"), "co.uk": ("co.uk", "co.uk"),
        "xco.uk": ("xco.uk", "uk"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "localhost": ("localhost", "localhost"), "": ("", ""), "shop.com.au": ("shop.com.au", "com.au"),
    }
    hosts = spark.createDataFrame([(k,) for k in want], "host string").select("host", urls.domain_of(urls.name_of(F.col("host"))).alias("domain"))
    assert {r.host: (r.domain, r.suffix) for r in hosts.withColumn("suffix", urls.suffix_of(F.col("domain"))).collect()} == want


def test_a_two_label_suffix_is_no_domain(spark):
    """Bad sites under co.uk do not block another one that has no labels."""
    pages = spark.createDataFrame([(i, f"http://bad{i % 2}.co.uk/{i}") for i in range(80)] + [(100 + i, f"http://good{i % 9}.co.uk/{i}") for i in range(90)] + [(999, "http://www.new.co.uk/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0) for i in range(80)] + [(100 + i, 1) for i in range(90)], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, labels, []).collect()}
    assert {got[i] for i in range(80)} == {"block"} and got[999] == "allow" and {got[100 + i] for i in range(90)} == {"allow"}


def h(seed, *values):
    """Spark's xxhash64 of a row."""
    out = 42
    for v in (seed, *values):
        if v is None:
            continue
        data = struct.pack("<q", v) if isinstance(v, int) and abs(v) >= 1 << 31 or isinstance(v, Long) else struct.pack("<i", v)
        out = xxhash.xxh64_intdigest(data, seed=out)
    return out - (1 << 64) if out >= 1 << 63 else out


class Long(int):
    pass


def plain_permuted(x, source, blocks, seed):
    for r in range(mixing.ROUNDS):
        key = h(seed, source, r) % blocks
        other = (key - x) % blocks
        if h(seed, source, r, Long(max(x, other))) & 1:
            x = other
    return x


def plain_mix(rows, block, seed, weights=(5, 2, 1)):
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    chunks = max(1, int(len(rows) ** 0.5))
    taken = {}
    for no, s in enumerate(names):
        own = sorted((h(seed, Long(d)) % chunks, h(seed, Long(d)), d, z) for d, source, z in rows if source == s)
        stream = [d for _, _, d, z in own for _ in range(z)]
        got, need, blocks, k = Counter(), int(target[s] + 0.5), -(-len(stream) // block), 0
        while need > 0:
            at = plain_permuted(k % blocks, no, blocks, seed) * block
            words = stream[at : at + block][:need]
            got.update(words)
            need -= len(words)
            k += 1
        taken |= {d: got[d] for _, _, d, _ in own}
    return {s: (sizes[s], target[s]) for s in names}, taken


def test_mix_by_brute_force(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["x", "x", "x", "y", "Z", "é", None, "tiny"]), r.randrange(0, 60)) for i in range(150)] + [(1000, "one", 3), (1001, "none", 0)]
    docs = spark.createDataFrame([(i, s, None if z == 0 else " ".join(["w"] * z), 1) for i, s, z in rows], "doc_id long, source string, text string, size int")
    stats, taken = plain_mix(rows, 16, 7)
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.source_size == stats[x.source][0] and x.target == pytest.approx(stats[x.source][1])
        assert x.taken == taken[x.doc_id] and x.taken <= 2 * x.size
    sums = defaultdict(int)
    for x in got:
        sums[x.source] += x.taken
    assert all(abs(sums[s] - stats[s][1]) <= 0.5 for s in stats)
    again = mixing.mix(docs.repartition(3), block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_permutation_is_a_bijection_and_inverts(spark):
    for blocks in (1, 2, 3, 7, 100, 1009):
        x = spark.range(blocks)
        forth = mixing.permuted(F.col("id"), F.lit(3), F.lit(blocks).cast("long"), 11)
        rows = x.select("id", forth.alias("p")).select("id", "p", mixing.permuted(F.col("p"), F.lit(3), F.lit(blocks).cast("long"), 11, inverse=True).alias("q")).collect()
        assert sorted(r.p for r in rows) == list(range(blocks)) and all(r.id == r.q for r in rows)


def test_slots_are_drawn_by_shard(spark):
    docs = spark.createDataFrame([(i, "aab"[i % 3], "w " * 50) for i in range(210)], "doc_id long, source string, text string")
    seen = []
    for seed in (7, 8):
        m = mixing.Mix(docs, block=8, seed=seed, per_shard=100)
        counts = {(c.source_no, c.shard): (c.before, c.slots_here) for c in m.counts.collect()}
        rows = m.slots.collect()
        assert sum(x.take for x in rows) == round(1.5 * 210 * 50)
        for source in (0, 1):
            own = sorted((x.slot, x.shard) for x in rows if x.source_no == source)
            assert [k for k, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
            for shard in {k for _, k in own}:
                mine = [k for k, at in own if at == shard]
                assert counts[source, shard] == (mine[0], len(mine))
        shards = {k for _, k in counts}
        assert len(shards) > 10 and len({n for _, n in counts.values()}) > 5
        seen.append(counts)
    assert seen[0] != seen[1]


def test_mix_on_awkward_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= x.taken <= 2 * x.size for x in got)
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_mixed_documents_hold_the_targets(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "b", "c", None]), " ".join(["w"] * r.choice([r.randrange(1, 50), r.randrange(300, 900)]))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want, words, most = {}, Counter(), Counter()
    taken = {}
    for x in mixing.mix(docs, block=16).collect():
        want[x.source], taken[x.doc_id] = x.target, (x.taken, x.size)
        most[x.source] = max(most[x.source], x.size)
    times = Counter()
    for x in mixing.mixed_documents(docs, block=16).collect():
        words[x.source] += len(x.text.split())
        times[x.doc_id] += 1
    assert all(abs(words[s] - want[s]) <= max(2 * most[s], 0.02 * want[s]) for s in want), (words, want)
    assert all(t // z <= times[i] <= -(-t // z) for i, (t, z) in taken.items())


def test_small_classes_are_judged(spark):
    r = random.Random(4)
    words = ["".join(r.choice(["the", "an", "ing", "er", "o", "st"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    junk = "\u2603\u2604\u2605\u2602 " * 60 + "end"
    rows = [(i, "en", text(100)) for i in range(60)] + [(200, "xx", junk), (201, None, junk), (202, "xx", text(100)), (203, "en", junk * 30)]
    got = {x.doc_id: x for x in rules.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string"), MODEL).collect()}
    assert not any(got[i].kept for i in (200, 201, 203) if not got[i].base_failed)
    bands = rules.bands(rules.measures(spark.createDataFrame(rows, "doc_id long, lang string, text string"), MODEL).withColumn("size_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 2)))
    found = bands.collect()
    assert {(b.band_lang) for b in found} == {"en", "xx", None} and all(b.low_entropy is not None for b in found)
    few = rules.judge(spark.createDataFrame(rows[:20] + rows[60:61], "doc_id long, lang string, text string"), MODEL)
    marks = {x.doc_id: x for x in few.collect()}
    assert all(marks[i].kept for i in range(20)) and not marks[200].kept
    wide = rules.bands(rules.measures(spark.createDataFrame(rows[:20] + rows[60:61], "doc_id long, lang string, text string"), MODEL).withColumn("size_class", F.lit(3).cast("long"))).collect()
    assert len(wide) == 2 and wide[0].low_byte_share == wide[1].low_byte_share and wide[0].high_byte_share < 0.5
