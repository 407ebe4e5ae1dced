"""Decontamination, fingerprints, Jaccard join and passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillworks.llm import common, decontaminate, fingerprint, hashing, jaccard_join, passages
from tillworks.llm.components import components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def judge(text, items):
    words, hit, names = WORD.findall(lower(text)), set(), set()
    for item, body in items:
        own = WORD.findall(lower(body))
        for k in range(max(1, len(own) - 12) if own else 0):
            w = own[k: k + 13]
            for at in range(len(words) - len(w) + 1):
                if words[at: at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    names.add(str(item))
    ids = ",".join(sorted(names))
    return (len(words), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


def test_decontamination(spark, docs, odd, prose):
    items = [(1, " ".join(prose(1, 30))), (2, "Short ITEM"), (3, " ".join(prose(1, 30)[5:25])),
             (10, "one"), (4, None), (5, "..."), (6, "das große É"), (1, " ".join(prose(1, 30)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = " ".join(prose(7, 300))
    texts = [clean, clean + " " + " ".join(prose(1, 30)[3:20]).upper(), " ".join(prose(1, 30)[:12]),
             "a short, item! and ONE", "One one one", " ".join(prose(1, 30) * 3), "große É das große É",
             " ".join(prose(1, 13)), None, ""]
    df = docs(list(enumerate(texts)))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.judge(df, bench).collect()}
    for i, text in enumerate(texts):
        assert got[i] == judge(text, [x for x in items if x[1]]), i
    kept = decontaminate.decontaminate(df.withColumn("_doc", F.lit(1)), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i][-1]}
    assert decontaminate.judge(odd, bench).count() == odd.count()
    assert decontaminate.judge(df, bench.limit(0)).filter("n_hit > 0").isEmpty()
    assert decontaminate.judge(docs([]), bench).isEmpty()


def test_fingerprints(docs, odd, prose):
    texts = {i: " ".join(prose(i % 9, 40)) + "é" * (i % 3) for i in range(60)} | {60: None, 61: "x"}
    got = {r.doc_id: r for r in fingerprint.fingerprint_all(docs(list(texts.items()))).collect()}
    order = sorted(texts, reverse=True)
    by_text: dict = {}
    for i, nxt in zip(order, order[1:] + order[:1]):
        text, following = texts[i] or "", texts[nxt] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        differ = int(r.fingerprint, 16) ^ int(got[nxt].fingerprint, 16)
        assert r.near_next == 1 - differ.bit_count() / 64
    for i in (0, 50):
        mine = int(got[i].fingerprint, 16)
        near = sum((mine ^ int(r.fingerprint, 16)).bit_count() <= 3 for r in got.values()) - 1
        assert got[i].n_near == near
    assert got[1].n_near is None
    assert fingerprint.fingerprint_all(odd).count() == odd.count()
    assert fingerprint.fingerprint_all(docs([])).isEmpty()


def test_near_finds_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in range(6)]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    got = [tuple(r) for r in fingerprint.near(df, df).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if ((a ^ b) & mask).bit_count() <= 3}
    assert len(got) == len(want) and {g[:2] for g in got} == want


def shingle_set(text):
    w = lower(text).encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i: i + 5]) for i in range(len(w) - 4)])


def groups(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in texts}


def mutated(words, rng, share):
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def similar(prose):
    """Near copies of many sizes and shares, a large group, common passages and copies."""
    rng, texts = random.Random(5), {}
    common = prose(500, 60)
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 11, 14, 20, 33, 60, 120, 400):
        for k in range(6):
            words = prose(size, size)
            texts[len(texts)] = " ".join(mutated(words, rng, 0.03 * k) if k else words)
    for k in range(60):  # one group, spread about the limit
        texts[len(texts)] = " ".join(mutated(prose(900, 150), rng, 0.005 + 0.0012 * k))
    for k in range(40):  # texts that share a passage
        texts[len(texts)] = " ".join(prose(1000 + k, 50) + common + prose(2000 + k, 40))
    for k in range(15):
        texts[len(texts)] = " ".join(prose(900, 150)).upper()
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: " \t"}
    return texts


def test_jaccard_join(docs, similar, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.join_all(docs(list(similar.items()))).collect()}
    assert got == groups(similar)
    assert jaccard_join.join_all(odd).count() == odd.count()
    assert jaccard_join.join_all(docs([])).isEmpty()


def test_signatures_of_two_instances_may_be_equal_by_chance(docs, prose, monkeypatch):
    """With two bytes kept of each, many are equal, also among sets with no instance in common."""
    monkeypatch.setattr(jaccard_join, "_LOW", 2)
    bands, rng = jaccard_join.Bands(), random.Random(6)
    assert bands.band(50) == bands.band(40) + 1
    texts = {k: " ".join(prose(3000 + k, 54 if k % 2 else 44)) for k in range(120)}
    texts |= {200 + k: " ".join(mutated(texts[k].split(), rng, 0.02)) for k in range(40)}
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.join_all(docs(list(texts.items()))).collect()}
    assert got == groups(texts)


def test_pages_repeat_little_of_a_document(docs, prose, monkeypatch):
    """Signatures of 4 bytes, 16 more per document and bucket, and fewer buckets than partitions."""
    df = docs([(k, " ".join(prose(k, 400))) for k in range(200)])
    bands, made, heads = jaccard_join.Bands(), 0, 0
    for row in df.collect():
        tokens = jaccard_join.text_set(row.text.encode())
        own = np.concatenate([jaccard_join.signatures(tokens, i, bands)[0]
                              for i in bands.instances(len(tokens))])
        made, heads = made + len(own), heads + len(np.unique(own % np.uint64(64)))
    pages = jaccard_join._pages(df.repartition(1), 64).filter("page IS NOT NULL").collect()
    packed = sum(len(pa.compress(r.page, codec="lz4_raw", asbytes=True)) for r in pages)
    assert packed <= 4 * made + 16 * heads
    asked, real = [], jaccard_join._pages
    monkeypatch.setattr(jaccard_join, "_pages", lambda d, n, *x: asked.append(n) or real(d, n, *x))
    assert jaccard_join.join_all(df).count() == 200
    assert asked == [2] and df.sparkSession.conf.get("spark.sql.shuffle.partitions") == "4"


def test_workers_get_and_give_small_batches(docs, prose, monkeypatch):
    """Long texts come to Python, and pages and rows go back, a few MB at once; the session's
    setting is as before."""
    limit, key = 6 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

    def measured(run, real=jaccard_join.giving_back):
        def small(batches):
            for batch in batches:
                if batch.nbytes > limit:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return real(lambda batches: small(run(small(batches))))

    monkeypatch.setattr(jaccard_join, "giving_back", measured)
    texts = [" ".join(prose(k, 1200) + ["x" * 4000]) for k in range(400)]
    df = docs([(k, t) for k, t in enumerate(texts + texts)]).repartition(1)
    conf = df.sparkSession.conf
    assert conf.get(key, None) is None
    got = {r.doc_id: r.component_id for r in jaccard_join.join_all(df).collect()}
    assert got == {k: k % 400 for k in range(800)}
    assert conf.get(key, None) is None
    conf.set(key, "8m")
    try:
        with common.small_batches(df.sparkSession):
            assert conf.get(key) == "8m"
        assert conf.get(key) == "8m"
    finally:
        conf.unset(key)


def test_small_lots_send_copies_once(docs, prose, monkeypatch):
    """A task that has sent its signatures on still knows which sets they were of."""
    texts = [" ".join(prose(k, 300)) for k in range(60)]
    df = docs([(k, t) for k, t in enumerate(texts + texts)]).coalesce(1)

    def heads():
        pages = jaccard_join._pages(df, 1).filter("page IS NOT NULL").collect()
        return [int.from_bytes(r.page[:4], "little") for r in pages]

    assert heads() == [60]
    monkeypatch.setattr(jaccard_join, "_FLUSH", 2000)
    assert sum(heads()) == 60 and len(heads()) > 3


def test_sets_of_equal_ids_get_others(docs, similar, monkeypatch):
    real = jaccard_join.set_names
    monkeypatch.setattr(jaccard_join, "set_names", lambda tokens, seed: (
        real(tokens, seed)[0] % (1 << (63 if seed else 4)), real(tokens, seed)[1]))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.join_all(docs(list(similar.items()))).collect()}
    assert got == groups(similar)


def test_one_of_each(docs, similar, odd):
    df = docs(list(similar.items())).withColumn("_hash", F.lit("x")).withColumn("cls", F.lit(1))
    kept = {r.doc_id for r in jaccard_join.one_of_each(df).collect()}
    assert kept == {root for _, root in groups(similar).values()}
    ids = sorted(str(r.doc_id) for r in jaccard_join.one_of_each(odd).collect())
    assert ids == ["1", "2", "3", "4", "5", "6", "None"]


def test_every_similar_pair_shares_signatures(prose):
    """The pigeonhole argument by itself: sets at the limit meet in an instance."""
    bands, rng = jaccard_join.Bands(), np.random.default_rng(1)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 17, 24, 50, 130] * 12:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, n // 4 + 1))
        extra = rng.integers(0, 1 << 63, n).astype(np.uint64)
        keep = rng.permutation(a)[drop:]
        room = int(len(keep) / 0.75) - n
        b = np.unique(np.concatenate([keep, extra[: max(0, int(rng.integers(0, room + 1)))]]))
        common = len(np.intersect1d(a, b))
        if not jaccard_join.linked(common, len(a), len(b)):
            continue
        met = any(
            np.intersect1d(jaccard_join.signatures(a, i, bands)[0],
                           jaccard_join.signatures(b, i, bands)[0]).size
            for i in set(bands.instances(len(a))) & set(bands.instances(len(b))))
        assert met, (n, len(b), common)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(1, 80)]
    df = spark.createDataFrame([*links, (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    alone = {x for x in root if all(a == b for a, b in links if x in (a, b))}
    for x, r in root.items():
        assert x in alone or got.get(x, x) == r
    assert components(df.limit(0)).isEmpty()


def test_passages(docs, odd, prose):
    shared, rng = prose(77, 80), random.Random(4)
    fuzzy = [w if rng.random() > 0.04 else "changed" for w in shared]
    gap = shared[:40] + prose(5, 7) + shared[40:]
    texts = {10: prose(1, 90) + shared + prose(2, 40), 11: prose(3, 30) + shared,
             12: fuzzy + prose(4, 200), 13: prose(6, 60) + gap, 14: prose(8, 300),
             15: shared[:30] + prose(9, 100), 16: prose(10, 400), 17: prose(10, 400)}
    df = docs([(i, " ".join(w)) for i, w in texts.items()]).withColumn("a", F.lit(1))
    got = {(r.doc_a, r.doc_b): r for r in passages.shared_passages(df).collect()}
    assert {(10, 11), (10, 12), (10, 13), (16, 17)} == set(got)
    one = got[10, 11]
    assert (one.start_a, one.end_a, one.start_b, one.end_b) == (90, 170, 30, 110)
    assert one.identity == 1 and got[16, 17].end_b == 400
    assert got[10, 12].end_b >= 75 and got[10, 13].end_b == 60 + 87
    assert passages.shared_passages(odd).isEmpty()
    assert passages.shared_passages(docs([])).isEmpty()


def test_chains_rise_and_pay_for_gaps():
    found = passages.chains([(0, 0, 10), (12, 11, 10), (15, 400, 10), (30, 30, 10)])
    assert found[0] == [(0, 0, 10), (12, 11, 10), (30, 30, 10)]
    assert found[1] == [(15, 400, 10)]


def _shared_by_brute_force(a, b, least=50):
    """Maximal runs of equal words of two lists, by all diagonals: (start_a, start_b, words)."""
    found = []
    for d in range(-len(b) + 1, len(a)):
        run = 0
        for i in range(max(0, d), min(len(a), len(b) + d) + 1):
            if i < min(len(a), len(b) + d) and a[i] == b[i - d]:
                run += 1
            else:
                if run >= least:
                    found.append((i - run, i - run - d, run))
                run = 0
    return found


def test_passages_of_one_pair_with_other_text_between(docs, prose):
    """Several shared passages; gaps and chance matches between them lose none."""
    texts, rng = {}, random.Random(8)
    for k, gap in enumerate((20, 31, 45, 70, 100, 300, 700)):
        kept = [prose(100 * k + j, 60) for j in range(3)]
        phrase = prose(100 * k + 50, 16)  # shared too, but too short
        for side in range(2):
            filler = [prose(5000 + 100 * k + 10 * side + j, gap + rng.randrange(5)) for j in range(4)]
            texts[2 * k + side] = sum(
                ([*f, *p] for f, p in zip(filler, kept)), []) + filler[3][:12] + phrase + filler[3]
    rows = passages.shared_passages(docs([(i, " ".join(w)) for i, w in texts.items()])).collect()
    for k in range(7):
        a, b = texts[2 * k], texts[2 * k + 1]
        runs = _shared_by_brute_force(a, b)
        assert len(runs) == 3
        for p, q, n in runs:
            assert any(r.doc_a == 2 * k and r.doc_b == 2 * k + 1
                       and r.start_a <= p and p + n <= r.end_a
                       and r.start_b <= q and q + n <= r.end_b for r in rows), (k, p, q)
    assert all(r.identity >= passages.IDENTITY for r in rows)


def test_a_weak_end_does_not_hide_a_passage():
    """Blocks of few words in a row beside two halves of a passage, with one gap as wide."""
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    a, b, at, spots = [], [], 0, []
    for size, gap in ((9, 10), (9, 10), (9, 10), (40, 11), (40, 10), (9, 10), (9, 10), (9, 0)):
        same = fresh(size)
        a += [same, fresh(gap)]
        b += [same, fresh(gap)]
        spots += [(x, x) for x in range(at, at + size - passages.SEED + 1)]
        at += size + gap
    found = passages.passages(np.concatenate(a), np.concatenate(b), np.array(spots))
    assert any(x[0] <= 57 and x[1] >= 57 + 91 for x in found)


def _linked(rows):
    """Least document that each can be reached from by passages."""
    root: dict = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for r in rows:
        a, b = sorted((find(r.doc_a), find(r.doc_b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_passages_whose_seeds_have_several_hubs(docs, prose):
    """Hubs that hold too little of a passage do not keep the others that hold it apart."""
    own = lambda i, n=80: prose(900 + i, n, 10**6)
    p, r, s = prose(801, 60, 10**6), prose(802, 50, 10**6), prose(803, 90, 10**6)
    texts = {
        0: own(0) + p[:35] + own(1), 1: own(2) + p[-35:] + own(3), 2: own(4) + p, 3: p + own(5),
        10: own(6) + r[:49] + own(7), 11: own(8) + r[1:] + own(9), 12: own(10) + r, 13: r + own(11),
        20: own(12) + s[:30] + own(13), 21: s[20:60] + own(14), 22: own(15) + s[50:],
        23: own(16, 30) + s, 24: own(17, 9) + s + own(18)}
    rows = passages.shared_passages(docs([(i, " ".join(w)) for i, w in texts.items()])).collect()
    assert {(r.doc_a, r.doc_b) for r in rows} == {(2, 3), (12, 13), (23, 24)}
    spans = {r.doc_a: (r.start_a, r.end_a, r.start_b, r.end_b) for r in rows}
    assert spans == {2: (80, 140, 0, 60), 12: (80, 130, 0, 50), 23: (30, 120, 9, 99)}
    both = passages.passages_of_documents(docs([(i, " ".join(w)) for i, w in texts.items()]))
    assert {(r.doc_id, r.partner_id) for r in both.collect()} == {
        (2, 3), (3, 2), (12, 13), (13, 12), (23, 24), (24, 23)}


def test_links_of_many_documents_by_brute_force(docs, prose):
    """Pieces of a few passages in many documents: the same groups as by all pairs."""
    rng, texts = random.Random(12), {}
    sources = [prose(700 + k, 110, 10**6) for k in range(5)]
    for i in range(60):
        words = prose(2000 + i, 20, 10**6)
        for _ in range(2):
            source = rng.choice(sources)
            n = rng.choice((20, 35, 49, 50, 70, 90))
            at = rng.randrange(len(source) - n)
            words += source[at: at + n] + prose(3000 + 10 * i + len(words), 15, 10**6)
        texts[i] = words
    rows = passages.shared_passages(docs([(i, " ".join(w)) for i, w in texts.items()])).collect()
    got, linked = _linked(rows), 0
    for a in texts:
        for b in range(a):
            if _shared_by_brute_force(texts[b], texts[a]):
                linked += 1
                assert a in got and got[a] == got[b], (b, a)
    assert linked > 50


def test_links_whose_seeds_very_many_documents_hold(docs, prose, monkeypatch):
    """All pieces of a fuzzy passage, and all two that follow each other, are in many documents."""
    own = lambda i, n=70: prose(7000 + i, n, 10**6)
    r = prose(814, 96, 10**6)
    fuzzy = [f"x{i}" if i % 24 == 23 else x for i, x in enumerate(r)]
    texts = {k: own(k) + r[24 * (k % 3): 24 * (k % 3) + 48] + own(100 + k) for k in range(60)}
    texts |= {80: own(300) + r + own(301), 81: fuzzy + own(302), 82: own(303, 9) + fuzzy}
    df = docs([(i, " ".join(w)) for i, w in texts.items()])
    for block in (passages.BLOCK, 9):
        monkeypatch.setattr(passages, "BLOCK", block)
        rows = passages.shared_passages(df).collect()
        assert {(r.doc_a, r.doc_b) for r in rows} == {(80, 81), (80, 82), (81, 82)}
        assert all(r.end_b - r.start_b >= 95 for r in rows) and len(rows) == 3


@pytest.mark.parametrize("often", [1024, 30])
def test_partners_looked_at_together_are_those_compared_one_by_one(prose, monkeypatch, often):
    """Near copies, common lines of many lengths and repeats: no pair with a passage is set aside."""
    monkeypatch.setattr(passages, "OFTEN", often)
    rng, texts = random.Random(21), []
    line = prose(815, 49, 10**6)
    for k in range(120):
        words = prose(8000 + k, rng.choice([0, 3, 60]), 10**6)
        n = rng.choice([8, 20, 33, 38, 40, 42, 46, 49])
        part = line[:n] if rng.random() < 0.7 else line[-n:]
        words += part + prose(8500 + k % 9, rng.choice([0, 9, 70]), 10**6)
        words += mutated(prose(8600 + k % 4, 60, 10**6), rng, 0.3 * rng.random())
        texts.append(" ".join(words + part[:rng.choice([9, 49])] * (k % 5 == 0)).encode())
    block = passages.Block(list(range(120)), [[(7, True)]] * 120, texts)
    compared = set_aside = 0
    for i, a in enumerate(block.texts):
        met = block.partners(i, [(7, False)])
        likely = set(block.likely(a, met).tolist())
        assert met.sum() == 119 - i and len(likely) <= met.sum()
        for j in np.flatnonzero(met).tolist():
            found = passages._whole(a, block.texts[j], block.places[j])[1]
            assert not found or j in likely, (i, j)
            compared, set_aside = compared + bool(found), set_aside + (j not in likely)
    assert compared > 500 and set_aside > 500


def test_links_that_hubs_hide(docs, prose):
    """Fuzzy passages that no hub holds as a whole, and a hub with a passage's seeds before it."""
    own = lambda i, n=70: prose(950 + i, n, 10**6)
    p, r, s = (prose(k, 96, 10**6) for k in (811, 812, 813))
    fuzzy = lambda w: [f"x{i}" if i % 24 == 23 else x for i, x in enumerate(w)]
    pieces = lambda w, i: sum(
        ([*w[k:k + 24], *own(100 * i + k, 30)] for k in (72, 24, 48, 0)), [])
    texts = {
        # the hub has the pieces apart; no 50 equal words in a row
        0: pieces(p, 1), 1: own(1) + p, 2: own(2) + fuzzy(p),
        # more documents with the pieces than are compared each with each
        **{10 + k: own(10 + k) + pieces(r, 10 + k) for k in range(20)}, 40: own(3) + r, 41: fuzzy(r),
        # all pieces come first in the hub, then the passage
        50: pieces(s, 2) + own(4) + s, 51: own(5) + fuzzy(s)}
    df = docs([(i, " ".join(w)) for i, w in texts.items()])
    rows = passages.shared_passages(df).collect()
    assert {(r.doc_a, r.doc_b) for r in rows} == {(1, 2), (40, 41), (50, 51)}
    assert all(r.end_b - r.start_b >= 95 for r in rows)


def test_words_are_told_apart_by_their_hashes():
    text = bytes(random.Random(3).choices(b" \t\n\r\x0b\f\x00\x1cabABz\xc3\x85\xff", k=150_000))
    text += b" " + b"long" * 20_000 + b" LONG" + b"long" * 19_999 + b" " + b"x" * 65
    known: dict = {}
    words, hashes = text.lower().split(), hashing.spaced_words(text).tolist()
    assert len(words) == len(hashes)
    assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(known.values())) == len(known)
    assert not len(hashing.spaced_words(b"")) and not len(hashing.spaced_words(b" \n"))


def test_a_changed_stretch_is_aligned_across_insertions(docs, prose):
    """Every 7th word of a long stretch changed, one word inserted at each end of it."""
    words = prose(600, 500, 10**6)
    changed = [w if not 130 <= i < 370 or i % 7 else f"x{i}" for i, w in enumerate(words)]
    changed = changed[:130] + ["extra"] + changed[130:370] + ["extra"] + changed[370:]
    got = passages.shared_passages(docs([(1, " ".join(words)), (2, " ".join(changed))])).collect()
    assert [(r.start_a, r.end_a, r.start_b, r.end_b) for r in got] == [(0, 500, 0, 502)]
    assert got[0].n_same == 500 - sum(130 <= i < 370 and i % 7 == 0 for i in range(500))
