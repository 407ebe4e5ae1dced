"""Filter audit, exact copies and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tillworks.llm import exact_copies, filter_audit, periodic_runs
from tillworks.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# exact copies


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def _copies(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(_norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(norm.encode()).hexdigest()
        for n, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), n == 0, digest))
    return sorted(out, key=repr)


def _got_copies(df):
    return sorted((tuple(r) for r in exact_copies.copy_groups(df).collect()), key=repr)


def test_copies_of_all_lengths(docs, prose, monkeypatch):
    rng, rows = random.Random(3), []
    for i in range(60):
        words = prose(i % 23, rng.choice([0, 1, 40, 700, 2100]))
        if i % 5 == 0 and words:  # equal but for one word at either end
            words[rng.choice([0, -1])] = f"x{i % 3}"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words) + " " * (i % 4)))
    rows += [(100 + i, "hot " * 900) for i in range(40)]
    assert _got_copies(docs(rows)) == _copies(rows)


def test_copies_blocks_of_few_letters(docs):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("aé漢") for _ in range(rng.randrange(9)))) for i in range(300)]
    rows += [(500, "a\u0085b"), (501, "a b"), (502, "ab"), (503, "a b"), (504, "😀" * 5)]
    df = docs(rows)
    for block in (1, 2, 3):
        own, names = exact_copies.identities(df, block=block)
        by_name: dict = {}
        for r in own.join(names, "row").collect():
            by_name.setdefault((r.n_blocks, r.name), set()).add(r.text_sha256)
        assert all(len(v) == 1 for v in by_name.values())
        assert len(by_name) == len({_norm(t) for _, t in rows})


def test_a_block_of_many_documents_and_blocks_of_few(docs, monkeypatch):
    monkeypatch.setattr(exact_copies, "HOT", 0.05)
    monkeypatch.setattr(exact_copies, "BLOCK", 4)
    rows = [(i, "same" + "same" * (i % 3) + f"{i % 50:04}") for i in range(200)]
    assert _got_copies(docs(rows)) == _copies(rows)


def test_copies_odd_rows(odd, docs, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _got_copies(odd) == _copies(rows)
    assert exact_copies.copy_groups(docs([])).count() == 0
    clash = odd.withColumns({c: F.lit(7) for c in (
        "row", "blocks", "hashes", "name", "n_blocks", "keep_id", "kept", "n_chars", "a", "b",
        "number", "names", "first", "_kept", "place")})
    got = exact_copies.mark_copies(clash)
    assert got.count() == odd.count() and got.filter("a = 7 AND place = 7").count() == odd.count()
    kept = exact_copies.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({_norm(t) for _, t in rows})


def test_copies_use_no_python_workers(odd):
    plan = exact_copies.mark_copies(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# filter audit


def _mask(rows, i, text):
    text = text or ""
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    copy = i is not None and any(
        j is not None and j < i and (t or "") == text for j, t, *_ in rows)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * capitals > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]


def _audit(rows, good, toxic):
    out = {}
    parts = sorted({r[3] or "" for r in rows})
    masks = [(r[3] or "", r[0], _mask(rows, r[0], r[1])) for r in rows]
    for part in parts:
        own = [(i, m) for p, i, m in masks if p == part]
        for order in permutations(range(5)):
            name = "".join("ABCDE"[f] for f in order)
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                out[part, name, step] = [
                    len(left), len(gone),
                    sum(m[f] for _, m in own) - len(gone),
                    sum(m[f] and sum(m) == 1 for _, m in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    shapley: dict = {}
    for (part, name, step), row in out.items():
        key = part, name[step - 1]
        shapley[key] = shapley.get(key, 0) + row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audit_docs(prose):
    rng, rows = random.Random(5), []
    for i in range(150):
        words = prose(i % 40, rng.choice([0, 30, 49, 50, 80]), rng.choice([30, 4000]))
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.2:
            words.append("a#b")
        rows.append((i, " ".join(words), None, rng.choice(["s", "t", "", None])))
    rows += [(900, "a b", None, "u"), (3, None, None, "s"), (None, "a b", None, "s"),
             (901, "a b", None, "u"), (901, "a b", None, "u")]
    return rows


def test_audit_against_each_order_in_turn(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 300)
    rows = _audit_docs(prose)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (901, None, 1), (777, 1, 1)]
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    got = filter_audit.interactions(filter_audit.flags(docs(rows)), label)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()}
    assert got == _audit(rows, good, toxic)


@pytest.mark.parametrize("bits", [63, 9])
def test_term_matrix_holds_every_count(docs, prose, monkeypatch, bits):
    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 500)
    monkeypatch.setattr(filter_audit, "TERM_BITS", bits)  # with few, most words share their hash
    rows = [(i, " ".join(prose(i, i * 7 % 200, 300))) for i in range(60)] + [(99, None), (98, "")]
    matrix, dictionary = filter_audit.term_matrix(docs(rows).select("doc_id", "text"))
    words = {r.term: r.word for r in dictionary.collect()}
    assert len(words) == len({w for _, t in rows for w in (t or "").split()}) == dictionary.count()
    assert any(t < 0 for t in words) == (bits < 63)
    shards, found = matrix.collect(), {}
    assert len(shards) > 3
    for s in shards:
        for i, row in enumerate(s.rows):
            a, b = s.starts[i], s.starts[i + 1]
            found[row.doc_id] = dict(zip((words[t] for t in s.terms[a:b]), s.counts[a:b]))
    for i, text in rows:
        want: dict = {}
        for w in (text or "").split():
            want[w] = want.get(w, 0) + 1
        assert found[i] == want


def test_audit_hands_on_little_at_once(spark, docs, prose, monkeypatch):
    """Texts and shards come to Python a few MB at once, a file's shards one by one; settings stay."""
    import pyarrow.parquet as pq

    limit, key, files = 6 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", []

    def measured(run, real=filter_audit.giving_back):
        def small(batches):
            for batch in batches:
                if batch.nbytes > limit:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return real(lambda batches: small(run(small(batches))))

    def settled(df, label, real=filter_audit.settle, **options):
        out = real(df, label, **options)
        files.extend(out.inputFiles() if label == "shards" else [])
        return out

    monkeypatch.setattr(filter_audit, "giving_back", measured)
    monkeypatch.setattr(filter_audit, "settle", settled)
    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 60_000)
    texts = [" ".join(prose(k, 1200, 10**6) + ["X" * 4000] * (k % 2)) for k in range(1000)]
    df = docs(list(enumerate(texts))).coalesce(1)
    got = {r.doc_id: r["mask"] for r in filter_audit.flags(df).collect()}
    assert got == {k: 4 * (k % 2) for k in range(1000)}
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in files]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert len(sizes) > 15 and set(sizes) == {1}
    assert spark.conf.get(key, None) is None


def test_audit_odd_rows(odd, docs, spark):
    label = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clash = odd.withColumns({c: F.lit(7) for c in ("part", "mask", "rows", "shard", "digest", "n")})
    got = filter_audit.interactions(filter_audit.flags(clash), label).collect()
    assert len(got) == 600 * len({r.source or "" for r in odd.collect()})
    none = filter_audit.interactions(filter_audit.flags(docs([])), label)
    assert none.count() == 0


# periodic runs


def _runs(words):
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            end = j + q
            inside = any(s <= i and end <= s + n and q % p == 0 for s, n, p in out)
            if j > i and end - i >= max(24, 3 * q) and not inside:
                out.append((i, end - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_all_periods(seed):
    rng, texts = random.Random(seed), []
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(5)):
            of = rng.choice([1, 2, 3, 50])
            piece = [b"%d" % rng.randrange(of) for _ in range(rng.randrange(1, 70))]
            long = rng.randrange(1, 1 + len(piece) * rng.choice([1, 2, 4, 9]))
            words += (piece * 9)[:long]
        texts.append(words)
    assert periodic_runs.runs_of(texts) == [_runs(words) for words in texts]


def test_runs_within_runs_and_long_ones():
    a, b = [b"0"], [b"0", b"1"]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic_runs.runs_of([b]) == [_runs(b)] and len(_runs(b)) > 10
    part = [b"%d" % i for i in range(3001)]
    assert periodic_runs.runs_of([[b"x"] * 200_000, part * 3, part * 2]) == [
        [(0, 200_000, 1)], [(0, 9003, 3001)], []]


def test_transform_is_exact():
    import numpy as np

    rows = np.random.default_rng(1).integers(0, periodic_runs.PRIME, (3, 64)).astype(np.uint64)
    there = periodic_runs.transform(rows)
    assert (periodic_runs.transform(there, inverse=True) == rows).all()
    root = pow(3, (periodic_runs.PRIME - 1) // 64, periodic_runs.PRIME)
    for k in (0, 1, 17, 63):
        want = sum(int(v) * pow(root, k * j, periodic_runs.PRIME) for j, v in enumerate(rows[1]))
        assert int(there[1][k]) == want % periodic_runs.PRIME


def _planted(i, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    return words


def test_digests_of_planted_documents(spark, docs, prose, odd, tmp_path):
    rows = [(i, " \n".join(prose(i, 40 + i * 13 % 500, 3000))) for i in range(200)]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    want, some = [], 0
    for i, text in rows:
        words = _planted(i, text)
        runs = _runs(words) if len(words) < 5000 else []
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        some += len(runs)
        want.append((
            i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert some > 10
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_runs_odd_rows(odd, docs):
    clash = odd.withColumns({"runs": F.lit(1), "start": F.lit(2), "_h": F.lit(3)})
    got = periodic_runs.periodic_runs(clash)
    assert got.count() == odd.count() and got.filter("start = 2 AND _h = 3").count() == odd.count()
    assert periodic_runs.periodic_runs(docs([])).count() == 0
    text = docs([(1, "go on " + "a b c " * 9), (2, None)])
    assert {r.doc_id: r.text for r in periodic_runs.without_repeats(text).collect()} == {
        1: "go on a b c", 2: ""}
