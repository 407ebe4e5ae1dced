"""The pipeline as a whole, against a plain version of its stages."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_models import invented
from test_pairs import groups, judge


def test_pipeline(spark, tmp_path):
    rng, rows, items = random.Random(8), [], [(1, invented("xa", 5000, 20))]
    for i in range(240):
        lang = sorted({"xa", "xb", "xc"})[i % 3]
        lines = [invented(lang, i, 12) for _ in range(2)] + [f"home {lang}"] * (i % 2)
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    rows += [(300 + i, rows[i][1] + " ka", rows[i][2], rows[i][3]) for i in range(0, 60, 2)]
    rows += [(400, rows[1][1] + " " + items[0][1], "xa", "s1"), (401, "123 456", None, "s1"),
             (402, None, None, None)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    texts = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    source = {r[0]: r[3] for r in rows}
    pages = {s: sum(source[i] == s for i in texts) for s in set(source.values())}
    count: dict = {}
    for i, t in texts.items():
        for line in {x.strip(" ") for x in t.split("\n")} - {""}:
            count[source[i], line] = count.get((source[i], line), 0) + 1
    texts = {i: "\n".join(
        x for x in t.split("\n")
        if not (count[source[i], x.strip(" ")] >= 5
                and count[source[i], x.strip(" ")] > 0.1 * pages[source[i]]))
        for i, t in texts.items()}
    roots = groups(texts)
    texts = {i: t for i, t in texts.items() if roots[i][1] == i}
    texts = {i: t for i, t in texts.items() if not judge(t, items)[-1]}

    assert {r.doc_id for r in got} <= set(texts)
    for r in got:
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text) and 1 <= r.copy <= 2
    total = sum(len(t.split()) for t in texts.values())
    taken = sum(len(r.text.split()) for r in got)
    assert abs(taken - 1.5 * total) < 0.1 * total
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_pipeline_odd_tables(spark, odd, tmp_path):
    """Clashing names, rows without labels, ties, repeated rows, and an empty table."""
    clashes = ["score", "lang_pred", "_read", "read_text", "size", "copies", "copy", "_text_hash",
               "_hash", "_doc", "_drop", "_site", "target", "row", "words"]
    rows = odd.withColumns({c: F.lit(7.5) for c in clashes}).drop("n_chars")
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    for name, lang, n in (("labelled", "en", 4), ("unlabelled", None, 4), ("empty", "en", 0)):
        (spark.createDataFrame([], odd.schema) if not n else
         rows.withColumn("lang", F.lit(lang).cast("string"))).write.parquet(
            f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(
            f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        if not n:
            assert got.isEmpty()
            continue
        assert got.columns == [*rows.columns, "copy_"]
        assert got.filter(" OR ".join(f"`{c}` != 7.5 OR `{c}` IS NULL" for c in clashes)).isEmpty()
        texts = {r.text for r in got.collect()}
        assert len(texts) >= 3 and texts <= {r.text for r in rows.collect()}
