"""Line dedup, mixing and chat formatting against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from tillworks.llm import chat_format, line_dedup, mixing
from tillworks.llm.queries import SQL


def test_lines_above_the_ratio_go(docs):
    rows = [(i, f"own {i}\n  menu  \nfoot", None, "a") for i in range(10)]
    rows += [(20 + i, "menu\nown", None, None) for i in range(4)]  # too few pages
    rows += [(30, None, None, "a"), (31, "", None, "a"), (32, "menu", None, "a")]
    got = {r.doc_id: r for r in line_dedup.clean_lines(docs(rows)).collect()}
    assert got[3].text == "own 3" and (got[3].n_lines, got[3].n_dropped) == (3, 2)
    assert got[21].text == "menu\nown" and got[21].n_dropped == 0
    assert got[30].text is None and got[30].n_lines == 0
    assert got[31].text == "" and got[32].text == ""


def test_line_dedup_odd_rows(odd, docs):
    clash = odd.withColumns({"_site": F.lit(1), "_drop": F.lit(2), "_n_lines": F.lit(3)})
    assert line_dedup.drop_site_lines(clash).count() == odd.count()
    same = line_dedup.drop_site_lines(odd).select(odd.columns)
    assert same.exceptAll(odd).isEmpty()
    assert line_dedup.clean_lines(docs([])).count() == 0


def _levels(sizes):
    total, weights = 1.5 * sum(s for _, s in sizes), {}
    order = sorted((k for k, _ in sizes if k is not None)) + [k for k, _ in sizes if k is None]
    for i, k in enumerate(order):
        weights[k] = (3, 1, 2)[i % 3]
    capped = set()
    while True:
        left = total - sum(2 * s for k, s in sizes if k in capped)
        free = sum(w for k, w in weights.items() if k not in capped)
        targets = {k: 2 * s if k in capped else left * weights[k] / free for k, s in sizes}
        over = {k for k, s in sizes if targets[k] > 2 * s + 1e-9}
        if not over:
            return targets
        capped |= over


def test_mixing_targets_and_reruns(docs, prose):
    rows = []
    for s, source in enumerate(["b", "a", None, "c", "dé"]):
        for i in range(60 + 40 * s):
            rows.append((1000 * s + i, " ".join(prose(i + s, 5 + (i * 7) % 90)), None, source))
    df = docs(rows)
    got = mixing.taken_words(df).collect()
    source_of = {r[0]: r[3] for r in rows}
    sizes: dict = {}
    for r in got:
        sizes[source_of[r.doc_id]] = sizes.get(source_of[r.doc_id], 0) + r.size
        assert 0 <= r.taken <= 2 * r.size
    want = _levels(list(sizes.items()))
    taken: dict = {}
    for r in got:
        k = source_of[r.doc_id]
        assert r.source_size == sizes[k] and abs(r.target - want[k]) < 1e-6
        taken[k] = taken.get(k, 0) + r.taken
    for k, t in want.items():
        assert abs(taken[k] - t) <= 0.06 * t
    again = mixing.taken_words(df.repartition(7)).collect()
    assert sorted(got) == sorted(again)


def test_mixing_odd_rows(odd, docs):
    got = mixing.taken_words(odd)
    assert got.count() == odd.count()
    assert {r.size for r in got.filter("doc_id in (1, 2, 3)").collect()} == {0}
    assert mixing.taken_words(docs([])).count() == 0
    assert mixing.taken_words(docs([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0
    sized = odd.withColumn("size", mixing.n_words(F.col("text"))).withColumn("copies", F.lit("x"))
    mixed = mixing.mix(sized)
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\</s> \\[INST] [\\\\/INST]", "a[/INST", "<<s>", "", None]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty * 2)]
    rows += [(2, 0, "user", "alone"), (3, 1, None, "x"), (3, 1, "assistant", "y"),
             (3, None, "assistant", "first"), (None, 0, "assistant", "no id"),
             (4, 0, "as</s>k", "x"), (4, 0, "as</s>k", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digest(df.withColumn("end", F.lit(1))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
                        for r in rows if r[0] == conv))
        told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss)
    assert chat_format.digest(df.limit(0)).count() == 0


def test_each_reply_is_an_example_of_its_own(spark):
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(["system", "user", "assistant", "user",
                                                      "assistant", "user"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.prefix_targets(df).orderBy("example").collect()
    assert [r.loss_length for r in got] == [2, 2, None]
    for r, text in zip(got, ["t2", "t4"]):
        assert r.formatted[r.loss_start: r.loss_start + r.loss_length] == text
        assert r.formatted.endswith(text + "</s>")
    assert got[0].formatted == got[1].formatted[: len(got[0].formatted)]
    assert not CONTROL.search(chat_format.OPEN.replace("[INST]", ""))


def test_sql_is_there_for_the_native_operators():
    assert {"op1_decontaminate", "op8_line_dedup", "op9_mixing", "op10_chat_format"} <= set(SQL)


def test_mixed_rows_agree_with_mix_and_keep_every_name(docs, prose):
    """Names of helper columns, repeated rows and NULL ids; the copies are those of mix."""
    rows = [(i, " ".join(prose(i, 5 + i % 40)), "en", f"s{i % 3}") for i in range(150)]
    rows += [(None, "no id", "en", None)] * 40 + [(7, "same", "en", "s0")] * 200 + [(8, None, None, "s1")]
    clashes = ["_rate", "_start", "row", "row_hash", "tie", "at", "lane", "n", "copy", "target"]
    df = docs(rows).withColumns({c: F.lit(7.5) for c in clashes})
    size = mixing.n_words(F.col("text"))
    got = mixing.mixed_rows(df, size)
    assert got.columns == [*df.columns, "copy_"]
    expected = mixing.mix(df.withColumn("size", size))
    assert {"_rate", "_start", "row", "n"} <= set(expected.columns)
    counts = lambda x, n: {
        (r[0], r[1]): r[2] for r in x.groupBy("doc_id", "text").agg(n).collect() if r[2]}
    assert counts(got, F.count("*")) == counts(expected, F.sum("copies"))
    assert got.filter("copy != 7.5 OR `_rate` != 7.5 OR target != 7.5").isEmpty()
    again = mixing.mixed_rows(df.repartition(7), size)
    assert again.exceptAll(got).isEmpty() and got.exceptAll(again).isEmpty()
    assert mixing.mixed_rows(docs([]), size).isEmpty()
