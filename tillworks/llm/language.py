"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import fold, giving_back, map_text

FEATURES = 1 << 16
ORDERS = (2, 3)
SMOOTHING = 0.5
EVIDENCE = 60
UNKNOWN = "und"
_PIECE = 1 << 19  # code points of a text worked on at once
_LOT = 1 << 16  # code points from which texts are no longer put together
_ROWS = 1024  # texts of a batch held as Python objects at once
_CODES = 0x33480  # letters lie below


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_CODES)), bool, _CODES)


def _pieces(texts: list) -> Iterator[tuple[list[int], list[str]]]:
    """Lots of (row, text) of bounded size; a long text is cut, its cuts overlapping."""
    rows, lot, size = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        text = text.decode("utf-8", "replace").lower()
        for at in range(0, len(text), _PIECE):
            piece = text[max(0, at - max(ORDERS) + 1): at + _PIECE]
            rows.append(row)
            lot.append(piece)
            size += len(piece)
            if size >= _LOT:
                yield rows, lot
                rows, lot, size = [], [], 0
    if lot:
        yield rows, lot


def _ngrams(lot: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of a lot and the piece each belongs to; what is no letter reads as blank,
    and n-grams of blanks alone do not count."""
    gap = "\0" * (max(ORDERS) - 1)
    codes = np.frombuffer((gap + gap.join(lot) + gap).encode("utf-32-le"), np.uint32)
    known = codes < _CODES
    codes = np.where(known & letters[np.where(known, codes, 0)], codes, 0).astype(np.uint32)
    # the blanks before a piece belong to it
    piece = np.repeat(np.arange(len(lot)), [len(gap) + len(p) for p in lot])
    piece = np.concatenate([piece, np.full(len(gap), len(lot) - 1)])
    for n in ORDERS:
        mixed = np.full(len(codes) - n + 1, n, np.uint32)
        some = np.zeros(len(mixed), bool)
        for i in range(n):
            part = codes[i: len(codes) - n + 1 + i]
            mixed = (mixed ^ part) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            some |= part > 0
        yield (mixed % np.uint32(FEATURES)).astype(np.int64)[some], piece[: len(mixed)][some]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of each feature per language with the prior as last row.

    Takes lang and text; all labelled rows count. Each task sums its counts, so it emits at most
    languages x FEATURES rows; the driver gets the summed counts, of the same bound.
    """
    schema = "lang string, feature int, n long"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        letters = _letters()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                langs = batch.column(0).slice(at, _ROWS).to_pylist()
                texts = batch.column(1).slice(at, _ROWS).cast(pa.binary()).to_pylist()
                for lang in set(langs):
                    mine = counts.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                    these = [t for t, x in zip(texts, langs) if x == lang]
                    mine[FEATURES] += len(these)
                    for _, lot in _pieces(these):
                        for ids, _ in _ngrams(lot, letters):
                            mine[:FEATURES] += np.bincount(ids, minlength=FEATURES)
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(mine[at])], names=["lang", "feature", "n"])

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    summed = labelled.select("lang", "text").mapInArrow(giving_back(count), schema).groupBy(
        "lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    counts = np.zeros((FEATURES + 1, len(langs)))
    column = summed["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    counts[summed["feature"].to_numpy(int), column] = summed["n"].to_numpy()
    grams = counts[:FEATURES] + SMOOTHING
    logs = np.log(grams) - np.log(grams.sum(axis=0))
    prior = np.log(counts[FEATURES:]) - np.log(counts[FEATURES].sum() or 1)
    return langs, np.concatenate([logs, prior]).astype(np.float32)


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: bool = False
) -> DataFrame:
    """Replaces the text column by lang_pred and score; with ``keep`` the text stays, too.

    ``und`` with score 0 where the text is NULL or has no letter, or nothing was learned. The
    language is that of the greatest sum of the prior and all n-grams; ties go to the first. Since
    the n-grams of a text are far from independent, its score is no plain posterior: of a text
    with more than EVIDENCE n-grams, the sums are scaled down to so many before they are compared.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def start():
        letters = _letters()
        matrix = shared.value

        def score(texts: list) -> dict:
            sums = np.zeros((len(texts), max(1, len(langs))))
            grams = np.zeros(len(texts))
            for rows, lot in _pieces(texts):
                rows = np.array(rows)
                for ids, piece in _ngrams(lot, letters) if langs else ():
                    # the sparse count matrix of the lot times the log probabilities
                    at = np.flatnonzero(np.diff(piece, prepend=-1))
                    if len(at):
                        each = np.add.reduceat(matrix[ids], at, axis=0, dtype=np.float64)
                        np.add.at(sums, rows[piece[at]], each)
                        np.add.at(grams, rows[piece[at]], np.diff(at, append=len(ids)))
            some = grams > 0
            if langs:
                sums += matrix[FEATURES]
            best = sums.argmax(axis=1)
            sums -= sums.max(axis=1, keepdims=True)
            sums *= (np.minimum(grams, EVIDENCE) / np.maximum(grams, 1))[:, None]
            share = 1 / np.exp(sums).sum(axis=1)
            return {
                "lang_pred": [langs[b] if s else UNKNOWN for b, s in zip(best, some)],
                "score": np.where(some, share, 0.0)}

        return score

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs.drop("lang_pred", "score"), text, added, start, _ROWS, keep)


def held_out(parts: int = 4, part: int = 2):
    return F.coalesce(fold("doc_id", parts) == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a NULL doc_id is not held out."""
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
