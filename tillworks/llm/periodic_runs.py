"""Periodic runs of words, found by block convolution in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import SPACED_WORD, fields

#: shortest run, and the least number of periods that it holds
MIN_WORDS = 24
MIN_PERIODS = 3
SMALLEST = 8  # words of a block at the smallest scale: MIN_WORDS holds two and a period of 8
#: a prime with roots of unity of order 2^26, and a generator of its multiplicative group; so
#: periods up to 2^26 words are found, those of texts of 200 million words
PRIME = 469762049
GENERATOR = 3
CHUNK = 1 << 18  # words of the documents that are worked on together
_CELLS = 1 << 20  # numbers that are transformed at once

RUNS = T.ArrayType(T.StructType([
    T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // np.uint64(PRIME) * np.uint64(PRIME)


def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size/2 - 1 of a root of unity of order size, or of its inverse."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    powers = np.ones(1, np.uint64)
    step = pow(root, -1, PRIME) if inverse else root
    while len(powers) < size // 2:
        powers = np.concatenate([powers, _mod(powers * np.uint64(pow(step, len(powers), PRIME)))])
    return powers


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number theoretic transform of each row; the row length is a power of two up to 2^26.

    Each pass halves the spans and doubles the strides, so that the result is in order.
    """
    count, size = rows.shape
    powers = _roots(size, inverse)
    x = rows.reshape(count, size, 1)
    while x.shape[1] > 1:
        span, stride = x.shape[1] // 2, x.shape[2]
        low, high = x[:, :span], x[:, span:]
        turned = powers[:: size // (2 * span)][:span, None]
        difference = _mod((low + (np.uint64(PRIME) - high)) * turned)
        x = np.stack([_mod(low + high), difference], axis=2).reshape(count, span, 2 * stride)
    out = x.reshape(count, size)
    return _mod(out * np.uint64(pow(size, -1, PRIME))) if inverse else out


def _zero_mismatch(codes: np.ndarray, at: np.ndarray, size: int, base: int) -> np.ndarray:
    """For blocks at places ``at``: at which shifts base + 0 .. size - 1 they occur again.

    Sums of squared differences of a block and each place of the window of 2 * size words that
    follows, modulo PRIME: sums of squares less twice the products, which are one convolution.
    Zero is necessary, and sufficient but for sums that are multiples of PRIME.
    """
    block = codes[at[:, None] + np.arange(size)]
    window = codes[at[:, None] + np.arange(base, base + 2 * size)]
    turned = np.zeros_like(window)
    turned[:, 0] = block[:, 0]
    turned[:, size + 1:] = block[:, :0:-1]
    products = transform(_mod(transform(window) * transform(turned)), inverse=True)[:, :size]
    squares = np.zeros((len(at), 2 * size + 1), np.uint64)
    np.cumsum(_mod(window * window), axis=1, out=squares[:, 1:])
    here = _mod(np.sum(_mod(block * block), axis=1, dtype=np.uint64))
    there = squares[:, size: 2 * size] - squares[:, :size]
    return _mod(here[:, None] + there + np.uint64(2) * (np.uint64(PRIME) - products)) == 0


def _next_gap(codes: np.ndarray) -> np.ndarray:
    """Distance to the next place of the same word; as far as the end and beyond if there is none."""
    order = np.argsort(codes, kind="stable")
    gap = np.full(len(codes), 2 * len(codes) + 1, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _agreeing(codes: np.ndarray, at: int, end: int, period: int) -> int:
    """First place from ``at`` before ``end`` that differs from the word a period later."""
    step = 64
    while at < end:
        stop = min(end, at + step)
        differ = codes[at:stop] != codes[at + period: stop + period]
        if differ.any():
            return at + int(differ.argmax())
        at, step = stop, step * 2
    return end


def _agreeing_back(codes: np.ndarray, at: int, begin: int, period: int) -> int:
    """Least place from which on all words up to ``at`` equal those a period later."""
    step = 64
    while at > begin:
        stop = max(begin, at - step)
        differ = (codes[stop:at] != codes[stop + period: at + period])[::-1]
        if differ.any():
            return at - int(differ.argmax())
        at, step = stop, step * 2
    return begin


def find_runs(codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of documents laid end to end, by period and start.

    ``codes`` numbers the words, ``ends`` says where each document ends. A run of period q has at
    least MIN_PERIODS * q and MIN_WORDS words. For scales L = 8, 16, ...: with L <= q < 2L
    (and L = 8 for q < 8) it holds a whole block at a multiple of L and the block's repeat at
    distance q. So each scale looks for the zero-mismatch shifts of its blocks, from L to 2L - 1 and
    before that from 1 to 7, and extends them to stretches as long as words agree. A repeat within
    a known run of a period of at most L is at a multiple of that period and is passed over.
    Blocks with a word that does not recur within the shifts' reach, and blocks whose whole window
    lies in a known run, tell nothing new and are not transformed.
    """
    n = len(codes)
    if n < MIN_WORDS:
        return []
    starts = np.concatenate([[0], ends[:-1]])
    longest = int((ends - starts).max())
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    gap = _next_gap(codes)
    passes = [(SMALLEST, 0), (SMALLEST, SMALLEST)]
    while MIN_PERIODS * 2 * passes[-1][0] <= longest:
        passes.append((2 * passes[-1][0], 2 * passes[-1][0]))
    padded = np.concatenate([codes, np.arange(n, n + 4 * passes[-1][0])]).astype(np.uint64)
    reach = np.zeros(n, np.int64)  # how far the known run of a smaller period goes
    found: list[tuple[int, int, int]] = []

    def note(stretches: list[tuple[int, int, int]]) -> None:
        for start, end, period in stretches:
            if end - start >= max(MIN_WORDS, MIN_PERIODS * period):
                found.append((start, end, period))
                reach[start:end] = np.maximum(reach[start:end], end)

    for size, base in passes:
        at = np.arange(0, n - size + 1, size)
        widest = gap[: len(at) * size].reshape(-1, size).max(axis=1)
        own = owner[at]
        at = at[(at + size + max(base, 1) <= ends[own]) & (widest < base + size)
                & (ends[own] - starts[own] >= max(MIN_WORDS, MIN_PERIODS * base))
                & (reach[at] < at + base + 2 * size - 1)]
        rows = max(1, _CELLS // (2 * size))
        hits = [np.empty((2, 0), np.int64)]
        for i in range(0, len(at), rows):
            block, shift = np.nonzero(_zero_mismatch(padded, at[i: i + rows], size, base))
            hits.append(np.stack([at[i: i + rows][block], shift + base]))
        place, shift = np.concatenate(hits, axis=1)
        open_ = (shift > 0) & (place + size + shift <= ends[owner[place]])
        open_ &= reach[place] < place + size + shift
        place, shift = place[open_], shift[open_]
        order = np.lexsort((place, shift))
        place, shift = place[order], shift[order]
        cuts = np.flatnonzero(np.diff(shift, prepend=-1, append=-1))
        later = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            period, here = int(shift[i]), place[i:j]
            if base == 0:  # smaller periods first, and known to the larger ones
                here = here[reach[here] < here + size + period]
                note(_stretches(codes, starts, ends, owner, here, period, size))
            else:
                later += _stretches(codes, starts, ends, owner, here, period, size)
        note(later)
    return found


def _stretches(codes, starts, ends, owner, places, period, size) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches around the blocks that repeat at one distance."""
    out, done = [], -1
    for at in places.tolist():
        if at < done:
            continue
        own = owner[at]
        last = _agreeing(codes, at, int(ends[own]) - period, period)
        if last >= at + size:  # or else equal only modulo the prime
            first = _agreeing_back(codes, at, int(starts[own]), period)
            out.append((first, last + period, period))
            done = last
    return out


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period."""
    numbers = _Codes()
    sizes = np.array([len(words) for words in documents], np.int64)
    codes = np.fromiter(
        (numbers[w] for words in documents for w in words), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for start, end, period in find_runs(codes, ends):
        own = int(np.searchsorted(ends, start, side="right"))
        out[own].append((start - int(ends[own] - sizes[own]), end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return [w for w, k in zip(words, keep) if k] if runs else words


def _per_document(
    docs: DataFrame, text: str, added: list[T.StructField],
    make: Callable[[list[bytes], list[tuple[int, int, int]]], tuple],
) -> DataFrame:
    """Replace the text by columns made from its words and runs; CHUNK words at a time."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*fields(docs, *kept), *added])
    at = len(kept)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def piece(batch):
            words = [(t or b"").split() for t in batch.column(at).cast(pa.binary()).to_pylist()]
            made = [make(*pair) for pair in zip(words, runs_of(words))]
            columns = [batch.column(i) for i in range(at)]
            columns += [pa.array(list(values), arrow.field(f.name).type)
                        for f, values in zip(added, zip(*made))]
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema(
                [pa.field(n, c.type) for n, c in zip(arrow.names, columns)]))

        for batch in batches:
            begin = size = 0
            for i, length in enumerate(_byte_lengths(batch.column(at))):
                size += length
                if size >= CHUNK * 6:
                    yield piece(batch.slice(begin, i + 1 - begin))
                    begin, size = i + 1, 0
            if begin < batch.num_rows:
                yield piece(batch.slice(begin))

    return docs.select(*kept, text).mapInArrow(run, schema)


def _byte_lengths(texts) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by the column runs, an array of (start, length, period) in words.

    A run is a stretch with smallest period q of at least MIN_WORDS words and MIN_PERIODS
    periods, as long as it can be. Words are what white space (ASCII) separates; NULL and empty
    texts have no runs. Other columns pass, whatever their names; an old column runs is replaced.
    Every row counts for itself, so ties and repeated rows get the same runs. Nothing is shuffled;
    a task holds one Arrow batch and the words of CHUNK words' documents, or of one longer one.
    """
    kept = docs.drop("runs") if text != "runs" else docs
    return _per_document(
        kept, text, [T.StructField("runs", RUNS, False)],
        lambda words, runs: ([dict(zip(("start", "length", "period"), r)) for r in runs],))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each run cut to its first period and words joined by one blank.

    Texts without a run are returned with their words joined by one blank as well; NULL becomes
    empty. Columns keep their names and order.
    """
    return _per_document(
        docs, text, [T.StructField(text, T.StringType())],
        lambda words, runs: (b" ".join(collapse(words, runs)).decode(),)).select(*docs.columns)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a tenth of the documents turned into repeats of a part of theirs.

    Documents with crc32(doc_id) % 10 = 0: from word a on, words repeat with period p, which
    follow from crc32(doc_id) / 10 and the number of words. NULL doc_id: unchanged.
    """
    words = F.regexp_extract_all("text", F.lit(f"({SPACED_WORD})"), F.lit(1))
    known = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    g = F.floor(F.col("_h") / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        i = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(i, lambda i: F.element_at(
            words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    chosen = (F.col("_h") % 10 == 0) & F.col("text").rlike(SPACED_WORD)
    listed = known.withColumn("_words", F.when(chosen, words))
    return listed.select(
        "doc_id", F.when(F.col("_words").isNull(), F.col("text"))
        .otherwise(repeat(F.col("_words"))).alias("text"))


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = (None,) * 4
    for start, length, period in runs:
        if best[0] is None or length * best[2] > best[1] * period:
            best = (start, length, period, 1000 * length // period)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row of doc_id, text: number of runs, the most repetitive one, and digests.

    The run with the greatest length / period, then the least start, then the least period.
    """
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    added = [T.StructField(n, T.LongType()) for n in names]
    added += [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    return _per_document(docs.select("doc_id", "text"), "text", added, _digest)
