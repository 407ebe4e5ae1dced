"""N-gram Jaccard join by universe partitioning and the pigeonhole principle, exact.

A document is the set of its distinct word shingles. Two sets link when their Jaccard similarity
reaches 3/4; then their sizes differ by a third at most and their symmetric difference has at most
H = (sum of sizes) / 7 members. Sets are put into size bands such that linked sets lie in the same
or in neighbouring bands; a join instance serves one band and the next. Within an instance the
universe of shingle hashes is cut into m segments, and the part of a set in each segment gets one
signature. If a set has H + 1 parts that are not empty, any partner agrees with it in one of them.

What a set spends its signatures on is decided by cost. Whole parts are cheapest (one row for one
unit of the H + 1), so m is the least number that leaves enough of them and some to spare. A set
that falls short, by the chance of hashing, buys second units by one-deletion neighbourhoods of
its parts (a row per shingle); should that not do, its single shingles count too. Signatures that
very many sets share are the dearest: a set that has H + 1 parts besides those skips them. Only
sets that cannot (copies of each other, or texts made of common passages) are compared there, by
way of the least of them: their distances to it link most, and rule out others by the triangle
inequality; the rest is thinned by bitmaps and by members that no other set has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count
from operator import add

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import fields, giving_back, keep_hashes, partitions, small_batches
from tillworks.llm.components import components
from tillworks.llm.hashing import from_planes, mix, planes, spaced_words, word_set
from tillworks.session import settle

WORDS = 5
SPARE = 0.12  # share of signatures that a set can do without
WIDE = 8  # signatures of more sets than this are skipped by sets that can
SKETCH_WORDS = 16  # 64-bit words of a bitmap
_FLUSH = 1 << 19  # signatures held by a task before it sends them on
_SEEN = 1 << 16  # sets that a task knows it has sent
_ROUNDS = 3  # shuffle partitions whose signatures one bucket takes, one after the other
_LOW = 4  # bytes kept of a signature besides its bucket (4 at most); chance matches come out later


def linked(common, size_a, size_b):
    """100 * intersection >= 75 * union."""
    return 100 * common >= 75 * (size_a + size_b - common)


def text_set(text: bytes | None) -> np.ndarray:
    return word_set(spaced_words(text or b""), WORDS)


def set_names(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """Two numbers of a set: its id, not negative, and one that tells sets of equal ids apart."""
    both = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    return both >> 65, (both & ((1 << 64) - 1)) - (1 << 63)


class Bands:
    """Size bands, and per instance the number of segments."""

    def __init__(self) -> None:
        self.least, self.segments = [1], []

    def band(self, n: int) -> int:
        while self.least[-1] <= n:
            self.least.append(self.least[-1] * 4 // 3 + 1)
        return int(np.searchsorted(self.least, n, "right")) - 1

    def top(self, band: int) -> int:
        return self.least[band] * 4 // 3

    def needed(self, n: int, instance: int) -> int:
        """H + 1 for a set of n shingles: its largest partner decides."""
        if self.band(n) == instance:
            return (n + n * 4 // 3) // 7 + 1
        return (self.top(instance) + n) // 7 + 1

    def instances(self, n: int) -> list[int]:
        band = self.band(n)
        return [band] + [band - 1] * (band > 0 and 3 * n <= 4 * self.top(band - 1))

    def parts(self, instance: int) -> int:
        """Least m for which a set at the band's top expects enough parts that are not empty."""
        while len(self.segments) <= instance:
            n = self.top(len(self.segments))
            aim = (1 + SPARE) * self.needed(n, len(self.segments))
            low, high = 1, 4 * n
            while low < high:
                m = (low + high) // 2
                low, high = (low, m) if m * (1 - (1 - 1 / m) ** n) >= aim else (m + 1, high)
            self.segments.append(low)
        return self.segments[instance]


def signatures(tokens: np.ndarray, instance: int, bands: Bands) -> tuple[np.ndarray, int]:
    """A set's signatures in an instance, and its number of parts that are not empty."""
    m = bands.parts(instance)
    segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(segment, prepend=segment[:1] + np.uint64(1)))
    each = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.add.reduceat(each, at)
    place = segment * np.uint64(0x9E3779B97F4A7C15) + np.uint64((instance * 2 + 1) << 40)
    needed = bands.needed(len(tokens), instance)
    if len(at) >= needed:
        return mix(sums + place[at]), len(at)
    sizes = np.diff(at, append=len(tokens))
    several = np.repeat(sizes > 1, sizes)
    without = (np.repeat(sums, sizes) - each + place)[several]
    found = [mix(sums + place[at]), mix(without)]
    if np.minimum(sizes, 2).sum() < needed:
        found.append(mix(tokens + np.uint64(instance)))
    return np.unique(np.concatenate(found)), len(at)


def _pages(docs: DataFrame, buckets: int, seed: int = 0) -> DataFrame:
    """Documents with their set's names and size, and pages of signatures for each bucket."""
    schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("page", T.BinaryType()),
        *fields(docs, "doc_id"), T.StructField("text_hash", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("cls", "other", "n")]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, bands = to_arrow_schema(schema), Bands()
        seen: set[tuple[int, int]] = set()
        heads, sigs, held = [], [], 0

        def flush():
            nonlocal heads, sigs, held
            if not heads:
                return
            head = np.array(heads, np.int64)
            lengths = np.array([len(x) for pair in sigs for x in pair])
            every = np.concatenate([x for pair in sigs for x in pair])
            heads, sigs, held = [], [], 0
            # document * 2 + instance
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            bucket = (every % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
            order = np.argsort(bucket, kind="stable")
            edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            rest, owner = (every // np.uint64(buckets))[order], owner[order]
            pages, names = [], []
            for k in range(buckets):
                mine, low = owner[edges[k]: edges[k + 1]], rest[edges[k]: edges[k + 1]]
                if len(mine):
                    who, at = np.unique(mine // 2, return_inverse=True)
                    counts = np.bincount(at * 2 + mine % 2, minlength=2 * len(who))
                    top = np.concatenate([head[who, 1:], counts.reshape(-1, 2)], axis=1)
                    cut = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_LOW]
                    pages.append(len(who).to_bytes(4, "little") + head[who, 0].tobytes()
                                 + planes(top.T.ravel()) + cut.tobytes())
                    names.append(k)
            empty = [pa.nulls(len(pages), f.type) for f in list(arrow)[2:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array(pages, pa.binary()), *empty], schema=arrow)

        for batch in batches:
            names, sizes = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                tokens = text_set(text)
                sizes.append(len(tokens))
                name = set_names(tokens, seed) if len(tokens) else (None, None)
                names.append(name)
                if not len(tokens) or name in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(name)
                made = [signatures(tokens, x, bands) for x in bands.instances(len(tokens))]
                made += [(tokens[:0], 0)] * (2 - len(made))
                heads.append((name[0], len(tokens), made[0][1], made[1][1]))
                sigs.append([x[0] for x in made])
                held += sum(len(x[0]) for x in made)
                if held >= _FLUSH:
                    yield from flush()
            where = np.arange(len(sizes), dtype=np.int32) % buckets
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.nulls(len(sizes), pa.binary()), batch.column(0),
                 batch.column(1), *[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)],
                 pa.array(sizes, pa.int64())], schema=arrow)
        yield from flush()

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(giving_back(run), schema)


#: what a page has of each document besides its set's id of 8 bytes, a column after the other: size,
#: parts that are not empty in the instance of its own band and in the one before, and how many
#: signatures of each are in the page
_NUMBERS = 5


# kinds of rows that a bucket gives
DOCUMENT, PAIR, SHARED, SKIPPED = range(4)
_INSTANCES = 1 << 10


def _matches(pages: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: pairs of sets that share signatures few sets have, and how many; the members of
    the others; and how many of those each set has."""
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), *fields(pages, "doc_id", "text_hash"),
        *[T.StructField(c, T.LongType()) for c in (
            "a", "b", "other", "n", "n_b", "sig", "instance", "parts", "parts_b", "times")]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, bands = to_arrow_schema(schema), Bands()
        names, heads, lows = [], [], []
        bucket = 0

        def rows(kind: int, **columns):
            size = len(next(iter(columns.values())))
            for at in range(0, size, 1 << 16):
                part = {k: v[at: at + (1 << 16)] for k, v in columns.items()}
                n = len(next(iter(part.values())))
                part["kind"] = np.full(n, kind, np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[f.name], f.type) if f.name in part else pa.nulls(n, f.type)
                    for f in arrow], schema=arrow)

        for batch in batches:
            page = batch.column(1).to_pylist()
            at = [i for i, p in enumerate(page) if p is None]
            if at:
                docs = batch.take(pa.array(at))
                yield from rows(
                    DOCUMENT, doc_id=docs.column(2), text_hash=docs.column(3), a=docs.column(4),
                    other=docs.column(5), n=docs.column(6))
            for p, k in zip(page, batch.column(0).to_pylist()):
                if p is not None:
                    bucket, who = k, int.from_bytes(p[:4], "little")
                    end = 4 + who * 8
                    names.append(np.frombuffer(p, "<i8", who, 4).copy())
                    heads.append(from_planes(p, end, who * _NUMBERS).reshape(_NUMBERS, who))
                    cut = np.frombuffer(p, np.uint8, offset=end + who * _NUMBERS * 4)
                    low = np.zeros((len(cut) // _LOW, 4), np.uint8)
                    low[:, :_LOW] = cut.reshape(-1, _LOW)
                    lows.append(low.view("<u4").ravel())
        if not heads:
            return
        head = np.concatenate(heads, axis=1)
        ids, cls = np.unique(np.concatenate(names), return_inverse=True)
        names, heads = [], []
        low = np.concatenate(lows)
        lows = []
        size, parts = np.zeros(len(ids), np.int64), np.zeros((len(ids), 2), np.int64)
        size[cls], parts[cls] = head[0], head[1:3].T
        band = np.array([bands.band(n) for n in size.tolist()], np.int16)

        def of_signatures(low: np.ndarray, owner: np.ndarray):
            # members of each signature, a set once: copies from other tasks are the same set
            # what is kept of signatures of different instances may be equal by chance
            instance = band[owner // 2] - (owner % 2).astype(np.int16)
            order = np.lexsort((owner, instance, low))
            low, owner, instance = low[order], owner[order], instance[order]
            del order
            new = np.ones(len(low), bool)
            new[1:] = ((low[1:] != low[:-1]) | (instance[1:] != instance[:-1])
                       | (owner[1:] != owner[:-1]))
            low, owner, instance = low[new], owner[new], instance[new]
            cls = owner // 2
            start = np.ones(len(low), bool)
            start[1:] = (low[1:] != low[:-1]) | (instance[1:] != instance[:-1])
            at = np.flatnonzero(start)
            width = np.diff(at, append=len(low))
            found = [np.empty(0, np.int64)]
            for g in range(2, WIDE + 1):
                places = at[width == g][:, None] + np.arange(g)
                members = cls[places].astype(np.int64)
                for i, j in combinations(range(g), 2):
                    a, b = members[:, i], members[:, j]
                    near = 4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])
                    found.append(
                        (a[near] * len(ids) + b[near]) * _INSTANCES + instance[places[near, i]])
            pairs, times = np.unique(np.concatenate(found), return_counts=True)
            pairs, of = np.divmod(pairs, _INSTANCES)
            a, b = np.divmod(pairs, len(ids))
            yield from rows(
                PAIR, a=ids[a], b=ids[b], n=size[a], n_b=size[b], instance=of, times=times,
                parts=parts[a, band[a] - of], parts_b=parts[b, band[b] - of])
            wide = np.flatnonzero(np.repeat(width > WIDE, width))
            yield from rows(
                SHARED, a=ids[cls[wide]], n=size[cls[wide]], instance=instance[wide].astype(np.int64),
                sig=low[wide].astype(np.int64) * buckets + bucket)
            which, times = np.unique(owner[wide], return_counts=True)
            a, of = which // 2, band[which // 2] - which.astype(np.int64) % 2
            needed = [bands.needed(n, i) for n, i in zip(size[a].tolist(), of.tolist())]
            yield from rows(
                SKIPPED, a=ids[a], instance=of, times=times,
                parts=parts[a, which % 2] - np.array(needed, np.int64))

        owners = np.repeat(
            (np.repeat(cls, 2) * 2 + np.tile([0, 1], len(cls))).astype(np.int32),
            head[3:].T.ravel())
        for part in range(_ROUNDS):
            chosen = low % _ROUNDS == part
            yield from of_signatures(low[chosen], owners[chosen])

    return pages.repartitionById(buckets, F.col("bucket")).mapInArrow(giving_back(run), schema)


def _texts(classes: DataFrame, wanted: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """key (the set), text for the sets in the column a of ``wanted``, from their first document."""
    who = settle(classes.join(wanted, classes["cls"] == wanted["a"], "left_semi").select(
        F.col("cls").alias("key"), F.col("first.doc_id").alias("_doc"),
        F.col("first.text_hash").alias("_hash")), f"{label}-who")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), "text").withColumn(
        "_row", F.xxhash64("doc_id", "_text_hash"))
    # copies of a wanted text under another doc_id need not be shuffled
    some = keep_hashes(hashed, "_row", who.select(F.xxhash64("_doc", "_hash")))
    # the hash of the text goes along, so rows that share a doc_id are told apart
    return settle(some.drop("_row").join(
        who, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")),
    ).select("key", "text"), f"{label}-texts")


def _verify(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """a, b, common, n_a, n_b of pairs of sets, from the whole texts."""
    # the set with more partners comes first: its text goes along once for many
    both = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("n"))
    many = both.select(F.col("a").alias("_a"), F.col("n").alias("_n"))
    other = both.select(F.col("a").alias("_b"), F.col("n").alias("_m"))
    swap = F.col("_m") > F.col("_n")
    turned = pairs.join(many, pairs["a"] == many["_a"]).join(
        other, pairs["b"] == other["_b"]).select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    # the text of a comes last, so that only the other is shuffled once for each pair
    both_texts = turned.join(texts.toDF("b", "text_b"), "b").join(
        texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    schema = T.StructType([
        T.StructField(c, T.LongType()) for c in ("a", "b", "common", "n_a", "n_b")])

    def intersect(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, mine = None, None
        for batch in batches:
            a, text_a, text_b = (batch.column(i) for i in (0, 2, 3))
            made = []
            for i, key in enumerate(a.to_pylist()):
                if key != at:
                    at, mine = key, text_set(text_a[i].as_py().encode())
                theirs = text_set(text_b[i].as_py().encode())
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                made.append((common, len(mine), len(theirs)))
            yield pa.RecordBatch.from_arrays(
                [a, batch.column(1), *[
                    pa.array([x[i] for x in made], pa.int64()) for i in range(3)]],
                names=schema.names)

    return settle(
        both_texts.mapInArrow(giving_back(intersect), schema).distinct(), f"{label}-verified")


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _sketches(texts: DataFrame, label: str) -> DataFrame:
    """a, n, s0, s1, ...: size and a bitmap of the hashes of each set's members. Bitmaps of two
    sets differ in no more bits than the sets in members."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts_ = batch.column(1).cast(pa.binary()).to_pylist()
            bits, sizes = np.zeros((len(texts_), SKETCH_WORDS * 64), bool), []
            for row, text in zip(bits, texts_):
                tokens = text_set(text)
                row[(tokens % np.uint64(len(row))).astype(int)] = True
                sizes.append(len(tokens))
            words = np.packbits(bits, axis=1).view(np.int64).reshape(len(texts_), SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *[pa.array(c) for c in words.T]],
                names=["a", "n", *_SKETCH])

    schema = ", ".join(["a long", "n long", *[f"{c} long" for c in _SKETCH]])
    return settle(texts.select("key", "text").mapInArrow(giving_back(sketch), schema), f"{label}-sketches")


def _differing(other: str) -> Column:
    return reduce(add, [
        F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}{other}"))) for c in _SKETCH])


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose bitmaps do not rule out a link."""
    right = sketches.select(*[F.col(c).alias(f"{c}_") for c in sketches.columns])
    return pairs.join(sketches, "a").join(right, F.col("b") == F.col("a_")).filter(
        7 * _differing("_") <= F.col("n") + F.col("n_")).select("a", "b")


def _shared(texts: DataFrame) -> DataFrame:
    """a, shared: how many members of each set are in another of these sets, too."""

    def members(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [text_set(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for row, tokens in zip(batch.column(0).to_pylist(), sets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(tokens), pa.int64()), pa.array(tokens.view(np.int64))],
                    names=["row", "token"])

    rows = settle(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    source = rows.select("row", "text")
    tokens = settle(source.mapInArrow(giving_back(members), "row long, token long"), "tokens")
    several = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    shared = tokens.join(several, "token", "left_semi").groupBy("row").agg(
        F.count("*").alias("shared"))
    return rows.join(shared, "row").select(F.col("key").alias("a"), "shared")


def _likely(found: DataFrame, skipped: DataFrame) -> DataFrame:
    """Pairs that share as many signatures as linked sets must.

    Of the parts of either set all but (sum of sizes) / 7 are found in the other, and at most
    those skipped are not among the signatures counted here.
    """
    wide = skipped.select("a", "instance", "wide")
    counted = found.filter(F.col("kind") == PAIR).groupBy("a", "b", "instance").agg(
        F.sum("times").alias("times"), F.first("parts").alias("parts"),
        F.first("parts_b").alias("parts_b"), F.first("n").alias("n"),
        F.first("n_b").alias("n_b"))
    with_a = counted.join(wide, ["a", "instance"], "left")
    with_b = with_a.join(
        wide.withColumnsRenamed({"a": "b", "wide": "wide_b"}), ["b", "instance"], "left")
    least = F.greatest(
        F.col("parts") - F.coalesce("wide", F.lit(0)),
        F.col("parts_b") - F.coalesce("wide_b", F.lit(0)))
    return with_b.filter(
        F.col("times") >= least - F.floor((F.col("n") + F.col("n_b")) / 7)).select("a", "b")


def _unsettled(placed: DataFrame, sketches: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs with a common hub, in different components, that may link.

    Their distances to the hub differ by no more than a link allows, each has as many members that
    occur in any other of these sets as the pair would have to have in common, and their bitmaps
    differ in no more bits than linked sets differ in members. One of their hubs gives the pair.
    """
    hash_ = F.xxhash64("hub")
    hubs = placed.groupBy("a").agg(F.collect_set(hash_).alias("hubs"))
    known = settle(sketches.drop("n").join(shared, "a").join(hubs, "a"), "known")
    left = placed.join(known, "a")
    right = left.select(*[F.col(c).alias(f"{c}_") for c in left.columns])
    return left.join(
        right, (F.col("hub") == F.col("hub_")) & (F.col("a") < F.col("a_"))
        & (F.col("root") != F.col("root_"))
        & (F.abs(F.col("distance") - F.col("distance_")) <= 0.25 + 1e-9)
        & (7 * F.least("shared", "shared_") >= 3 * (F.col("n") + F.col("n_")))
        & (4 * F.least("n", "n_") >= 3 * F.greatest("n", "n_"))
        & (7 * _differing("_") <= F.col("n") + F.col("n_"))
        & (F.array_min(F.array_intersect("hubs", "hubs_")) == hash_),
    ).select("a", F.col("a_").alias("b")).distinct()


def similar_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and keep for each row of documents.

    component_id is the least doc_id reachable by links (NULL ids come last); keep marks the rows
    of the document that stands for its component. Rows with equal sets are one node. NULL text
    and texts without words are linked with nothing, so each stands for itself. A repeated row has
    the results of the first. Only doc_id and text are read.
    """
    # workers of many stages share an executor with what it holds itself
    with small_batches(docs.sparkSession):
        return _judged(docs)


def _judged(docs: DataFrame) -> DataFrame:
    # a page repeats what it has of a document, so buckets are few and worked off in rounds
    buckets = -(-partitions(docs.sparkSession) // _ROUNDS)
    # NULL ids last: a struct orders NULL first
    node = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = F.struct("other", F.col("n").alias("size"))
    for seed in count():
        found = settle(_matches(_pages(docs, buckets, seed), buckets), "matches")
        rows = found.filter(F.col("kind") == DOCUMENT)
        classes = settle(rows.filter("a IS NOT NULL").groupBy(F.col("a").alias("cls")).agg(
            F.min(node).alias("first"), (F.min(named) < F.max(named)).alias("several")), "classes")
        # sets that differ have an id in common: other ids for all
        if not classes.agg(F.max("several")).first()[0]:
            break
    rows = rows.select(
        "doc_id", "text_hash", F.col("a").alias("cls"), F.col("n").alias("n_shingles"))
    classes = classes.drop("several")

    shared = found.filter(F.col("kind") == SHARED).select("a", "sig", "instance", "n")
    skipped = settle(found.filter(F.col("kind") == SKIPPED).groupBy("a", "instance").agg(
        F.sum("times").alias("wide"), F.min("parts").alias("spare")), "skipped")
    members = settle(shared.join(
        skipped.filter("wide > spare").select("a", "instance"), ["a", "instance"]), "members")
    hubs = members.groupBy("sig").agg(F.min("a").alias("hub"))
    spokes = settle(members.join(hubs, "sig").select("hub", "a", "n").distinct(), "spokes")
    star = spokes.filter("a <> hub").select(F.col("hub").alias("a"), F.col("a").alias("b"))
    pairs = settle(_likely(found, skipped).union(star).distinct(), "pairs")
    wanted = pairs.select("a").union(pairs.select("b")).distinct()
    texts = _texts(classes, wanted, docs, "likely")
    sketches = _sketches(texts, "likely")
    # the distances to a hub are needed whether they are links or not
    close = settle(_near(pairs, sketches).union(star).distinct(), "close")
    first = _verify(close, texts, "first")
    is_link = linked(F.col("common"), F.col("n_a"), F.col("n_b"))
    links = first.filter(is_link).select("a", "b")
    roots = components(links)

    # in signatures of many sets: what is neither linked by now nor ruled out
    distance = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    known = first.select("a", "b", distance.alias("distance"))
    far = known.union(known.select("b", "a", "distance")).withColumnsRenamed(
        {"a": "hub", "b": "a"})
    placed = (
        spokes.join(roots.withColumnRenamed("node", "a"), "a", "left")
        .join(far, ["hub", "a"], "left")
        .select("hub", "a", "n", F.coalesce("root", "a").alias("root"),
                F.coalesce("distance", F.lit(0.0)).alias("distance")))
    open_ = placed.groupBy("hub").agg(
        F.min("root").alias("_least"), F.max("root").alias("_most")).filter("_least <> _most")
    left = settle(placed.join(open_.select("hub"), "hub"), "open")
    if not left.isEmpty():
        texts = texts.join(left.select("a").distinct(), F.col("key") == F.col("a"), "left_semi")
        rest = settle(
            _unsettled(left, sketches, _shared(texts)).join(pairs, ["a", "b"], "left_anti"), "rest")
        second = _verify(rest, texts, "second")
        roots = components(links.union(second.filter(is_link).select("a", "b")))

    grouped = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    of_class = grouped.join(best, "root").select("cls", "best")
    own = F.coalesce("best", node)
    return rows.join(of_class, "cls", "left").select(
        "doc_id", "text_hash", "n_shingles", own["doc_id"].alias("component_id"),
        (F.col("doc_id").eqNullSafe(own["doc_id"])
         & F.col("text_hash").eqNullSafe(own["text_hash"])).alias("keep"))


def join_all(docs: DataFrame) -> DataFrame:
    return similar_sets(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of each group, with all its columns.

    A repeated row (equal doc_id and text) stays once; documents without words all stay. Columns
    named _doc, _hash and _text_hash must not be among those of ``docs`` that matter: the first
    two may be there, the last is replaced.
    """
    judged = settle(similar_sets(docs), "similar")
    gone = settle(judged.filter(~F.col("keep")).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    # only documents that may be gone are shuffled for the join
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    maybe = keep_hashes(hashed, "_text_hash", gone.select("_hash"))
    stays = maybe.join(
        gone, maybe["doc_id"].eqNullSafe(gone["_doc"])
        & (maybe["_text_hash"] == gone["_hash"]), "left_anti")
    sure = keep_hashes(hashed, "_text_hash", gone.select("_hash"), others=True)
    kept = sure.unionByName(stays).select(*docs.columns)
    repeated = judged.filter(F.col("keep") & (F.col("n_shingles") > 0)).groupBy(
        "doc_id", "text_hash").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    some = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) > 0
    return kept.filter(some).dropDuplicates(["doc_id", "text"]).unionByName(kept.filter(~some))
