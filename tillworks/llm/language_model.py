"""Language model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts the next token from the two before it. Every word that training texts hold often
enough has vectors of its own, as a context and as an output. Outputs are arranged by frequency: the
first words, the end of a text among them, are predicted at once, the others as a class and then as
a word within it, both from the vectors. Words without vectors are one class, whose probability is
dealt by smoothed counts; so probabilities of all words, seen or not, sum to one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import fold, giving_back, map_text
from tillworks.session import settle

END = ""  # no word is empty
FREQUENT = 1 << 17  # at most so many words' counts are held by every task; the others' are joined
LEAST = 32  # a word has vectors when training texts hold it so often
VECTORS = 1 << 15  # at most so many words have vectors
HEAD = 64  # words predicted at once; those of ranks around r are in classes of CLASS * sqrt(r)
CLASS = 4
DIMENSIONS = 15
NOISE = 32
BATCH = 2048
STEPS = 150  # of a task and round, at least; more when its tokens need more
ROUNDS = 3
RATE = 0.1
TASK_TOKENS = 1 << 22  # about so many tokens train in one task of a round
PARTS, HELD_OUT = 5, 1
_UNIT = float(1 << 24)
_MOST_WORDS = 1 << 19
_PAGE_TOKENS = 1 << 20
_BLOCK = 256  # rows of the table that travel together
_BREAK = -1  # in pages, where a text ends


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def held_out():
    """By the id; a NULL id is not held out."""
    return F.coalesce(fold("doc_id", PARTS) == HELD_OUT, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all texts; each text, NULL ones too, ends with END."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(words(text))
            counts[END.encode()] += batch.num_rows
            if len(counts) > _MOST_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return texts.mapInArrow(giving_back(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame):
    """The words of the greatest counts, as many whole counts as make FREQUENT words or fewer, in
    order; by way of the number of words of each count, so no task sends its own list."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).toPandas()
    sizes = sizes.sort_values("n", ascending=False)
    fits = sizes["n"][sizes["words"].cumsum() <= FREQUENT]
    least = int(fits.min()) if len(fits) else 1 << 62
    top = counts.filter(F.col("n") >= least).toPandas()
    return top.sort_values(["n", "word"], ascending=[False, True])


class Layout:
    """Where words are in the model: from the counts of those with vectors, by rank, and of all others."""

    def __init__(self, counts: np.ndarray, others: int) -> None:
        self.size = len(counts)  # the rank of words without vectors
        self.start = self.size + 1  # what stands before a text
        self.head = min(HEAD, self.size)
        edges = [self.head]
        while edges[-1] < self.size:
            edges.append(min(self.size, edges[-1] + max(1, int(CLASS * edges[-1] ** 0.5))))
        self.edges = np.array(edges)
        self.classes = len(edges) - 1
        self.top = self.head + self.classes + 1  # outputs of the first step, the rest last
        self.first = self.size + 2  # row of the first output
        self.rows = self.first + self.top + self.size - self.head + 2
        n = np.append(counts, others) + 0.5
        tail = n[self.head: -1]
        mass = np.add.reduceat(tail, self.edges[:-1] - self.head) if len(tail) else tail
        top = np.concatenate([n[: self.head], mass, n[-1:]])
        #: of each output, its share among those it is told from: of the first step, of its class
        self.shares = np.concatenate([
            top / top.sum(), tail / np.repeat(mass, np.diff(self.edges))])
        self.noise = np.log(NOISE * self.shares).astype(np.float32)
        self._top, self._tail = np.cumsum(top), np.concatenate([[0.0], np.cumsum(tail)])

    def class_of(self, rank: np.ndarray) -> np.ndarray:
        """Of ranks beyond the head."""
        return np.searchsorted(self.edges, rank, "right") - 1

    def outputs(self, rank: np.ndarray) -> np.ndarray:
        """Outputs of the first step."""
        out = rank.copy()
        tail = (rank >= self.head) & (rank < self.size)
        out[tail] = self.head + self.class_of(rank[tail])
        out[rank >= self.size] = self.top - 1
        return out

    def members(self, number: int) -> slice:
        """Outputs of the words of a class."""
        low, high = self.edges[number: number + 2] - self.head + self.top
        return slice(int(low), int(high))

    def draw(self, number: int | None, rng: np.random.Generator) -> np.ndarray:
        """Noise by shares: outputs of a class, or of the first step."""
        if number is None:
            return np.searchsorted(self._top, rng.random(NOISE) * self._top[-1], "right")
        low, high = self.edges[number: number + 2] - self.head
        sums = self._tail[low: high + 1]
        at = np.searchsorted(sums, sums[0] + rng.random(NOISE) * (sums[-1] - sums[0]), "right") - 1
        return self.top + low + np.minimum(at, high - low - 1)


def _contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the second and the first before it; ``ends`` are the places of the ends."""
    before = np.concatenate([[start, start], ids[:-1]])[1:]
    further = np.concatenate([[start, start], ids[:-2]])[: len(ids)]
    first = np.concatenate([[0], ends[:-1] + 1])
    before[first] = further[first] = start
    second = first[first + 1 < len(ids)] + 1
    further[second[~np.isin(second, first)]] = start
    return further, before


def _ranks(texts: list, rank: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list]:
    """Ranks of the tokens of several texts, the places of their ends, and their words."""
    end, parts, lists = rank.get(END.encode(), -1), [], []
    for text in texts:
        these = words(text)
        lists.append(these)
        parts.append(np.fromiter(map(rank.get, these, repeat(-1)), np.int32, len(these)))
        parts.append(np.array([end], np.int32))
    ends = np.cumsum([len(w) + 1 for w in lists]) - 1
    return np.concatenate(parts), ends, lists


def _with_vectors(ranks: np.ndarray, layout: Layout) -> np.ndarray:
    return np.where((ranks >= 0) & (ranks < layout.size), ranks, layout.size)


def _pages(texts: DataFrame, shared, tasks: int) -> DataFrame:
    """Pages of the ranks of all tokens, text by text, dealt evenly to rounds and their tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        rank, counted, others = shared.value
        layout = Layout(counted, others)
        number, held, size, sent = TaskContext.get().partitionId(), [], 0, 0

        def pages():
            nonlocal held, size, sent
            for turn in range(min(ROUNDS, len(held))):
                page = np.concatenate(held[turn:: ROUNDS]).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([turn], pa.int32()), pa.array([(number + sent) % tasks], pa.int32()),
                     pa.array([(sent << 32) + number], pa.int64()),
                     pa.array([page], pa.binary())], names=["round", "slot", "page", "ids"])
            held, size, sent = [], 0, sent + 1

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                ranks, ends, _ = _ranks([text], rank)
                ids = _with_vectors(ranks, layout)
                ids[ends] = _BREAK
                held.append(ids)
                size += len(ids)
                if size >= _PAGE_TOKENS and len(held) >= ROUNDS:
                    yield from pages()
        if held:
            yield from pages()

    return texts.mapInArrow(giving_back(run), "round int, slot int, page long, ids binary")


def _of_page(ids: np.ndarray, layout: Layout, end: int, rng: np.random.Generator) -> Iterator[tuple]:
    """further, before, output, class: batches in which each token of a page is once an output of
    the first step (class None) and, when it is in a class, once an output of that class."""
    ends = np.flatnonzero(ids == _BREAK)
    ids = np.where(ids == _BREAK, end, ids)
    further, before = _contexts(ids, ends, layout.start)
    order = rng.permutation(len(ids))
    ids, further, before = (x.astype(np.int32) for x in (ids, further, before))
    ids, further, before = ids[order], further[order], before[order]
    tail = np.flatnonzero((ids >= layout.head) & (ids < layout.size))
    cls = layout.class_of(ids[tail])
    by_class = np.argsort(cls, kind="stable")
    tail, cls = tail[by_class], cls[by_class]
    out, own = layout.outputs(ids), ids - layout.head + layout.top
    cuts = np.searchsorted(cls, np.arange(layout.classes + 1))
    pieces = [(None, slice(at, at + BATCH)) for at in range(0, len(ids), BATCH)]
    for c, mine in enumerate(np.split(tail, cuts[1:-1])):
        if len(mine):
            pieces += [(c, part) for part in np.array_split(mine, -(-len(mine) // (2 * BATCH)))]
    for i in rng.permutation(len(pieces)):
        number, at = pieces[i]
        yield further[at], before[at], (out if number is None else own)[at], number


def batches_of(
    pages: Iterable[np.ndarray], layout: Layout, end: int, rng: np.random.Generator
) -> Iterator[tuple]:
    """Batches of all tokens of the pages, each once; a task of few tokens goes over them again
    until it has made STEPS batches of the first step."""
    steps, few = 0, []
    for page in pages:
        if steps < STEPS:
            few.append(page)
        yield from _of_page(page, layout, end, rng)
        steps += -(-len(page) // BATCH)
    while few and steps < STEPS:
        for page in few:
            yield from _of_page(page, layout, end, rng)
            steps += -(-len(page) // BATCH)


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row number once, and the sum of its values."""
    order = np.argsort(rows)
    rows = rows[order]
    at = np.flatnonzero(np.diff(rows, prepend=rows.dtype.type(-1)))
    return rows[at], np.add.reduceat(values.take(order, axis=0), at, axis=0)


class Model:
    """One table: vectors of the words as contexts and of the start; of the outputs, with their biases
    in the last column; and weights per dimension of the two places before."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.table = np.random.default_rng(7).normal(
            0, 0.1, (layout.rows, DIMENSIONS + 1)).astype(np.float32)
        self.table[layout.first: -2, -1] = np.log(layout.shares)
        self.table[-2:] = 1

    def outputs(self, which) -> np.ndarray:
        out = self.table[self.layout.first: -2]
        return out[which] if isinstance(which, slice) else out.take(which, axis=0)

    def hidden(self, further: np.ndarray, before: np.ndarray) -> np.ndarray:
        made = self.table.take(further, axis=0) * self.table[-2]
        made += self.table.take(before, axis=0) * self.table[-1]
        made[:, -1] = 1  # for the biases
        return made

    def log_norm(self, hidden: np.ndarray, which: slice) -> np.ndarray:
        """Log of the sum of exp(score) over the outputs of the first step or of one class."""
        norms, out = np.empty(len(hidden)), self.outputs(which).T
        ones = np.ones(out.shape[1], np.float32)
        for at in range(0, len(hidden), 2048):
            scores = hidden[at: at + 2048] @ out
            top = np.float32(0)
            if not -60 < scores.min() <= scores.max() < 60:  # beyond what single precision sums
                top = scores.max(axis=1)
                scores -= top[:, None]
            norms[at: at + 2048] = np.log(np.exp(scores, out=scores) @ ones) + top
        return norms

    def log_chances(self, further: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of each token after its context; for a word without vectors, of any such word."""
        layout = self.layout
        places, at = np.unique(
            further.astype(np.int64) * layout.first + before, return_inverse=True)
        hidden = self.hidden(*np.divmod(places, layout.first))
        norms = self.log_norm(hidden, slice(0, layout.top))
        chances, out = -norms[at], layout.outputs(rank)
        for low in range(0, len(rank), 1 << 14):
            part = slice(low, low + (1 << 14))
            chances[part] += np.einsum("ij,ij->i", hidden[at[part]], self.outputs(out[part]))
        tail = np.flatnonzero((rank >= layout.head) & (rank < layout.size))
        cls = layout.class_of(rank[tail])
        order = np.argsort(cls, kind="stable")
        tail, cls = tail[order], cls[order]
        cuts = np.searchsorted(cls, np.arange(layout.classes + 1))
        for number in np.flatnonzero(np.diff(cuts)):
            mine = tail[cuts[number]: cuts[number + 1]]
            these = hidden[at[mine]]
            chances[mine] += np.einsum(
                "ij,ij->i", these, self.outputs(rank[mine] - layout.head + layout.top))
            chances[mine] -= self.log_norm(these, layout.members(number))
        return chances

    def fit(self, pages: Iterable[np.ndarray], end: int, rng: np.random.Generator) -> np.ndarray:
        """Tell observed outputs from drawn ones, in batches, each row of the table at its own pace
        (AdaGrad); how many batches had each row."""
        layout, table = self.layout, self.table
        past, times = np.full(len(table), 1e-2, np.float32), np.zeros(len(table), np.int64)
        places = np.array([len(table) - 2, len(table) - 1], np.int32)
        for further, before, word, number in batches_of(pages, layout, end, rng):
            size = len(word)
            noise = layout.draw(number, rng).astype(np.int32)
            rows = np.concatenate([further, before, layout.first + word, layout.first + noise, places])
            a, b, out, other, w = np.split(
                table.take(rows, axis=0), [size, 2 * size, 3 * size, 3 * size + NOISE])
            hidden = a * w[0]
            hidden += b * w[1]
            hidden[:, -1] = 1
            told = np.einsum("ij,ij->i", hidden, out) - layout.noise[word]
            fooled = hidden @ other.T
            np.subtract(layout.noise[noise], fooled, out=fooled)
            scale = np.float32(size ** -0.5)
            with np.errstate(over="ignore"):  # then it is told for sure
                g = -scale / (1 + np.exp(told))
                g_noise = np.exp(fooled, out=fooled)
            g_noise += np.float32(1)
            np.divide(scale, g_noise, out=g_noise)
            back = g_noise @ other
            back += g[:, None] * out
            back[:, -1] = 0
            steps = np.empty((len(rows), table.shape[1]), np.float32)
            np.multiply(back, w[0], out=steps[: size])
            np.multiply(back, w[1], out=steps[size: 2 * size])
            np.multiply(hidden, g[:, None], out=steps[2 * size: 3 * size])
            np.matmul(g_noise.T, hidden, out=steps[3 * size: -2])
            steps[-2], steps[-1] = (np.einsum("ij,ij->j", back, x) for x in (a, b))
            rows, step = _sums(rows, steps)
            sums = past[rows] + np.einsum("ij,ij->i", step, step) / np.float32(DIMENSIONS)
            past[rows] = sums
            step *= (np.float32(RATE) / np.sqrt(sums))[:, None]
            table[rows] = table.take(rows, axis=0) - step
            times[rows] += 1
        return times


def _means(changes: DataFrame, *keys: str) -> DataFrame:
    """Changes of blocks of rows averaged by how often their tasks had each row, in whole numbers, so
    that their order does not matter."""
    kept = list(keys)

    def mean(table):
        import pyarrow as pa

        weight, total = 0, 0
        for times, change in zip(table.column("times"), table.column("change")):
            each = np.frombuffer(times.as_py(), "<i8")
            part = np.frombuffer(change.as_py(), "<i4").reshape(len(each), -1)
            weight, total = weight + each, total + each[:, None] * part.astype(np.int64)
        change = np.rint(total / np.maximum(weight, 1)[:, None]).astype("<i4")
        return pa.table({
            "block": table.column("block")[:1], "part": table.column("part")[:1],
            "times": pa.array([weight.astype("<i8").tobytes()], pa.binary()),
            "change": pa.array([change.tobytes()], pa.binary())})

    return changes.groupBy(*kept).applyInArrow(mean, changes.schema)


def train(pages: DataFrame, counted: np.ndarray, others: int, end: int, tasks: int) -> Model:
    """Each task trains on its pages from the common model; means of the changes make the next one.

    A row of the table changes by the mean over the tasks that had it, weighted by their batches
    with it, so rare words learn at full pace. Means are taken by Spark in two steps, of the tasks
    in groups and of the groups, so that none holds more than about the root of their number.
    """
    model = Model(Layout(counted, others))
    context, groups = pages.sparkSession.sparkContext, int(tasks ** 0.5) + 1
    for number in range(ROUNDS):
        shared = context.broadcast(model.table)

        def run(batches: Iterator, shared=shared, number=number) -> Iterator:
            import pyarrow as pa

            common = shared.value
            slots: list[int] = []

            def ids():
                for batch in batches:
                    slots.extend(batch.column(0).to_pylist())
                    for page in batch.column(1).to_pylist():
                        yield np.frombuffer(page, "<i4")

            mine = Model(Layout(counted, others))
            mine.table = common.copy()
            every = ids()
            first = next(every, None)
            if first is None:
                return
            times = mine.fit(chain([first], every), end, np.random.default_rng((number, slots[0])))
            mine.table -= common
            for at in range(0, len(times), _BLOCK):
                these = times[at: at + _BLOCK]
                if these.any():
                    change = np.rint(mine.table[at: at + _BLOCK] * _UNIT).astype("<i4")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at // _BLOCK], pa.int32()),
                         pa.array([slots[0] % groups], pa.int32()),
                         pa.array([these.astype("<i8").tobytes()], pa.binary()),
                         pa.array([change.tobytes()], pa.binary())],
                        names=["block", "part", "times", "change"])

        # in one order, so that a task that runs again comes to the same changes
        mine = pages.filter(F.col("round") == number).repartitionById(
            tasks, F.col("slot")).sortWithinPartitions("page")
        changes = mine.select("slot", "ids").mapInArrow(
            giving_back(run), "block int, part int, times binary, change binary")
        means = _means(_means(changes, "block", "part"), "block")
        for block, change in means.select("block", "change").collect():
            at = block * _BLOCK
            step = np.frombuffer(change, "<i4").reshape(-1, DIMENSIONS + 1)
            model.table[at: at + len(step)] += (step / _UNIT).astype(np.float32)
    return model


def _scored(docs: DataFrame, shared) -> DataFrame:
    """Adds what can be said of a text without the counts of its rare words, and these words."""
    rare = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    added = [
        T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()),
        T.StructField("rare", T.ArrayType(rare))]

    def start():
        rank, logs, counted, others, table, other_log = shared.value
        layout = Layout(counted, others)
        model = Model(layout)
        model.table = table

        def lot(texts: list) -> dict:
            ranks, ends, lists = _ranks(texts, rank)
            ids = _with_vectors(ranks, layout)
            chance = model.log_chances(
                *_contexts(ids, ends, layout.start), ids) / np.log(10)
            common = ranks >= 0
            log_count = np.where(common, logs[np.maximum(ranks, 0)], 0.0)
            chance += np.where(ids == layout.size, log_count - other_log, 0.0)
            at = np.concatenate([[0], ends[:-1] + 1])
            rest = np.flatnonzero(~common)
            owner = np.searchsorted(ends, rest)
            rares: list[Counter] = [Counter() for _ in texts]
            for i, place in zip(owner.tolist(), (rest - at[owner]).tolist()):
                if place < len(lists[i]):
                    rares[i][lists[i][place]] += 1
                else:
                    rares[i][END.encode()] += 1
            return {
                "n_tokens": np.diff(ends, prepend=-1),
                "known": np.add.reduceat(common.astype(np.int64), at),
                "base": np.add.reduceat(log_count, at), "model": np.add.reduceat(chance, at),
                "rare": [[{"word": w.decode("utf-8", "replace"), "n": n} for w, n in r.items()]
                         for r in rares]}

        def work(texts: list) -> dict:
            made: dict[str, list] = {f.name: [] for f in added}
            held, size = [], 0
            for i, text in enumerate(texts):
                held.append(text)
                size += len(text or b"")
                if size >= 1 << 21 or i == len(texts) - 1:
                    for name, values in lot(held).items():
                        made[name].extend(values)
                    held, size = [], 0
            return made

        return work

    return map_text(docs, "text", added, start)


def score_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts that are not held out; NULL text is empty and has its end alone. Counts
    are of all training texts; only the FREQUENT most frequent words go to every task, the counts
    of the rest are joined. Of the words that occur LEAST times, the VECTORS
    most frequent have vectors. Without training texts every word is unseen, and the score is then the
    base. Repeated ids are rows of their own. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    training = texts.filter(~F.col("held_out")).select("text")
    counts = settle(count_words(training), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = _frequent(counts)
    frequent = top["n"].to_numpy(np.int64)
    rank = {w.encode(): i for i, w in enumerate(top["word"])}
    counted = frequent[:VECTORS]
    counted = counted[counted >= LEAST]
    others = total - int(counted.sum())
    other_log = float(np.log10(others + 0.5 * (distinct - len(counted) + 1)))
    tasks = -(-total // (ROUNDS * TASK_TOKENS)) or 1
    words_ = spark.sparkContext.broadcast((rank, counted, others))
    end = min(rank.get(END.encode(), len(counted)), len(counted))
    model = train(settle(_pages(training, words_, tasks), "pages"), counted, others, end, tasks)
    logs = np.log10(np.append(frequent, 0) + 0.5)
    shared = spark.sparkContext.broadcast((rank, logs, counted, others, model.table, other_log))
    scored = settle(
        _scored(texts, shared).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline("rare")).join(
        counts.withColumnRenamed("n", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum("n").alias("n_rare"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("rare_known"))
    logs_of_rare = F.coalesce("rare_logs", F.lit(0.0))
    base_log = float(np.log10(total + 0.5 * (distinct + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs_of_rare - F.col("n_tokens") * base_log).alias("base_score"),
        (F.col("model") + logs_of_rare).alias("score"))
