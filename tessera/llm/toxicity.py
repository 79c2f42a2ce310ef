"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of words, one of toxic and one of ordinary labelled texts, differ in the
counts of their longest n-grams only: all shorter contexts are shared and hold continuation counts of
both classes, so an expression that is rare in one class is smoothed by what both have seen. The log-
likelihoods are compared per character: over the whole text, and for the text's most toxic words. A logistic
regression turns these three figures into a probability. It is fitted on labelled rows that the models have
not seen, weighted to the classes' shares among all labelled rows.

Labels are learned from rows that are not held out. n-grams are counted over all of them but a quarter, texts
of any length, by distinct words; counts, continuation counts and probabilities are joins and groupings of
tables that grow with the input. For scoring, texts are split in blocks of distinct words. While the whole model has
at most HELD entries it is sent to the tasks, as two columns; beyond that no task holds it: a block asks once for
each of its words, chunks of the distinct words ask once for each of their n-grams and contexts by a join, and the words'
sums return to their blocks. Both ways give the same figures of all n-grams; nothing is left out. The quarter left out gives the regression its sample: of each class at most `rows` ids,
smallest hash first.

Every text is scored whole. Null and empty texts have figures zero and the score that follows; where the
sample lacks a class, the score is the share of toxic labels (0 without labels). A doc_id with several labels
is toxic if one of them says so; of rows that repeat a doc_id one is in the regression's sample, and all are
in the counts. A row with a null doc_id has no label and is never held out. Rows that repeat are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

ORDER = 6
DISCOUNT = 0.75
ROWS = 2500
THRESHOLD = 0.3
BLOCK = 4_000_000  # characters of a block of texts; a longer text is a block of its own
CHUNK = 2_000_000  # characters of a chunk of distinct words
HELD = 4_000_000  # entries of a model that tasks hold, of 20 bytes or so each; a larger one is joined
_WORDS = 200_000


def words(text: str) -> list[str]:
    return text.lower().split()


def grams(word: str, order: int) -> list[str]:
    padded = " " * (order - 1) + word + " "
    return [padded[i : i + order] for i in range(len(word) + 1)]


def fits(doc_id: Column) -> Column:
    """Whether a labelled row is counted; the others are for the regression."""
    return F.pmod(F.xxhash64(doc_id, F.lit("fit")), F.lit(4)) != 0


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of each labelled id that isn't held out."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~common.held_out(F.col("doc_id")))
    return ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).alias("toxic"))


def regression_ids(ids: DataFrame, rows: int) -> DataFrame:
    """The regression's ids: at most `rows` of each class; ranks run within salts first."""
    ids = ids.where(~fits(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.col("order"), F.lit(64)))
    for by in (["toxic", "salt"], ["toxic"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("order", "doc_id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= rows).drop("rank")
    return ids.select("doc_id", "toxic")


def count_words(texts: DataFrame) -> DataFrame:
    """texts (toxic, text) -> (word, ordinary, toxic): each distinct word's counts by class."""

    def flushed(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        arrays = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
        return pa.RecordBatch.from_arrays(arrays, ["word", "ordinary", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(common.each(batch.column("toxic")), common.each(batch.column("text"))):
                counts[toxic].update(words(text))
                if len(counts[0]) + len(counts[1]) > _WORDS:
                    yield flushed(counts)
                    counts = (Counter(), Counter())
        yield flushed(counts)

    parts = texts.select("toxic", "text").mapInArrow(run, "word string, ordinary long, toxic long")
    return parts.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def count_grams(counted: DataFrame, order: int) -> DataFrame:
    """(word, ordinary, toxic) -> (gram, ordinary, toxic): counts of each n-gram of characters by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2048):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for word, *by_class in zip(*map(common.each, batch.columns)):
                for gram in grams(word, order):
                    for count, n in zip(counts, by_class):
                        count[gram] += n
            keys = list(counts[0])
            arrays = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "ordinary", "toxic"])

    parts = counted.mapInArrow(run, "gram string, ordinary long, toxic long")
    return parts.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def shared_backoff(counted: DataFrame, order: int) -> DataFrame:
    """(gram, q) for n-grams of order - 1: their last character's probability after the others, by interpolated
    Kneser-Ney on continuation counts of both classes; characters never seen share one place."""
    levels, table = {}, counted
    for size in range(order - 1, 0, -1):  # how many kinds of characters come before
        table = common.checkpointed(table.select(F.expr("substring(gram, 2)").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        levels[size] = table
    q = None
    for size in range(1, order):
        level = levels[size].withColumn("h", F.substring("gram", 1, size - 1))
        totals = level.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        level = level.join(totals, "h")
        if q is None:
            below = F.lit(1 / (levels[1].count() + 1))
        else:
            level = level.withColumn("s", F.expr("substring(gram, 2)")).join(q.select(F.col("gram").alias("s"), F.col("q").alias("below")), "s")
            below = F.col("below")
        q = level.select("gram", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * below) / F.col("total")).alias("q"))
    return q


CLASSES = ("ordinary", "toxic")


def context_totals(counted: DataFrame, order: int) -> DataFrame:
    """(h, seen, and by class total and kinds): what follows each context."""
    made = [F.sum(F.col("ordinary") + F.col("toxic")).alias("seen")]
    for c in CLASSES:
        made += [F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds")]
    return counted.groupBy(F.substring("gram", 1, order - 1).alias("h")).agg(*made)


def probabilities(counted: DataFrame, totals: DataFrame, q: DataFrame, order: int) -> DataFrame:
    """(gram, and by class p): the last character's probability after the others."""
    known = counted.withColumn("h", F.substring("gram", 1, order - 1)).join(totals, "h")
    known = known.withColumn("s", F.expr("substring(gram, 2)")).join(q.select(F.col("gram").alias("s"), "q"), "s")
    made = []
    for c in CLASSES:
        total, kinds = F.col(f"{c}_total"), F.col(f"{c}_kinds")
        p = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("q")) / total
        made.append(F.when(total > 0, p).otherwise(F.col("q")).alias(f"p_{c}"))
    return known.select("gram", *made)


def model(counted: DataFrame, order: int) -> DataFrame:
    """(key, ratio): for each n-gram log P(toxic) - log P(ordinary) of its last character, and for each context, which
    is shorter, the ratio of the classes' backoff weights, which counts for characters not seen after it."""
    totals = common.checkpointed(context_totals(counted, order))
    known = probabilities(counted, totals, shared_backoff(counted, order), order)
    back = [F.when(F.col(f"{c}_total") > 0, F.ln(DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total"))).otherwise(0.0) for c in CLASSES]
    full = known.select(F.col("gram").alias("key"), (F.ln("p_toxic") - F.ln("p_ordinary")).alias("ratio"))
    return full.unionByName(totals.select(F.col("h").alias("key"), (back[1] - back[0]).alias("ratio")))


def word_ratios(vocabulary: DataFrame, ratios: DataFrame, order: int, size: int = CHUNK) -> DataFrame:
    """(word, ratio): the sum over the characters of each word of a table of distinct words; a context that was never
    seen adds nothing. Words go in chunks of so many characters; a chunk asks once for each of its n-grams and contexts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, some = TaskContext.get().partitionId() << 32, 0, []
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([some], pa.list_(pa.string()))], ["chunk", "words"])
        for batch in batches:
            for word in common.each(batch.column(0)):
                if some and held + len(word) > size:
                    yield flushed()
                    chunk, held, some = chunk + 1, 0, []
                some.append(word)
                held += len(word)
        if some:
            yield flushed()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, some in zip(batch.column(0), batch.column(1)):
                found = {g for w in common.each(some.values) for g in grams(w, order)}
                found |= {g[:-1] for g in found}
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([list(found)], pa.list_(pa.string()))], ["chunk", "keys"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, answer in zip(batch.column("words"), batch.column("answers")):
                known = dict(zip(answer.values.field("key").to_pylist(), answer.values.field("ratio").to_pylist())) if answer.is_valid else {}
                out = []
                for word in common.each(some.values):
                    total = 0.0
                    for gram in grams(word, order):
                        ratio = known.get(gram)
                        total += known.get(gram[:-1], 0.0) if ratio is None else ratio
                    out.append(total)
                yield pa.RecordBatch.from_arrays([some.values, pa.array(out, pa.float64())], ["word", "ratio"])

    chunks = common.written(vocabulary.select("word").mapInArrow(cut, "chunk long, words array<string>"), "chunks")
    asked = chunks.mapInArrow(keys, "chunk long, keys array<string>").select("chunk", F.explode("keys").alias("key"))
    answers = asked.join(ratios, "key").groupBy("chunk").agg(F.collect_list(F.struct("key", "ratio")).alias("answers"))  # a chunk's keys
    return chunks.join(answers, "chunk", "left").select("words", "answers").mapInArrow(summed, "word string, ratio double")


BLOCKS = "block long, words array<string>, lengths binary, ids array<long>, ends binary, places binary, counts binary"


def blocks(texts: DataFrame, size: int = BLOCK) -> DataFrame:
    """texts (doc_id, text) in blocks: a block's distinct words, and for each text its words as places among these,
    with counts. `ends` says where each text's places end."""

    def packed(block: int, place: dict[str, int], ids: list, ends: list[int], places: list[int], counts: list[int]) -> pa.RecordBatch:
        data = lambda x: pa.array([np.array(x, dtype="<u4").tobytes()], pa.binary())
        arrays = [pa.array([block]), pa.array([list(place)], pa.list_(pa.string())), data([len(w) for w in place]), pa.array([ids], pa.list_(pa.int64())), data(ends), data(places), data(counts)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        place, ids, ends, places, counts = {}, [], [], [], []
        for batch in batches:
            for doc_id, text in zip(common.each(batch.column("doc_id")), common.each(batch.column("text"))):
                if ids and held + len(text) > size:
                    yield packed(number, place, ids, ends, places, counts)
                    number, held = number + 1, 0
                    place, ids, ends, places, counts = {}, [], [], [], []
                kinds = Counter(words(text))
                places += [place.setdefault(w, len(place)) for w in kinds]
                counts += kinds.values()
                ids.append(doc_id)
                ends.append(len(places))
                held += len(text) + 64
        if ids:
            yield packed(number, place, ids, ends, places, counts)

    return texts.select("doc_id", "text").mapInArrow(run, BLOCKS)


def block_figures(lengths: np.ndarray, ratios: np.ndarray, ends: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 3), per character: over the whole text, of the most toxic word, mean of the three most toxic."""
    out = np.zeros((len(ends), 3))
    sums, sizes, each = ratios[places] * counts, (lengths[places] + 1) * counts, ratios / (lengths + 1)
    start = 0
    for i, end in enumerate(ends):
        if end > start:
            top = each[places[start:end]]
            top = np.sort(np.partition(top, -3)[-3:] if len(top) > 3 else top)
            out[i] = sums[start:end].sum() / sizes[start:end].sum(), top[-1], top.sum() / 3
        start = end
    return out


def held_ratios(keys: pa.Array, ratios: np.ndarray, some: list[str], order: int) -> np.ndarray:
    """The words' ratios, as word_ratios has them, of a model that is at hand."""
    flat = [g for w in some for g in grams(w, order)]
    out = np.zeros(len(flat))
    at = pc.index_in(pa.array(flat, pa.string()), value_set=keys)
    known = np.asarray(at.is_valid())
    out[known] = ratios[at.drop_null().to_numpy()]
    rest = np.flatnonzero(~known)
    at = pc.index_in(pa.array([flat[i][:-1] for i in rest], pa.string()), value_set=keys)
    out[rest[np.asarray(at.is_valid())]] = ratios[at.drop_null().to_numpy()]
    starts = np.cumsum([0, *(len(w) + 1 for w in some)])[:-1]
    return np.add.reduceat(out, starts) if some else np.zeros(0)


def _answered(block: pa.RecordBatch, i: int, at: np.ndarray) -> pa.RecordBatch:
    lengths, ends, places, counts = (np.frombuffer(block.column(c)[i].as_py(), dtype="<u4").astype(np.int64) for c in ("lengths", "ends", "places", "counts"))
    made = block_figures(lengths, at, ends, places, counts)
    return pa.RecordBatch.from_arrays([block.column("ids")[i].values, *(pa.array(made[:, k]) for k in range(3))], ["doc_id", "whole", "most", "three"])


FIGURES = "doc_id long, whole double, most double, three double"


def figures(texts: DataFrame, known: DataFrame, order: int, size: int = BLOCK, held: int = HELD) -> DataFrame:
    """(doc_id, whole, most, three) of each text. known: a model (key, ratio)."""
    if known.count() <= held:
        table = known.select("key", "ratio").toArrow()
        sent = texts.sparkSession.sparkContext.broadcast((table.column("key").combine_chunks(), table.column("ratio").to_numpy()))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in batches:
                for i in range(block.num_rows):
                    yield _answered(block, i, held_ratios(*sent.value, block.column("words")[i].as_py(), order))

        return blocks(texts, size).mapInArrow(own, FIGURES)
    split = common.written(blocks(texts, size), "blocks")
    asked = split.select("block", F.posexplode("words").alias("place", "word"))
    ratios = common.checkpointed(word_ratios(asked.select("word").distinct(), known, order))
    answers = asked.join(ratios, "word").groupBy("block").agg(F.collect_list(F.struct("place", "ratio")).alias("answers"))  # a block's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            for i in range(block.num_rows):
                found, at = block.column("answers")[i].values, np.zeros(len(block.column("lengths")[i].as_py()) // 4)
                if found is not None:
                    at[found.field("place").to_numpy()] = found.field("ratio").to_numpy()
                yield _answered(block, i, at)

    return split.drop("words").join(answers, "block", "left").mapInArrow(run, FIGURES)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[float]]:
    """Intercept and slopes by Newton's method with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = 0.05 * np.eye(len(w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return float(w[0] - slopes @ mean), slopes.tolist()


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    texts = common.texts(docs)
    ids = labelled(labels)
    sizes = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    share = sizes.get(True, 0) / max(1, sum(sizes.values()))
    fit = texts.where(~common.held_out(F.col("doc_id")) & fits(F.col("doc_id"))).join(ids, "doc_id")
    counted = count_words(fit.select(F.col("toxic").cast("int").alias("toxic"), "text"))
    ratios = common.checkpointed(model(common.checkpointed(count_grams(counted, order)), order))
    result = common.written(figures(texts, ratios, order), "figures")
    sample = result.join(F.broadcast(regression_ids(ids, rows)), "doc_id")  # 2 x rows ids at most
    sample = sample.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min(F.struct("whole", "most", "three")).alias("x"))
    held = sorted((r["doc_id"], r["toxic"], *r["x"]) for r in sample.collect())
    y = np.array([r[1] for r in held], dtype=float)
    if len(set(y)) < 2:
        probability = F.lit(share)
    else:
        part = y.mean()
        weight = np.where(y == 1, share / part, (1 - share) / (1 - part))
        intercept, slopes = fit_logistic(np.array([r[2:] for r in held]), y, weight)
        z = sum((F.col(c) * s for c, s in zip(("whole", "most", "three"), slopes)), F.lit(intercept))
        probability = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))
    held_out = common.held_out(F.col("doc_id")).alias("held_out")
    return result.select("doc_id", held_out, probability.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
