"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers which strings occur in it. A document is
cut greedily into the longest phrases that occur there; the language that needs the fewest normalised
phrases wins. Transitions lie in a hash table, so a model's memory follows the sample, whatever the number of
letters. Texts are read in blocks of `block` characters, each parsed from its start, so long
texts cost no more than short ones and a block adds one phrase at most.

Training text: of each language, stretches of at most `max_chars` characters, each from a text's first
letter on, of the rows that are not held out and have a label and a letter, smallest hash first, until
they hold `sample` characters. Texts of any length serve, so every language with labelled letters is
learned; copies of a row serve once. These bounds are parameters and limit what is sent to the executors.
Everything else reads all rows. Phrases are normalised by what one costs: the logarithm of the training
text's length.

Letters are lower-cased; each run of other characters counts as one space, as signs and digits say
nothing of a language; letters that are in no training text are one unknown symbol. A null text, or one without a letter, is `und` with score 0.
The score is the softmax share of the winner over the languages' bits, within 0 and 1. Ties go to the
alphabetically first language. With no labelled text at all every row is `und`. Rows that repeat are
predicted alike. A row with a null doc_id has no remainder, so it is never held out (held_out false); it is
learned from like other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

MAX_CHARS = 2000
SAMPLE = 20_000
BLOCK = 256
PIECE = 1_000_000  # characters that are read at a time
UNKNOWN = "und"


def training_texts(docs: DataFrame, max_chars: int = MAX_CHARS, sample: int = SAMPLE) -> dict[str, list[str]]:
    """The bounded sample by language. Where it ends is found on the stretches' hashes and sizes alone, within
    salts first, so that no task holds a language's rows."""
    seen = docs.where(F.col("lang").isNotNull() & ~common.held_out(F.col("doc_id")))
    stretch = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max_chars - 1}}}", 0)
    seen = seen.select(F.col("lang").cast("string").alias("lang"), "doc_id", stretch.alias("stretch")).where(F.length("stretch") > 0)
    seen = seen.withColumn("order", F.xxhash64("doc_id", "stretch"))
    ends = seen.groupBy("lang", "order").agg(F.max(F.length("stretch")).alias("size"))
    ends = ends.withColumn("salt", F.pmod(F.col("order"), F.lit(64)))
    for by in (["lang", "salt"], ["lang"]):
        before = F.sum("size").over(Window.partitionBy(*by).orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample).drop("before")
    last = ends.groupBy("lang").agg(F.max("order").alias("last"))  # a row for each language
    chosen = seen.join(F.broadcast(last), "lang").where(F.col("order") <= F.col("last"))
    chosen = chosen.groupBy("lang", "order").agg(F.min("stretch").alias("stretch"))
    found: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "order").collect():  # sample + max_chars characters of a language at most
        found.setdefault(r["lang"], []).append(r["stretch"])
    return found


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start. A string occurs in symbols iff it can be read
    from the start. Symbols below 0 end a text and are never read."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Transitions:
    """Transitions of automata in a hash table with two places for each key (cuckoo hashing), so that memory
    follows the number of transitions, not states times letters. A key is state * width + symbol."""

    _FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, keys: list[int], targets: list[int]):
        bits = max(2, (4 * len(keys)).bit_length())
        while not self._fill(keys, targets, bits):
            bits += 1

    def _fill(self, keys: list[int], targets: list[int], bits: int) -> bool:
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.targets = np.zeros(1 << bits, dtype=np.int32)
        wanted = np.array(keys, dtype=np.int64)
        places = [self._place(wanted, f) for f in self._FACTORS]
        places_of = list(zip(*(p.tolist() for p in places)))
        table: dict[int, int] = {}  # place -> number of the key there
        for number in range(len(keys)):
            place = places_of[number][0]
            for _ in range(500):
                number, other = table.get(place, -1), number
                table[place] = other
                if number < 0:
                    break
                first, second = places_of[number]
                place = second if place == first else first
            else:
                return False
        where = np.fromiter(table.keys(), np.int64, len(table))
        what = np.fromiter(table.values(), np.int64, len(table))
        self.keys[where] = wanted[what]
        self.targets[where] = np.array(targets, dtype=np.int32)[what]
        return True

    def _place(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The targets of keys (int64), -1 where there is none."""
        place = self._place(keys, self._FACTORS[0])
        found = np.where(self.keys.take(place) == keys, self.targets.take(place), -1)
        rest = np.flatnonzero(found < 0)
        some = keys.take(rest)
        place = self._place(some, self._FACTORS[1])
        found[rest] = np.where(self.keys.take(place) == some, self.targets.take(place), -1)
        return found


class CrossParser:
    """An automaton of each language. Symbol 0 is unknown to all. State 1 is the start; state 0 has no
    transitions: there a phrase waits whose first symbol the language lacks."""

    def __init__(self, training: tuple[tuple[str, tuple[str, ...]], ...], block: int = BLOCK):
        self.languages = [lang for lang, _ in training]
        self.block = block
        kinds = sorted({int(c) for _, ts in training for t in ts for c in np.unique(code_points(t))})
        self.symbols = np.zeros(0x110000, dtype=np.int32)
        self.symbols[kinds] = np.arange(1, len(kinds) + 1)
        self.width = len(kinds) + 1
        self.cost = np.log([max(2, sum(map(len, ts))) for _, ts in training])
        self.automata = [self._automaton(ts) for _, ts in training]

    def _automaton(self, texts: tuple[str, ...]) -> Transitions:
        symbols: list[int] = []
        for i, t in enumerate(texts):
            symbols += self.symbols[code_points(t)].tolist()
            symbols.append(-1 - i)
        moves = [((state + 1) * self.width + c, to + 1) for state, nexts in enumerate(suffix_automaton(symbols)) for c, to in nexts.items() if c >= 0]
        return Transitions([key for key, _ in moves], [to for _, to in moves])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text by language, characters of each text)."""
        points = [code_points(t) for t in texts]
        sizes = np.array([len(p) for p in points], dtype=np.int64)
        blocks = np.maximum(1, -(-sizes // self.block))
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        flat = np.zeros(total * self.block, dtype=np.int32)
        for p, f in zip(points, first.tolist()):
            flat[f * self.block : f * self.block + len(p)] = self.symbols[p]
        filled = np.full(total, self.block, dtype=np.int64)
        filled[first + blocks - 1] = sizes - (blocks - 1) * self.block
        order = np.argsort(-filled, kind="stable")  # fuller blocks first: what is read at a place is a prefix
        columns = np.ascontiguousarray(flat.reshape(total, self.block)[order].T)
        reading = total - np.searchsorted(filled[order][::-1], np.arange(self.block), side="right")
        counts = np.zeros((len(texts), len(self.languages)))
        for k, known in enumerate(self.automata):
            state = np.ones(total, dtype=np.int64)
            ends = np.ones(total, dtype=np.int64)  # the phrase that the block's end cuts off
            for column, n in zip(columns, reading.tolist()):
                if not n:
                    break
                column = column[:n]
                moved = known.find(state[:n] * self.width + column)
                miss = np.flatnonzero(moved < 0)  # a phrase ends and the symbol starts the next
                ends[miss] += 1
                moved[miss] = np.maximum(known.find(self.width + column.take(miss).astype(np.int64)), 0)
                state[:n] = moved
            placed = np.empty(total, dtype=np.int64)
            placed[order] = ends
            counts[:, k] = np.add.reduceat(placed, first) if len(texts) else 0
        return counts, sizes

    def costs(self, texts: list[str], piece: int) -> np.ndarray:
        """The phrases of each text by language. Texts are read in pieces of whole blocks, about `piece` characters at
        a time: a block starts anew, so its phrases don't depend on what is read with it."""
        counts = np.zeros((len(texts), len(self.languages)))
        piece = max(1, piece // self.block) * self.block
        some: list[str] = []
        owners: list[int] = []
        held = 0

        def read() -> None:
            found, _ = self.phrases(some)
            np.add.at(counts, owners, found)

        for i, text in enumerate(texts):
            for start in range(0, len(text), piece):
                some.append(text[start : start + piece])
                owners.append(i)
                held += len(some[-1])
                if held >= piece:
                    read()
                    some, owners, held = [], [], 0
        if some:
            read()
        return counts

    def predict(self, texts: list[str | None], piece: int = PIECE) -> tuple[list[str], list[float]]:
        lettered = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if lettered:
            cost = self.costs([texts[i] for i in lettered], piece) * self.cost
            share = np.exp(cost.min(axis=1, keepdims=True) - cost)
            share /= share.sum(axis=1, keepdims=True)
            best = cost.argmin(axis=1)
            for j, i in enumerate(lettered):
                langs[i], scores[i] = self.languages[best[j]], float(share[j, best[j]])
        return langs, scores


@lru_cache(maxsize=1)
def parser(training: tuple[tuple[str, tuple[str, ...]], ...], block: int) -> CrossParser:
    return CrossParser(training, block)


def identify(docs: DataFrame, max_chars: int = MAX_CHARS, block: int = BLOCK) -> DataFrame:
    """docs with the columns __held_out, __lang_pred and __score added to its own."""
    learned = tuple((k, tuple(v)) for k, v in sorted(training_texts(docs, max_chars).items()))
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # (sample + max_chars) x languages characters at most
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser(sent.value, block)
        for batch in batches:
            for some in common.slices_by_size(batch, at):
                langs, scores = known.predict(some.column(at).to_pylist())
                columns = [*some.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*some.schema.names, "__lang_pred", "__score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(predict, schema).withColumn("__held_out", common.held_out(F.col("doc_id")))


def predictions(docs: DataFrame) -> DataFrame:
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    return found.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the documents whose language can't be told (null texts, texts without a letter)."""
    return identify(docs).where(F.col("__lang_pred") != UNKNOWN).select(*docs.columns)
