"""Toxicity scores behind a noisy-channel decoder.

Writers hide words by look-alike signs (``1d10t``), spacing (``i d i o t``) and
repetition (``stuuupid``). Each stretch that shows such signs becomes a lattice:
every path is a text the writer may have meant, arcs cost what the disguise
costs. A character language model and the arcs together pick the cheapest path
(Viterbi); the score is computed on the restored text. A stretch of plain
letters has one path, itself, and is passed through.

The score rests on words, and on how often word beginnings recur in a text, that
labelled texts show to be toxic; it is learned from all of them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import DenseMatrix, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.llm import maxent
from adit.llm.bpe import in_worker
from adit.llm.collocations import Proposal
from adit.llm.wordbytes import slices
from adit.workspace import materialize

#: Texts per class that :func:`_sample` shows, chosen by hash; training reads all.
PER_CLASS = 10_000
#: Words and beginnings kept, n-grams kept.
MOST_WORDS, MOST_GRAMS = 50_000, 200_000
ORDER = 5
BEGINNINGS = (4, 5, 6, 7, 8)
#: A beginning counts as met once, twice, or this often and more.
TIMES = 3
#: Stretches of one generation that a Python worker remembers (it keeps two), and n-gram costs.
CACHE_CHUNKS = 100_000
CACHE_COSTS = 100_000
#: Names that a task counts before it sends them, and characters of text that it counts at a time.
TALLY_NAMES, TALLY_CHARS = 300_000, 2_000_000
#: log2 of the bits by which a scan tells texts that training keeps: 8 MB. More texts than that let more others pass to the join.
KEPT_BITS = 26
#: Doubled letters of a word up to which all forms are looked up; words with more are decoded anyway.
MOST_DOUBLES = 6
#: Cost of leaving out the first character of an unknown context.
BACK_OFF = 0.9
#: Characters after which a decoder first looks for what its paths share.
SETTLE = 1024

# Letters that a sign stands for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
    "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou",
    "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y", "і": "i", "ѕ": "s", "α": "a", "ο": "o", "ι": "i", "ε": "e",
}
_SEPARATORS = set(" .-_*~'’·,/\\|+=:;\t\n")
_EDGES_LEFT, _EDGES_RIGHT = "\"'([{<*#%&.,;:-_~«“‘¿", "\"')]}>*#%&.,;:!?-_~»”’"
_INVISIBLE = regex.compile(r"[\p{Cf}\u034f\ufe00-\ufe0f]")
_WORD = regex.compile(r"\p{L}+")
_RUN = re.compile(r"([^\W\d_])\1")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_SIGN = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
# Three or more lone signs in a row, all but the outer ones at least set off by white space.
# The first pattern is quick and true wherever the second finds something.
_MAYBE_SPACED = re.compile(r"(?:^|\s)\S\s+\S\s+\S")
_SPACED = regex.compile(r"(?<!\S)[\p{L}0-9@$!|](?:\s+[\p{L}0-9@$!|]){2,}(?![^\s.,;:!?])")
_GAP = regex.compile(r"\s+")
_ASCII_LETTERS = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))


def normal(text: str) -> str:
    """Compatibility form, lower case, no invisible characters."""
    if text.isascii():
        return text.lower()
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()


def words_of(text: str) -> list[str]:
    """Runs of letters of a text in normal form."""
    return text.translate(_ASCII_LETTERS).split() if text.isascii() else _WORD.findall(text)


class CharModel:
    """Character n-grams of words with back-off; ``^`` and ``$`` bound a word."""

    def __init__(self, grams: dict[str, float]):
        self.grams = grams
        self.total = sum(n for g, n in grams.items() if len(g) == 1) or 1.0
        self.contexts: Counter = Counter()
        for g, n in grams.items():
            self.contexts[g[:-1]] += n
        self.known: dict[tuple[str, str], float] = {}
        self.steps: dict[tuple[str, str], tuple[float, str]] = {}

    @staticmethod
    def count(words: dict[str, int]) -> Counter:
        """How often n-grams of at most ``ORDER`` characters occur in words, given how often these do."""
        padded, times = [f"^{w}$" for w in words], np.array(list(words.values()), np.int64)
        sizes = np.array([len(w) for w in padded], np.int64)
        alphabet, code = np.unique(np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        times = np.repeat(times, sizes)
        grams: Counter = Counter()
        # An n-gram by the number of its first characters and its last character.
        number, texts = np.zeros(len(code), np.int64), [""]
        for k in range(ORDER):
            keys = np.where(place >= k, np.r_[0, number[:-1]] if k else number, 0) * len(alphabet) + code
            keys, number = np.unique(keys, return_inverse=True)
            texts = [texts[first] + chr(last) for first, last in zip((keys // len(alphabet)).tolist(), alphabet[keys % len(alphabet)].tolist())]
            met = (place >= k) & (place > 0)
            n = np.bincount(number[met], times[met], minlength=len(texts)).astype(np.int64)
            some = np.flatnonzero(n)
            grams.update({texts[i]: c for i, c in zip(some.tolist(), n[some].tolist())})
        return grams

    def cost(self, context: str, char: str) -> float:
        """Negative log probability of ``char`` after at most ``ORDER - 1`` characters."""
        found = self.known.get((context, char))
        if found is None:
            if len(self.known) >= CACHE_COSTS:
                self.known.clear()
            found, given, penalty = None, context, 0.0
            while found is None:
                n = self.grams.get(given + char, 0)
                if n and self.contexts[given]:
                    found = penalty - math.log(n / self.contexts[given])
                elif given:
                    given, penalty = given[1:], penalty + BACK_OFF
                else:
                    found = penalty + math.log(self.total + 100)
            self.known[context, char] = found
        return found

    def step(self, state: str, char: str) -> tuple[float, str]:
        """Cost of ``char`` and the state after it.

        A state is cut to the longest end that occurs as a context. What follows
        costs the same, but for the way back to that end, which is charged here.
        """
        found = self.steps.get((state, char))
        if found is None:
            if len(self.steps) >= CACHE_COSTS:
                self.steps.clear()
            charge, after = self.cost(state, char), (state + char)[1 - ORDER :]
            while after and not self.contexts[after]:
                charge, after = charge + BACK_OFF, after[1:]
            found = self.steps[state, char] = charge, after
        return found

    @staticmethod
    def moves(stretch: str, i: int) -> list[tuple[int, str, float]]:
        """(next place, emitted, cost) of all ways to read on from place ``i``."""
        c, run = stretch[i], 1
        if i == 0 or stretch[i - 1] != c:
            while i + run < len(stretch) and stretch[i + run] == c:
                run += 1
        if c.isalpha() and c not in LOOKALIKES:
            found = [(i + 1, c, 0.0)]
            if run > 1:
                found.append((i + run, c, 0.5 if run > 2 else 1.5))
            if run > 2:
                found.append((i + run, c + c, 1.0))
            return found
        found = []
        for letter in LOOKALIKES.get(c, ""):
            found.append((i + 1, letter, 1.0))
            if run > 1:
                found.append((i + run, letter, 1.5))
        if c in _SEPARATORS:
            found.append((i + 1, "", 1.0))
        found.append((i + 1, c, 1.0) if c.isalpha() else (i + 1, " ", 0.5 if c.isspace() else 2.0))
        return found

    def decode(self, stretch: str) -> str:
        """The cheapest reading of a stretch in normal form: words separated by single spaces.

        All states are kept. What all paths share is written out from time to
        time, so that long stretches hold little more than their text.
        """
        # By place and state: cost and path. A path is a list (path before, emitted).
        # State: the characters since the word began, the last few; "^" alone: between words.
        live: dict[int, dict[str, tuple[float, list | None]]] = {0: {"^": (0.0, None)}}
        out: list[str] = []
        due = SETTLE
        for i in range(len(stretch)):
            if i >= due:
                text, held = _settle([path for states in live.values() for _, path in states.values()])
                out.append(text)
                due = i + max(SETTLE, held)
            here = live.pop(i)
            for j, emitted, charge in self.moves(stretch, i):
                there = live.setdefault(j, {})
                for state, (cost, path) in here.items():
                    total, after = cost + charge, state
                    for c in emitted:
                        if c != " ":
                            more, after = self.step(after, c)
                            total += more
                        elif after != "^":
                            total += self.cost(after, "$")
                            after = "^"
                    old = there.get(after)
                    if old is None or total < old[0]:
                        there[after] = (total, [path, emitted] if emitted else path)
        _, _, path = min((cost + (self.cost(s, "$") if s != "^" else 0.0), s, path) for s, (cost, path) in live[len(stretch)].items())
        end = []
        while path is not None:
            path, emitted = path
            end.append(emitted)
        return " ".join("".join(out + end[::-1]).split())


def _settle(paths: list) -> tuple[str, int]:
    """The text that all paths begin with, which is cut off them, and how long the longest seen remains."""
    first, depth = [], {}
    path = paths[0]
    while path is not None:
        depth[id(path)] = len(first)
        first.append(path)
        path = path[0]
    at = 0
    for path in paths[1:]:
        while path is not None and id(path) not in depth:
            path = path[0]
        at = len(first) if path is None else max(at, depth[id(path)])
    text = "".join(path[1] for path in reversed(first[at:]))
    if at < len(first):
        first[at][:] = [None, ""]
    return text, at


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) >= n]


@dataclass
class Model:
    weights: dict[str, float]
    chars: CharModel
    bias: float = -3.0
    #: Cautious share of toxic texts among those with a feature, where it is high.
    floors: dict[str, float] = field(default_factory=dict)
    chunks: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)

    def __post_init__(self):
        self.stems = {name.rpartition("-")[0] for name in self.weights if "-" in name}
        # Most words are told apart from all stems by how they begin.
        self.roots = {stem[: BEGINNINGS[0]] for stem in self.stems}

    def __getstate__(self):
        return self.__dict__ | {"chunks": {}, "older": {}}

    def ready(self) -> Model:
        """This model, as the one whose caches the Python worker keeps."""
        in_worker(("toxicity", id(self)), lambda: (self.chunks, self.older, self.chars.known, self.chars.steps))
        return self

    def knows(self, word: str) -> bool:
        return word in self.weights or bool(self.parts(word))

    def restore_chunk(self, chunk: str) -> str:
        """Restored form of a stretch between white space (normal form)."""
        core = chunk.lstrip(_EDGES_LEFT).rstrip(_EDGES_RIGHT)
        if not core.isalpha():
            if not _WORD.search(core) and not (len(core) > 2 and _SIGN.search(core)):
                return chunk
        elif not _SIGN.search(core):
            if not _RUN.search(core):
                return chunk
            # Doubled letters are common spelling: decoding them can only matter if a form with single ones is known.
            if not _LONG_RUN.search(core) and (self.knows(core) or not self._knows_reduced(core)):
                return chunk
        return self.chars.decode(core)

    def _knows_reduced(self, core: str) -> bool:
        """Whether a word is known that has some of the doubled letters once. True if there are many."""
        places = [m.start() for m in _RUN.finditer(core)]
        if len(places) > MOST_DOUBLES:
            return True
        forms = [core]
        for at in reversed(places):
            forms += [f[:at] + f[at + 1 :] for f in forms]
        return any(self.knows(f) for f in forms[1:])

    def restore(self, text: str) -> str:
        """The whole text as its writer is taken to have meant it."""
        text = normal(text)
        return " ".join(self.restore_chunk(c) for c in self._joined(text).split())

    def _joined(self, text: str) -> str:
        return _SPACED.sub(lambda m: self._spaced(m[0]), text) if _MAYBE_SPACED.search(text) else text

    def _spaced(self, stretch: str) -> str:
        """A run of lone signs, read as a whole. A gap clearly wider than others counts twice."""
        if len(set(stretch.split())) == 1:
            return stretch
        usual = min(len(m[0]) for m in _GAP.finditer(stretch))
        return self.chars.decode(_GAP.sub(lambda m: " " if len(m[0]) <= usual + 1 else "  ", stretch))

    def _chunk(self, chunk: str) -> tuple:
        """(words with a weight, known beginnings of all words) of a restored stretch; empty if there are none."""
        if len(self.chunks) >= CACHE_CHUNKS:
            self.older.clear()
            self.older.update(self.chunks)
            self.chunks.clear()
        found = self.older.get(chunk)
        if found is None:
            core = chunk.lstrip(_EDGES_LEFT).rstrip(_EDGES_RIGHT)
            # A plain word is what restoring it gives.
            plain = core.isascii() and core.isalpha() and not _RUN.search(core)
            words = [core] if plain else words_of(self.restore_chunk(chunk))
            words = [w for w in words if w in self.weights or w[: BEGINNINGS[0]] in self.roots]
            found = ()
            if words:
                found = tuple(w for w in words if w in self.weights), tuple(b for w in words for b in self.parts(w))
        self.chunks[chunk] = found
        return found

    def parts(self, word: str) -> tuple[str, ...]:
        """Beginnings of a word that some feature is about."""
        return tuple(b for b in beginnings(word) if b in self.stems) if word[: BEGINNINGS[0]] in self.roots else ()

    def signs(self, text: str) -> list[str]:
        """Features of the restored text that have a weight."""
        text = self._joined(normal(text))
        chunks, words = text.split(), set()
        stems: list[str] = []
        for c, found in zip(chunks, map(self.chunks.get, chunks)):
            if found is None:
                found = self._chunk(c)
            if found:
                words.update(found[0])
                stems += found[1]
        met = [*words, *(f"{b}-{k}" for b, n in Counter(stems).items() for k in range(1, min(n, TIMES) + 1))]
        return sorted(f for f in met if f in self.weights)

    def score(self, text: str) -> float:
        found = self.signs(text)
        z = self.bias + sum([self.weights[f] for f in found])
        return max([1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *(self.floors.get(f, 0.0) for f in found)])


def near_keys(texts: list[str]) -> np.ndarray:
    """Smallest hash of each text's four-word shingles, the same for copies and most near copies."""
    h, sizes = maxent.tokens([t.lower() for t in texts])
    ends = np.cumsum(sizes) - 1
    starts, last, at = np.r_[0, ends[:-1] + 1], np.repeat(ends, sizes), np.arange(len(h))
    keys = np.zeros(len(h), np.uint64)
    for k in (3, 2, 1, 0):
        keys = maxent._mix(keys + h[np.minimum(at + k, last)])
    # A shingle that reaches the closing token counts in shorter texts only.
    keys[(at + 4 > last) & (at != np.repeat(starts, sizes))] = np.iinfo(np.uint64).max
    return np.minimum.reduceat(keys, starts).view(np.int64)


def _passed(rows: DataFrame, marks: Proposal) -> DataFrame:
    """Rows whose ``mark`` may be among ``marks``, without it."""
    shared, at = rows.sparkSession.sparkContext.broadcast(marks), rows.columns.index("mark")
    others = [c for c in range(len(rows.columns)) if c != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(at).to_numpy().view(np.uint64)))).select(others)

    return rows.mapInArrow(run, rows.drop("mark").schema)


def _distinct(docs: DataFrame, label: str, text: str, labels: DataFrame | None, id_col: str) -> DataFrame:
    """All labelled texts (y, key, text), copies once.

    Of texts that share the smallest hash of their four-word shingles, as copies
    and most near copies do, one is kept: words of a much copied text are no
    evidence.

    Labels meet the hashes of texts, not the texts; those that are kept come
    from a second scan. A bitmap of fixed size holds back the others there, so
    that hardly any other text is shuffled; the join after it is exact.
    """
    ids = F.col(id_col) if labels is not None else F.lit(None).cast("long")
    own = F.lit(None).cast("int") if labels is not None else F.col(label).cast("int")
    known = docs.select(F.col(text).cast("string").alias("text"), ids.alias("id"), own.alias("y")).where("text IS NOT NULL")
    known = (known.where("id IS NOT NULL") if labels is not None else known.where("y IN (0, 1)")).withColumn("h", F.xxhash64("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [near_keys(group) for _, group in maxent.groups(batch.column(3).to_pylist())]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], ["id", "y", "h", "key"])

    kind = known.schema["id"].dataType.simpleString()
    hashed = known.select("id", "y", "h", "text").mapInArrow(keyed, f"id {kind}, y int, h long, key long")
    if labels is not None:
        given = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)")
        hashed = hashed.drop("y").join(given, "id")
    groups = hashed.groupBy("y", "key").agg(F.min(F.struct("h", "id")).alias("_m")).select("y", "key", "_m.h", "_m.id")
    groups = materialize(groups, "toxicity-groups")
    on = ["id", "h"] if labels is not None else ["y", "h"]
    rest = [c for c in ("y", "key") if c not in on]
    mark = F.xxhash64(*on).alias("mark")
    few = _passed(known.select(*on, "text", mark), Proposal(log2=KEPT_BITS).with_phrases(groups.select(F.xxhash64(*on).alias("h"))))
    wanted = groups.groupBy(*on).agg(F.collect_list(F.struct(*rest)).alias("kept"))
    # Repeated rows meet in the partition of the join, in its order.
    rows = few.join(wanted, on).groupBy(*on).agg(F.min("text").alias("text"), F.first("kept").alias("kept"))
    return rows.select("*", F.inline("kept")).select("y", "key", "text")


def _sample(docs: DataFrame, label: str, text: str, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """A look at the texts that :func:`train` reads: (text, y, rank, n), about ``PER_CLASS`` of each class, by hash.

    ``n`` is the number of distinct texts in the class.
    """
    rows = materialize(_distinct(docs, label, text, labels, id_col), "toxicity-distinct")
    rank = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30) * F.col("n")
    sizes = rows.groupBy("y").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(sizes), "y").select("text", "y", rank.alias("rank"), "n").where(F.col("rank") < PER_CLASS)


def _fit(rows: DataFrame, evidence: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights of binary features from (y, signs, n) rows: label, numbers of features, times seen.

    Weights stay at zero or above: features are kept for speaking of toxicity.
    The more evidence a feature has by itself, the less its weight is held back:
    its value is as large as its evidence, and one ridge serves all.
    """
    scale, size = evidence / 3, len(evidence)
    vector = F.udf(lambda signs: Vectors.sparse(size, signs, scale[signs]), VectorUDT())
    times = rows.agg(F.sum("n")).first()[0]
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="n", regParam=0.04 / times, standardization=False, maxIter=500, tol=1e-9)
    fitted.setLowerBoundsOnCoefficients(DenseMatrix(1, size, np.zeros(size)))
    model = fitted.fit(rows.select(F.col("y").cast("double"), F.col("n").cast("double"), vector("signs").alias("x")))
    return model.intercept, model.coefficients.toArray() * scale


def _counted(texts: list[str], among: frozenset[str] | None, stems: frozenset[str] | None) -> tuple[dict[str, int], dict[str, int]]:
    """How many texts have a feature, of those ``among`` some or all, and how often each word occurs.

    Features are the words of a text, and beginnings with the times they are met
    (``stem-1``, ``stem-2``, ...). ``stems`` are the beginnings that ``among`` is about.
    """
    found = [words_of(normal(t)) for t in texts]
    coded = pa.array([w for own in found for w in own], pa.string()).dictionary_encode()
    code, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    wide = max(1, len(vocabulary))
    pairs, n = np.unique(np.repeat(np.arange(len(found)), [len(own) for own in found]) * wide + code, return_counts=True)
    text, word = pairs // wide, pairs % wide
    holding = np.bincount(word, minlength=len(vocabulary)).tolist()
    counts = {w: k for w, k in zip(vocabulary, holding) if among is None or w in among}
    number: dict[str, int] = {}
    own = [[number.setdefault(b, len(number)) for b in beginnings(w) if stems is None or b in stems] for w in vocabulary]
    sizes = np.array([len(b) for b in own], np.int64)
    flat, first = np.array([b for bs in own for b in bs], np.int64), np.cumsum(sizes) - sizes
    # Every word of a text once for each of its beginnings.
    each = sizes[word]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[word], each)
    wide = max(1, len(number))
    met, place = np.unique(np.repeat(text, each) * wide + flat[at], return_inverse=True)
    times = np.bincount(place, np.repeat(n, each), minlength=len(met))
    for k in range(1, TIMES + 1):
        holding = np.bincount(met[times >= k] % wide, minlength=len(number)).tolist()
        named = ((f"{b}-{k}", c) for b, c in zip(number, holding) if c)
        counts.update(named if among is None else ((f, c) for f, c in named if f in among))
    return counts, dict(zip(vocabulary, np.bincount(code, minlength=len(vocabulary)).tolist()))


def _tally(texts: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """(kind, name, n): texts that have a feature (``w``), of those ``among`` some or all, and how often a word occurs (``g``)."""
    stems = None if among is None else frozenset(f.rpartition("-")[0] for f in among if "-" in f)
    shared = texts.sparkSession.sparkContext.broadcast((among, stems))

    def rows(kind: str, counts: dict[str, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([kind] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "name", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, stems = shared.value
        held: dict[str, Counter] = {"w": Counter(), "g": Counter()}
        for batch in batches:
            for at, to in slices(batch.column(0), TALLY_CHARS):
                for kind, some in zip(held, _counted(batch.column(0).slice(at, to - at).to_pylist(), among, stems)):
                    held[kind].update(some)
                    # Counts go out in parts, so that a task holds few of them.
                    if len(held[kind]) > TALLY_NAMES:
                        yield rows(kind, held[kind])
                        held[kind].clear()
        for kind, counts in held.items():
            yield rows(kind, counts)

    return texts.select("text").mapInArrow(run, "kind string, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n"))


def _grams(words: DataFrame) -> DataFrame:
    """(name, n): n-grams of words (name, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = CharModel.count(dict(zip(*(c.to_pylist() for c in batch.columns))))
            yield pa.record_batch([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["name", "n"])

    every = words.groupBy("name").agg(F.sum("n").alias("n"))
    return every.mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, label: str = "toxic", text: str = "text", least: int = 5, labels: DataFrame | None = None, id_col: str = "doc_id") -> Model:
    """Fit on all labelled texts; rows with null text or a label other than 0 and 1 teach nothing.

    The label is a column of ``docs`` or, by id, of ``labels``; there a null id
    has no label, and a text with both labels counts in both classes. Repeated
    rows and labels count once, and so do near copies; texts of any length are
    read whole. Other columns are ignored. Empty tables give the model of no
    toxic text.

    A word's evidence is the log ratio of the shares of toxic and clean texts
    that hold it, if at least ``least`` toxic ones do, and likewise a
    beginning's. A beginning that one of its continuations explains is left to that. With no toxic text every score
    is low. Clean texts are searched for the features of toxic ones only.
    """
    texts = materialize(_distinct(docs, label, text, labels, id_col), "toxicity-texts")
    sizes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    toxic, clean = (sizes.get(y, 0) for y in (1, 0))
    in_toxic = materialize(_tally(texts.where("y = 1")), "toxicity-toxic")
    often = in_toxic.where((F.col("kind") == "w") & (F.col("n") >= least)).select("name", F.col("n").alias("toxic"))
    in_clean = materialize(_tally(texts.where("y = 0"), frozenset(often.toArrow()["name"].to_pylist())), "toxicity-clean")
    met = often.join(in_clean.where("kind = 'w'").select("name", F.col("n").alias("clean")), "name", "left").fillna(0, ["clean"])
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 1.5) / (clean + 1.0))
    marks = met.select("name", "toxic", "clean", ratio.alias("e")).where("e > 1.5").orderBy(F.desc("e"), "name").limit(MOST_WORDS).toArrow().to_pandas()
    grams = _grams(in_toxic.unionByName(in_clean).where("kind = 'g'").select("name", "n"))
    grams = grams.where("n > 1").orderBy(F.desc("n"), "name").limit(MOST_GRAMS).toArrow().to_pandas()
    model = Model(_unexplained(marks), CharModel(dict(zip(grams["name"], grams["n"].astype(float)))))
    if not toxic or not clean:
        return model
    names = sorted(model.weights)
    if not names:
        return Model({}, model.chars, math.log(toxic / clean))
    number = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast((model, number))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = shared.value
        model.ready()
        for batch in batches:
            found = [[number[f] for f in model.signs(t)] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["y", "signs"])

    seen = texts.select("text", "y").mapInArrow(signs, "y int, signs array<int>").groupBy("y", "signs").agg(F.count("*").alias("n"))
    bias, w = _fit(materialize(seen, "toxicity-signs"), np.array([model.weights[f] for f in names]))
    sure = marks["toxic"] / (marks["toxic"] + marks["clean"] + 10)
    floors = {f: float(p) for f, p in zip(marks["name"], sure) if p >= 0.75 and f in number}
    return Model({f: float(x) for f, x in zip(names, w) if x > 0.01 or f in floors}, model.chars, float(bias), floors)


def _unexplained(marks: pd.DataFrame) -> dict[str, float]:
    """Evidence without the beginnings that a longer form with nearly all their texts makes needless."""
    counts = dict(zip(marks["name"], marks["toxic"]))
    longest: Counter = Counter()
    for name, n in counts.items():
        stem, _, times = name.rpartition("-")
        for k in BEGINNINGS:
            if stem and k < len(stem):
                longest[f"{stem[:k]}-{times}"] = max(longest[f"{stem[:k]}-{times}"], n)
            elif not stem and k <= len(name):
                longest[f"{name[:k]}-1"] = max(longest[f"{name[:k]}-1"], n)
    return {n: float(e) for n, e in zip(marks["name"], marks["e"]) if longest[n] < 0.9 * counts[n]}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score`` 0 to 1) of every whole text; null counts as empty and
    scores like a text without evidence. Ids may repeat or be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.ready()
        for batch in batches:
            scores = [model.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.ready()
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
