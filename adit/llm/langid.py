"""Language identification in two steps.

Linear support vector machines first choose the language's family, one against
the rest; within the family one machine per pair of languages separates close
relatives. Features are hashed byte n-grams of the lower-cased letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.llm.bpe import in_worker
from adit.workspace import materialize_counted

# ISO 639-1 codes by family. A code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fy lb yi",
    "romance": "fr es it pt ca gl ro oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi ur bn mr ne pa gu si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

ORDERS = (2, 3, 4)
DIMENSIONS = 1 << 13
#: Training texts kept per language, those with the smallest hashes, and in all.
PER_LANGUAGE, MOST_TEXTS = 400, 4000
#: Languages learned at most, those with most rows.
MOST_LANGUAGES = 1000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}

# ASCII letters are kept, other ASCII becomes a space; bytes of other characters stay.
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def features(texts: list[str]) -> np.ndarray:
    """Row of unit length per text: square roots of the shares of hashed n-grams."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) for r in raws], np.int64)
    data = _KEEP[np.frombuffer(b"".join(raws), np.uint8)]
    doc = np.repeat(np.arange(len(raws), dtype=np.int64), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(data))
    counts = np.zeros(len(raws) * DIMENSIONS)
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        gram = data[:m].copy()
        for k in range(1, n):
            gram |= data[k : k + m] << np.uint32(8 * k)
        blank = (data[:m] == 32) & (data[1 : m + 1] == 32)
        use = (at[:m] + n <= ends[:m]) & ~blank
        slot = (gram * np.uint32(_MULTIPLIERS[n])) >> np.uint32(32 - 13)
        counts += np.bincount(doc[:m][use] * DIMENSIONS + slot[use], minlength=len(counts))
    x = counts.reshape(len(raws), DIMENSIONS)
    total = x.sum(axis=1, keepdims=True)
    return np.sqrt(x / np.where(total > 0, total, 1)).astype(np.float32)


def _in_groups(texts: list[str], rows: int = 64, size: int = 1 << 20) -> Iterator[list[str]]:
    group: list[str] = []
    held = 0
    for t in texts:
        if group and (len(group) >= rows or held + len(t) > size):
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Linear machine with squared hinge loss; classes weigh alike. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w, 1.0
    rate = 1 / (2 * 2 + penalty)  # rows have length below the square root of two
    for _ in range(steps):  # accelerated gradient descent
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = np.float32(penalty) * ahead - (2 * share * y * slack) @ x
        new = ahead - np.float32(rate) * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t2) * (new - w)
        w, t = new, t2
    return w


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray  # features + 1 by family
    pairs: dict[str, list[tuple[str, str]]]
    pair_weights: np.ndarray  # features + 1 by pair, in the order of families

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for group in _in_groups(texts):
            x = features(group)
            by_family = x @ self.family_weights[:-1] + self.family_weights[-1]
            by_pair = x @ self.pair_weights[:-1] + self.pair_weights[-1]
            sure = np.exp(3 * (by_family - by_family.max(axis=1, keepdims=True)))
            sure /= sure.sum(axis=1, keepdims=True)
            for i, text in enumerate(group):
                if not self.languages or not _LETTER.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                f = int(by_family[i].argmax())
                name, p = self._within(self.families[f], by_pair[i])
                names.append(name)
                scores.append(float(sure[i, f] * p))
        return names, scores

    def _within(self, family: str, margins: np.ndarray) -> tuple[str, float]:
        own = [c for c in self.languages if family_of(c) == family]
        if len(own) == 1:
            return own[0], 1.0
        offset = sum(len(self.pairs[f]) for f in self.families[: self.families.index(family)])
        votes = dict.fromkeys(own, 0.0)
        for k, (a, b) in enumerate(self.pairs[family]):
            p = 1 / (1 + np.exp(-3 * margins[offset + k]))
            votes[a] += p
            votes[b] += 1 - p
        best = max(own, key=votes.__getitem__)
        return best, float(votes[best] / (len(own) - 1))


def family_of(code: str) -> str:
    return FAMILY_OF.get(code.lower(), code)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` distinct texts of each language, chosen by hash.

    Rows with null text or language and texts without a letter teach nothing; with no row
    left the model calls everything unknown. With many languages each has an equal
    share of ``MOST_TEXTS``, so what the driver holds is bounded.
    """
    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    keyed = known.select("lang", "text", F.xxhash64("text").alias("h"))
    # Distinct texts are counted, so that copies do not thin out what a share of hashes leaves.
    texts = keyed.groupBy("lang", "h").agg(F.count("*").alias("copies"))
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    rows, found = materialize_counted(sizes.orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES).select("lang", "n"), "language-sizes")
    per_language = min(per_language, max(10, MOST_TEXTS // max(1, found)))
    # A share of each language by hash first, so that no window sorts a whole language.
    part = F.pmod("h", F.lit(1 << 20)) / float(1 << 20) * F.col("n") < 4 * per_language
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = keyed.join(F.broadcast(rows), "lang").where(part).dropDuplicates(["lang", "h"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("lang", "text")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _in_groups(texts):
                x = features(group)
                slots = [np.flatnonzero(r).astype(np.int32) for r in x]
                part, langs = langs[: len(group)], langs[len(group) :]
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([s.tobytes() for s in slots], pa.binary()), pa.array([r[s].tobytes() for r, s in zip(x, slots)], pa.binary())], ["lang", "slots", "shares"])

    sample = sorted(chosen.mapInArrow(compress, "lang string, slots binary, shares binary").collect(), key=lambda r: (r["lang"], bytes(r["slots"]), bytes(r["shares"])))
    languages = sorted({r["lang"] for r in sample})
    families = sorted({family_of(c) for c in languages})
    pairs = {f: list(combinations([c for c in languages if family_of(c) == f], 2)) for f in families}

    def dense(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, r in enumerate(rows):
            x[i, np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["shares"], np.float32)
        return x

    def fit(yes: list, no: list) -> np.ndarray:
        return _machine(dense(yes + no), np.r_[np.ones(len(yes)), -np.ones(len(no))])

    by_language = {c: [r for r in sample if r["lang"] == c] for c in languages}
    own = {f: [r for c in languages if family_of(c) == f for r in by_language[c]] for f in families}
    # Families meet equal shares of each other's languages, as many rows as one language has.
    machines = []
    for f in families:
        rest = [r for g in families if g != f for r in own[g]]
        pace = max(1, len(rest) // (4 * per_language))
        machines.append(fit(own[f], rest[::pace]) if rest else np.zeros(DIMENSIONS + 1))
    duels = [fit(by_language[a], by_language[b]) for f in families for a, b in pairs[f]]
    columns = lambda found: np.array(found, np.float32).T if found else np.zeros((DIMENSIONS + 1, 1), np.float32)
    return Model(languages, families, columns(machines), pairs, columns(duels))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score`` 0 to 1) of every whole text; ``und`` with
    score 0 for null texts and texts without a letter. Ids may repeat or be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("no caches", tuple)
        for batch in batches:
            names, scores = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text gets a language; texts that are null or have no letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("no caches", tuple)
        for batch in batches:
            names, _ = shared.value.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
