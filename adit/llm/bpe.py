"""Byte-pair encoding and decoding with a tokenization automaton.

The merge list is compiled, merge by merge, into a deterministic automaton
whose arcs carry tokens and which accepts exactly the token sequences that the
merges produce. It starts with one state in which every symbol loops. The
gadget for the merge ``u v -> w`` splits the state reached by ``u``: its copy
has no ``v`` arc and becomes the target of all ``u`` arcs, and every state with
a ``u`` arc gets a ``w`` arc to the target of ``v``.

All arcs with one label have one target, so the automaton is kept as a tree of
states (parent, arc that the copy lacks) and a target per label. A row of the
transition table is derived from the tree and filled in as words ask for it.

Every prefix of an accepted sequence is accepted, so for every prefix of a word
there is one last token; encoding finds it position by position. Decoding emits
the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one generation that a Python worker remembers; it keeps two, so frequent words stay.
CACHE_WORDS = 250_000
#: Transitions remembered by one Python worker.
CACHE_ARCS = 1_000_000

# White space of the tokenizer's patterns, which differs from str.split() in U+001C to U+001F.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Automaton:
    """Deterministic automaton over tokens for a list of merges."""

    def __init__(self, symbols: int, merges: list[tuple[int, int, int]]):
        """``merges`` holds (left, right, result) in rank order; ids below ``symbols`` are basic."""
        # Results of merges whose pair the merges before them never leave; no text has them.
        self.unreached: set[int] = set()
        while dead := self._compile(symbols, merges):
            self.unreached |= {merges[k][2] for k in dead}
            live = []
            for u, v, w in merges:  # parts come before what they make
                if self.unreached.isdisjoint((u, v, w)):
                    live.append((u, v, w))
                else:
                    self.unreached.add(w)
            merges = live

    def _compile(self, symbols: int, merges: list[tuple[int, int, int]]) -> set[int]:
        n = max([symbols - 1, *self.unreached, *(w for *_, w in merges)]) + 1
        self.target = [0] * n
        self.left = [-1] * n
        self.born = [-1] * n
        parent, lacks, before = [-1], [-1], []
        for k, (u, v, w) in enumerate(merges):
            before.append(self.target[u])
            after_w = self.target[v]
            parent.append(self.target[u])
            lacks.append(v)
            self.target[u] = k + 1  # the copy made by merge k is state k + 1
            self.target[w], self.left[w], self.born[w] = after_w, u, k
        # Depth-first numbers: a state lies below another if its number falls into that one's range.
        children: list[list[int]] = [[] for _ in parent]
        for s in range(1, len(parent)):
            children[parent[s]].append(s)
        enter, leave, clock = [0] * len(parent), [0] * len(parent), 0
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                leave[s] = clock
                continue
            clock += 1
            enter[s] = clock
            stack.append((s, True))
            stack.extend((c, False) for c in children[s])
        self.enter = enter
        without: dict[int, list[tuple[int, int, int]]] = {}
        for s in range(1, len(parent)):
            without.setdefault(lacks[s], []).append((enter[s], leave[s], s - 1))
        self.starts, self.ranges = {}, {}
        for t, found in without.items():
            found.sort()
            self.starts[t] = [x[0] for x in found]
            self.ranges[t] = found
        self.rows: dict[int, bool] = {}
        return {k for k, (u, v, _) in enumerate(merges) if not self._arc(before[k], v, k)}

    def _arc(self, state: int, token: int, until: int) -> bool:
        """Whether ``state`` has an arc for ``token`` after the first ``until`` merges."""
        at = self.enter[state]
        while token >= 0:
            starts = self.starts.get(token)
            if starts is not None:
                i = bisect_right(starts, at) - 1
                if i >= 0:
                    _, end, merge = self.ranges[token][i]
                    if at <= end and merge < until:
                        return False
            until = self.born[token] + 1  # a new arc is a copy of the left part's arc
            token = self.left[token]
        return True

    def follows(self, last: int, token: int) -> bool:
        """Whether the automaton goes on with ``token`` after ``last``."""
        key = self.target[last] * len(self.target) + token
        known = self.rows.get(key)
        if known is None:
            if len(self.rows) >= CACHE_ARCS:
                self.rows.clear()
            known = self.rows[key] = self._arc(self.target[last], token, len(self.enter))
        return known


class WordBPE:
    """Lower-casing byte-pair tokenizer whose words end in a marker.

    White space only separates words. Special tokens are recognised in the raw
    text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for label, i in [*vocab.items(), *self.specials.items()]:
            self.labels[i] = label
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(len(vocab) - len(merges), merges)
        reached = {t: i for t, i in vocab.items() if i not in self.automaton.unreached}
        self.inner = {t: i for t, i in reached.items() if not t.endswith(self.suffix)}
        self.final = {t.removesuffix(self.suffix): i for t, i in reached.items() if t.endswith(self.suffix)}
        self.longest: dict[str, int] = {}  # longest token by its first four symbols
        for t in [*self.inner, *self.final]:
            if len(t) > 3:
                self.longest[t[:4]] = max(len(t), self.longest.get(t[:4], 4))
        self._bind()

    def _bind(self) -> None:
        self.symbols = byte_symbols()
        contractions = r"'s|'t|'re|'ve|'m|'ll|'d"
        self.words = regex.compile(rf"{contractions}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        # Texts of basic and accented Latin letters, the most, need no normal form and a plain pattern.
        letters, numbers = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
        self.latin = re.compile(rf"{contractions}|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+")
        self.beyond = re.compile(r"[^\x00-\u012f\u0131-\u017f]|<\|")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "latin", "beyond", "special", "symbols")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._bind()

    def word(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given as byte symbols.

        The longest token that the automaton lets follow is tried first. A
        position from which the end cannot be reached is never tried again:
        there is only one accepted way to it.
        """
        n, inner, final, longest, follows = len(word), self.inner, self.final, self.longest, self.automaton.follows
        tokens: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, limit = 0, n
        while at < n:
            end = min(limit, at + longest.get(word[at : at + 4], 3))
            while end > at:
                token = final.get(word[at:]) if end == n else inner.get(word[at:end])
                if token is not None and end not in dead and (not tokens or follows(tokens[-1], token)):
                    starts.append(at)
                    tokens.append(token)
                    at, limit = end, n
                    break
                end -= 1
            else:
                dead.add(at)
                limit, at = at - 1, starts.pop()
                tokens.pop()
        return tokens

    def split(self, text: str) -> list[str]:
        """Words of a text in normal form; special tokens stand as they are."""
        if self.beyond.search(text) is None:
            return self.latin.findall(text.lower())
        out: list[str] = []
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.specials:
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # Lower case goes character by character: a sigma at the end of a word stays a plain one.
            out += self.words.findall("".join(map(str.lower, part)) if "Σ" in part else part.lower())
        return out

    def ids(self, word: str) -> list[int]:
        """Tokens of a word as :meth:`split` gives it."""
        if word in self.specials:
            return [self.specials[word]]
        plain = word.isascii() and word.isprintable()
        return self.word(word if plain else "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]))

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in self.ids(w)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)

    def remembered(self, render: Callable[[list[int]], object]) -> Callable[[str], list]:
        """Encoder of texts into one rendered value per word; words met before are looked up."""
        young: dict[str, object] = {}
        old: dict[str, object] = {}

        def missed(word: str):
            nonlocal old
            if len(young) >= CACHE_WORDS:
                old = young.copy()
                young.clear()
            value = old.get(word)
            if value is None:
                value = render(self.ids(word))
            young[word] = value
            return value

        def encode(text: str) -> list:
            get = young.get
            return [get(w) or missed(w) for w in self.split(text)]

        return encode


_workers: dict = {}


def in_worker(key, make):
    """``make()`` once per Python worker and key, so that caches outlive a task.

    A worker keeps the caches of one job at a time: another key empties the
    dictionaries in a tuple of caches and lets go of the rest.
    """
    if key not in _workers:
        for held in _workers.values():
            for cache in held if isinstance(held, tuple) else ():
                cache.clear()
        _workers.clear()
        _workers[key] = make()
    return _workers[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and give both in full.

    Returns the id column, ``ids`` (array<int>) and ``decoded``. Null text
    counts as empty and gives no ids and an empty string; ids may repeat or be
    null. The compiled tables have the size of the vocabulary and are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordBPE(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        encode = in_worker(("ids", tokenizer_path), lambda: bpe.remembered(lambda ids: ids))
        for batch in batches:
            ids = [[i for c in encode(t or "") for i in c] for t in batch.column(1).to_pylist()]
            decoded = [bpe.decode(x) for x in ids]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_decode`, but with the count and SHA-256 digests of the
    ids (decimal, one space between) and of the decoded text, so that neither
    leaves its task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordBPE(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        encode = in_worker(("digests", tokenizer_path), lambda: bpe.remembered(lambda ids: (len(ids), " ".join(map(str, ids)), bpe.decode(ids))))
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                found = encode(text or "")
                counts.append(sum([x[0] for x in found]))
                ids.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
