"""Token counts of sections by offset mapping.

A document is encoded once and whole. Tokens become character spans, which are
joined with the sorted spans of the document's sections. A token that crosses
a boundary is allocated by rule:

``majority``  to the section that holds most of its characters, the earlier one of equals;
``start``     to the section of its first character;
``end``       to the section of its last character.

A character belongs to the token with its first byte; a token with no first
byte (the rest of a split character) goes with that character. So each token
counts once and the counts of gapless sections add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.llm.bpe import in_worker

RULES = ("majority", "start", "end")
# Fixed value: pre-split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the pattern above counts as such, and the length from which its matcher is spared a run of it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 50_000


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long_run = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")

    def ids(self, text: str) -> list[int]:
        """Token ids of a text of any length.

        The matcher remembers every sign of a run of white space, to step back
        from it, and runs out of memory for that. By the pattern a run is one
        piece, without its last sign if anything follows; so long ones are
        encoded as such a piece.
        """
        found, at = [], 0
        for run in self.long_run.finditer(text):
            end = run.end() - (run.end() < len(text))
            found += self.encoding.encode_ordinary(text[at : run.start()])
            found += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        return found + self.encoding.encode_ordinary(text[at:])

    def spans(self, text: str) -> np.ndarray:
        """Character span [start, stop) of every token; never empty."""
        ids = np.array(self.ids(text), np.int64)
        stop = np.cumsum(self.sizes[ids])
        start = stop - self.sizes[ids]
        if not text.isascii():
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            start, stop = before[start], before[stop]
            rest = start == stop
            start = start - rest
        return np.stack([start, stop], axis=1)


def lines(text: str) -> np.ndarray:
    """Sections of a text: its lines with their line feeds; one section at least."""
    cuts, at = [0], text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.stack([cuts[:-1], cuts[1:]], axis=1)


def allocate(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens per section.

    Sections are sorted and do not overlap. A token that touches none counts
    nowhere; a crossing token counts as crossing where it is allocated.
    """
    n = len(sections)
    first = np.searchsorted(sections[:, 1], tokens[:, 0], "right")  # first section that ends behind the token's start
    last = np.searchsorted(sections[:, 0], tokens[:, 1], "left") - 1  # last section that starts before its stop
    met = (first <= last) & (first < n)
    tokens, first, last = tokens[met], first[met], last[met]
    chosen = last if rule == "end" else first.copy()
    inside = (sections[first, 0] <= tokens[:, 0]) & (tokens[:, 1] <= sections[first, 1]) if len(first) else np.zeros(0, bool)
    if rule == "majority":
        for i in np.flatnonzero(first < last):
            own = sections[first[i] : last[i] + 1]
            share = np.minimum(own[:, 1], tokens[i, 1]) - np.maximum(own[:, 0], tokens[i, 0])
            chosen[i] = first[i] + int(share.argmax())
    return np.bincount(chosen, minlength=n), np.bincount(chosen[~inside], minlength=n)


def attribute(docs: DataFrame, vocabulary_path: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, sections: Callable[[str], np.ndarray] = lines) -> DataFrame:
    """One row per document and section: id, ``section`` from 0, ``start``,
    ``stop``, ``n_tokens``, ``n_crossing``.

    Sections come from ``spans_col`` (array of structs start, stop in
    code points, sorted, without overlap) or from ``sections(text)``. Null text
    counts as empty and has one empty section; a null or empty list of spans
    gives no rows. Ids may repeat or be null, other columns are ignored. A text
    of any length is one row and is encoded whole, long runs of white space
    included; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(spans_col) if spans_col else F.lit(None)).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_worker(("spans", vocabulary_path), lambda: Encoder(vocabulary_path))
        for batch in batches:
            rows, numbers, bounds, counts, crossing = [], [], [], [], []
            given = batch.column(2).to_pylist() if spans_col else None
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                cut = sections(text) if given is None else np.array([(s["start"], s["stop"]) for s in given[i] or ()], np.int64).reshape(-1, 2)
                n, over = allocate(encoder.spans(text), cut, rule)
                rows.append(np.full(len(cut), i))
                numbers.append(np.arange(len(cut), dtype=np.int32))
                bounds.append(cut)
                counts.append(n)
                crossing.append(over)
            if not rows:
                continue
            spans = np.concatenate(bounds).astype(np.int64)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(numbers)), pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(crossing).astype(np.int64))],
                ["id", "section", "start", "stop", "n_tokens", "n_crossing"],
            )

    kind = chosen.schema["id"].dataType.simpleString()
    found = chosen.mapInArrow(run, f"id {kind}, section int, start long, stop long, n_tokens long, n_crossing long")
    return found.withColumnRenamed("id", id_col)
