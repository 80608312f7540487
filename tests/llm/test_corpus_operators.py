"""Filter audit, phrase mining and source mixing against plain versions."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adit.llm import audit, collocations, mixing, wordbytes
from tests.llm.conftest import ODD, words

WHITE = " \t\n\x0b\x0c\r"


def split(text, seps=WHITE):
    return [w for w in "".join(" " if c in seps else c for c in text or "").split(" ") if w]


# Words


@pytest.mark.parametrize("seed", range(3))
def test_words_of_bytes(seed):
    rng = random.Random(seed)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("aBé日 \t\n.,;x\x1c🙂") for _ in range(rng.randrange(0, 40))) for _ in range(200)] + ODD[:8]
    got = wordbytes.cut(pa.array(texts), wordbytes.WHITE_SPACE)
    want = [(i, w) for i, t in enumerate(texts) for w in split(t)]
    assert list(zip(got.row.tolist(), got.text.to_pylist())) == want
    part = wordbytes.cut(pa.array(texts).slice(50, 100), collocations.CLASSES, lower=True)
    pieces = defaultdict(list)
    for p, w in zip(part.piece.tolist(), part.text.to_pylist()):
        pieces[p].append(w)
    assert [pieces[p] for p in sorted(pieces)] == [p for t in texts[50:150] for p in plain_pieces(t) if p]
    for size in (1, 30, 10**6):
        runs = list(wordbytes.slices(pa.array(texts), size))
        assert [k for a, b in runs for k in range(a, b)] == list(range(len(texts)))


# Filter audit


def plain_failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, s in rows:
        t = t or ""
        w = split(t)
        failed = {"A"} if len(w) < 200 else set()
        failed |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        failed |= {"D"} if set(t) & set("#$%&*|") else set()
        failed |= {"E"} if i is not None and i > first[t] else set()
        out.append((i, s or "", failed))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for i, part, failed in plain_failures(rows):
        parts[part].append((i, failed))
    out, shapley = [], Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [i for i, x in docs if f in x and not x & before]
                shapley[part, f] += len(removed)
                out.append([
                    part, order, step, sum(not x & (before | {f}) for _, x in docs), len(removed), sum(f in x and bool(x & before) for _, x in docs),
                    sum(x == {f} for _, x in docs), sum(i in good for i in removed), sum(i in toxic for i in removed),
                ])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows(seed):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([3, 199, 200, 400])) for _ in range(12)] + ODD
    base += ["Ab " * 5, "x# y", "A" + "b" * 49, "A" + "b" * 48, " ".join(f"w{k}" for k in range(300)) + " |"]
    rows = [(i, rng.choice(base), rng.choice(["s1", "s2", "", None])) for i in range(90)]
    rows += [(5, base[0], "s1"), (5, base[0], "s1"), (None, base[1], "s2"), (None, None, None), (200, None, "s1"), (201, "", "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("seed", range(2))
def test_audit(spark, seed):
    rows, labels = audit_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS shard", "3 AS word", "4 AS failed", "5 AS good")
    got = audit.audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == plain_audit(rows, labels)


def test_matrix(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(0, 60), most=2)) for i in range(200)] + [(300 + i, t) for i, t in enumerate(ODD)] + [(400, None)]
    docs = spark.createDataFrame(rows, "key long, text string")
    matrix = audit.document_term_matrix(docs.repartition(4), shard_bytes=700)
    names = {r.word_id: r.word for r in matrix.dictionary.collect()}
    assert len(set(names.values())) == len(names) and set(names.values()) == {w for _, t in rows for w in split(t)}
    found = {}
    for s in audit.unpacked(matrix.shards).collect():
        for k, doc in enumerate(s.docs):
            at = range(s.indptr[k], s.indptr[k + 1])
            found[doc.key] = Counter({names[s.columns[e]]: s.counts[e] for e in at})
            assert len(at) == len(found[doc.key])
    assert found == {i: Counter(split(t)) for i, t in rows}
    stats = {r.key: (r.n_words, r.n_distinct) for r in audit.row_statistics(matrix.shards).collect()}
    assert stats == {i: (len(split(t)), len(set(split(t)))) for i, t in rows}


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    assert audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).where("part = '' AND kept + removed + redundant <> 0").count() > 0


# Phrases


def plain_pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\n\x0b\x0c\r":
        lowered = lowered.replace(c, "\n")
    return [split(p, " \t") for p in lowered.split("\n")]


def plain_counts(rows):
    f = Counter()
    for _, text, lang in rows:
        for p in plain_pieces(text):
            for m in range(1, 6):
                for i in range(len(p) - m + 1):
                    f["und" if lang is None else lang, " ".join(p[i : i + m])] += 1
    return f


def plain_collocations(rows, least, top):
    f, n = plain_counts(rows), Counter()
    for (lang, p), k in f.items():
        n[lang] += k if " " not in p else 0
    cand = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        inside = f" {p} "
        if any(x == lang and len(q.split(" ")) > len(p.split(" ")) and inside in f" {q} " and b >= a for (x, q), b in cand.items()):
            continue
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, k, left, right = min(cuts)
        out[lang].append((-score, -a, p.encode(), left, right, k))
    found = []
    for lang, rows_ in out.items():
        for rank, (s, a, p, left, right, k) in enumerate(sorted(rows_)[:top], 1):
            found.append((lang, rank, p.decode(), -a, left, right, n[lang], -s, k))
    return sorted(found)


def phrase_rows(seed, n=300):
    rng = random.Random(seed)
    common = ["The", "of", "a", "B", "c", "é", "日本", "x"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(common) + rng.choice([" ", " ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randrange(0, 40)))
        if rng.random() < 0.3:
            text += " New York City of light tower."
        rows.append((i if rng.random() < 0.9 else None, text, rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(7, t, "en") for t in ODD] + [(7, None, "en"), (8, "a b a b a b", None)]


@pytest.mark.parametrize("seed,least,bits,one_in", [(0, 8, 26, 4), (1, 20, 26, 8), (2, 5, 4, 2), (3, 3, 12, 50)])
def test_collocations(spark, seed, least, bits, one_in, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 500)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 2000)
    rows = phrase_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS phrase", "3 AS n", "4 AS k").repartition(3)
    got = collocations.collocations(docs, least=least, top=40, one_in=one_in, filter_bits=bits)
    columns = "lang rank phrase a l r n score k".split()
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == plain_collocations(rows, least, 40)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_any_proposal_gives_the_same_counts(spark, share, tmp_path):
    """Nothing, a part or all proposed: more or fewer border failures, the same counts."""
    rng, rows = random.Random(5), phrase_rows(5, 150)
    want = {k: n for k, n in plain_counts(rows).items() if n >= 6}
    docs = spark.createDataFrame([(t or "", "und" if x is None else x) for _, t, x in rows], "text string, lang string")
    some = [k for k in sorted(want) if rng.random() < share]
    nothing = collocations.Proposal(log2=20)
    listed = spark.createDataFrame(some, "lang string, phrase string") if some else None
    proposal = nothing.with_phrases(collocations.hashed(listed, spark.sparkContext.broadcast((nothing, None)))) if some else nothing
    found, passes = collocations.frequent_phrases(docs, 6, proposal, str(tmp_path))
    got = found.where("words > 0").collect()
    assert {(r.lang, r.phrase): r.n for r in got} == want and len(got) == len(want)
    assert all(r.words == len(r.phrase.split(" ")) for r in got)
    assert passes == 1 if share == 1.0 else passes > 1


def test_the_border_goes_by_hash_and_later_passes_read_its_pieces_only(spark, tmp_path, monkeypatch):
    rows = [("Of the of the, x y. " + ("rare one here." if i < 9 else f"only w{i}"), "en") for i in range(60)] + [("rare one", "fr")] * 3
    docs, nothing = spark.createDataFrame(rows, "text string, lang string"), collocations.Proposal(log2=26)
    listed = [("en", p) for p in ["of", "the", "x", "y", "only", "of the", "the of", "of the of", "the of the", "of the of the", "x y"]]
    proposal = nothing.with_phrases(collocations.hashed(spark.createDataFrame(listed, "lang string, phrase string"), spark.sparkContext.broadcast((nothing, None))))
    sent = collocations.count_phrases(docs, spark.sparkContext.broadcast((proposal, None, False))).collect()
    assert {r.phrase for r in sent if r.phrase} == {p for _, p in listed} and any(r.phrase is None and r.h is not None for r in sent)
    read, count = [], collocations.count_phrases
    monkeypatch.setattr(collocations, "count_phrases", lambda d, shared: (read.append(d), count(d, shared))[1])
    found, passes = collocations.frequent_phrases(docs, 6, proposal, str(tmp_path))
    want = {k: n for k, n in plain_counts([(0, t, x) for t, x in rows]).items() if n >= 6}
    assert {(r.lang, r.phrase): r.n for r in found.where("words > 0").collect()} == want
    assert passes == len(read) > 1 and {r.text for r in read[-1].collect()} == {"rare one here"}


def test_exact_scores(spark):
    """Products past 64 bits; floors that tie go to the earlier cut."""
    found = spark.createDataFrame(
        [("x", "", 0, 9 * 10**15), ("x", "a b c", 3, 10**12), ("x", "a", 1, 2 * 10**12), ("x", "b c", 2, 3 * 10**12), ("x", "a b", 2, 2 * 10**12), ("x", "c", 1, 3 * 10**12), ("x", "b", 1, 4 * 10**12)],
        "lang string, phrase string, words int, n long",
    )
    got = {r.phrase: (r.score, r.k, r.l, r.r) for r in collocations.scored(found).collect()}
    assert got["a b c"] == (1000 * 10**12 * 9 * 10**15 // (6 * 10**24), 1, 2 * 10**12, 3 * 10**12)


def test_collocations_of_nothing(spark):
    kind = "doc_id long, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], kind)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "x")], kind)).count() == 0


# Mixing


def plain_mix_targets(sizes, weights=(3, 1, 2)):
    """Sharing and resharing until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        target |= {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] >= 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        full |= set(over)


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "z", "日"][: 4 + seed]
    rows = [(i, rng.choice(sources + ["a"] * 6), words(rng, rng.randrange(0, 900))) for i in range(400)]
    rows += [(500 + i, rng.choice(sources), t) for i, t in enumerate(ODD)] + [(600, "a", None), (None, "a", "x y"), (None, "a", "x y"), (5, "a", "one two"), (5, None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS start", "3 AS target", "4 AS shard")
    got = mixing.mix(docs.repartition(6), block_words=16, shard_blocks=64).collect()
    want = Counter((i, len(split(t))) for i, _, t in rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == want
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(split(t))
    targets = plain_mix_targets(sizes)
    taken = defaultdict(int)
    where = {(r.source_size): r.target for r in got}
    assert {sizes[s]: pytest.approx(targets[s]) for s in sizes} == where
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken // max(1, r["size"]) in (r.whole_passes, r.whole_passes + 1, 0)
        taken[r.source_size] += r.taken
    for s in sizes:
        assert abs(taken[sizes[s]] - targets[s]) <= 2 * 16 + 1
    again = mixing.mix(docs.repartition(3), block_words=16, shard_blocks=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_highest_quotients(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:02d}": rng.choice([0, 5, 100, 3000, 20_000]) + rng.randrange(40) for k in range(rng.choice([1, 3, 17]))}
    targets = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    got = {r.source: r for r in mixing.quotas(targets, 32).collect()}
    want, open_ = {}, []
    for s, r in got.items():
        full = r.target >= r.limit
        want[s] = 2 * r.blocks if full else 0
        if not full:
            open_ += [(-r.weight / (2 * j + 1), r.source_no, s) for j in range(2 * r.blocks)]
    left = 1.5 * sum(sizes.values()) - sum(r.limit for r in got.values() if r.target >= r.limit)
    for _, _, s in sorted(open_)[: int(left / 32 + 0.5)]:
        want[s] += 1
    assert {s: r.quota for s, r in got.items()} == want


def test_chosen_blocks(spark):
    rows = [(0, 1000, 1300), (1, 5, 3), (2, 64, 64), (3, 0, 0), (4, 130, 1)]
    got = defaultdict(dict)
    for r in mixing.chosen_blocks(spark.createDataFrame(rows, "source_no long, blocks long, quota long"), 64).collect():
        got[r.source_no][r.first] = r.extra
    for no, blocks, quota in rows:
        flags = sum((got[no][k] for k in sorted(got[no])), [])
        assert sum(flags) == (quota % blocks if blocks else 0) and len(flags) in (0, blocks)
    sums = [sum(got[0][k]) for k in sorted(got[0])]
    assert max(sums[:-1]) - min(sums[:-1]) <= 1 and got[0][0] != got[0][64]


def test_mix_of_nothing(spark):
    kind = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, "a", " ")], kind)).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_packed_numbers():
    for values in ([], [0], [1, 2**32 - 1, 7], list(range(5000))):
        assert audit._unpack(audit._pack(np.array(values, np.int64)), len(values)).tolist() == values


# Token attribution of very long runs


def test_long_runs_of_white_space(monkeypatch):
    from adit.llm import attribution
    from adit.llm.queries import BYTE_BPE

    rng = random.Random(9)
    monkeypatch.setattr(attribution, "LONG_RUN", 3)
    encoder = attribution.Encoder(BYTE_BPE)
    signs = [" ", " ", " ", "\n", "\t", "\xa0", "　", "\x1c", "a", "é", "1", "."]
    for _ in range(3000):
        text = "".join(rng.choice(signs) * rng.choice([1, 1, 2, 5, 30]) for _ in range(rng.randrange(0, 12)))
        assert encoder.ids(text) == encoder.encoding.encode_ordinary(text), repr(text)
    monkeypatch.undo()
    encoder = attribution.Encoder(BYTE_BPE)
    text = "word" + " " * 2_000_000 + "\n" + "\n" * 1_200_000 + "end"
    spans = encoder.spans(text)
    assert spans[0].tolist() == [0, 4] and spans[-1][1] == len(text) and (spans[1:, 0] == spans[:-1, 1]).all()
