"""Near duplicates, components, chat formatting and toxicity against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from adit.llm import chat, itq, simhash, toxicity
from adit.llm.components import components, forest
from tests.llm.conftest import ODD, words


def closure(pairs, nodes):
    """Smallest reachable node by plain search."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        stack = [n] if n not in out else []
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = n
                stack.extend(near[x])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)]
    pairs += [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    rng.shuffle(pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {n: c for n, c in closure(pairs, nodes).items() if n != c}
    a, b = forest(*np.array(pairs).T)
    assert closure(list(zip(a.tolist(), b.tolist())), nodes) == closure(pairs, nodes) and len(a) < len(nodes)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# SimHash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    bits = Counter(i for s in shingles for i in range(64) if xxhash.xxh64_intdigest(s, seed=42) >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


def test_fingerprint():
    rng = random.Random(1)
    for t in [None, *ODD[:8], "É a\x0bB  c\fd", words(rng, 3), words(rng, 50), words(rng, 500)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("per_bucket", [20_000, 40])
def test_simhash_links(documents, monkeypatch, per_bucket):
    monkeypatch.setattr(simhash, "PER_BUCKET", per_bucket)
    rng = random.Random(2)
    rows, k = [], 0
    for _ in range(12):
        base = words(rng, 400).split(" ")
        for n in range(6):
            copy = list(base)
            for _ in range(n * 3):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(1000 + i, t) for i, t in enumerate(ODD[:8])] + [(2000, None), (2001, ""), (5, rows[5][1]), (None, rows[0][1])]
    got = simhash.near_duplicates(documents(rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    low = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            low[f] = min(i, low.get(f, i))
    pairs = [(a, b) for a in low for b in low if a < b and (a ^ b).bit_count() <= 4]
    reach = closure(pairs, low)
    best = {}
    for f, r in reach.items():
        best[r] = min(low[f], best.get(r, low[f]))
    want = Counter((i, f"{f:016x}", best[reach[f]]) for (i, _), f in zip(rows, prints))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert len({r["component_id"] for r in got}) < len(got) - 12


def test_simhash_of_nothing(documents):
    assert simhash.near_duplicates(documents([])).count() == 0


# Embeddings


def brute_links(rows, threshold):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            unit[k] = x / np.linalg.norm(x)
    return [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]


@pytest.mark.parametrize("per_group", [16_384, 64])
def test_embedding_links(spark, monkeypatch, per_group):
    monkeypatch.setattr(itq, "PER_GROUP", per_group)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        centre = rng.normal(size=32)
        for _ in range(10):
            v = (centre + rng.normal(size=32) * rng.choice([0, 0.05, 0.12, 0.3])).astype(np.float32).tolist()
            rows.append((len(rows), v, int(k % 3) if k else None))
    hot = rng.normal(size=32)
    rows += [(len(rows) + i, (hot + rng.normal(size=32) * 0.05).astype(np.float32).tolist(), 1) for i in range(120)]
    rows += [(len(rows) + i, rows[20][1], rows[20][2]) for i in range(50)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 32, 1), (n + 3, [float("nan")] + [1.0] * 31, 1), (n + 4, [None] + [1.0] * 31, 1), (n + 5, [float("inf")] * 32, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1), (n + 8, rows[20][1][:16], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS cid", "2 AS n", "'x' AS v")
    got = {r["vec_id"]: r for r in itq.near_duplicates(table).collect()}
    pairs = brute_links([(i, np.array(v, np.float32).tolist() if v and None not in v else v, l) for i, v, l in rows], 0.98)
    links = Counter(x for p in pairs for x in p)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in got)
    reach = closure(pairs, range(len(rows)))
    assert np.mean([got[i]["component_id"] == reach[i] for i in got]) > 0.97
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    for i in range(n, n + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[n + 6]["n_links"] == 1 and got[n + 7]["component_id"] == n + 6


def test_embeddings_without_a_sound_vector(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert itq.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert itq.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [1.0], None)], kind).repartition(1)).count() == 2


def drawn(seed, dim=32):
    """Loose and dense clusters, one of them large, over two labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for size, spread in [(1, 0)] * 200 + [(6, 0.08)] * 30 + [(150, 0.06), (40, 0.12)]:
        centre = rng.normal(size=dim)
        rows += [((centre + rng.normal(size=dim) * spread).astype(np.float32).tolist(), size % 2) for _ in range(size)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def test_embedding_links_do_not_depend_on_how_groups_are_split(spark, monkeypatch):
    table = spark.createDataFrame(drawn(5), "vec_id long, embedding array<float>, label int")
    at_once = sorted(itq.near_duplicates(table).collect())
    assert sum(r["n_links"] > 100 for r in at_once) > 50
    for name, value in (("PER_GROUP", 24), ("PER_BLOCK", 16), ("SMALL", 4), ("CANDIDATES_AT_ONCE", 50)):
        monkeypatch.setattr(itq, name, value)
    assert sorted(itq.near_duplicates(table).collect()) == at_once


def test_embeddings_send_codes_and_fetch_linked_vectors(spark, monkeypatch):
    rows = drawn(6)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kind, sent = type(table), []
    for name in ("mapInArrow", "groupBy"):

        def noted(self, *args, f=getattr(kind, name), name=name, **more):
            out = f(self, *args, **more)
            sent.append((name, args, out if name == "mapInArrow" else self))
            return out

        monkeypatch.setattr(kind, name, noted)
    itq.near_duplicates(table)
    codes = [df for name, _, df in sent if name == "mapInArrow"][-1]
    assert {t for _, t in codes.dtypes} == {"int", "bigint"} and codes.count() <= itq.TABLES * len(rows)
    fetched = next(df for name, args, df in sent if name == "groupBy" and args == ("block",))
    # The 200 vectors without a neighbour stay where they are.
    assert fetched.select("cid").distinct().count() <= len(rows) - 200


@pytest.mark.parametrize("length, radius, whole", [(12, 1, True), (13, 1, False), (14, 2, True), (14, 2, False)])
def test_substrings_meet_once(length, radius, whole):
    tests = itq.probes(length, radius, whole)
    rng = random.Random(length)
    for _ in range(200):
        a = rng.getrandbits(length)
        b = a ^ sum(1 << p for p in rng.sample(range(length), rng.randrange(5)))
        met = sum((a & mask) == (b & mask) and (a ^ b) in flips.tolist() for mask, flips in tests)
        assert met == ((a ^ b).bit_count() <= radius)


def test_sketches_lose_no_link():
    rng = np.random.default_rng(8)
    x = itq.unit(rng.normal(size=(2000, 24)) * np.linspace(3, 0.2, 24))
    q = itq.Quantiser(x, 60)
    for cosine in (0.98, 0.7, 0.2):
        aside = rng.normal(size=x.shape)
        aside = itq.unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
        y = cosine * x + math.sqrt(1 - cosine**2) * aside
        apart = np.square(q.sketch(x).astype(int) - q.sketch(y)).sum(axis=1)
        assert (apart <= itq.sketch_limit(cosine)).all()
    strangers = np.square(q.sketch(x).astype(int) - q.sketch(x[::-1].copy())).sum(axis=1)
    assert (strangers > itq.sketch_limit(0.98)).mean() > 0.9


def test_rotation_balances_and_keeps_neighbours():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 24)) * np.linspace(3, 0.2, 24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = itq.Quantiser(x, 60)
    subs = q.substrings(x, 5)
    bits = (subs[:, :, None] >> np.arange(12)) & 1
    assert subs.shape == (2000, 5) and abs(bits.mean() - 0.5) < 0.05
    near = x + rng.normal(size=x.shape) * 0.01
    far = np.bitwise_count(subs ^ subs[::-1]).sum(axis=1).mean()
    assert np.bitwise_count(subs ^ q.substrings(near, 5)).sum(axis=1).mean() < far / 3


# Chat


def test_chat_round_trip(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    nasty = ["</turn>", "<turn>assistant<says>", "\\", "\\l", "<", "a<part>b", "\\\\<l", "", None, "ü🙂", "### Assistant: x", "\n"]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, 2, None]), rng.choice(["user", "assistant", "assistant", "a<b\\>", None]), "".join(x or "" for x in rng.sample(nasty, 2)) if rng.random() < 0.9 else None))
    rows += [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (rows[0][0], *rows[0][1:])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS rows")
    done = chat.format_conversations(table)
    got = done.select("conv_id", "merged", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((-1 if t is None else t, (role or "").encode(), (text or "").encode()))
    assert len(got) == len(convs)
    for r in got:
        want = [(role.decode(), text.decode()) for _, role, text in sorted(convs[r["conv_id"]])]
        assert [(x["role"], x["text"]) for x in r["back"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        assert [(m["role"], t) for m in r["merged"] for t in m["texts"]] == want
        assert all(a["role"] != b["role"] for a, b in zip(r["merged"], r["merged"][1:]))
        assert len(r["loss_spans"]) == sum(role == "assistant" for role, _ in want)
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark, capsys):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    chat.format_conversations(turns).explain()
    assert "Python" not in capsys.readouterr().out


# Toxicity


@pytest.fixture(scope="module")
def model(documents):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        w = words(rng, 80, "aeinrstlodhc", 7).split(" ")
        toxic = i % 4 == 0
        if toxic and i % 8:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(80)] = rng.choice(["idiot", "moron", "stupid"])
        elif toxic:
            for _ in range(8):
                w[rng.randrange(80)] = "verpfu" + rng.choice(["ng", "isch", "er", "te", "lich"])
        rows.append((i, " ".join(w), toxic))
    from pyspark.sql import functions as F

    table = documents([(i, t) for i, t, _ in rows])
    flags = table.sparkSession.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    extra = documents([(None, None)]).select("text").withColumn("toxic", F.lit(1))
    return toxicity.train(table.join(flags, "doc_id").select("text", "toxic").union(extra))


@pytest.mark.parametrize("hidden", ["idiot", "1d10t", "i d i o t", "IDIOT!!", "m0r0n,", "5tup1d", "stuuuupid", "$tupid", "s-t-u-p-i-d", "mo​ron", "ｉｄｉｏｔ", "i.d.i.o.t", "moooron", "id!ot"])
def test_disguises_are_read(model, hidden):
    plain = "the rest of a text " + hidden + " with other words"
    assert model.score(plain) >= 0.7 > 0.3 > model.score(plain.replace(hidden, "nice"))
    assert set(toxicity._WORD.findall(model.restore(hidden))) & {"idiot", "moron", "stupid"}


def test_beginnings_and_clean_text(model):
    assert model.score("some verpfuerei and verpfugung and verpfuest here") >= 0.7
    for t in ["", "   ", "A price of 100 $ at 10:30, see (a) b c.", "a a a a a a", "THE!! END!!", "x" * 50_000, "1 " * 20_000, "a$b!c " * 2_000, "$" * 100, "0" * 500 + "text", "1" * 61, "@" * 70 + "!" * 70]:
        assert model.score(t) < 0.3


@pytest.mark.parametrize("gap", [" ", "  ", "   ", " \n\t "])
def test_spaced_words_are_read_at_every_place(model, gap):
    for before in range(25):
        said = ["moron"] * before + ["idiot", "stupid"]
        assert model.restore(gap.join("".join(said))).split() == said
        assert model.restore((gap * 4).join(gap.join(w) for w in said)).split() == said


def test_long_spaced_text_is_read_as_a_whole(model):
    said = ["stupid", "moron", "idiot"] * 700
    got = model.restore(" ".join("".join(said))).split()
    assert Counter(got) == Counter(said)


@pytest.mark.parametrize("hidden", ["st" + "u" * 60 + "pid", "st" + "u" * 5000 + "pid", ".".join("stupid" * 12), "/".join(["1d10t"] * 15), "_".join(["1d10t"] * 15), "-".join("m0r0n" * 500)])
def test_long_stretches_are_read(model, hidden):
    assert len(hidden) > 60 and model.score("the rest of a text " + hidden + " with other words") >= 0.7
    found = model.restore(hidden)
    assert any(w in found for w in ("idiot", "moron", "stupid"))


def test_doubled_letters_are_reduced_one_by_one():
    words = Counter({"asshole": 9, "ashes": 9, "hole": 9})
    model = toxicity.Model({"asshole": 5.0}, toxicity.CharModel(toxicity.CharModel.count(words)))
    assert model.restore("asshoole") == "asshole"


def test_all_states_are_kept():
    vowels = [a + b + c + d for a in "aeiou" for b in "aeiou" for c in "aeiou" for d in "aeiou"]
    model = toxicity.CharModel(toxicity.CharModel.count(Counter({**dict.fromkeys(vowels, 50), "uoiexyz": 1})))
    assert model.decode("****xyz") == "uoiexyz"


def test_decoder_keeps_no_more_than_it_needs(model, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdi10@$*.-eo") for _ in range(300)) for _ in range(10)] + ["z" * 3000 + "1d10t"]
    want = [model.chars.decode(t) for t in texts]
    monkeypatch.setattr(toxicity, "SETTLE", 3)
    monkeypatch.setattr(toxicity, "CACHE_COSTS", 50)
    assert [model.chars.decode(t) for t in texts] == want


def test_decoder_finds_the_cheapest_path(model):
    """Against all readings of a short stretch, spelled out."""
    chars = model.chars

    def cost(word):
        padded, total = "^" + word + "$", 0.0
        for i in range(1, len(padded)):
            total += chars.cost(padded[max(0, i - toxicity.ORDER + 1) : i], padded[i])
        return total

    for stretch in ["1d10t", "st0ne", "m0r0n", "l1ed"]:
        readings = [("", 0.0)]
        for c in stretch:
            steps = [(c, 0.0)] if c.isalpha() else [(x, 1.0) for x in toxicity.LOOKALIKES[c]]
            readings = [(w + x, k + extra) for w, k in readings for x, extra in steps]
        best = min(readings, key=lambda r: cost(r[0]) + r[1])
        found = chars.decode(stretch)
        if " " not in found:
            assert cost(found) + sum(not c.isalpha() for c in stretch) <= cost(best[0]) + best[1] + 1e-9


def test_scores_of_odd_rows(documents, model):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (1, "idiot moron"), (1, "idiot moron")]
    got = toxicity.score(documents(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.keep_clean(documents(rows), model).count() == len(rows) - 2
    assert toxicity.score(documents([]), model).count() == 0


def test_copies_do_not_thin_out_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    monkeypatch.setattr(toxicity, "PER_CLASS", 100)
    others = [(words(rng, 12, "aeinrstlodhc", 7), y) for y in (0, 1) for _ in range(200)]
    table = spark.createDataFrame(others, "text string, toxic int")
    hot = spark.range(5_000).select(F.lit("one text that is copied over and over again").alias("text"), F.lit(1).alias("toxic"))
    near = spark.range(5_000).select(F.concat(F.lit(words(rng, 900) + " "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("toxic"))
    got = toxicity._sample(table.union(hot).union(near), "toxic", "text").toPandas()
    sizes = got.groupby("y")["n"].max().to_dict()
    assert sizes[0] == 200 and 202 <= sizes[1] <= 220
    for y in (0, 1):
        assert 70 <= len(got[got["y"] == y]) <= 130
    short = toxicity.near_keys(["", "a", "A b", "a b c D", "a b c d", "a b c d e", "z", ""])
    assert short[3] == short[4] and short[0] == short[7] and len(set(short[[0, 1, 2, 3, 6]].tolist())) == 5


def test_training_without_labels(documents, spark):
    model = toxicity.train(spark.createDataFrame([], "text string, toxic int"))
    assert model.score("idiot") < 0.1
    only = toxicity.train(spark.createDataFrame([("a b c", 1), (None, 1), ("x", 7)], "text string, toxic int"))
    assert only.score("a b c") < 0.5


def test_evidence_drops_explained_beginnings():
    marks = pd.DataFrame({"name": ["lowe-1", "lowei-1", "lower", "lowerx"], "toxic": [100, 95, 3, 3], "clean": [0, 0, 0, 0], "e": [3.0, 4.0, 2.0, 2.0]})
    assert "lowe-1" not in toxicity._unexplained(marks) and "lowei-1" in toxicity._unexplained(marks)


def test_all_labelled_texts_teach(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(toxicity, "PER_CLASS", 20)
    monkeypatch.setattr(toxicity, "LANGUAGE_TEXTS", 5, raising=False)
    rare = ["q" + c * 2 + "vbmq" for c in "bcdfghjk"]
    rows = [(words(rng, 15, "aeinrstlodhc", 7) + " " + rare[i % 8], 1) for i in range(160)] + [(words(rng, 15, "aeinrstlodhc", 7), 0) for _ in range(160)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    assert all(model.score(f"the rest of it {w} and more") >= 0.7 for w in rare) and model.score("the rest of it and more") < 0.3
    # The character model has counted every word of every text.
    assert model.chars.grams["^q"] == 160


def test_texts_are_counted_as_by_a_plain_loop():
    rng = random.Random(9)
    texts = [words(rng, 40, "aeinrst", 9) + rng.choice([" Größe GROSSE Größen", " x²y ａｂｃｄ", "a1b_c", ""]) for _ in range(60)] + ODD
    features, occurring = Counter(), Counter()
    for t in texts:
        found = toxicity._WORD.findall(toxicity.normal(t))
        stems = Counter(b for w in found for b in toxicity.beginnings(w))
        features.update({*found, *(f"{b}-{k}" for b, n in stems.items() for k in range(1, min(n, toxicity.TIMES) + 1))})
        occurring.update(found)
    assert toxicity._counted(texts, None, None) == (features, occurring)
    among = frozenset(rng.sample(sorted(features), len(features) // 3))
    stems = frozenset(f.rpartition("-")[0] for f in among if "-" in f)
    assert toxicity._counted(texts, among, stems) == ({f: n for f, n in features.items() if f in among}, occurring)
    assert toxicity._counted([], None, None) == toxicity._counted(["", "1 2"], None, None) == ({}, {})


@pytest.mark.parametrize("bits", [0, 3, 26])
def test_few_texts_but_those_kept_are_shuffled(spark, monkeypatch, bits):
    """Whatever the bitmap lets pass, a text of each group and class is kept; a large one lets little else pass."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "KEPT_BITS", bits)
    rng = random.Random(6)
    own = [words(rng, 30, "aeinrstlodhc", 7) for _ in range(40)]
    rows = [(i, own[i % 40]) for i in range(400)] + [(1, own[1]), (None, own[2]), (900, None)]
    labels = [(i, int(i % 40 < 10)) for i in range(200)] + [(0, 0), (0, 1), (0, 1), (7, None), (8, 5), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = toxicity._distinct(docs, "toxic", "text", spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id")
    want = sorted([(int(k < 10), own[k]) for k in range(40)] + [(0, own[0])])
    assert sorted((r.y, r.text) for r in kept.collect()) == want
    given = spark.createDataFrame([(t, i % 2) for i, t in rows if i is not None], "text string, toxic int")
    alone = toxicity._distinct(given, "toxic", "text", None, "doc_id")
    assert sorted((r.y, r.text) for r in alone.collect()) == sorted({(i % 2, t) for i, t in rows if i is not None and t})
    if bits == 26:
        marks = toxicity.Proposal(log2=bits).with_phrases(docs.where("doc_id < 5").select(F.xxhash64("doc_id").alias("h")))
        assert toxicity._passed(docs.select(F.xxhash64("doc_id").alias("mark"), "text"), marks).count() == 6


def test_fitted_weights_are_the_best_ones(spark):
    rng = np.random.default_rng(1)
    evidence = np.array([2.0, 3.0, 4.0, 5.0])
    rows = [(int(y), sorted(set(rng.choice(4, 2).tolist())) if y or k % 5 == 0 else [], int(n)) for k, (y, n) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(1, 9, 60)))]
    bias, w = toxicity._fit(spark.createDataFrame(rows, "y int, signs array<int>, n long"), evidence)

    def loss(b, v):
        z = np.array([b + v[s].sum() for _, s, _ in rows])
        y, n = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        return (n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (0.04 * (3 / evidence) ** 2 * v * v).sum()

    best = loss(bias, w)
    assert (w >= 0).all()
    for k in range(4):
        for step in (-0.02, 0.02):
            assert loss(bias, np.maximum(0, w + step * np.eye(4)[k])) >= best - 1e-6
    assert min(loss(bias - 0.02, w), loss(bias + 0.02, w)) >= best
