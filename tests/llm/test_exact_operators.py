"""Operators with exact contracts against brute force over small fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from tidemark.llm import brown_lm, mixing, topk
from tidemark.llm.brown_lm import brown_scores, exchange
from tidemark.llm.components import components
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix, realise
from tidemark.llm.ngram_join import choose_prefix, similar_documents
from tidemark.llm.sharding import CapacityTree, best_fit_decreasing, pack_into, shard
from tidemark.llm.topk import top_k
from tidemark.llm.window_dedup import dedup_windows
from tests.llm.conftest import DOCS

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [x.decode() for x in (text or "").encode().lower().split()]


def brute_lines(rows, least=10):
    holders = defaultdict(set)
    keyed = {}
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        keyed[d] = [(x, x.translate(LOWER).strip(WS)) for x in lines]
        for _, k in keyed[d]:
            if len(k) >= least:
                holders[k].add(d)
    out = {}
    for d, lines in keyed.items():
        kept = [x for x, k in lines if not (len(k) >= least and len(holders[k]) > 1 and min(holders[k]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, rows):
    want = brute_lines(rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(docs).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 10


def test_line_dedup_repeats_nulls_and_clashes(spark, empty):
    rows = [(1, "same long line here\nother", "x"), (1, "different\nsame long line here", "y"), (2, "SAME long line here ", "z"), (None, "same long line here", "n"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, drops string")
    out = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(df).collect())
    assert out == [(0, 1, 0, "same long line here"), (1, 2, 0, "different\nsame long line here"), (1, 2, 0, "same long line here\nother"), (2, 1, 1, ""), (3, 1, 0, "")]
    assert dedup_lines(empty).count() == 0


def brute_windows(rows, length=100):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[d] = (len(data), int(gone.sum()), len(edges) // 2, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def test_window_dedup(docs, rows):
    want = brute_windows(rows)
    found = dedup_windows(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found} == want
    assert sum(x[1] for x in want.values()) > 3000
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_window_dedup_other_length_and_edge_rows(spark, rows, empty):
    df = spark.createDataFrame([*rows, (None, rows[5][1] or "t" * 300, None, None, None)], DOCS)
    want = brute_windows(rows, 64)
    got = dedup_windows(df.withColumn("marks", F.lit(1)), 64, with_text=False).where("doc_id IS NOT NULL").collect()
    assert {r["doc_id"]: r["kept"].decode() for r in got} == {d: hashlib.sha256(x[3]).hexdigest() for d, x in want.items()}
    assert dedup_windows(empty).count() == 0
    again = spark.createDataFrame([(1, "q" * 99 + "w" * 120), (1, "q" * 99 + "w" * 120), (2, "w" * 110)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in dedup_windows(again).collect()) == [(1, 119), (1, 119), (2, 110)]


def test_window_dedup_common_lines_in_many_texts(spark):
    """Lines that most texts hold between words of their own: one a little shorter than a window, one longer, one that repeats inside a text."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("klmnopq") for _ in range(5))
    short, long, twice = ("".join(rng.choice("abcdef") for _ in range(n)) for n in (95, 130, 60))
    rows = []
    for i in range(120):
        parts = [word() for _ in range(30)]
        for line in (short, long, twice + twice + twice) if i % 3 else (short,):
            parts.insert(rng.randrange(len(parts)), line)
        rows.append((rng.randrange(10**6) * 200 + i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_windows(df).collect()}
    assert got == brute_windows(rows)


def brute_components(rows, k=5, percent=75):
    sets = {}
    for d, t, *_ in rows:
        w = split(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_ngram_join(docs, rows):
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(docs).collect()}
    assert got == want
    assert max(Counter(c for _, c in want.values()).values()) > 5


def test_ngram_join_scattered_copies(spark):
    """A large group of copies of which many only link through others, so that no leader joins all."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(df).collect()}
    assert got == brute_components(rows)
    assert 1 < len({c for _, c in got.values()}) < 90


def test_ngram_join_edge_rows(spark, empty):
    assert similar_documents(empty).count() == 0
    df = spark.createDataFrame([(5, "a b c"), (2, "A  b\tC"), (7, None), (8, ""), (None, "a b c"), (2, "A b c")], "doc_id long, text string")
    assert sorted(map(tuple, similar_documents(df).collect())) == [(2, 1, 2), (2, 1, 2), (5, 1, 2), (7, 0, 7), (8, 0, 8)]


def test_prefix_lengthens_with_heavy_shingles():
    s = np.arange(1, 41, dtype=np.uint64)
    light, e1, few = choose_prefix(s, np.zeros(0, np.uint64), np.zeros(0, np.int64), 75)
    heavy, e2, many = choose_prefix(s, s, np.full(40, 5000), 75)
    assert (len(light), e1) == (11, 1)
    assert e2 > 1 and len(heavy) == 10 + e2
    assert few == 0 and many == 5000 * len(heavy)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(150)]
    rows += [(i, rows[17][1]) for i in range(200, 220)]  # ties
    bad = [(300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (700, [1.0, 2.0]), (800, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 100 = 0"), 10).collect())
    ints = {i: np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(int) for i, v in rows}
    want = []
    for q in (x for x in ints if x % 100 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert top_k(df.limit(0), df, 10).count() == 0


def test_mixing_realises_weights(docs, rows, empty):
    mixed = mix(docs, budget_share=1.0, entropy_share=0.98, max_repeat=4.0).collect()
    assert len(mixed) == len(rows)
    tokens, copies, weight = Counter(), Counter(), {}
    for r in mixed:
        assert r["n_tokens"] == len(split(r["text"]))
        s = r["source"] or ""
        tokens[s] += r["n_tokens"]
        copies[s] += r["n_tokens"] * r["copies"]
        weight[s] = r["weight"]
        assert r["copies"] <= 4
    total = sum(tokens.values())
    longest = max(r["n_tokens"] for r in mixed)
    assert abs(sum(weight.values()) - 1) < 1e-6
    for s in tokens:
        assert 0 <= weight[s] * total - copies[s] + 1 <= longest + 2
    h = -sum(w * math.log(w) for w in weight.values())
    assert h >= 0.98 * math.log(len(weight)) - 1e-4 or max(weight[s] * total / tokens[s] for s in tokens) > 3.99
    assert mix(empty).count() == 0
    shown = realise(mix(docs, entropy_share=0.98))
    assert shown.count() == sum(r["copies"] for r in mix(docs, entropy_share=0.98).collect())


def test_mixing_single_source_and_proportional(spark):
    df = spark.createDataFrame([(i, "a b c", "only", "x") for i in range(9)], "doc_id long, text string, source string, block string")
    assert {r["copies"] for r in mix(df).collect()} == {1}


def test_capacity_tree_against_a_sorted_list():
    import bisect
    import random

    rng, tree, plain = random.Random(2), CapacityTree(), []
    for i in range(3000):
        if rng.random() < 0.6 or not plain:
            key = (rng.randrange(500), i)
            tree.insert(key)
            bisect.insort(plain, key)
        else:
            size = rng.randrange(500)
            at = bisect.bisect_left(plain, (size, -1))
            assert tree.take(size) == (plain.pop(at) if at < len(plain) else None)


def test_best_fit_decreasing():
    sizes = {"a": 7, "b": 6, "c": 4, "d": 3}
    assert best_fit_decreasing(sizes, 10) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert len(set(best_fit_decreasing({i: 5 for i in range(7)}, 10).values())) == 4
    assert best_fit_decreasing({"big": 50, "x": 1}, 10)["big"] != best_fit_decreasing({"big": 50, "x": 1}, 10)["x"]
    packed = pack_into({i: 1 + i % 17 for i in range(500)}, 8)
    loads = Counter()
    for i, b in packed.items():
        loads[b] += 1 + i % 17
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 17


def test_sharding(docs, rows, empty):
    out = shard(docs.withColumn("slot", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    by_text, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by_text[r["text"] or ""].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) <= set(range(8))
    assert shard(empty).count() == 0
    fixed = shard(docs, capacity=20_000).groupBy("shard").agg(F.sum("size").alias("n"), F.count_distinct("text").alias("t")).collect()
    assert all(r["n"] <= 20_000 or r["t"] <= 1 for r in fixed)
    assert len(fixed) <= math.ceil(sum(loads.values()) / 20_000) + 2


def test_brown_scores(docs, rows, empty):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = {r["doc_id"]: r for r in brown_scores(docs, learn).collect()}
    counts = Counter()
    tokens = lambda t: [*split(t), None]
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for d, t, *_ in rows:
        w = tokens(t)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert r["score"] < 0
    assert brown_scores(empty).count() == 0


def test_brown_model_is_a_distribution(spark):
    """All one-word texts over the vocabulary plus one unknown word, times the chance to go on, sum to at most one."""
    train = [(i, t) for i, t in enumerate(["a b a b c", "a c", "b a d", "c d a b"] * 5)]
    texts = [(100 + i, w) for i, w in enumerate(["a", "b", "c", "d", "zzz", ""])]
    df = spark.createDataFrame(train + texts, "doc_id long, text string")
    got = brown_scores(df, F.col("doc_id") < 100).where("doc_id >= 100").collect()
    assert 0.05 < sum(10 ** r["score"] for r in got) <= 1 + 1e-9


def test_brown_core_words_keep_their_class_when_a_count_level_overflows(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "HEAD", 1)
    df = spark.createDataFrame([(i, "a b " * 8) for i in range(20)] + [(100, "a b a b"), (101, "a a b b")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in brown_scores(df, F.col("doc_id") < 100).collect()}
    assert s[100] > s[101] + 1


def test_brown_core_is_of_whole_counts():
    """A word that is rare in every batch may be frequent over all: no batch leaves words out."""
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i}" for i in range(3 * brown_lm.CORE)), " ".join(f"v{i}" for i in range(3 * brown_lm.CORE))]})
    got = pa.Table.from_batches(list(brown_lm._word_counts(iter([batch]))))
    assert got.num_rows == 6 * brown_lm.CORE and set(got["n"].to_pylist()) == {1}


def test_exchange_finds_alternating_classes():
    b = np.zeros((7, 7))
    b[:3, 3:6] = 5
    b[3:6, :3] = 5
    of = exchange(b, 6, 2)
    assert len(set(of[:3])) == 1 and len(set(of[3:6])) == 1 and of[0] != of[3]


def brute_brown(train, texts):
    """The class model in plain Python, classes given: scores of texts from counts."""
    classes, counts, words = train
    size = Counter()
    for w, n in words.items():
        size[classes[w]] += n
    once = sum(n == 1 for n in words.values())

    def score(tokens):
        total, before = 0.0, "end"
        for w in [*tokens, None]:
            c = "end" if w is None else classes.get(w, "rare")
            row = counts[before]
            total += math.log10(row[c] / sum(row.values()))
            if w is not None:
                total += math.log10((words.get(w, 0) + 1) / (2 * once + 1)) if c == "rare" else math.log10(words[w] / size[c])
            before = c
        return total

    return [score(t) for t in texts]


def test_brown_scores_against_plain_python(spark, monkeypatch):
    """With a small table the words outside it, single, in rows and at both ends, get the score of the whole model."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    train = [[vocabulary[min(int(rng.expovariate(0.12)), 39)] for _ in range(rng.randint(1, 12))] for _ in range(120)]
    asked = [["w0", "w30", "w31", "w1"], ["w29", "w28", "w27"], ["never", "w35"], ["w2"], [], ["never", "seen", "w0"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(train)] + [(1000 + i, " ".join(t)) for i, t in enumerate(asked)]
    seen = {}
    table = brown_lm._table

    def keep_table(vocabulary_, core, core_class, room):
        out = table(vocabulary_, core, core_class, room)
        seen["words"] = {r["word"]: (r["n"], r["class"]) for r in vocabulary_.collect()}
        seen["head"] = dict(zip(out[0].tolist(), out[2].tolist(), strict=True))
        return out

    monkeypatch.setattr(brown_lm, "_table", keep_table)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in brown_scores(df, F.col("doc_id") < 1000, core_words=4, table_words=3).collect()}
    hashed = {}
    for w in {*vocabulary, "never", "seen"}:
        for _, h, _ in brown_lm._tokens(pa.array([w])):
            hashed[w] = int(h[0])
    name = lambda c: "rare" if c == brown_lm.OTHER else "end" if c == brown_lm.END else c
    of = {w: seen["head"].get(h, seen["words"][h][1]) for w, h in hashed.items() if h in seen["words"]}
    counts = {name(a): {name(b): 0.5 for b in range(brown_lm.ALL)} for a in range(brown_lm.ALL)}
    for t in train:
        cs = ["end", *(name(of[w]) for w in t), "end"]
        for a, b in zip(cs, cs[1:], strict=False):
            counts[a][b] += 1
    words = {w: seen["words"][h][0] for w, h in hashed.items() if h in seen["words"]}
    assert len(seen["head"]) < len(words) / 2
    want = brute_brown(({w: name(c) for w, c in of.items()}, counts, words), asked)
    for i, x in enumerate(want):
        assert abs(got[1000 + i] - x) < 1e-6


def test_brown_table_changes_no_score(docs):
    """Two sizes of the table, far below the vocabulary and above it, give equal scores."""
    got = [{r["doc_id"]: r["score"] for r in brown_scores(docs, core_words=16, table_words=n).collect()} for n in (8, 300, None)]
    for d, x in got[-1].items():
        assert all(abs(other[d] - x) < 1e-9 * max(1, abs(x)) for other in got[:-1])


def test_sharding_packs_every_group(spark):
    """All groups are placed by best fit: no shard is fuller than the mean plus one bin or the largest group, whatever the sizes."""
    import random

    rng = random.Random(6)
    texts = ["x" * int(rng.paretovariate(1.1) * 20) + str(i) for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3]) for i in range(80)] + [(None, texts[5]), (None, texts[5]), (None, None)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    loads, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text"] or ""].add(r["shard"])
    groups = Counter()
    for r in out:
        groups[r["text"] or ""] += r["size"]
    total = sum(loads.values())
    assert len(out) == len(rows) and all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= max(total / 8 * 1.01 + 50, max(groups.values()))
    fixed = shard(spark.createDataFrame(rows, "doc_id long, text string"), capacity=max(groups.values())).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert all(r["n"] <= max(groups.values()) for r in fixed) and len(fixed) <= math.ceil(total / max(groups.values())) + 1


def test_top_k_repeats_nulls_and_carried_floors(spark, monkeypatch):
    """Several blocks, so that kth scores are carried; repeated and null ids; no queries."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=5), 2)]) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), rows[7]], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 6).collect())
    ints = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in [*rows, rows[7]]]
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(ints[q][1] @ v), i) for i, v in ints if i != q)[:6]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert top_k(df, df.limit(0), 6).count() == 0


def test_mixing_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (None, "d", None), (1, "e f", "s"), (1, "e f", "s"), (2, None, "t")]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), entropy_share=0.5).collect()
    assert len(out) == 6 and all(r["copies"] >= 0 for r in out) and sum(r["n_tokens"] for r in out) == 11


def test_line_dedup_drops_a_column_named_tag(spark):
    df = spark.createDataFrame([(1, "a long enough line", "x")], "doc_id long, text string, tag string")
    assert "tag" not in dedup_lines(df).columns


def test_ngram_join_keeps_no_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y")], "doc_id long, text string, component_id string")
    assert [tuple(r) for r in similar_documents(df).orderBy("doc_id").collect()] == [(1, 2, 1), (2, 2, 1)]


def test_brown_scores_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 3), (2, "word " * 50_000, 4)], "doc_id long, text string, score int")
    out = brown_scores(df).collect()
    assert len(out) == 4 and len({round(r["score"], 9) for r in out if r["n_tokens"] == 3}) == 1 and "score" in out[0].asDict()


@pytest.mark.parametrize("size", [3e4, 3e5, 1.2e6])
def test_top_k_of_large_components(spark, size):
    rng = random.Random(int(size))
    vectors = [(i, [float(int(rng.uniform(-size, size))) for _ in range(6)]) for i in range(400)] + [(1000 + i, [size, size - i % 3, 0.0, 0.0, 1.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ints = {i: [int(1024 * x) for x in v] for i, v in vectors}
    want = []
    for q in (0, 100, 1000):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert (size > 1e5) == any(abs(w[3]) > 2**53 for w in want)
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id % 100 = 0 AND vec_id IN (0, 100, 1000)"), 10).collect()) == want


def test_top_k_refuses_what_a_long_cannot_hold(spark):
    df = spark.createDataFrame([(i, [3e9 + i]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        top_k(df, df, 2).collect()
    far = spark.createDataFrame([(1, [1e18]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        top_k(far, far, 2).collect()


def test_joins_of_written_tables_broadcast_nothing(docs, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *args, **named):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    before = docs.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    similar_documents(docs)
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert not [p for p in plans if "BroadcastHashJoin" in p and "blocks" not in p]  # of lists longer than a block there are few
    assert docs.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_mixing_tries_exponents_in_few_jobs(spark, docs, monkeypatch):
    def mixed(group):
        spark.sparkContext.setJobGroup(group, "")
        try:
            rows = sorted(mix(docs, entropy_share=0.98).select("doc_id", "weight", "copies", "block").collect())
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    fine, few = mixed("mix-fine")
    monkeypatch.setattr(mixing, "FEW", 0)
    coarse, many = mixed("mix-coarse")
    assert fine == coarse
    assert few <= 40 and few < many  # 31 here, 58 when each try summed the blocks anew
