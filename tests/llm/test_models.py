"""Learned operators: held-out accuracy; retrieval against brute force; the pipeline stage by stage."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_exact_operators import brute_components, split
from tidemark.llm import quality, toxicity
from tidemark.llm._common import fold
from tidemark.llm.decontamination import contaminated, decontaminate, lcs_length, right_singular
from tidemark.llm.queries import QUERIES
from tidemark.llm.textbytes import chunks

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES[name](spark, sf).where("held_out").join(labels, "doc_id").collect()
    return np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([r["score"] for r in rows])


def test_quality_held_out(spark):
    y, p, s = held_out(spark, "op3_quality", "quality")
    assert (y == p).mean() >= 0.95
    assert s[y == 1].mean() > s[y == 0].mean() + 0.4


def test_toxicity_held_out(spark):
    y, p, s = held_out(spark, "op5_toxicity", "toxic", "/root/testdata/sf0.1")  # sf0.01 has some 40 positives to learn from, too few
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = (y == 1).sum()
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (y == 0).sum())
    assert auc >= 0.9


def test_classifiers_without_labels_and_with_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for module in (quality, toxicity):
            out = module.score(docs.withColumn("score", F.lit("clash")), module.fit(docs, labels)).collect()
            assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
            assert module.score(empty, module.fit(empty, labels)).count() == 0


def test_lcs():
    a = np.array([1, 2, 3, 4, 2])
    assert lcs_length(a, np.array([2, 9, 3, 2])) == 3
    assert lcs_length(a, np.zeros(0, int)) == 0
    assert lcs_length(a, a) == 5


def test_decontamination_finds_verbatim_and_paraphrased_items(spark, docs, rows, empty):
    import random

    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("klmnopq") for _ in range(6)) for _ in range(30))) for i in range(20)]
    def reworded(t):
        w = t.split()
        for j in range(0, 30, 6):
            w[j] = "other"
        return " ".join(w)
    planted = [(9001, f"Before, {items[3][1].upper()}. After that."), (9002, "x y " * 50 + reworded(items[7][1])), (9003, " ".join(reversed(items[5][1].split()))), (9004, " ".join(items[6][1].split()[:6]) + " end")]
    all_docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame(planted, "doc_id long, text string")).withColumn("item_id", F.lit(0))
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (None, "q"), items[3]], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(all_docs, benchmark).collect()}
    assert found == {(9001, 3), (9002, 7)}
    assert decontaminate(all_docs, benchmark).count() == all_docs.count() - 2
    assert contaminated(empty, benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0


def test_decontamination_finds_paraphrases_of_an_item_held_by_a_hot_group(spark, docs):
    """Copies make all words of the item common; whichever words a paraphrase changes, it is found."""
    import random

    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choice("klmnopq") for _ in range(6)) for _ in range(30))) for i in range(20)]
    w = items[7][1].split()
    changed = [(8000 + r, " ".join("other" if j % 6 == r else x for j, x in enumerate(w))) for r in range(6)]
    copies = [(9000 + i, items[7][1]) for i in range(60)]
    held = docs.select("doc_id", "text").unionAll(spark.createDataFrame(changed + copies, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(held, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(d, 7) for d, _ in changed + copies}


def test_decontamination_finds_items_longer_than_a_window(spark, docs):
    import random

    rng = random.Random(6)
    items = [(i, " ".join("".join(rng.choice("klmnopq") for _ in range(6)) for _ in range(1200))) for i in range(12)]
    reworded = " ".join("other" if rng.random() < 0.12 else x for x in items[11][1].split())
    planted = [(8000 + i, f"Before. {t} After.") for i, t in items[:10]] + [(8011, reworded), (8012, " ".join(items[10][1].split()[:400]))]
    held = docs.select("doc_id", "text").unionAll(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(held, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {*((8000 + i, i) for i in range(10)), (8011, 11)}


def test_decontamination_recall_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    text = {r["doc_id"]: " ".join(split(r["text"])) for r in docs}
    want = {(d, i["item_id"]) for d, t in text.items() for i in items if " ".join(split(i["text"])) in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(want) + 1


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = [], [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(seen[-1], docs.schema)
        docs = stage(spark, docs, sf)
        names.append(name)
        seen.append(docs.collect())
    start, good, apart, clean, mixed, sharded = seen
    assert names == ["quality", "near_duplicates", "decontamination", "mixture", "shards"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert np.mean([(r["doc_id"] in kept) == bool(labels[r["doc_id"]]) for r in start if r["doc_id"] in labels]) > 0.9
    groups = brute_components([tuple(r) for r in good])
    assert sorted(r["doc_id"] for r in apart) == sorted(d for d, (_, c) in groups.items() if c == d)
    items = [" ".join(split(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in apart if any(i in " ".join(split(r["text"])) for i in items)}
    assert not leaks & {r["doc_id"] for r in clean} and len(apart) - len(clean) <= len(leaks) + 1
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert len(sharded) == len(mixed) and {r["shard"] for r in sharded} <= set(range(8))
    assert list(mixed[0].asDict()) == list(start[0].asDict())


def test_randomised_svd_of_passages():
    """Singular values and right singular vectors out of one product with A'A, against numpy's SVD."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(300, 40)) @ np.diag(0.7 ** np.arange(40)) @ rng.normal(size=(40, 120))
    start = rng.normal(size=(120, 20))
    vectors, values = right_singular(a.T @ (a @ start), start)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(values[:6], s[:6], rtol=1e-2)
    assert np.linalg.svd(vectors[:, :8].T @ vt[:8].T)[1].min() > 0.999
    low = rng.normal(size=(50, 5)) @ rng.normal(size=(5, 120))  # fewer directions than columns of the start
    assert right_singular(low.T @ (low @ start), start)[0].shape == (120, 5)


def test_decontamination_recall_of_paraphrases_of_many_items(spark, docs):
    """2048 items in one block, 300 of them paraphrased: a sixth of the words changed, some left out, in other text."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(6000)]
    word = lambda: vocabulary[min(int(rng.expovariate(1 / 900)), len(vocabulary) - 1)]  # noqa: E731  few words are frequent
    items = [(i, " ".join(word() for _ in range(rng.randint(20, 45)))) for i in range(2048)]
    planted = []
    for i in rng.sample(range(2048), 300):
        w = [word() if rng.random() < 1 / 6 else x for x in items[i][1].split() if rng.random() > 0.03]
        around = [word() for _ in range(rng.randint(20, 80))]
        planted.append((10_000 + i, " ".join(around[:20] + w + around[20:])))
    held = docs.select("doc_id", "text").unionAll(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(held, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, d - 10_000) for d, _ in planted}
    assert len(found & want) >= 0.9 * len(want)
    assert len(found - want) <= 0.02 * len(want)


def test_toxicity_held_out_with_few_positives(spark):
    """Some 40 positives to learn from."""
    y, p, s = held_out(spark, "op5_toxicity", "toxic")
    rank = np.argsort(np.argsort(s)) + 1
    n1 = (y == 1).sum()
    assert (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (y == 0).sum()) >= 0.9


def test_scores_of_given_models_against_plain_python(spark, docs, rows):
    """Both classifiers score a text by hand-sized models as plain Python does."""
    import pyarrow as pa

    table = np.random.default_rng(1).normal(size=1 << quality.BITS)
    model = quality.SubwordModel(np.stack([table, np.zeros_like(table)], axis=1), np.array([[0.0, 1.0], [0.0, 0.0]]), np.array([0.2, 0.5]))
    flat, bias = model.table()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    chosen = np.unique(np.random.default_rng(2).integers(0, 1 << toxicity.BITS, 400_000))
    weights = np.random.default_rng(3).normal(size=len(chosen)).astype(np.float32)
    toxic = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), toxicity.LinearModel(chosen, weights, -0.3)).collect()}
    place = dict(zip(chosen.tolist(), weights.tolist(), strict=True))
    for d, t, *_ in rows[:25]:
        c = next(iter(chunks(pa.array([t or ""], pa.string()))), None)
        odds = bias
        for b, _ in quality.buckets(c):
            odds += sum(float(flat[x]) for x in b.tolist()) / max(len(b), 1) / quality.KINDS
        assert abs(got[d] - 1 / (1 + np.exp(-odds))) < 1e-6
        held = {x for b, _ in toxicity.buckets(c) for x in b.tolist()}
        assert abs(toxic[d] - 1 / (1 + np.exp(-(-0.3 + sum(place.get(x, 0.0) for x in held))))) < 1e-5


def test_classifiers_with_repeated_null_and_clashing_rows(spark):
    text = "same text again"
    odd = spark.createDataFrame([(1, text, "p"), (1, text, "p"), (None, text, "q"), (2, None, "r"), (3, "word " * 60_000, "s")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        out = module.score(odd, module.fit(odd, labels)).collect()
        assert len(out) == 5 and len({r["score"] for r in out if r["text"] == text}) == 1 and {r["predicted"] for r in out} <= {0, 1}


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows and clashing columns pass every stage."""
    rows = [(1, "one text of six words here", "en", "a", 26), (1, "one text of six words here", "en", "a", 26), (None, "no id but a text of its own", None, None, 27), (2, None, "en", "b", None), (3, "", None, "b", 0), (4, "another text that has words", "en", "b", 27)]
    clashing = ["before", "budget", "whole", "src", "order_key", "weight", "n_tokens", "copies", "block", "upto", "copy", "score", "predicted"]
    schema = DOCS + ", rank string, start int, slot string, " + ", ".join(f"{c} string" for c in clashing)
    whole = spark.createDataFrame([(*r, "x", 1, "y", *[f"own {c}" for c in clashing]) for r in rows], schema)
    for name, docs_ in (("some", whole), ("none", whole.limit(0))):
        sf = str(tmp_path / name)
        docs_.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").limit(10 if name == "some" else 0).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "an item of some words"), (None, "x"), (2, None)], "item_id long, text string").limit(10 if name == "some" else 0).write.parquet(f"{sf}/benchmark.parquet")
        seen = spark.read.parquet(f"{sf}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES:
            before, seen = seen.columns, stage(spark, seen, sf)
            if stage_name != "shards":
                assert seen.columns == before
        out = seen.collect()
        assert all(r[c] == f"own {c}" for r in out for c in clashing)
        assert {"shard", "slot", "rank", "start"} <= set(seen.columns)
        assert (len(out) == 0) if name == "none" else len(out) >= 1
