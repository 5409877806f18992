"""Cuts by the sparse index against a list of all units, exact round trips and odd rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.fill_middle import UnitIndex, fill_middle, restored

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("abZ <>\n\t1é中\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 7), st.integers(1, 9))
def test_index_finds_every_unit(text, every, width):
    units = UNIT.findall(text)
    index = UnitIndex.of(np.frombuffer(text.encode(), dtype=np.uint8), every=every, width=width)
    assert (index.n_units, index.n_points, len(index.units)) == (len(units), len(text), -(-len(units) // every))
    assert [index.point_of(u, width=width) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]
    assert [text.encode()[b:].decode() for b in index.at_byte] == ["".join(units[u:]) for u in index.units]


def plain_way(doc_id, text, rate=90, swapped=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < swapped:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (0, ""), (1, None), (None, "no id here"), (2, "repeated row"), (2, "repeated row"), (2, "other text"), (3, "holds <S> already"), (4, "ends with <"), (5, "<S <P <M"), (6, "> starts"),
    (7, "é" * 5000 + "word" * 30000 + "\U0001f600 " * 300), (8, "\n\r\n\t "), (9, "x"), (10, "<<<<>>>>PSM" * 50), (-11, "negative id"),
]


@pytest.mark.parametrize("rate", [90, 100, 0])
def test_rows_equal_the_plain_way_and_round_trip(spark, rate):
    rows = ODD + [(i, f"text {i} < of <P some S> words M>" * (i % 7)) for i in range(20, 120)]
    docs = spark.createDataFrame([(d, t, 1, "f", 2) for d, t in rows], "doc_id long, text string, n int, form string, cut int").repartition(3)
    made = fill_middle(docs, rate=rate)
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(made.output, made.form).alias("back")).collect()
    want = sorted((repr(d), *map(repr, plain_way(d, t, rate)), t or "") for d, t in rows)
    assert sorted((repr(r[0]), *map(repr, r[1:6]), r.back) for r in found) == want
    assert {r.form for r in found} == ({"plain"} if rate == 0 else {"plain", "psm", "spm"})


def test_empty_table(spark):
    assert fill_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
