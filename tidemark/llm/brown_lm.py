"""LM scoring: Brown class-based bigrams.

P(text) is the product over its tokens (words, then one end) of P(class | class before) and
P(word | class). The exchange algorithm proper assigns the CORE most frequent words to classes.
Then whole sweeps go over the corpus: in each, every word of whatever count moves to the class
that most of its occurrences prefer between their neighbours' classes, an exchange step of all
words at once. Words seen once share a class with unseen ones, the end has one of its own.
Counts of all words are one shuffle of per-task sums.

Tasks get a table of the most frequent words, HEAD at most, which only saves work: a word outside
it meets its class and count by a join. Class transitions are counted in tasks where both words
are in the table; any other pair of neighbours is summed by its words, which meet their classes
by one join, or two if both are outside. In scoring, the sums of a word outside the table return
to the text by a shuffle in which two such words in a row meet again. Such a word holds less than
about one in HEAD of all tokens, so none is a hot key. CORE, CLASSES, PASSES and CONTEXT are the
model's own sizes and so shape its scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm._common import discard, text_or_empty, written
from tidemark.llm.textbytes import chunks, words

CORE = 1023
CLASSES = 32
HEAD = 1 << 17
CONTEXT = 1 << 17  # the most frequent words, whose classes the second sweep sees beside a word; all others are OTHER there
OTHER, END = CLASSES, CLASSES + 1  # class of words seen once or never, class of the end
PASSES = 2  # sweeps of all words over the corpus
ALL = CLASSES + 2
END_WORD = -1  # no word hashes to it in practice: it stands for the end in the table of counts
SWEEPS = 8
TOKENS_AT_ONCE = 2_000_000  # tokens that a map task counts before it sends their sums


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds by document) of each chunk."""
    for c in chunks(texts):
        w = words(c)
        yield c.first, w.hash.view(np.int64), w.of_doc


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each batch and their counts."""
    for batch in batches:
        parts = [h for _, h, _ in _tokens(batch["text"])]
        if parts:
            w, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n.astype(np.int64))], names=["word", "n"])


class Table:
    """A sorted table of word hashes: index or -1 of each word."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        bits = max(8, int(len(hashes)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[(hashes.view(np.uint64) >> self.shift).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.sorted):
            return out
        at = np.flatnonzero(self.maybe[(words.view(np.uint64) >> self.shift).astype(np.int64)])
        w = words[at]
        i = np.minimum(np.searchsorted(self.sorted, w), len(self.sorted) - 1)
        hit = self.sorted[i] == w
        out[at[hit]] = self.order[i[hit]]
        return out


def _with_ends(values: np.ndarray, of_doc: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """values with an end after each document, and the bounds of documents in it."""
    return np.insert(values, of_doc[1:], end), of_doc + np.arange(len(of_doc))


def _core_bigrams(batches: Iterator[pa.RecordBatch], core: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs of core words; limit stands for other words, limit + 1 for the end (before and after each text)."""
    table, side = Table(core), limit + 2
    total = np.zeros(side * side, dtype=np.int64)
    for batch in batches:
        for _, h, of_doc in _tokens(batch["text"]):
            t = table.find(h)
            t[t < 0] = limit
            t, _ = _with_ends(t, of_doc, limit + 1)
            before = np.append(limit + 1, t[:-1])
            total += np.bincount(before * side + t, minlength=side * side)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, n_words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words 0 .. n_words - 1 by the exchange algorithm; further rows of bigrams keep classes of their own.

    Starts from words dealt in order of frequency; each sweep moves every word to the class of
    greatest likelihood and stops when no word moves.
    """
    fixed = len(bigrams) - n_words
    k = classes + fixed
    of = np.append(np.arange(n_words) % classes, classes + np.arange(fixed))
    z = np.zeros((len(bigrams), k))
    z[np.arange(len(bigrams)), of] = 1
    after, before = bigrams @ z, bigrams.T @ z  # of each word: counts by class of the next, the previous word
    c = z.T @ after
    left, right = c.sum(1), c.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            a, same = of[w], bigrams[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= same
            into[a] -= same
            n_out, n_in = out.sum() + same, into.sum() + same
            if n_out + n_in == 0:
                continue
            c[a] -= out
            c[:, a] -= into
            c[a, a] -= same
            left[a] -= n_out
            right[a] -= n_in
            own = np.arange(classes)
            rows = (_xlogx(c[:classes] + out) - _xlogx(c[:classes]))
            cols = (_xlogx(c[:, :classes].T + into) - _xlogx(c[:, :classes].T))
            diagonal = c[own, own]
            gain = rows.sum(1) - rows[own, own] + cols.sum(1) - cols[own, own]
            gain += _xlogx(diagonal + out[:classes] + into[:classes] + same) - _xlogx(diagonal)
            gain -= _xlogx(left[:classes] + n_out) - _xlogx(left[:classes]) + _xlogx(right[:classes] + n_in) - _xlogx(right[:classes])
            b = int(np.argmax(gain))
            c[b] += out
            c[:, b] += into
            c[b, b] += same
            left[b] += n_out
            right[b] += n_in
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
                before[:, a] -= bigrams[w]
                before[:, b] += bigrams[w]
        if not moved:
            break
    return of


def _votes(batches: Iterator[pa.RecordBatch], known: np.ndarray, classes: np.ndarray, prefer: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, vote, n): in the batch, how many occurrences of a word prefer a class between the classes of their neighbours that are known."""
    table = Table(known)
    lookup = np.append(classes, OTHER)  # index -1
    for batch in batches:
        parts, held = [], 0
        for _, h, of_doc in _tokens(batch["text"]):
            c, _ = _with_ends(lookup[table.find(h)], of_doc, END)
            w, _ = _with_ends(h, of_doc, END_WORD)
            before, after = np.append(END, c[:-1]), np.append(c[1:], END)
            parts.append((w, prefer[before, after]))
            held += len(w)
            if held >= TOKENS_AT_ONCE:
                yield _vote_counts(parts)
                parts, held = [], 0
        if parts:
            yield _vote_counts(parts)


def _vote_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    w, vote = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(w, kind="stable")
    w, vote = w[order], vote[order]
    head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    word = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(w))))
    code, n = np.unique(word * CLASSES + vote, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(w[head[code // CLASSES]]), pa.array((code % CLASSES).astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "vote", "n"])


KNOWN, OPEN = -2, -1  # codes of _transitions: word is a pair of classes; both words of a pair are outside the table


def _transitions(batches: Iterator[pa.RecordBatch], head: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, code, other, n): counts of pairs of neighbours.

    Pairs of known classes have KNOWN and the pair as word. Where one word is outside the table,
    code is the class before it, or ALL + the class after it. Where both are, code is OPEN and
    other the second word.
    """
    table, lookup, total = Table(head), np.append(classes, -1), np.zeros(ALL * ALL, dtype=np.int64)
    parts, held = [], 0
    for batch in batches:
        for _, h, of_doc in _tokens(batch["text"]):
            c, _ = _with_ends(lookup[table.find(h)], of_doc, END)
            w, _ = _with_ends(h, of_doc, END_WORD)
            before, word_before = np.append(END, c[:-1]), np.append(END_WORD, w[:-1])
            left, right = before >= 0, c >= 0
            known, comes, goes, both = left & right, left & ~right, ~left & right, ~left & ~right
            total += np.bincount(before[known] * ALL + c[known], minlength=ALL * ALL)
            code = np.concatenate([before[comes], ALL + c[goes], np.full(both.sum(), OPEN)])
            other = np.concatenate([np.zeros(comes.sum() + goes.sum(), np.int64), w[both]])
            parts.append((np.concatenate([w[comes], word_before[goes], word_before[both]]), code, other))
            held += len(code)
            if held >= TOKENS_AT_ONCE:
                yield _transition_counts(parts)
                parts, held = [], 0
    if held:
        yield _transition_counts(parts)
    at = np.flatnonzero(total)
    yield _transition_rows(at, np.full(len(at), KNOWN), np.zeros(len(at), np.int64), total[at])


def _transition_counts(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    word, code, other = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((other, code, word))
    word, code, other = word[order], code[order], other[order]
    new = (word[1:] != word[:-1]) | (code[1:] != code[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(np.append(True, new))
    return _transition_rows(word[first], code[first], other[first], np.diff(np.append(first, len(word))))


def _transition_rows(word: np.ndarray, code: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word), pa.array(code.astype(np.int32)), pa.array(other), pa.array(n.astype(np.int64))], names=["word", "code", "other", "n"])


def _class_pairs(train: DataFrame, vocabulary: DataFrame, head: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Counts of all class transitions: words outside the table meet their class by a join, the second word of an open pair by another."""
    class_of = vocabulary.select("word", "class")
    counted = train.mapInArrow(lambda x: _transitions(x, head, classes), "word long, code int, other long, n long")
    # one exchange by word serves both the sums and the join
    sums = counted.repartition("word").groupBy("word", "code", "other").agg(F.sum("n").alias("n"))
    pair = (
        F.when(F.col("code") == KNOWN, F.col("word"))
        .when(F.col("code") >= ALL, F.col("class") * ALL + F.col("code") - ALL)
        .when(F.col("code") >= 0, F.col("code") * ALL + F.col("class"))
    )
    first = sums.join(class_of, "word", "left").select(
        F.coalesce(pair, F.col("other")).alias("word"), F.when(F.col("code") == OPEN, F.col("class")).otherwise(KNOWN).alias("code"), "n"
    )
    second = first.groupBy("word", "code").agg(F.sum("n").alias("n")).join(class_of, "word", "left")
    pair = F.when(F.col("code") == KNOWN, F.col("word")).otherwise(F.col("code") * ALL + F.col("class"))
    return _square(second.select(pair.alias("pair"), "n"), ALL)


_PARTS = "uid long, doc_id long, word long, pos int, before int, after int, n_tokens long, n_known long, base double, score double"


def _score(batches: Iterator[pa.RecordBatch], head: np.ndarray, classes: np.ndarray, step: np.ndarray, emit: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text with the sums of its head, and one for each of its words outside it, with the classes beside (-1: outside, too); uid is unique in the job."""
    table, lookup = Table(head), np.append(classes, -1)
    emit, base = np.append(emit, 0.0), np.append(base, 0.0)  # index -1: added by the join
    step = np.pad(step, ((0, 1), (0, 1)))  # nor has -1 a transition yet
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch["doc_id"]
        for first, h, of_doc in _tokens(batch["text"]):
            n = len(of_doc) - 1
            if not n:
                continue
            t = table.find(h)
            c, bounds = _with_ends(lookup[t], of_doc, END)
            before, after = np.append(END, c[:-1]), np.append(c[1:], END)
            known = np.append(0, np.cumsum(t >= 0))
            sums = lambda x: np.append(0.0, np.cumsum(x))
            e, b = sums(emit[t]), sums(base[t])
            score = np.add.reduceat(step[before, c], bounds[:-1]) + e[of_doc[1:]] - e[of_doc[:-1]]
            own = uid + np.arange(n)
            none, no = pa.nulls(n, pa.int64()), np.full(n, -1, np.int32)
            yield _part_rows(own, ids.slice(first, n), none, no, no, no, np.diff(of_doc) + 1, known[of_doc[1:]] - known[of_doc[:-1]], b[of_doc[1:]] - b[of_doc[:-1]], score)
            tail = np.flatnonzero(t < 0)
            if len(tail):
                doc = np.searchsorted(of_doc, tail, side="right") - 1
                at = tail + doc  # among the tokens with ends
                m = len(tail)
                zero = np.zeros(m)
                small = lambda x: x.astype(np.int32)
                yield _part_rows(own[doc], pa.nulls(m, pa.int64()), pa.array(h[tail]), small(tail - of_doc[doc]), small(before[at]), small(after[at]), zero.astype(np.int64), zero.astype(np.int64), zero, zero)
            uid += n


def _part_rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in _PARTS.split(", ")])


def _square(pairs: DataFrame, side: int) -> np.ndarray:
    """A side x side matrix of counts from (pair, n): side * side numbers at most reach the driver."""
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(side, side)


def brown_scores(docs: DataFrame, learn: Column | None = None, core_words: int | None = None, table_words: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    learn: the rows to learn from (all by default). core_words are clustered by exchange (CORE),
    table_words at most go to tasks (HEAD), which
    changes no score. Words are [^\\x20\\x09-\\x0D]+ with A-Z
    lowered; null text counts as empty, whose only token is the end. base_score is the add-one
    unigram score, score the class model's; both are log10. A row whose doc_id is null is
    scored like any other; repeated rows are scored each. With nothing to learn from, all words
    are unknown and only the end and the class of unknown words share the probability. Extra
    columns are not returned.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    if learn is None:
        learn = F.lit(True)
    limit, room = core_words or CORE, table_words or HEAD
    train = docs.where(learn).select(text_or_empty().alias("text"))
    top = train.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    core = np.array([r["word"] for r in top.collect()], dtype=np.int64)  # core_words at most
    side = limit + 2
    bigrams = _square(train.mapInArrow(lambda x: _core_bigrams(x, core, limit), "pair long, n long"), side)
    used = np.append(np.arange(len(core)), [limit, limit + 1])
    of = exchange(bigrams[np.ix_(used, used)], len(core), CLASSES)
    core_class = of[: len(core)]
    z = np.zeros((side, ALL))
    z[used, of] = 1
    counts = z.T @ bigrams @ z
    head, head_class = core, core_class
    for sweep in range(PASSES):
        flow = np.log((counts + 0.1) / (counts + 0.1).sum(1, keepdims=True))
        prefer = np.argmax(flow[:, :CLASSES, None] + flow[:CLASSES][None], axis=1).astype(np.int64)  # before -> class -> after
        votes = train.mapInArrow(lambda x, known=head, of=head_class, prefer=prefer: _votes(x, known, of, prefer), "word long, vote int, n long")
        words_ = votes.groupBy("word", "vote").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.max_by("vote", F.struct("n", "vote")).alias("vote"))
        own = F.when(F.col("word") == END_WORD, END).when(F.col("n") == 1, OTHER).otherwise(F.col("vote")).cast("int").alias("class")
        if sweep:
            discard(vocabulary)
        vocabulary = written(words_.select("word", "n", own), "lm-vocabulary")
        last = sweep == PASSES - 1
        head, head_n, head_class, sizes = _table(vocabulary, core, core_class, room if last else CONTEXT)
        counts = _class_pairs(train, vocabulary, head, head_class)
    whole = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("class") == OTHER).alias("once")).first()
    n_all, v_all, once = int(whole["n"]), int(whole["v"]), int(whole["once"])
    ends = int(sizes[END])
    counts += 0.5
    log_step = np.log10(counts / counts.sum(1, keepdims=True))
    emit = np.log10(head_n / sizes[head_class])
    base_all = math.log10(n_all + 1 * (v_all + 1))
    base = np.log10(head_n + 1.0)
    log_size = np.log10(np.maximum(sizes, 1.0))
    rare = math.log10(2 * once + 1)  # words seen once count twice, all unseen ones together as one

    parts = texts.mapInArrow(lambda x: _score(x, head, head_class, log_step, emit, base), _PARTS)
    # text rows carry a key of their own, which no word has in practice and the flag disregards
    keyed = parts.withColumns({"tail": F.col("word").isNotNull(), "word": F.coalesce("word", F.xxhash64("uid"))})
    joined = keyed.join(vocabulary.select("word", F.col("n").alias("c"), "class"), "word", "left")
    joined = joined.withColumns({"c": F.when(F.col("tail"), F.coalesce("c", F.lit(0))), "class": F.when(F.col("tail"), F.coalesce("class", F.lit(OTHER)))})
    order = Window.partitionBy("uid").orderBy("pos")
    chained = joined.repartition("uid").withColumn("last", F.lag("class").over(order))
    steps, sizes_ = F.array(*[F.lit(float(x)) for x in log_step.ravel()]), F.array(*[F.lit(float(x)) for x in log_size])
    step = lambda a, b: F.get(steps, a * ALL + b)
    came = step(F.when(F.col("before") >= 0, F.col("before")).otherwise(F.col("last")), F.col("class"))
    goes = F.when(F.col("after") >= 0, step(F.col("class"), F.col("after"))).otherwise(0.0)
    said = F.when(F.col("class") == OTHER, F.log10(F.col("c") + 1.0) - F.lit(rare)).otherwise(F.log10(F.col("c").cast("double")) - F.get(sizes_, F.col("class")))
    own = F.when(F.col("tail"), came + goes + said).otherwise(F.col("score"))
    return (
        chained.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_tokens").alias("n_tokens"),
            # the end is known if anything was learned
            (F.sum(F.col("n_known") + F.when(F.col("c") > 0, 1).otherwise(0)) + F.lit(1 if ends else 0)).alias("n_known"),
            F.sum(F.col("base") + F.when(F.col("tail"), F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("base"),
            F.sum(own).alias("score"),
        )
        .select(
            "doc_id",
            "n_tokens",
            "n_known",
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("base") + F.lit(math.log10(ends + 1.0)) - F.col("n_tokens") * F.lit(base_all)).alias("base_score"),
            "score",
        )
    )


def _table(vocabulary: DataFrame, core: np.ndarray, core_class: np.ndarray, room: int) -> tuple[np.ndarray, ...]:
    """(words, counts, classes) of the table that tasks get, and tokens of each class over all data.

    The table takes whole levels of count from the top, as many words as there is room for, and the core, which keeps its classes.
    """
    level = F.floor(F.log2("n") * 8)
    inner = vocabulary.where(F.col("class") < OTHER)
    levels = sorted(((r["level"], r["w"]) for r in inner.groupBy(level.alias("level")).agg(F.count("*").alias("w")).collect()), reverse=True)
    least = math.inf
    for at, w in levels:
        if w > room:
            break
        least, room = at, room - w
    is_core = F.col("word").isin(core.tolist()) & (F.col("word") != END_WORD)
    chosen = vocabulary.where(((F.col("class") < OTHER) & (level >= F.lit(float(least)))) | is_core).toArrow()  # the table and the core at most
    head, head_n, head_class = chosen["word"].to_numpy(), chosen["n"].to_numpy(), chosen["class"].to_numpy().astype(np.int64)
    at = Table(core).find(head)
    sizes = np.zeros(ALL)
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row for each class
        sizes[r["class"]] = r["n"]
    moved = at >= 0
    np.add.at(sizes, head_class[moved], -head_n[moved])
    head_class[moved] = core_class[at[moved]]
    np.add.at(sizes, head_class[moved], head_n[moved])
    return head, head_n, head_class, sizes
