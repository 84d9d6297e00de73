"""Language-model scores from a hidden Markov model.

Every token belongs to one class: the end, a frequent word on its own, or one of ``RARE`` classes
of other words, told by a checksum of their last two characters. Latent states emit classes, and
a class emits its words by their counts, so p(word | state) = p(class | state) p(word | class).
A frequent word occurs at least ``LEAST`` times and has a share of at least 1 / ``SHARE`` of all
tokens, more if it is long; so their number and bytes have a bound, while the words themselves
are counted without any. The rare classes learn from rare words where unseen ones are likely.

Training is Baum-Welch: each round every task runs the scaled forward and backward recursions
over its whole texts, the expected counts are summed over all partitions by Spark, and the driver
gets one row per class. Texts advance together, step by step, in lanes of ``STEPS`` tokens; a
longer text is cut into lanes whose transfer matrices carry the exact recursion from one to the
next. A text's likelihood is then the product of its scales in the forward recursion. Words
without a class of their own get their counts from a join.

Cases: a null text is empty, and an empty one is the end alone; a null id is not learned from
and not held out; words unseen in training share one count in their class, as in the base score;
without any training text all classes are equally likely; repeated rows are each learned from
and returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from topicloom.llm.common import slices, small_batches
from topicloom.scratch import materialize

STATES, ROUNDS = 8, 6
SHARE, WORD_BYTES, LEAST, RARE = 1 << 19, 32, 2, 1024
STEPS = 512
#: Weight of the classes' overall shares in each state, as a share of all tokens of a state.
PRIOR = 0.05
STICKY, SPREAD, SEED = 0.9, 1.0, 42
#: Bytes of text or of classes that one step holds; words that a task holds back to add up.
TEXTS, CLASSES, HELD = 4 << 20, 2 << 20, 400_000


def held_out(doc_id: Column) -> Column:
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(7)) == 2, F.lit(False))


def _tokens(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(kept[offsets].astype(np.int32)), words.filter(full))


def word_counts(texts: DataFrame) -> DataFrame:
    """Written word, n over all rows of the single column; tasks add up before the shuffle."""

    def run(batches):
        held = None
        for batch in batches:
            for part in slices(batch, 0, TEXTS):
                found = _tokens(part.column(0)).flatten().value_counts()
                new = pa.table({"word": found.field(0), "n": found.field(1)})
                held = new if held is None else pa.concat_tables([held, new])
                if len(held) > HELD:
                    held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if len(held) > HELD // 2:
                    yield from held.combine_chunks().to_batches(10_000)
                    held = None
        if held is not None:
            yield from held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches(10_000)

    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted, "lm-words")


@dataclass
class Vocabulary:
    """Frequent words by code point, all class counts (end, words, rare classes), totals."""

    words: pa.Array
    counts: np.ndarray
    tokens: int
    kinds: int
    #: log10 of the tokens, kinds and one unseen word of each rare class.
    rare_logs: np.ndarray

    @property
    def prior(self) -> np.ndarray:
        return (self.counts + 1.0) / (self.counts.sum() + len(self.counts))

    def classes(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Class of each distinct word, and which of them have none of their own."""
        own = pc.index_in(distinct, self.words)
        rare = pc.is_null(own).to_numpy(zero_copy_only=False)
        found = pc.fill_null(own, 0).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        ends = pc.utf8_slice_codeunits(distinct.filter(pa.array(rare)), -2)
        tail = np.fromiter((zlib.crc32(x.encode()) % RARE for x in ends.to_pylist()), np.int32, len(ends))
        found[rare] = tail + 1 + len(self.words)
        return found, rare


def vocabulary(counts: DataFrame, texts: int, share: int = SHARE) -> Vocabulary:
    """Vocabulary of written ``counts`` (word, n); each of ``texts`` texts has one end."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = (sums["n"] or 0) + texts, sums["v"] + (texts > 0)
    size = F.greatest(F.octet_length("word"), F.lit(WORD_BYTES))
    shared = F.col("n") * F.lit(float(share) * WORD_BYTES) >= F.lit(float(tokens)) * size
    own = shared & (F.col("n") >= LEAST)
    rows = counts.filter(own).toArrow().sort_by("word")
    rare = np.zeros((RARE, 2), np.int64)
    last = F.pmod(F.crc32(F.right("word", F.lit(2)).cast("binary")), F.lit(RARE))
    for r in counts.filter(~own).groupBy(last.alias("c")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")
    ).collect():
        rare[r["c"]] = r["n"], r["v"]
    words = pa.array(rows["word"].to_pylist(), pa.string())
    every = np.concatenate([[texts], rows["n"].to_numpy(), rare[:, 0]]).astype(np.int64)
    return Vocabulary(words, every, tokens, kinds, np.log10(rare.sum(1) + 1.0))


ENCODED = (
    "spot long, doc_id long, held_out boolean, learn boolean, n_tokens long, n_own long, own_logs double, "
    "rare_logs double, classes binary, rare array<string>, rare_n array<int>"
)


def _encode(vocab: Vocabulary, texts: pa.Array) -> list[pa.Array]:
    lists = _tokens(texts)
    coded = pc.dictionary_encode(lists.flatten())
    codes, offsets = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    kind, rare = vocab.classes(coded.dictionary)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    ids = np.zeros(len(codes) + n, np.int32)  # the end is class 0
    ids[np.arange(len(codes)) + doc] = kind[codes]
    bounds = (offsets + np.arange(n + 1)) * 4
    classes = pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]
    )
    is_rare = rare[codes]
    logs = np.log10(vocab.counts + 1.0)
    own = np.bincount(doc, np.where(is_rare, 0.0, logs[kind[codes]]), n) + logs[0]
    at = kind[codes[is_rare]] - 1 - len(vocab.words)
    lost = np.bincount(doc[is_rare], vocab.rare_logs[at], n)
    pairs, times = np.unique(doc[is_rare] * len(kind) + codes[is_rare], return_counts=True)
    ends = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(kind))).astype(np.int32)
    words = coded.dictionary.take(pa.array(pairs % max(1, len(kind))))
    lengths = np.diff(offsets) + 1
    known = lengths - np.bincount(doc[is_rare], minlength=n)
    if not vocab.tokens:
        known = np.zeros(n, np.int64)
    return [
        pa.array(lengths), pa.array(known), pa.array(own, pa.float64()),
        pa.array(lost.astype(np.float64)), classes,
        pa.ListArray.from_arrays(pa.array(ends), words),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
    ]


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Written class sequence of every document and its words without a class of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ["spot", "doc_id", "held_out", "learn", "n_tokens", "n_own", "own_logs", "rare_logs", "classes", "rare", "rare_n"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4, TEXTS):
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(4)] + _encode(shared.value, part.column(4)), names=names
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("spot"), F.col("doc_id").cast("long"),
        held_out(F.col("doc_id")).alias("held_out"),
        (F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).alias("learn"), F.col("text").cast("string"),
    )
    return materialize(rows.mapInArrow(run, ENCODED), "lm-classes")


@dataclass
class Model:
    """Start, transitions, and emissions over the classes' overall shares."""

    start: np.ndarray
    move: np.ndarray
    ratio: np.ndarray
    prior: np.ndarray


def first_model(prior: np.ndarray, states: int = STATES) -> Model:
    """States that last, with fixed scattered emissions."""
    draw = np.random.default_rng(SEED).normal(size=(len(prior), states))
    ratio = np.exp(SPREAD * draw)
    ratio /= prior @ ratio
    move = np.full((states, states), (1 - STICKY) / max(1, states - 1))
    np.fill_diagonal(move, STICKY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, ratio, prior)


class Lanes:
    """Texts cut into lanes of at most ``steps`` tokens, which advance together.

    The longest lanes come first, so the lanes still running at a step are a prefix, and the
    tokens are stored step by step.
    """

    def __init__(self, model: Model, ids: np.ndarray, ends: np.ndarray, steps: int = STEPS):
        self.model = model
        lengths = np.diff(ends)
        many = -(-lengths // steps)
        self.first = np.cumsum(many) - many
        self.many = many
        doc = np.repeat(np.arange(len(lengths)), many)
        self.place = np.arange(len(doc)) - self.first[doc]
        begin = ends[:-1][doc] + self.place * steps
        length = np.minimum(lengths[doc] - self.place * steps, steps)
        order = np.argsort(-length, kind="stable")
        self.lane_of = np.empty(len(order), np.int64)  # lane of a text's part
        self.lane_of[order] = np.arange(len(order))
        self.doc, self.place, self.length = doc[order], self.place[order], length[order]
        at = np.arange(self.length[0] if len(order) else 0)
        inside = self.length[None, :] > at[:, None]
        self.running = inside.sum(1)
        self.offset = np.concatenate([[0], np.cumsum(self.running)])
        self.ids = ids[(begin[order][None, :] + at[:, None])[inside]]
        self.emit = model.ratio[self.ids]
        k = len(model.start)
        self.before = np.zeros((len(order), k))  # forward state at the end of the part before
        self.after = np.ones((len(order), k))  # backward state at the end of the part
        if len(order) and self.many.max() > 1:
            self._carry()

    def _carry(self) -> None:
        """Exact states at the borders of parts.

        The first part of a text carries its start forward and the last one its end backward;
        only the parts between need a transfer matrix.
        """
        k, move = len(self.model.start), self.model.move
        parts = self.many[self.doc]
        heads = np.flatnonzero((self.place == 0) & (parts > 1))
        tails = np.flatnonzero((self.place == parts - 1) & (parts > 1))
        inner = np.flatnonzero((self.place > 0) & (self.place < parts - 1))
        # Heads and inner parts have full length, tails end earlier.
        head = self.model.start * self.emit[heads]
        cross = move * self.emit[inner][:, None, :]
        for t in range(1, len(self.running)):
            at = self.offset[t]
            head = (head @ move) * self.emit[at + heads]
            if len(inner):
                cross = (cross.reshape(-1, k) @ move).reshape(-1, k, k)
                cross *= self.emit[at + inner][:, None, :]
            if t % 8 == 0:
                head /= head.max(1, keepdims=True)
                cross /= cross.max((1, 2), keepdims=True)
        tail = np.ones((len(tails), k))
        on = np.searchsorted(tails, self.running)
        for t in range(len(self.running) - 1, -1, -1):
            n = on[t]
            tail[:n] = (tail[:n] * self.emit[self.offset[t] + tails[:n]]) @ move.T
            if t % 8 == 0:
                tail[:n] /= tail[:n].max(1, keepdims=True)
        cross /= cross.max((1, 2), keepdims=True)
        row = np.full(len(self.doc), -1)
        row[inner] = np.arange(len(inner))
        state = np.zeros((len(self.many), k))
        state[self.doc[heads]] = head / head.sum(1, keepdims=True)
        back = np.zeros((len(self.many), k))
        back[self.doc[tails]] = tail / tail.max(1, keepdims=True)
        # Through the parts of all long texts at once, forward and backward.
        for j in range(1, int(self.many.max())):
            docs = np.flatnonzero(self.many > j)
            self.before[self.lane_of[self.first[docs] + j]] = state[docs]
            docs = docs[self.many[docs] > j + 1]
            state[docs] = np.einsum("ni,nij->nj", state[docs], cross[row[self.lane_of[self.first[docs] + j]]])
            state[docs] /= state[docs].sum(1, keepdims=True)
        for j in range(1, int(self.many.max())):
            docs = np.flatnonzero(self.many > j)
            at = self.first[docs] + self.many[docs] - 1 - j
            self.after[self.lane_of[at]] = back[docs]
            docs, at = docs[self.many[docs] > j + 1], at[self.many[docs] > j + 1]
            back[docs] = np.einsum("nij,nj->ni", cross[row[self.lane_of[at]]], back[docs])
            back[docs] /= back[docs].max(1, keepdims=True)

    def forward(self, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward states (if kept) and scale of each token, log likelihood of each text.

        The likelihood is relative to the classes' overall shares.
        """
        k, move = len(self.model.start), self.model.move
        states = np.empty((len(self.ids) if keep else 0, k))
        scales = np.empty(len(self.ids))
        now = np.where((self.place == 0)[:, None], self.model.start, self.before @ move)
        ones = np.ones(k)
        for t, on in enumerate(self.running):
            a, b = self.offset[t], self.offset[t + 1]
            now = now[:on] * self.emit[a:b]
            scale = now @ ones
            now /= scale[:, None]
            if keep:
                states[a:b] = now
            scales[a:b] = scale
            now = now @ move
        logs = self.by_text(np.log(scales))
        return states, scales, logs

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each token over its text."""
        lane = np.arange(len(self.ids)) - np.repeat(self.offset[:-1], self.running)
        return np.bincount(self.doc[lane], values, len(self.many))

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions by class, and the log likelihood."""
        move, k = self.model.move, len(self.model.start)
        states, scales, logs = self.forward(True)
        moves = np.zeros((k, k))
        pull = np.zeros((0, k))  # emission times backward state, scaled, at the step after
        for t in range(len(self.running) - 1, -1, -1):
            a, b, on = self.offset[t], self.offset[t + 1], self.running[t]
            later = len(pull)
            back = np.empty((on, k))
            back[:later] = pull @ move.T
            # A part that ends here takes the state behind it, in the scale of its forward state.
            back[later:] = self.after[later:on]
            back[later:] /= (states[a + later : b] * back[later:]).sum(1, keepdims=True)
            pull = self.emit[a:b] * back / scales[a:b, None]
            if t:
                moves += states[self.offset[t - 1] : self.offset[t - 1] + on].T @ pull
            states[a:b] *= back
        late = self.place > 0
        moves += self.before[late].T @ pull[late] if len(pull) else 0
        starts = states[: len(self.doc)][~late].sum(0)
        # One state's column after the other lies together, which is faster to add up.
        emitted = np.stack([np.bincount(self.ids, c, len(self.model.prior)) for c in states.T.copy()], 1)
        return starts, moves * move, emitted, float(logs.sum())


def _lanes(model: Model, classes: pa.Array) -> Lanes:
    ends = np.frombuffer(classes.buffers()[1], np.int32)[classes.offset : classes.offset + len(classes) + 1]
    data = np.frombuffer(classes.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return Lanes(model, data.view(np.int32), (ends - ends[0]).astype(np.int64) // 4)


START, MOVE, TOTAL = -1, -1000, -2


def expected_counts(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One pass of Baum-Welch over the column ``classes``; the tasks' counts are summed by class."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)
    columns = [f"s{i}" for i in range(k)]

    def run(batches):
        m = shared.value
        starts, moves, emitted, logs = np.zeros(k), np.zeros((k, k)), np.zeros((len(m.prior), k)), 0.0
        for batch in batches:
            for part in slices(batch, 0, CLASSES):
                one = _lanes(m, part.column(0)).expected()
                starts, moves, emitted, logs = starts + one[0], moves + one[1], emitted + one[2], logs + one[3]
        met = np.flatnonzero(emitted.any(1))
        keys = np.concatenate([met, [START, TOTAL], MOVE - np.arange(k)]).astype(np.int32)
        values = np.vstack([emitted[met], starts, np.r_[logs, np.zeros(k - 1)], moves])
        for at in range(0, len(keys), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at : at + 10_000]), *[pa.array(np.ascontiguousarray(values[at : at + 10_000, s])) for s in range(k)]],
                names=["class", *columns],
            )

    schema = "class int, " + ", ".join(f"{c} double" for c in columns)
    summed = rows.select("classes").mapInArrow(run, schema).groupBy("class").agg(*[F.sum(c).alias(c) for c in columns])
    found = summed.toArrow()
    keys = found["class"].to_numpy()
    values = np.stack([found[c].to_numpy() for c in columns], 1) if len(keys) else np.zeros((0, k))
    emitted, moves, starts, logs = np.zeros((len(model.prior), k)), np.zeros((k, k)), np.zeros(k), 0.0
    emitted[keys[keys >= 0]] = values[keys >= 0]
    moves[MOVE - keys[keys <= MOVE]] = values[keys <= MOVE]
    if (keys == START).any():
        starts, logs = values[keys == START][0], float(values[keys == TOTAL][0, 0])
    return starts, moves, emitted, logs


def improved(model: Model, starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> Model:
    """The model that fits the expected counts best, under priors that keep all probabilities
    above zero: one start and move each, and the classes' overall shares."""
    k = len(model.start)
    weight = max(1.0, PRIOR * emitted.sum() / k)
    ratio = (emitted / model.prior[:, None] + weight) / (emitted.sum(0) + weight)
    return Model(
        (starts + 1) / (starts.sum() + k), (moves + 1) / (moves.sum(1, keepdims=True) + k), ratio, model.prior
    )


def train(rows: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all ``rows`` (column classes), the same number of rounds at every size."""
    model = first_model(prior, states)
    for _ in range(rounds):
        starts, moves, emitted, _ = expected_counts(rows, model)
        model = improved(model, starts, moves, emitted)
    return model


def _state_logs(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with the log10 likelihood of their classes in place of the classes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        overall = np.log(m.prior)
        for batch in batches:
            at = batch.schema.get_field_index("classes")
            for part in slices(batch, at, CLASSES):
                lanes = _lanes(m, part.column(at))
                logs = lanes.forward(False)[2] + lanes.by_text(overall[lanes.ids])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array(logs / np.log(10))], names=[*part.schema.names[:at], "state_logs"]
                )

    schema = "spot long, doc_id long, held_out boolean, n_tokens long, n_own long, own_logs double, rare_logs double"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.select(*names, "classes").mapInArrow(run, schema + ", state_logs double")


def score(
    docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, share: int = SHARE,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    small_batches(docs.sparkSession)
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = word_counts(learn.select(F.col("text").cast("string")))
    vocab = vocabulary(counts, learn.count(), share)
    rows = encode(docs, vocab)
    model = train(rows.filter("learn"), vocab.prior, states, rounds)
    scored = _state_logs(rows, model)

    pair = F.explode(F.arrays_zip("rare", "rare_n")).alias("p")
    rare = rows.select("spot", pair).select("spot", F.col("p.rare").alias("word"), F.col("p.rare_n").alias("times"))
    met = rare.join(counts, "word").groupBy("spot").agg(
        F.sum("times").alias("met"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("met_logs")
    )
    floor = float(np.log10(vocab.tokens + vocab.kinds + 1))
    logs = F.coalesce("met_logs", F.lit(0.0))
    return scored.join(met, "spot", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_own") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("own_logs") + logs - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("state_logs") + logs - F.col("rare_logs")).alias("score"),
    )
