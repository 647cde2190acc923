"""Language-model scoring with a causal self-attention model on subword ids.

The chance of a subword is the chance of its class, given by attention over the subwords before it, times the chance
of the subword in its class after the one or two subwords before it, from counts over the whole training corpus. The
classes are k-means over each subword's neighbours, from the counted bigrams of all training rows. The attention model
(one head, residual, trained by Adam in numpy) starts from at most about `SAMPLE_ROWS` training rows in one task and then
passes over every training row once, in `ROUNDS` rounds of lanes whose parameters are averaged. A row's round, lane and place
in it are hashes of its id and text, so the model does not depend on how the table is partitioned. Texts are scored in context
windows that overlap; each token is scored once, in the window that has it behind the overlap.

The subword tokenizer is a public sentencepiece model whose path is a parameter; it is shipped with the job. A word is
encoded by itself; each text ends with one end token.

Runs and contexts beyond the MODEL_PAIRS most frequent are joined with the whole tables of counts.

Base score: sum of log10((c + 1) / (N + V + 1)) over words and the end. Words above a count that leaves at most
`COMMON_WORDS` are looked up in tasks; all others are joined with the whole word table.

Cases: null and empty texts consist of their end; without training rows all counts are 0; null ids are ids; repeated
rows are scored each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilark.llm.common import group_starts, pieces, ranges, stored, text_of, unit_hash, words_of

SAMPLE_ROWS = 2_000
COMMON_WORDS = 1 << 18
MODEL_PAIRS = 1 << 20  # counted runs, and contexts, that tasks look up, the most frequent; the others are joined
NONE = (1 << 20) - 1  # in place of a second subword before
WINDOW, STRIDE, DIM, CLASSES = 32, 24, 8, 32
STEPS, BATCH, RATE, DISCOUNT = 500, 192, 0.02, 0.7
ROUNDS, ROUND_BATCH = 4, 512  # rounds of the pass over all rows; windows of a step in them
BLOCK_WINDOWS = 64  # windows computed at once, so that a block's arrays stay in a core's cache; but for rounding, sums do not depend on it
LANE_WORDS, LANE_TASKS = 1 << 18, 10_000  # words of a lane of a round, about; tasks of a round at most
CAUSAL = np.triu(np.ones((WINDOW, WINDOW), np.float32))  # which places (columns) attend to a place of a window
OTHERS = ("place", "query", "key", "value", "out", "bias")  # parameters that all subwords share
BEGIN, END = 1, 2
KEPT_WORDS = 1 << 18  # distinct words whose subwords a Python worker keeps
PIECE_BYTES = 5 << 20  # text that a task works on at once


class Subwords:
    """Subword ids of distinct words, from the bytes of a sentencepiece model; KEPT_WORDS repeated words are coded once or twice."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.processor.get_piece_size()
        self.kept, self.flat, self.first = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of(self, names: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, first id of each word and the end). A word has at least one id; `count`: how often each occurs."""
        at = pc.fill_null(pc.index_in(names, self.kept), len(self.kept)).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at == len(self.kept))
        fresh = names.take(pa.array(new))
        flat, first = self._coded(fresh)
        at[new] += np.arange(len(new))
        repeated = np.flatnonzero(count[new] > 1)[:KEPT_WORDS - len(self.kept)]
        lengths, all_flat, all_first = np.diff(first), np.append(self.flat, flat), np.append(self.first, self.first[-1] + first[1:])
        if len(repeated):
            self.kept = pa.concat_arrays([self.kept, fresh.take(pa.array(repeated))])
            self.flat = np.append(self.flat, flat[ranges(first[repeated], lengths[repeated])])
            self.first = np.append(self.first, self.first[-1] + np.cumsum(lengths[repeated]))
        lengths = np.diff(all_first)[at]
        return all_flat[ranges(all_first[at], lengths)], np.append(0, np.cumsum(lengths))

    def _coded(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = self.processor.encode(names.to_pylist(), num_threads=1)
        lengths = np.fromiter((len(x) or 1 for x in coded), np.int64, len(coded))
        flat = np.fromiter((i for x in coded for i in (x or (0,))), np.int32, int(lengths.sum()))
        return flat, np.append(0, np.cumsum(lengths))


@functools.lru_cache(1)
def subwords_of(model: bytes) -> Subwords:
    """One for all tasks of a Python worker."""
    return Subwords(model)


def word_rows(texts: pa.Array, subwords: Subwords) -> dict[str, np.ndarray]:
    """Words of each text and the subwords of distinct words (`flat`; its last entry is the end).

    `word`: the distinct word of each word, an end after each text; `ends_at`: the first of them of each text, and the end.
    """
    ids, names, offsets = words_of(texts)
    flat, first = subwords.of(names, np.bincount(ids)) if len(names) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    word = np.insert(ids, offsets[1:], len(names))
    flat, first = np.append(flat, np.int32(END)), np.append(first, first[-1] + 1)
    return {"ids": ids, "names": names, "offsets": offsets, "flat": flat, "first": first, "word": word,
            "ends_at": offsets + np.arange(len(texts) + 1)}


def token_rows(texts: pa.Array, subwords: Subwords) -> dict[str, np.ndarray]:
    """`word_rows` and the subwords of each text, as places (`at`) into `flat`; `bounds` are the texts', `starts` the words'."""
    t = word_rows(texts, subwords)
    lengths = np.diff(t["first"])[t["word"]]
    places = np.append(0, np.cumsum(lengths))
    return t | {"at": ranges(t["first"][t["word"]], lengths), "bounds": places[t["ends_at"]], "starts": places[:-1]}


@dataclass
class Attention:
    """Classes of subwords and the parameters of the class model."""

    classes: np.ndarray
    weights: dict[str, np.ndarray]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, classes=self.classes, **self.weights)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Attention:
        with np.load(io.BytesIO(data)) as found:
            return cls(found["classes"], {k: found[k] for k in found.files if k != "classes"})


def _neighbour_table(size: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((size, 48)).astype(np.float32)


def _add_neighbours(near: np.ndarray, table: np.ndarray, own: np.ndarray, other: np.ndarray, n: np.ndarray, after: np.ndarray) -> None:
    """Adds the projections of n neighbours to their subwords' rows, those after a subword in front of those before it."""
    for side, columns in ((after, slice(0, 48)), (~after, slice(48, 96))):
        at = np.flatnonzero(side)[np.argsort(own[side], kind="stable")]
        if len(at):
            first = np.flatnonzero(np.append(True, own[at][1:] != own[at][:-1]))
            near[own[at][first], columns] += np.add.reduceat(table[other[at]] * n[at, None], first, axis=0)


def _clustered(near: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Class of each subword: k-means over the projections of its neighbours; those never seen get a drawn class."""
    found = np.random.default_rng(6).integers(0, CLASSES, len(count))
    seen = np.flatnonzero(count > 0)
    if len(seen) < CLASSES:
        return found
    x = (near[seen] / np.sqrt(count[seen])[:, None]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    centres = x[np.argsort(-count[seen])[:CLASSES]]
    for _ in range(15):
        label = (x @ centres.T).argmax(1)
        for k in range(CLASSES):
            own = label == k
            if own.any():
                centres[k] = np.average(x[own], axis=0, weights=np.sqrt(count[seen][own]))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-6
    found[seen] = label
    return found


def _classes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Classes from one row of subwords."""
    near, table = np.zeros((size, 96)), _neighbour_table(size)
    for a in range(0, len(tokens) - 1, 1 << 18):
        now, after = tokens[a:a + (1 << 18)], tokens[a + 1:a + 1 + (1 << 18)]
        now, n = now[: len(after)], np.ones(len(after), np.float32)
        _add_neighbours(near, table, now, after, n, np.ones(len(n), bool))
        _add_neighbours(near, table, after, now, n, np.zeros(len(n), bool))
    return _clustered(near, np.bincount(tokens, minlength=size).astype(np.float64))


def corpus_classes(runs: DataFrame, size: int) -> np.ndarray:
    """Classes from the counted bigrams (run, n) of all rows; one row per subword reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, table, count = np.zeros((size, 96)), _neighbour_table(size), np.zeros(size)
        for batch in batches:
            own, other, n, after = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("own", "other", "n", "after"))
            _add_neighbours(near, table, own, other, n, after)
            count += np.bincount(own, weights=np.where(after, 0, n), minlength=size)  # each occurrence has one subword before it
        seen = np.flatnonzero(count > 0)
        yield pa.RecordBatch.from_pydict({
            "token": pa.array(seen), "n": pa.array(count[seen]), "near": pa.array([x.tobytes() for x in near[seen]], pa.binary())})

    token, before = (F.shiftright("run", k).bitwiseAND((1 << 20) - 1) for k in (0, 20))
    bigrams = runs.filter(F.shiftright("run", 40) == NONE)
    sides = bigrams.select(before.alias("own"), token.alias("other"), "n", F.lit(True).alias("after")).unionByName(
        bigrams.select(token.alias("own"), before.alias("other"), "n", F.lit(False).alias("after")))
    rows = sides.repartition("own").mapInArrow(run, "token long, n double, near binary").toArrow()
    near, count = np.zeros((size, 96)), np.zeros(size)
    token = rows.column("token").to_numpy()
    count[token] = rows.column("n").to_numpy()
    near[token] = np.frombuffer(b"".join(rows.column("near").to_pylist())).reshape(-1, 96)
    return _clustered(near, count)


def _room(rooms: dict[str, np.ndarray], name: str, *shape: int) -> np.ndarray:
    """A work array, the one of the last call if that had the same shape: new memory costs as much as the sums in it."""
    if name not in rooms or rooms[name].shape != shape:
        rooms[name] = np.empty(shape, np.float32)
    return rooms[name]


def _limited(x: np.ndarray, most: float) -> None:
    if not (x.max() <= most and x.min() >= -most):
        np.clip(x, -most, most, out=x)


def _windows(rows: np.ndarray, n: int) -> np.ndarray:
    """(window, row, place) of an array (row, places of n windows); no copy."""
    return rows.reshape(len(rows), n, -1).transpose(1, 0, 2)


def _forward(w: dict[str, np.ndarray], before: np.ndarray, first: int = 0, rooms: dict[str, np.ndarray] | None = None) -> tuple:
    """States after attention for windows of subwords (batch, window), from place `first` of each window on.

    Arrays hold a row per feature and the places of all windows side by side, as numpy's loops and products are fast along
    long rows; a row of ones behind values and states adds up shares and adds the bias. Shares are (window, attended, place),
    not yet divided by their sums. The last array returned is a view of the states, (batch, place, feature).
    """
    n, width = before.shape
    size, scored = n * width, n * (width - first)
    rooms = {} if rooms is None else rooms
    entered = w["embed"].take(before.reshape(-1), axis=0, mode="clip")  # no id is outside; mode: the quick way through numpy
    entered.reshape(n, -1)[...] += w["place"][:width].reshape(-1)
    x = _room(rooms, "x", DIM, size)
    x[...] = entered.T
    heads = np.concatenate([w["query"] * np.float32(DIM ** -0.5), w["key"], w["value"]], axis=1)
    qkv = _room(rooms, "qkv", 3 * DIM + 1, size)
    np.matmul(heads.T.copy(), x, out=qkv[:-1])
    qkv[-1] = 1
    q, k, v = _windows(qkv[:DIM], n)[..., first:], _windows(qkv[DIM:2 * DIM], n), _windows(qkv[2 * DIM:], n)
    shares = np.matmul(k.transpose(0, 2, 1), q, out=_room(rooms, "shares", n, width, width - first))
    _limited(shares, 30)
    np.exp(shares, out=shares)
    shares *= CAUSAL[:width, first:width].copy()
    mixed_in = _room(rooms, "mixed_in", DIM + 1, scored)
    np.matmul(v, shares, out=_windows(mixed_in, n))
    part = 1 / mixed_in[-1]
    mixed_in = mixed_in[:-1]
    mixed_in *= part
    state = _room(rooms, "state", DIM + 1, scored)
    np.add(x.reshape(DIM, n, width)[..., first:], mixed_in.reshape(DIM, n, -1), out=state[:-1].reshape(DIM, n, -1))
    state[-1] = 1
    return entered, q, k, v, heads, shares, part, mixed_in, state, _windows(state[:-1], n).transpose(0, 2, 1)


def _logits(w: dict[str, np.ndarray], state: np.ndarray, rooms: dict[str, np.ndarray]) -> np.ndarray:
    """A row per class for states with a row of ones behind them."""
    logits = np.matmul(np.append(w["out"].T, w["bias"][:, None], axis=1), state, out=_room(rooms, "logits", CLASSES, state.shape[1]))
    _limited(logits, 60)
    return logits


def _gradients(
    model: Attention, w: dict[str, np.ndarray], before: np.ndarray, after: np.ndarray, rooms: dict[str, np.ndarray] | None = None
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(gradients of all but `embed`, gradients of the state that enters at each subword of `before`), mean over `before`."""
    rooms = {} if rooms is None else rooms
    grads, d_x = dict.fromkeys(OTHERS, np.float32(0)), np.empty((*before.shape, DIM), np.float32)
    for a in range(0, len(before), BLOCK_WINDOWS):
        now = slice(a, a + BLOCK_WINDOWS)
        own = _block_gradients(w, before[now], model.classes.take(after[now].reshape(-1)), np.float32(before.size), rooms, d_x[now])
        for name, g in own.items():
            grads[name] = grads[name] + g
    return grads, d_x.reshape(-1, DIM)


def _block_gradients(
    w: dict[str, np.ndarray], before: np.ndarray, target: np.ndarray, size: np.float32, rooms: dict[str, np.ndarray], d_x: np.ndarray
) -> dict[str, np.ndarray]:
    """Gradients of all but `embed`; those of what enters are written to d_x."""
    entered, q, k, v, heads, shares, part, mixed_in, state, _ = _forward(w, before, 0, rooms)
    n = len(before)
    p = _logits(w, state, rooms)
    np.exp(p, out=p)
    p *= 1 / (p.sum(0) * size)
    p.reshape(-1)[target * before.size + np.arange(before.size)] -= 1 / size
    d_state = w["out"] @ p
    d_mixed = _room(rooms, "d_mixed", DIM + 1, before.size)
    np.multiply(d_state, part, out=d_mixed[:-1])
    np.negative((d_mixed[:-1] * mixed_in).sum(0), out=d_mixed[-1])  # the shares' mean of what enters them
    d_scores = np.matmul(v.transpose(0, 2, 1), _windows(d_mixed, n), out=_room(rooms, "d_scores", *shares.shape))
    d_scores *= shares
    d_heads = _room(rooms, "d_heads", 3 * DIM, before.size)
    np.matmul(k, d_scores, out=_windows(d_heads[:DIM], n))
    np.matmul(q, d_scores.transpose(0, 2, 1), out=_windows(d_heads[DIM:2 * DIM], n))
    np.matmul(_windows(d_mixed[:-1], n), shares.transpose(0, 2, 1), out=_windows(d_heads[2 * DIM:], n))
    out = state @ p.T
    query, key, value = ((d_heads @ entered).T[:, k:k + DIM] for k in range(0, 3 * DIM, DIM))
    d_state += heads @ d_heads
    d_x.reshape(-1, DIM)[...] = d_state.T
    return {
        "out": out[:-1], "bias": out[-1], "query": query * np.float32(DIM ** -0.5), "key": key, "value": value, "place": d_x.sum(0)}


class Adam:
    """Steps on a model's parameters; rows of `embed` that a batch does not hold rest."""

    def __init__(self, model: Attention):
        self.model, self.w, self.turn, self.rooms = model, {k: v.copy() for k, v in model.weights.items()}, 0, {}
        self.slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}

    def step(self, before: np.ndarray, after: np.ndarray, rate: float) -> None:
        self.turn += 1
        grads, d_x = _gradients(self.model, self.w, before, after, self.rooms)
        token = before.reshape(-1)
        order = np.argsort(token.astype(np.uint16) if len(self.w["embed"]) <= 1 << 16 else token, kind="stable")  # few bytes: radix sort
        token = token.take(order)
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        token = token[first]
        grads["embed"] = np.add.reduceat(d_x.take(order, axis=0, mode="clip"), first, axis=0)
        for name, g in grads.items():
            at = token if name == "embed" else slice(None)
            m, s = (x.take(at, axis=0, mode="clip") if name == "embed" else x for x in self.slow[name])
            m, s = m + np.float32(0.1) * (g - m), s + np.float32(0.01) * (g * g - s)
            self.slow[name][0][at], self.slow[name][1][at] = m, s
            self.w[name][at] -= (rate * (m / (1 - 0.9 ** self.turn)) / (np.sqrt(s / (1 - 0.99 ** self.turn)) + 1e-8)).astype(np.float32)


def fit_attention(tokens: np.ndarray, size: int, classes: np.ndarray | None = None) -> Attention:
    """Classes, where none are given, and class model from one row of subwords (each text: BEGIN, its subwords, END)."""
    rng = np.random.default_rng(11)
    shapes = {"embed": (size, DIM), "place": (WINDOW, DIM), "query": (DIM, DIM), "key": (DIM, DIM), "value": (DIM, DIM), "out": (DIM, CLASSES)}
    w = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in shapes.items()} | {"bias": np.zeros(CLASSES, np.float32)}
    model = Attention(_classes(tokens, size) if classes is None else classes, w)
    if len(tokens) <= WINDOW + 1:
        return model
    adam = Adam(model)
    for step in range(1, STEPS + 1):
        at = rng.integers(0, len(tokens) - WINDOW - 1, BATCH)[:, None] + np.arange(WINDOW)
        adam.step(tokens[at], tokens[at + 1], RATE * min(1.0, 2 * (1 - step / (STEPS + 1))))
    return Attention(model.classes, adam.w)


def _with_begin(t: dict[str, np.ndarray]) -> np.ndarray:
    return np.insert(t["flat"][t["at"]], t["bounds"][:-1], BEGIN).astype(np.int32)


def _in_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) of each partition in an order that depends on nothing but the rows."""
    return rows.withColumn("_turn", F.xxhash64(F.lit("turn"), "doc_id", "text"))


class Lane:
    """Adam steps over a row of subwords that comes in parts, in blocks of windows side by side."""

    def __init__(self, model: Attention):
        self.adam = Adam(model)
        self.seen, self.windows, self.waiting = np.zeros(len(model.classes)), 0, np.zeros(0, np.int32)

    def _step(self, starts: np.ndarray, rate: float) -> None:
        at = starts[:, None] + np.arange(WINDOW)
        before = self.waiting[at]
        self.adam.step(before, self.waiting[at + 1], rate)
        self.seen += np.bincount(before.reshape(-1), minlength=len(self.seen))
        self.windows += len(starts)

    def add(self, tokens: np.ndarray, rate: float) -> None:
        self.waiting = np.concatenate([self.waiting, tokens])
        while len(self.waiting) > ROUND_BATCH * WINDOW:
            self._step(np.arange(ROUND_BATCH) * WINDOW, rate)
            self.waiting = self.waiting[ROUND_BATCH * WINDOW:]  # its first subword was a target only

    def finish(self, rate: float) -> None:
        if len(self.waiting) < 2:
            return
        if len(self.waiting) <= WINDOW:
            self.waiting = np.append(self.waiting, np.full(WINDOW + 1 - len(self.waiting), END, np.int32))
        starts = np.arange(0, len(self.waiting) - 1, WINDOW)
        starts[-1] = len(self.waiting) - 1 - WINDOW  # the last window ends with the row
        self._step(starts, rate)


def train_round(rows: DataFrame, tokenizer: bytes, model: Attention, rate: float, lanes: int) -> tuple[Attention, int]:
    """(model, number of windows) after one pass over every subword of rows (doc_id, text), in windows side by side.

    Rows are dealt to lanes by a hash; each lane goes on from the same parameters, in an order of its rows' own. The lanes' parameters are averaged by the
    windows seen, a subword's own by how often the lane saw it. Sums of parts of the parameters move, so the driver gets one
    set whatever the number of lanes.
    """
    n_parts = 16
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, lane, now, windows = subwords_of(tokenizer), None, None, 0
        embed, others = np.zeros((subwords.size, DIM + 1)), 0.0

        def close() -> None:
            nonlocal others, windows
            lane.finish(rate)
            embed[:, :DIM] += lane.adam.w["embed"] * lane.seen[:, None]
            embed[:, DIM] += lane.seen
            others = others + np.concatenate([lane.adam.w[k].reshape(-1) for k in OTHERS]) * float(lane.windows)
            windows += lane.windows

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(batch, ["_lane"])
            for a, b in zip(starts[:-1], starts[1:]):
                if batch.column("_lane")[a].as_py() != now:
                    if lane is not None:
                        close()
                    lane, now = Lane(shipped.value), batch.column("_lane")[a].as_py()
                for part in pieces(batch.slice(a, b - a), most_bytes=PIECE_BYTES):
                    lane.add(_with_begin(token_rows(part.column("text"), subwords)), rate)
        if lane is not None:
            close()
        if windows:
            for k, own in enumerate(np.array_split(embed, n_parts)):
                values = np.concatenate([own.reshape(-1), others, [windows]]) if k == 0 else own.reshape(-1)
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": pa.array([values.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(sums)
        for k, sums in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    dealt = (
        _in_order(rows.select("doc_id", "text")).withColumn("_lane", F.pmod(F.xxhash64(F.lit("lane"), "doc_id", "text"), F.lit(lanes)))
        .select("_lane", "_turn", "text").repartition(min(lanes, LANE_TASKS), "_lane").sortWithinPartitions("_lane", "_turn")
    )
    made = dealt.mapInArrow(learn, "part int, sums binary").repartition("part").mapInArrow(add, "part int, sums binary")
    found = {r["part"]: np.frombuffer(bytes(r["sums"])) for r in made.collect()}
    if not found:
        return model, 0
    w = {k: v.copy() for k, v in model.weights.items()}
    n_other = sum(w[k].size for k in OTHERS)
    windows = int(found[0][-1])
    for k, own in enumerate(np.array_split(np.arange(len(w["embed"])), n_parts)):
        sums = found[k][: len(own) * (DIM + 1)].reshape(len(own), DIM + 1)
        was = sums[:, DIM] > 0  # subwords not seen in this round stay
        w["embed"][own[was]] = sums[was, :DIM] / sums[was, DIM:]
    place = 0
    mean = found[0][-1 - n_other:-1] / windows
    for k in OTHERS:
        w[k] = mean[place:place + w[k].size].reshape(w[k].shape).astype(np.float32)
        place += w[k].size
    return Attention(model.classes, w), windows


def train(rows: DataFrame, tokenizer: bytes, model: Attention, n_words: int = 0) -> tuple[Attention, int]:
    """(model, number of windows) after one pass over all rows (doc_id, text) of `n_words` words, dealt to ROUNDS rounds by a
    hash of id and text, a third of all rows with one id included."""
    windows, lanes = 0, max(1, -(-n_words // (ROUNDS * LANE_WORDS)))
    for k in range(ROUNDS):
        own = rows.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(ROUNDS)) == k)
        model, n = train_round(own, tokenizer, model, RATE / 2 * (1 - k / ROUNDS), lanes)
        windows += n
    return model, windows


def class_scores(model: Attention, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log chance of the class of each token given all before it in its window; `bounds` are the texts'."""
    lengths = np.diff(bounds)
    overlap = WINDOW - STRIDE
    # a text's first window scores WINDOW tokens, each later one STRIDE
    n_windows = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    number = ranges(np.zeros(len(lengths), np.int64), n_windows)
    text = np.repeat(np.arange(len(lengths)), n_windows)
    begin = bounds[:-1][text] + number * STRIDE
    shifted = np.empty(len(tokens), np.int32)  # the token before each token
    shifted[1:] = tokens[:-1]
    shifted[bounds[:-1][lengths > 0]] = BEGIN
    out = np.zeros(len(tokens) + WINDOW, np.float32)
    target = np.append(model.classes.take(tokens), np.zeros(WINDOW, np.int64))
    shifted = np.append(shifted, np.zeros(WINDOW, np.int32))
    w, rooms = model.weights, {}
    for from_place, chosen in ((overlap, number > 0), (0, number == 0)):
        windows = begin[chosen]
        for a in range(0, len(windows), BLOCK_WINDOWS):
            at = windows[a:a + BLOCK_WINDOWS, None] + np.arange(WINDOW)
            logits = _logits(w, _forward(w, shifted.take(at), from_place, rooms)[-2], rooms)
            at = at[:, from_place:].reshape(-1)
            own = logits.take(target.take(at) * len(at) + np.arange(len(at)))
            np.exp(logits, out=logits)
            # what a text's last window writes behind its end lies in first windows of later texts, which come later
            out[at] = own - np.log(logits.sum(0))
    return out[: len(tokens)]


def run_key(second: np.ndarray | int, before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """One number for the subwords (second before, before, token); NONE as second: a bigram."""
    return (np.asarray(second, np.int64) << 40) | (before.astype(np.int64) << 20) | token.astype(np.int64)


class Places:
    """Places of distinct numbers, by a table of twice as many slots where a taken slot sends to the next."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, (2 * len(keys)).bit_length())
        self.keys, self.shift, self.slots = keys, np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            again = self.slots[slot] != left
            left, slot = left[again], (slot[again] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted number among the keys; their count where it is none of them."""
        slot = self._slot(wanted)
        out = self.slots[slot]
        if not len(self.keys):
            return np.zeros(len(wanted), np.int32)
        left = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        while len(left):
            slot = (slot[left] if len(slot) != len(left) else slot) + 1 & (len(self.slots) - 1)
            found = self.slots[slot]
            out[left] = found
            again = (found >= 0) & (self.keys[found] != wanted[left])
            left, slot = left[again], slot[again]
        out[out < 0] = len(self.keys)
        return out


@dataclass
class Counts:
    """Chances of subwords in their class (`single`) and of kept runs; mass left for shorter contexts by (context, class).

    A (context, class) is `whole` when all runs counted in it are kept, so that any other run is an unseen one;
    `complete`: all runs of all contexts are kept.
    """

    single: np.ndarray
    runs: np.ndarray
    chances: np.ndarray
    rest_keys: np.ndarray
    rest: np.ndarray
    whole: np.ndarray
    complete: bool

    def __post_init__(self):
        self.run_places, self.rest_places = Places(self.runs), Places(self.rest_keys)
        # the last entries stand for what is not kept
        self.chance_at, self.rest_at = np.append(self.chances, 0.0), np.append(self.rest, 1.0)
        self.whole_at = np.append(self.whole, False)

    def chance(self, runs: np.ndarray, classes: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted share of the run in its context and class, and the left mass times the shorter context's chance;
        whether what is kept gives the whole table's count of the run and of its context and class)."""
        own, group = self.run_places.of(runs), self.rest_places.of((runs >> 20) * CLASSES + classes)
        sure = np.ones(len(runs), bool) if self.complete else self.whole_at[group] | (own < len(self.runs))
        return self.chance_at[own] + self.rest_at[group] * shorter, sure

    def after_one(self, run: np.ndarray, token: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.chance(run, classes[token], self.single[token])

    def in_words(self, t: dict[str, np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log chance, run, settled) of each subword of distinct words but the first, given one or two before it in the word."""
        out, flat = np.zeros(len(t["flat"])), t["flat"]
        run, sure = np.zeros(len(flat), np.int64), np.ones(len(flat), bool)
        place = _place(t)
        k = np.flatnonzero(place > 0)
        run[k] = run_key(NONE, flat[k - 1], flat[k])
        out[k], sure[k] = self.after_one(run[k], flat[k], classes)
        k = np.flatnonzero(place > 1)
        run[k] = run_key(flat[k - 2], flat[k - 1], flat[k])
        out[k], known = self.chance(run[k], classes[flat[k]], out[k])
        sure[k] &= known
        out[place > 0] = np.log(out[place > 0])
        return out, run, sure


def _place(t: dict[str, np.ndarray]) -> np.ndarray:
    return np.arange(len(t["flat"])) - np.repeat(t["first"][:-1], np.diff(t["first"]))


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of a bounded table."""
    rows = table.toArrow()
    keys, n = (rows.column(i).to_numpy().astype(kind) for i, kind in ((0, np.int64), (1, np.float64)))
    order = np.argsort(keys)
    return keys[order], n[order]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def corpus_counts(rows: DataFrame, tokenizer: bytes) -> DataFrame:
    """(word, run, n): words, subword bigrams, and trigrams inside words, of all rows (text), counted; see `run_key`."""

    def counted(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.nulls(len(found), pa.string()), "run": pa.array(found), "n": pa.array(n)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(tokenizer)
        for batch in batches:
            for part in pieces(batch, most_bytes=PIECE_BYTES):
                t = word_rows(part.column("text"), subwords)
                count = np.bincount(t["ids"], minlength=len(t["names"]))
                yield pa.RecordBatch.from_pydict({
                    "word": t["names"].cast(pa.string()), "run": pa.nulls(len(count), pa.int64()), "n": pa.array(count)})
                token, before = _pairs(t)
                found, n = np.unique(run_key(NONE, before, token), return_counts=True)
                yield counted(found, n)
                # inside words: once per distinct word
                flat, times, place = t["flat"], np.repeat(np.append(count, 0), np.diff(t["first"])), _place(t)
                two, three = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
                keys = np.concatenate([run_key(NONE, flat[two - 1], flat[two]), run_key(flat[three - 2], flat[three - 1], flat[three])])
                found, index = np.unique(keys, return_inverse=True)
                yield counted(found, np.bincount(index, weights=np.concatenate([times[two], times[three]]), minlength=len(found)).astype(np.int64))

    return rows.select("text").mapInArrow(run, "word string, run long, n long").groupBy("word", "run").agg(F.sum("n").alias("n"))


def _pairs(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first subword of each word, subword before it) over all words and ends."""
    first, word = t["first"], t["word"]
    token, last = t["flat"][first[word]], t["flat"][first[word + 1] - 1]
    before = np.append(np.int32(BEGIN), last[:-1])
    before[t["ends_at"][:-1]] = BEGIN
    return token, before


def fit_sample(rows: DataFrame, tokenizer: bytes, classes: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Attention:
    """Attention model to start from: about `sample_rows` of rows (doc_id, text), trained in one task."""
    share = min(1.0, sample_rows / max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, parts = subwords_of(tokenizer), [np.zeros(0, np.int32)]
        for batch in batches:
            parts.append(_with_begin(token_rows(batch.column("text"), subwords)))
        model = fit_attention(np.concatenate(parts), subwords.size, classes)
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.to_bytes()], pa.binary())})

    sample = _in_order(rows.filter(unit_hash("attention", "doc_id", "text") < share)).select("_turn", "text")
    row = sample.repartition(1).sortWithinPartitions("_turn").mapInArrow(run, "model binary").first()
    if row is None:  # nothing to learn from
        return fit_attention(np.zeros(0, np.int32), len(classes), classes)
    return Attention.from_bytes(bytes(row[0]))


def most_frequent(counted: DataFrame, room: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows above a count that leaves at most `room` of them, and (level, rows, sum) of all levels of `n`.

    Levels are sixteenths of powers of two: some hundred rows reach the driver, and no sort is needed.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted((tuple(r) for r in counted.groupBy(level).agg(F.count("*"), F.sum("n")).collect()), reverse=True)
    least = None
    for at, rows, _ in levels:
        room -= rows
        if room < 0:
            break
        least = at
    return counted.filter(level >= least) if least is not None else counted.limit(0), levels


def run_model(runs: DataFrame, model: Attention) -> tuple[Counts, DataFrame]:
    """(what tasks look up, the whole table (key, total, n_runs) by context and class) of a stored table (run, n).

    Subwords, MODEL_PAIRS runs and as many contexts reach the driver at most.
    """
    split = runs.select((F.col("run").bitwiseAND((1 << 20) - 1)).cast("int").alias("token"), F.shiftright("run", 20).alias("context"), "run", "n")
    single = np.full(len(model.classes), 0.5)
    token, n = _sorted(split.filter(F.shiftright("context", 20) == NONE).groupBy("token").agg(F.sum("n").alias("n")))
    single[token] += n
    single /= np.bincount(model.classes, weights=single, minlength=CLASSES)[model.classes]
    groups = stored(
        split.join(F.broadcast(_named(runs, model, single)), "token").groupBy((F.col("context") * CLASSES + F.col("class")).alias("key"))
        .agg(F.sum("n").alias("total"), F.count("*").alias("n_runs")), "attention-contexts")
    often, levels = most_frequent(groups.withColumnRenamed("total", "n"), MODEL_PAIRS)
    kept = often.select("key", "n", "n_runs").toArrow()
    rest_keys, total, n_runs = (kept.column(i).to_numpy().astype(kind) for i, kind in enumerate((np.int64, np.float64, np.float64)))
    order = np.argsort(rest_keys)
    rest_keys, total, n_runs = rest_keys[order], total[order], n_runs[order]
    common, run_levels = most_frequent(runs.select("run", "n"), MODEL_PAIRS)
    own, n = _sorted(common)
    key = (own >> 20) * CLASSES + model.classes[own & ((1 << 20) - 1)]
    inside = _lookup(rest_keys, np.ones(len(rest_keys)), key, 0.0) > 0
    own, n, group = own[inside], n[inside], np.searchsorted(rest_keys, key[inside])
    complete = max(sum(r[1] for r in levels), sum(r[1] for r in run_levels)) <= MODEL_PAIRS
    whole = np.bincount(group, minlength=len(rest_keys)) == n_runs
    # every run leaves DISCOUNT to shorter contexts
    return Counts(single, own, (n - DISCOUNT) / total[group], rest_keys, DISCOUNT * n_runs / total, whole, complete), groups


def _named(rows: DataFrame, model: Attention, single: np.ndarray) -> DataFrame:
    """(token, class, single), one row per subword."""
    listed = list(zip(range(len(single)), model.classes.tolist(), single.tolist()))
    return rows.sparkSession.createDataFrame(listed, "token int, class int, single double")


def joined_chances(wanted: DataFrame, runs: DataFrame, groups: DataFrame, model: Attention, single: np.ndarray) -> DataFrame:
    """(run, chance) of distinct runs, from the whole tables `runs` and `groups`; the same rule as `Counts.chance`."""
    low = F.lit(NONE << 40).bitwiseOR(F.col("run").bitwiseAND((1 << 40) - 1))
    rows = wanted.withColumn("token", F.col("run").bitwiseAND((1 << 20) - 1).cast("int")).join(F.broadcast(_named(wanted, model, single)), "token")
    chance = F.col("single")
    for name, key in (("two", low), ("three", F.col("run"))):
        counted = runs.select(F.col("run").alias(name), F.col("n").alias(f"n_{name}"))
        group = groups.select(F.col("key").alias(f"key_{name}"), F.col("total").alias(f"total_{name}"), F.col("n_runs").alias(f"runs_{name}"))
        rows = rows.withColumn(name, key).withColumn(f"key_{name}", F.shiftright(name, 20) * CLASSES + F.col("class"))
        rows = rows.join(counted, name, "left").join(group, f"key_{name}", "left")
        own = F.coalesce((F.col(f"n_{name}") - DISCOUNT) / F.col(f"total_{name}"), F.lit(0.0))
        longer = own + F.coalesce(DISCOUNT * F.col(f"runs_{name}") / F.col(f"total_{name}"), F.lit(1.0)) * chance
        chance = longer if name == "two" else F.when(F.shiftright("run", 40) == NONE, chance).otherwise(longer)
    return rows.select("run", chance.alias("chance"))


def score_documents(docs: DataFrame, training: DataFrame, tokenizer_path: str, common_words: int = COMMON_WORDS) -> DataFrame:
    """docs' doc_id and other columns but text, with n_tokens, n_known, train_tokens, base_score and score.

    Columns of docs named like these results are replaced.
    """
    with open(tokenizer_path, "rb") as file:
        tokenizer = file.read()
    training = training.select("doc_id", text_of().alias("text"))
    counts = stored(corpus_counts(training, tokenizer), "attention-counts")
    counted = counts.filter("run is not null").select("run", "n")
    classes = corpus_classes(counted, Subwords(tokenizer).size)
    words = counts.filter("word is not null").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model, _ = train(training, tokenizer, fit_sample(training, tokenizer, classes), total)
    runs, groups = run_model(counted, model)
    n_docs = training.count()
    common, levels = most_frequent(words, common_words)
    n_train = n_docs + sum(r[2] for r in levels)
    n_words = (1 if n_docs else 0) + sum(r[1] for r in levels)
    common = common.toArrow()
    listed = pa.chunked_array(common.column("word").chunks, pa.string()).combine_chunks().cast(pa.large_string())
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((listed, common.column("n").to_numpy(), model, runs))
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c not in ("text", *results)]
    scale = float(n_train + n_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(tokenizer)
        listed, n_common, attention, runs = shipped.value
        logs = np.append(np.log10((n_common + 1) / scale), 0.0)
        for batch in batches:
            for part in pieces(batch, most_bytes=PIECE_BYTES):
                t = token_rows(part.column("text"), subwords)
                n = part.num_rows
                row = np.repeat(np.arange(n), np.diff(t["offsets"]))
                at = pc.fill_null(pc.index_in(t["names"], listed), len(listed)).to_numpy(zero_copy_only=False)
                known = at < len(listed)
                base = np.bincount(row, weights=logs[at][t["ids"]], minlength=n) + np.log10((n_docs + 1) / scale)
                n_known = np.bincount(row, weights=known[t["ids"]], minlength=n).astype(np.int64) + (1 if n_docs else 0)
                rare = np.flatnonzero(~known[t["ids"]])
                rare_words = t["names"].take(pa.array(t["ids"][rare])).cast(pa.string())
                rare_of = np.append(0, np.cumsum(np.bincount(row[rare], minlength=n))).astype(np.int32)
                tokens = t["flat"][t["at"]]
                log, run, sure = (x[t["at"]] for x in runs.in_words(t, attention.classes))  # each distinct word is looked up once
                (token, before), start = _pairs(t), t["starts"]
                run[start] = run_key(NONE, before, token)
                chance, sure[start] = runs.after_one(run[start], token, attention.classes)
                log[start] = np.log(chance)
                log[~sure] = 0
                unsure = run[~sure]
                unsure_of = np.append(0, np.cumsum(~sure))[t["bounds"]].astype(np.int32)
                log += class_scores(attention, tokens, t["bounds"])
                score = np.add.reduceat(log, t["bounds"][:-1]) / np.log(10.0) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_kept"), pa.array(np.diff(t["offsets"]) + 1), pa.array(n_known), pa.array(base),
                     pa.array(score), pa.ListArray.from_arrays(pa.array(rare_of), rare_words),
                     pa.ListArray.from_arrays(pa.array(unsure_of), pa.array(unsure))],
                    names=["_kept", "n_tokens", "n_known", "base_score", "score", "rare", "runs"])

    made = docs.select(F.struct(*others).alias("_kept"), text_of().alias("text"))
    schema = StructType([made.schema["_kept"]])
    for field in spark.createDataFrame([], "n_tokens long, n_known long, base_score double, score double, rare array<string>, runs array<long>").schema:
        schema = schema.add(field)
    scored = stored(made.mapInArrow(run, schema)
                    .withColumn("_row", F.monotonically_increasing_id()), "attention-scores")
    rare = scored.select("_row", F.explode("rare").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("times"))
    n = F.coalesce("n", F.lit(0))
    extra = (
        rare.join(words, "word", "left").groupBy("_row")
        .agg(F.sum(F.col("times") * F.log10((n + 1) / F.lit(scale))).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"))
    )
    score = F.col("score")
    found = scored.drop("rare", "runs").join(extra, "_row", "left")
    if not runs.complete:
        unsure = scored.select("_row", F.explode("runs").alias("run")).groupBy("_row", "run").agg(F.count("*").alias("times"))
        chances = joined_chances(unsure.select("run").distinct(), counted, groups, model, runs.single)
        added = unsure.join(chances, "run").groupBy("_row").agg(F.sum(F.col("times") * F.log10("chance")).alias("joined"))
        found, score = found.join(added, "_row", "left"), score + F.coalesce("joined", F.lit(0.0))
    return found.select(
        "_kept.*", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score.alias("score"))
