"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own hashed embedding and the mean of the embeddings of its character
3- and 4-grams. Two recurrent passes read windows of 32 words that overlap by half;
attention pools the states of a window to a score. The score of a text is that of its highest
window, and every window of every text is scored.

The network is fitted in one task on a sample of labelled rows, bounded by `MOST_TOXIC`,
`MOST_CLEAN` and `LONGEST` characters per text, and then sent to all tasks (under 2 MB). Training
picks the highest window of each text, first by log odds of its words, later by the network; one
coordinate of the embeddings starts from the same log odds, which helps small samples. A part of
the sample is left out of fitting and sets the point at which a score passes 0.5: that of the
best F1, but none that more than `MOST_FALSE` of its clean texts reach.

Defined results. Null and empty texts are one window without words and get the score of the
bias; rows without a label only get scored; if the labels learned from hold one class or
none, every score is the share of that class, 0 without any. A row with several labels counts
as toxic if one of them says so. Repeated rows repeat their score. Further columns stay; those
named `score` or `predicted` are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.batches import distinct, giving_back, hashes, slices, word_lists
from wardline.llm.common import read, ship

MOST_TOXIC, MOST_CLEAN, LONGEST = 1000, 2000, 12_000
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, EMBED, HIDDEN = 1 << 14, 1 << 13, 8, 8
EDGES = ".,;:!?\"'()[]|#*$%&<>"
BLOCK = 2048
LEAST_STEPS = 30
MOST_FALSE = 0.01
GRAM_WORDS = 16_384
SEED = 11
SLICE_BYTES = 2 << 20

Arrays = dict[str, np.ndarray]


def gram_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character grams of all words, and how many each word has."""
    raw = [b"<" + w + b">" for w in words]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    flat = np.frombuffer(b"".join(raw) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = flat[:-3] * 65599
    code = (code + flat[1:-2]) * np.uint32(65599) + flat[2:-1]
    three = place + 3 <= lengths[owner]
    four = place + 4 <= lengths[owner]
    more = (code * np.uint32(65599) + flat[3:]) ^ np.uint32(0x5BD1E995)
    rows = np.concatenate([code[three], more[four]])
    owners = np.concatenate([owner[three], owner[four]])
    rows = ((rows * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64) % GRAM_ROWS
    order = np.argsort(owners, kind="stable")
    return rows[order], np.bincount(owners, minlength=len(raw))


class Words:
    """The different words of some texts: embedding rows and character grams."""

    def __init__(self, texts: list[str]) -> None:
        found, self.counts = word_lists(texts)
        different, places = distinct(found, pa.large_binary())
        plain = [w.decode("utf-8", "replace").lower().strip(EDGES).encode() for w in different]
        # Row 0 stands for no word, at the end of short windows.
        self.places = places.astype(np.int64) + 1
        self.rows = np.concatenate([[0], (hashes(plain) % (WORD_ROWS - 1)).astype(np.int64) + 1])
        grams, sizes = gram_table(plain)
        self.grams, self.sizes = grams, np.concatenate([[0], sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of each window, and the text of each window."""
        more = np.maximum(0, -(-(self.counts - WINDOW) // STRIDE)) + 1
        owner = np.repeat(np.arange(len(self.counts)), more)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
        first = np.repeat(np.cumsum(self.counts) - self.counts, more) + number * STRIDE
        last = np.cumsum(self.counts)[owner]
        at = first[:, None] + np.arange(WINDOW)
        inside = at < last[:, None]
        padded = np.concatenate([self.places, [0]])
        return np.where(inside, padded[np.where(inside, at, len(self.places))], 0), owner

    def vectors(self, net: Arrays) -> np.ndarray:
        """Embeddings of all words, some words at a time, since grams are many."""
        result = np.zeros((len(self.rows), 2 * EMBED), np.float32)
        for start in range(1, len(self.rows), GRAM_WORDS):
            some = slice(start, start + GRAM_WORDS)
            first, sizes = self.starts[some], self.sizes[some]
            grams = self.grams[first[0]:first[-1] + sizes[-1]]
            total = np.zeros((len(grams) + 1, EMBED))
            np.cumsum(net["grams"][grams], axis=0, dtype=np.float64, out=total[1:])
            ends = np.cumsum(sizes)
            result[some, :EMBED] = net["words"][self.rows[some]]
            result[some, EMBED:] = (total[ends] - total[ends - sizes]) / np.maximum(
                sizes, 1)[:, None]
        return result


def gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid of straight lines."""
    return np.clip(0.25 * x + 0.5, 0.0, 1.0)


def recur(inputs: np.ndarray, live: np.ndarray, u: np.ndarray, back: bool,
          trace: list | None = None) -> np.ndarray:
    """States (step, window, hidden); steps without a word keep the state."""
    steps, n, _ = inputs.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((steps, n, HIDDEN), np.float32)
    for t in (range(steps - 1, -1, -1) if back else range(steps)):
        hu = h @ u
        gates = gate(inputs[t, :, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(inputs[t, :, 2 * HIDDEN:] + reset * hu[:, 2 * HIDDEN:])
        step = update * live[t]
        if trace is not None:
            trace.append((t, h, hu, gates, new, step))
        h = h + step * (new - h)
        states[t] = h
    return states


def attend(states: np.ndarray, live: np.ndarray, net: Arrays):
    """Pooled states of each window, with what the way back needs."""
    hidden = np.tanh(states @ net["att"])
    weight = np.where(live[..., 0] > 0, hidden @ net["att_v"], -30.0)
    weight = np.exp(weight - weight.max(0))
    weight = weight / weight.sum(0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled, weight, hidden


def logits(vectors: np.ndarray, windows: np.ndarray, net: Arrays) -> np.ndarray:
    """Scores of windows; words are projected once, not at each of their places."""
    ahead = vectors @ net["in_f"] + net["b_f"]
    behind = vectors @ net["in_b"] + net["b_b"]
    result = np.empty(len(windows), np.float32)
    for start in range(0, len(windows), BLOCK):
        at = windows[start:start + BLOCK].T
        live = (at > 0)[..., None].astype(np.float32)
        states = np.concatenate([recur(ahead[at], live, net["u_f"], False),
                                 recur(behind[at], live, net["u_b"], True)], axis=2)
        states *= live
        result[start:start + BLOCK] = attend(states, live, net)[0] @ net["out"] + net["out_b"]
    return result


def slopes(net: Arrays, words: Words, windows: np.ndarray, labels: np.ndarray,
           weight: np.ndarray) -> Arrays:
    """Gradient of the weighted log loss over some windows."""
    used, at = np.unique(windows, return_inverse=True)
    at = at.reshape(windows.shape).T
    sizes = words.sizes[used]
    grams = np.concatenate([words.grams[a:a + n] for a, n in zip(words.starts[used], sizes)]
                           or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(used)), sizes)
    mean = np.zeros((len(used), EMBED), np.float32)
    np.add.at(mean, owner, net["grams"][grams])
    share = (1 / np.maximum(sizes, 1)).astype(np.float32)[:, None]
    own = net["words"][words.rows[used]] * (used > 0)[:, None]
    x = np.concatenate([own, mean * share], axis=1)
    live = (used[at] > 0)[..., None].astype(np.float32)
    traces: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([
        recur((x @ net[f"in_{d}"] + net[f"b_{d}"])[at], live, net[f"u_{d}"], d == "b", traces[d])
        for d in "fb"], axis=2) * live
    pooled, attention, hidden = attend(states, live, net)
    score = pooled @ net["out"] + net["out_b"]
    off = ((1 / (1 + np.exp(-score)) - labels) * weight / len(labels)).astype(np.float32)
    found = {"out": pooled.T @ off, "out_b": off.sum(keepdims=True)}
    to_pooled = off[:, None] * net["out"]
    to_states = attention[..., None] * to_pooled
    to_weight = np.einsum("nh,tnh->tn", to_pooled, states)
    to_score = attention * (to_weight - (attention * to_weight).sum(0))
    found["att_v"] = np.einsum("tn,tnk->k", to_score, hidden)
    to_hidden = to_score[..., None] * net["att_v"] * (1 - hidden ** 2)
    found["att"] = np.einsum("tnh,tnk->hk", states, to_hidden)
    to_states = (to_states + to_hidden @ net["att"].T) * live
    to_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u, carry = net[f"u_{d}"], 0.0
        grad_u = np.zeros_like(u)
        to_in = np.zeros((len(x), 3 * HIDDEN), np.float32)
        for t, h, hu, gates, new, step in reversed(traces[d]):
            carry = carry + to_states[t, :, k * HIDDEN:(k + 1) * HIDDEN]
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            raw = carry * step * (1 - new ** 2)
            soft = 0.25 * ((gates > 0) & (gates < 1))
            to_u = np.concatenate([carry * (new - h) * live[t] * soft[:, :HIDDEN],
                                   raw * hu[:, 2 * HIDDEN:] * soft[:, HIDDEN:],
                                   raw * reset], axis=1)
            to_i = np.concatenate([to_u[:, :2 * HIDDEN], raw], axis=1)
            grad_u += h.T @ to_u
            np.add.at(to_in, at[t], to_i)
            carry = carry * (1 - step) + to_u @ u.T
        found[f"u_{d}"], found[f"b_{d}"] = grad_u, to_in.sum(0)
        found[f"in_{d}"] = x.T @ to_in
        to_x += to_in @ net[f"in_{d}"].T
    found["words"] = np.zeros_like(net["words"])
    np.add.at(found["words"], words.rows[used], to_x[:, :EMBED] * (used > 0)[:, None])
    found["grams"] = np.zeros_like(net["grams"])
    np.add.at(found["grams"], grams, (to_x[:, EMBED:] * share)[owner])
    return found


def highest(scores: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The window with the highest score of each text."""
    order = np.lexsort((-scores, owner))
    return order[np.searchsorted(owner[order], np.arange(texts))]


def log_odds(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of embedding rows of words and of grams, by the texts that hold them."""
    texts = np.repeat(np.arange(len(words.counts)), words.counts)
    pairs = np.unique(texts * np.int64(len(words.rows)) + words.places)
    text, place = pairs // len(words.rows), pairs % len(words.rows)
    toxic = np.bincount(place, labels[text], len(words.rows))
    every = np.bincount(place, minlength=len(words.rows))
    rows = words.rows
    seen = np.bincount(rows, toxic, WORD_ROWS), np.bincount(rows, every, WORD_ROWS)
    gram_owner = np.repeat(np.arange(len(rows)), words.sizes)
    grams = (np.bincount(words.grams, toxic[gram_owner], GRAM_ROWS),
             np.bincount(words.grams, every[gram_owner], GRAM_ROWS))
    base = labels.mean()

    def odds(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        p = (hits + 4 * base) / (total + 4)
        return np.log(p / (1 - p + 1e-6)) - np.log(base / (1 - base))

    return odds(*seen), odds(*grams)


def first_scores(words: Words, windows: np.ndarray, by_word: np.ndarray,
                 by_gram: np.ndarray) -> np.ndarray:
    """A first score of windows: the sum of the positive log odds of words and of their grams."""
    total = np.concatenate([[0.0], np.cumsum(by_gram[words.grams])])
    mean = (total[words.starts + words.sizes] - total[words.starts]) / np.maximum(words.sizes, 1)
    word = np.maximum(by_word[words.rows], 0) + np.maximum(mean, 0)
    word[0] = 0
    return word[windows].sum(1)


def train(texts: list[str], labels: np.ndarray, rounds: int = 3, epochs: int = 5, batch: int = 128,
          rate: float = 0.01, seed: int = SEED) -> Arrays:
    """The network, or only a constant score if there is one class."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return {"constant": np.array(labels.mean() if len(labels) else 0.0)}

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, shape[0] ** -0.5 if len(shape) > 1 else 0.1, shape).astype(np.float32)

    net: Arrays = {"words": start(WORD_ROWS, EMBED) * 12, "grams": start(GRAM_ROWS, EMBED) * 9,
                   "att": start(2 * HIDDEN, HIDDEN), "att_v": start(HIDDEN),
                   "out": start(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
    for d in "fb":
        net |= {f"in_{d}": start(2 * EMBED, 3 * HIDDEN), f"u_{d}": start(HIDDEN, 3 * HIDDEN),
                f"b_{d}": np.zeros(3 * HIDDEN, np.float32)}
    words = Words(texts)
    windows, owner = words.windows()
    fitted = rng.random(len(texts)) < 0.8
    if labels[fitted].min() == labels[fitted].max():
        fitted[:] = True
    # One coordinate of the embeddings starts from the log odds in the texts fitted.
    odds = log_odds(Words([t for t, own in zip(texts, fitted) if own]), labels[fitted])
    for name, values in zip(("words", "grams"), odds):
        net[name][:, 0] = np.clip(values, -1, 3) * 0.5
    scores = first_scores(words, windows, *odds)
    moment = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    balance = np.where(labels > 0, min(4.0, (1 - labels.mean()) / labels.mean()), 1.0)
    a_pass = max(1, int(fitted.sum() * 1.5) // batch)
    epochs = max(epochs, LEAST_STEPS // (rounds * a_pass))
    step, total = 0, rounds * epochs * a_pass
    for _ in range(rounds):
        top = highest(scores, owner, len(texts))
        for _ in range(epochs):
            some = rng.permutation(np.flatnonzero(fitted))
            # Clean texts show another window too: none of theirs may score high.
            at = np.concatenate([top[some], rng.permutation(np.flatnonzero(
                (labels[owner] == 0) & fitted[owner]))[:len(some) // 2]])
            at = rng.permutation(at)
            for begin in range(0, len(at), batch):
                part = at[begin:begin + batch]
                found = slopes(net, words, windows[part], labels[owner[part]],
                               balance[owner[part]])
                step += 1
                pace = rate * max(0.1, 1 - step / total)
                for k, g in found.items():
                    moment[k] += 0.1 * (g - moment[k])
                    square[k] += 0.01 * (g * g - square[k])
                    net[k] -= (pace * (moment[k] / (1 - 0.9 ** step))
                               / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)
                               + pace * 1e-3 * net[k]).astype(np.float32)
        scores = logits(words.vectors(net), windows, net)
    held = ~fitted if (~fitted).sum() >= 50 and len(set(labels[~fitted])) == 2 else fitted | True
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, scores)
    net["shift"] = np.array(cut(best[held], labels[held]))
    return net


def cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score with the best F1, but none that more than `MOST_FALSE` of clean texts reach."""
    order = np.argsort(-scores)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(f1))
    after = scores[order[k + 1]] if k + 1 < len(order) else scores[order[k]] - 1.0
    clean = np.sort(scores[labels == 0])
    least = clean[int(np.ceil((1 - MOST_FALSE) * len(clean))) - 1] + 1e-3
    return float(max((scores[order[k]] + after) / 2, least))


def score_texts(texts: list[str], net: Arrays) -> np.ndarray:
    if "constant" in net:
        return np.full(len(texts), float(net["constant"]))
    words = Words(texts)
    windows, owner = words.windows()
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, logits(words.vectors(net), windows, net))
    return 1 / (1 + np.exp(-(best - net["shift"])))


def held_out(id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def chosen(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
           toxic: str = "toxic") -> DataFrame | None:
    """Labelled texts to learn from (d_row, d_text, p_label), a bounded number of each class in
    the order of a hash; None if there are none."""
    known = (labels.where(F.col(toxic).isNotNull() & ~held_out(F.col(id)))
             .groupBy(F.col(id).alias("l_id")).agg(F.max(toxic).alias("l_toxic")))
    slim = docs.select(F.col(id).alias("d_id"), F.col(text).alias("d_text"),
                       F.xxhash64(id, text).alias("d_row")).where(
        F.col("d_id").isNotNull() & (F.length("d_text") <= LONGEST))
    # Rows are picked by id and hash alone; only the texts picked are read again.
    rows = slim.select("d_id", "d_row").distinct().join(known, F.col("d_id") == F.col("l_id"))
    order = [F.md5(F.col("d_id").cast("string")), F.col("d_id"), F.col("d_row")]
    picked = {}
    for label, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        for r in (rows.where((F.col("l_toxic") > 0) == bool(label)).orderBy(*order).limit(most)
                  .select("d_row").collect()):
            picked[r["d_row"]] = label
    if not picked:
        return None
    side = docs.sparkSession.createDataFrame(list(picked.items()), "p_row long, p_label int")
    return (slim.join(F.broadcast(side), F.col("d_row") == F.col("p_row"))
            .groupBy("d_row", "p_label").agg(F.first("d_text").alias("d_text"))
            .select("d_row", "d_text", "p_label"))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
          toxic: str = "toxic") -> Arrays:
    """The network trained on the chosen texts, in one task that reads no more than these."""
    ship(docs.sparkSession)
    texts = chosen(docs, labels, id, text, toxic)
    if texts is None:
        return train([], np.zeros(0, dtype=np.float32))

    @giving_back
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(*[c.to_pylist() for c in b.columns])]
        if rows:
            net = train([t for _, t, _ in rows], np.array([x for *_, x in rows], np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())],
                                             names=["net"])

    one = texts.repartition(1).sortWithinPartitions("d_row")
    return pickle.loads(one.mapInArrow(fit, "net binary").first()["net"])


def scorer(net: Arrays) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "tox_text", SLICE_BYTES):
            at = part.schema.get_field_index("tox_text")
            names = [n for n in part.schema.names if n != "tox_text"]
            columns = [c for i, c in enumerate(part.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(score_texts(texts, net).astype(np.float64))],
                names=[*names, "score"])
    return run


def score(docs: DataFrame, net: Arrays, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with `score` (0 to 1) and `predicted` (1 from 0.5 on)."""
    ship(docs.sparkSession)
    added = ("score", "predicted", "tox_text")
    table = docs.select(F.col(text).cast("string").alias("tox_text"), *[
        F.col(f"`{c}`") for c in docs.columns if c not in added and (keep_text or c != text)])
    fields = [f for f in table.schema.fields if f.name != "tox_text"]
    schema = table.select(*[f"`{f.name}`" for f in fields]).withColumn(
        "score", F.lit(0.0)).schema
    return table.mapInArrow(scorer(net), schema).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that aren't predicted to be toxic, with their own columns as they are."""
    net = learn(docs, labels, text=text)
    wrapped = docs.select(F.struct("*").alias("m_doc"), F.col(text).alias("m_text"))
    return score(wrapped, net, "m_text", keep_text=False).where("predicted = 0").select("m_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = learn(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, net, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         "predicted")
