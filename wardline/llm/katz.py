"""Language-model scores: a bigram model with Katz backoff and Good-Turing discounts.

    p(w | h) = d(c(hw)) c(hw) / c(h)          if hw was seen in training
             = alpha(h) p(w)                  otherwise
    alpha(h) = (1 - what seen words take) / (1 - their sum of p(w))

p(w) is discounted likewise, and what it leaves goes to one unknown word, so that both levels sum
to 1 exactly. Counts above 5 aren't discounted; if all counts of a history are above, one more
event in its total makes room. A history never seen backs off with weight 1.

The work is dealt by hash. Chunks of texts are stored as numbers, with the hashes of their
words. Parts of the vocabulary add up counts and answer each chunk with numbers and counts of its
words. Chunks then send their bigrams, with the texts they occur in, to parts by history (and
by word, if a history holds more than a part's share), which store counts, what the backoff
weights need, and sums per text. Rows carry packed arrays, so that a bigram costs a few bytes.
To the driver go counts of counts and the histories that are split, at most twice as many as parts.

Defined results. Null and empty texts are one end token. Without training texts every word is unknown
and every score 0. Rows with a null id are learned from. Repeated rows count again and
repeat their score. Empty tables give empty results. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.batches import distinct, hashes, slices, word_lists
from wardline.llm.common import read, ship, stored
from wardline.llm.packing import pack, unpack

CHUNK_TOKENS = 1_500_000
CUT = 5
END, BEGIN = np.uint64(0), np.uint64(1)


def discounts(seen: dict[int, int], cut: int = CUT) -> np.ndarray:
    """Good-Turing discounts of counts 0..cut from counts of counts; d[0] is not used.

    Where counts of counts are too few for a value between 0 and 1, half an event is taken off.
    """
    n = [0] + [seen.get(r, 0) for r in range(1, cut + 2)]
    result = np.array([1.0] + [(r - 0.5) / r for r in range(1, cut + 1)])
    tail = (cut + 1) * n[cut + 1] / n[1] if n[1] else 1.0
    for r in range(1, cut + 1):
        if n[r] and tail < 1:
            value = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
            if 0 < value < 1:
                result[r] = value
    return result


def in_training(id: Column, folds: int = 7, held: int = 2) -> Column:
    """Whether crc32 of the id as text has another remainder than that held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds != held, F.lit(True))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts as ranges of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def chunks(docs: DataFrame, id: str, text: str, train: Column, tokens: int) -> DataFrame:
    """Texts as numbers of words, chunk by chunk, with the chunk's sorted word hashes."""
    slim = docs.select(F.col(id).cast("string").alias("id"), train.alias("train"),
                       F.col(text).cast("string").alias("text"))
    ship(docs.sparkSession)

    def close(ids: list, train: list, counts: list, vocab: list, codes: list) -> pa.RecordBatch:
        keys, where = np.unique(np.concatenate([*vocab, [END]]), return_inverse=True)
        starts = np.cumsum([0] + [len(v) for v in vocab])
        words = np.concatenate([where[s + c] for s, c in zip(starts, codes)])
        sizes = np.concatenate(counts)
        ends = np.cumsum(sizes)
        words = np.insert(words, ends, where[-1])  # each text gets its end
        learns = np.array(train, dtype=bool)
        used = np.bincount(words[np.repeat(learns, sizes + 1)], minlength=len(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.string())),
             *[pa.array([pack(x)]) for x in (learns.astype(np.uint8), sizes + 1, words)],
             pa.array([keys.tobytes()]), pa.array([pack(used)])],
            names=["chunk", "ids", "train", "sizes", "words", "keys", "used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        total = 0
        for part, texts in slices(batches):
            found, counts = word_lists(texts)
            words, codes = distinct(found, pa.large_binary())
            keys = hashes(words)
            keys[keys <= BEGIN] += np.uint64(2)  # two numbers are kept for the ends
            held[0].extend(part.column(0).to_pylist())
            held[1].extend(part.column(1).to_pylist())
            for store, value in zip(held[2:], (counts, keys, codes.astype(np.int64))):
                store.append(value)
            total += len(found) + len(texts)
            if total >= tokens:
                yield close(*held)
                held, total = ([], [], [], [], []), 0
        if held[0]:
            yield close(*held)

    return slim.mapInArrow(run, "chunk string, ids array<string>, train binary, sizes binary, "
                                "words binary, keys binary, used binary")


def vocabulary(table: DataFrame, parts: int) -> DataFrame:
    """Per part: its unigram table, counts of counts, and for each chunk the words' numbers.

    A word's number is its place by count in its part, times the parts, plus the part, so that
    frequent words have small numbers.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, used in zip(*[c.to_pylist() for c in batch.columns]):
                keys, used = np.frombuffer(raw, dtype=np.uint64), unpack(used)
                owner = part_of(keys, parts)
                edges = np.searchsorted(owner, np.arange(parts + 1))
                some = [p for p in range(parts) if edges[p] < edges[p + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.string()),
                     pa.array([keys[edges[p]:edges[p + 1]].tobytes() for p in some]),
                     pa.array([pack(used[edges[p]:edges[p + 1]]) for p in some])],
                    names=["part", "chunk", "keys", "used"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        asked = [np.frombuffer(x, dtype=np.uint64) for x in group["keys"]]
        keys, where = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(where, np.concatenate([unpack(x) for x in group["used"]]),
                            len(keys)).astype(np.int64)
        number = np.empty(len(keys), dtype=np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(keys)) * parts + part
        ends = np.cumsum([len(x) for x in asked])
        rows = [(part, c, pack(number[where[e - len(a):e]]), pack(total[where[e - len(a):e]]), None)
                for c, a, e in zip(group["chunk"], asked, ends)]
        of_counts = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3).tolist()
        rows.append((part, None, pack(number), pack(total), [int(total.sum()), *of_counts]))
        return pd.DataFrame(rows, columns=["part", "chunk", "numbers", "counts", "stats"])

    asked = table.select("chunk", "keys", "used").mapInArrow(
        ask, "part long, chunk string, keys binary, used binary")
    return asked.groupBy("part").applyInPandas(
        count, "part long, chunk string, numbers binary, counts binary, stats array<long>")


class Unigrams:
    """What p(w) takes from the counts of a word."""

    def __init__(self, stats: list[int]) -> None:
        self.total = stats[0]
        self.known = sum(stats[2:])
        self.d = discounts({r: stats[1 + r] for r in range(1, CUT + 2)})
        if self.total:
            kept = sum((self.d[r] - 1) * r * stats[1 + r] for r in range(1, CUT + 1))
            self.unknown = -kept / self.total
            # Without rare words one more event makes room for the unknown one.
            self.events = self.total if self.unknown > 0 else self.total + 1
            self.unknown = self.unknown if self.unknown > 0 else 1 / self.events
        else:
            self.events, self.unknown = 1, 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        d = np.where(counts <= CUT, self.d[np.minimum(counts, CUT)], 1.0)
        return np.where(counts > 0, d * counts / self.events, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.known + 1))


def shares(counts: np.ndarray, total: int, parts: int) -> np.ndarray:
    """Over how many parts a history is spread: 1, but for those above half a part's share."""
    return np.minimum(parts, 1 + (2 * counts * parts // max(total, 1))).astype(np.int64)


def spread_words(numbers: np.ndarray) -> np.ndarray:
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(
        np.int64)


def bigrams(table: DataFrame, words: DataFrame, model: Unigrams, begins: int,
            parts: int) -> DataFrame:
    """Per chunk: a row of sums per text, and a row of packed bigrams for each part."""
    columns = ["chunk", "part", "ids", "a", "b", "c", "d", "e", "f", "g"]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        chunk = key[0]
        own = group[group["words"].notna()].iloc[0]
        answers = group[group["words"].isna()].sort_values("part")
        number = np.concatenate([unpack(x) for x in answers["numbers"]]).astype(np.int64)
        count = np.concatenate([unpack(x) for x in answers["counts"]]).astype(np.int64)
        word, sizes = unpack(own["words"]).astype(np.int64), unpack(own["sizes"]).astype(np.int64)
        learns = unpack(own["train"]).astype(bool)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, values[word], len(sizes))

        # The row of texts travels with some part's bigrams and passes through.
        rows = [(chunk, int(chunk[:8], 16) % parts, own["ids"], pack(sizes), pack(per_text(count > 0).astype(np.int64)),
                 pack(per_text(model.base(count))), pack(learns.astype(np.uint8)), None, None, None)]
        # The begin is one more word, seen as often as there are training texts.
        number, count = np.append(number, -1), np.append(count, begins)
        before = np.concatenate([[0], word[:-1]])
        before[ends - sizes] = len(number) - 1
        pair, place = np.unique(before * len(number) + word, return_inverse=True)
        h, w = pair // len(number), pair % len(number)
        used = np.bincount(place, np.repeat(learns, sizes), len(pair)).astype(np.int64)
        ref, times = np.unique(place * len(sizes) + doc, return_counts=True)
        refs = np.bincount(ref // len(sizes), minlength=len(pair))
        split = shares(count[h], model.total, parts)
        part = (number[h] + 1 + spread_words(number[w]) % split) % parts
        order = np.lexsort((number[w], number[h], part))
        starts = np.cumsum(refs) - refs
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            at = order[edges[p]:edges[p + 1]]
            if not len(at):
                continue
            mine = number[h[at]]
            new = np.concatenate([[True], mine[1:] != mine[:-1]])
            runs = np.diff(np.append(np.flatnonzero(new), len(at)))
            n = refs[at]
            spot = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((chunk, p, None, pack(np.stack([mine[new] + 1, count[h[at]][new], runs])
                                              .ravel()),
                         pack(number[w[at]]), pack(count[w[at]]), pack(used[at]), pack(n),
                         pack(ref[spot] % len(sizes)), pack(times[spot])))
        return pd.DataFrame(rows, columns=columns)

    left = table.select("chunk", F.lit(-1).cast("long").alias("part"), "ids", "train", "sizes",
                        "words", F.lit(None).cast("binary").alias("numbers"),
                        F.lit(None).cast("binary").alias("counts"))
    right = words.where("chunk IS NOT NULL").select(
        "chunk", "part", F.lit(None).cast("array<string>").alias("ids"),
        *[F.lit(None).cast("binary").alias(c) for c in ("train", "sizes", "words")],
        "numbers", "counts")
    return left.union(right).groupBy("chunk").applyInPandas(
        run, "chunk string, part long, ids array<string>, " + ", ".join(
            f"{c} binary" for c in "abcdefg"))


def counted(pairs: DataFrame, model: Unigrams, parts: int) -> DataFrame:
    """Per part: bigram counts, what backoff weights need, and sums per text and chunk.

    Rows by `kind`: 0 counts of counts; 1 the bigram table; 2 sums of a chunk's texts; 3 weights of
    histories with their unseen bigrams; 4 a share of a split history; 5 a chunk's texts.
    """
    columns = ["kind", "part", "chunk", "history", "stats", "a", "b", "c", "d", "ids"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        passed = [(5, part, r.chunk, None, None, r.a, r.b, r.c, r.d, r.ids)
                  for r in group[group["e"].isna()].itertuples()]
        group = group[group["e"].notna()]
        if group.empty:
            return pd.DataFrame(passed, columns=columns)
        # Numbers stay as narrow as they came; a part holds many.
        read: dict[str, list[np.ndarray]] = {k: [] for k in "hcwpuotn"}
        base = 0
        for row in group.itertuples():
            head = unpack(row.a).astype(np.int64).reshape(3, -1)
            ids = head[0].astype(np.uint32) if head[0].max() < 1 << 32 else head[0]
            read["h"].append(np.repeat(ids, head[2]))
            read["c"].append(np.repeat(head[1].astype(np.min_scalar_type(int(head[1].max()))),
                                       head[2]))
            read["w"].append(unpack(row.b))
            read["p"].append(unpack(row.c))
            read["u"].append(unpack(row.d))
            refs = unpack(row.e)
            read["o"].append(np.repeat(np.arange(base, base + len(refs), dtype=np.uint32), refs))
            read["t"].append(unpack(row.f))
            read["n"].append(unpack(row.g))
            base += len(refs)
        ends = np.cumsum([0] + [len(x) for x in read["t"]])
        spans = [slice(a, b) for a, b in zip(ends, ends[1:])]

        def take(name: str) -> np.ndarray:
            return np.concatenate(read.pop(name))

        history, hi = np.unique(take("h"), return_inverse=True)
        c_h = np.zeros(len(history), dtype=np.int64)
        c_h[hi] = take("c")
        word, wi = np.unique(take("w"), return_inverse=True)
        pair = hi * np.int64(len(word)) + wi
        del hi, wi
        pair, place, at = np.unique(pair, return_index=True, return_inverse=True)
        at = at.astype(np.uint32)
        total = np.bincount(at, take("u"), len(pair)).astype(np.int64)
        mine = pair // len(word)
        p_w = model.p(take("p")[place].astype(np.int64))
        del place
        seen = total > 0
        rare = seen & (total <= CUT)
        history, word = history.astype(np.int64), word.astype(np.int64)
        n = len(history)
        by_count = np.stack([np.bincount(mine[total == r], minlength=n)
                             for r in range(1, CUT + 1)])
        plain = np.bincount(mine[seen & ~rare], total[seen & ~rare], n)
        taken = np.bincount(mine[seen], p_w[seen], n)
        split = shares(c_h, model.total, parts) > 1
        rows = [(0, part, None, None, np.bincount(np.minimum(total, CUT + 2),
                                                  minlength=CUT + 3).tolist()[:CUT + 2],
                 None, None, None, None),
                (1, part, None, None, None, pack(history[mine][seen]), pack(word[pair % len(word)][seen]),
                 pack(total[seen]), None)]
        owner, text, time = at[take("o")], take("t"), take("n")
        del at
        # Logarithms that need no discount: of counts over totals, or of p(w).
        room = c_h + ((by_count.sum(0) == 0) & ~split)
        value = np.where(seen, np.log10(np.maximum(total, 1) / np.maximum(room, 1)[mine]),
                         np.log10(p_w))
        known = np.where(rare, total, 0).astype(np.uint8)
        for own, chunk in zip(spans, group["chunk"]):
            texts_k, where = np.unique(text[own], return_inverse=True)
            sums = np.bincount(where, value[owner[own]] * time[own], len(texts_k))
            grid = np.bincount(where * (CUT + 1) + known[owner[own]], time[own],
                               len(texts_k) * (CUT + 1)).astype(np.int64)
            rows.append((2, part, chunk, None, None, pack(texts_k), pack(sums),
                         pack(grid.reshape(-1, CUT + 1)[:, 1:].ravel()), None))
        # Histories with unseen bigrams; a split one without rare ones may need its room as well.
        unsure = split & (by_count.sum(0) == 0)
        open_ = ~seen[owner] | unsure[mine[owner]]
        if open_.any():
            order = np.flatnonzero(open_)
            needed, local = np.unique(mine[owner[order]], return_inverse=True)
            refs = np.stack([local, text[order], time[order], seen[owner[order]]])
            table = np.stack([history[needed], c_h[needed], split[needed],
                              plain[needed].astype(np.int64), *by_count[:, needed]])
            chunk_sizes = [int(open_[own].sum()) for own in spans]
            rows.append((3, part, "\n".join(group["chunk"]), None, chunk_sizes,
                         pack(table.ravel()), pack(taken[needed]), pack(refs.ravel()), None))
        for i in np.flatnonzero(split):
            rows.append((4, part, None, int(history[i]),
                         [int(c_h[i]), int(plain[i]), *by_count[:, i].tolist()],
                         np.float64(taken[i]).tobytes(), None, None, None))
        return pd.DataFrame([*passed, *[(*r, None) for r in rows]], columns=columns)

    return pairs.groupBy("part").applyInPandas(
        run, "kind int, part long, chunk string, history long, stats array<long>, "
             "a binary, b binary, c binary, d binary, ids array<string>")


def backoff(c_h: np.ndarray, plain: np.ndarray, by_count: np.ndarray, taken: np.ndarray,
            d: np.ndarray) -> np.ndarray:
    """Log10 of the backoff weights; 0 for histories that were never seen."""
    room = c_h + (by_count.sum(0) == 0)
    kept = plain + (d[1:] * np.arange(1, CUT + 1)) @ by_count
    left = np.where(c_h > 0, 1 - kept / np.maximum(room, 1), 1.0)
    return np.where(c_h > 0, np.log10(np.maximum(left, 1e-300) / (1 - taken)), 0.0)


def text_sums(tables: DataFrame, d: np.ndarray, split: dict) -> DataFrame:
    """Per chunk and part: log10 sums of its texts, with discounts and backoff weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, chunk, stats, a, b, c in zip(*[x.to_pylist() for x in batch.columns]):
                if kind == 2:
                    texts = unpack(a)
                    grid = unpack(c).astype(np.int64).reshape(len(texts), CUT)
                    yield row([chunk], [texts], [unpack(b) + grid @ np.log10(d[1:])])
                    continue
                table = unpack(a).astype(np.int64).reshape(4 + CUT, -1)
                taken = unpack(b).astype(np.float64)
                local, text, time, seen = unpack(c).astype(np.int64).reshape(4, -1)
                weight = backoff(table[1], table[3], table[4:], taken, d)
                room = np.zeros(len(weight))
                for i in np.flatnonzero(table[2]):
                    c_h, plain, by_count, p = split[int(table[0, i])]
                    weight[i] = backoff(np.array([c_h]), np.array([plain]),
                                        by_count[:, None], np.array([p]), d)[0]
                    room[i] = np.log10(c_h / (c_h + 1)) if by_count.sum() == 0 else 0.0
                value = np.where(seen > 0, room[local], weight[local]) * time
                ends = np.cumsum(stats)
                names, texts, sums = [], [], []
                for name, n, end in zip(chunk.split("\n"), stats, ends):
                    if n:
                        some, where = np.unique(text[end - n:end], return_inverse=True)
                        names.append(name)
                        texts.append(some)
                        sums.append(np.bincount(where, value[end - n:end], len(some)))
                yield row(names, texts, sums)

    def row(names: list, texts: list, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([pack(t) for t in texts], pa.binary()),
             pa.array([pack(s) for s in sums], pa.binary())], names=["chunk", "a", "b"])

    return tables.where("kind IN (2, 3)").select("kind", "chunk", "stats", "a", "b", "c").mapInArrow(
        run, "chunk string, a binary, b binary")


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", train: Column | None = None,
          tokens: int = CHUNK_TOKENS, parts: int | None = None) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    train = in_training(F.col(id)) if train is None else train
    table = stored(chunks(docs, id, text, train, tokens))
    words = stored(vocabulary(table, parts))
    # Counts of counts: one row, however large the vocabulary is.
    stats = words.where("stats IS NOT NULL").select(*[
        F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(CUT + 4)]).first()
    model = Unigrams([int(x or 0) for x in stats])
    begins = docs.where(train).count()
    tables = stored(counted(bigrams(table, words, model, begins, parts), model, parts))
    seen = tables.where("kind = 0").select(*[
        F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(CUT + 2)]).first()
    d = discounts({r: int(seen[r] or 0) for r in range(1, CUT + 2)})
    # At most two split histories per part, by the rule that splits them.
    shared: dict = {}
    for r in tables.where("kind = 4").select("history", "stats", "a").toLocalIterator():
        c_h, plain, by_count, p = shared.get(r["history"], (0, 0, np.zeros(CUT), 0.0))
        shared[r["history"]] = (r["stats"][0], plain + r["stats"][1],
                                by_count + np.array(r["stats"][2:]),
                                p + np.frombuffer(bytes(r["a"]))[0])
    sums = text_sums(tables, d, shared)
    total = model.total

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["c"].notna()].iloc[0]
        sizes = unpack(own["a"]).astype(np.int64)
        result = np.zeros(len(sizes))
        for row in group[group["c"].isna()].sort_values("b").itertuples():
            np.add.at(result, unpack(row.a).astype(np.int64), unpack(row.b))
        return pd.DataFrame({
            id: list(own["ids"]), "held_out": ~unpack(own["d"]).astype(bool), "n_tokens": sizes,
            "n_known": unpack(own["b"]).astype(np.int64), "train_tokens": total,
            "base_score": unpack(own["c"]), "score": result})

    both = tables.where("kind = 5").select("chunk", "ids", "a", "b", "c", "d").unionByName(
        sums, allowMissingColumns=True)
    scored = both.groupBy("chunk").applyInPandas(
        finish, f"`{id}` string, held_out boolean, n_tokens long, n_known long, "
                "train_tokens long, base_score double, score double")
    return scored.withColumn(id, F.col(id).cast(docs.schema[id].dataType))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
