"""LM scoring: a log-bilinear model, trained in numpy with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import keep, ship, sliced

END = "\n"  # the end token; no word holds white space
SMOOTH = 0.1
#: Numbers of the model in a row, where copies are averaged.
BLOCK = 4096


class Shape:
    """Sizes of the model: classes of one word, buckets of words, words of the buckets that have items of their own, context, dimensions, noise words."""

    def __init__(self, words: int = 191, buckets: int = 64, items: int = 4000, context: int = 3, dims: int = 12, noise: int = 24, near: int = 4, step: float = 0.15, damp: float = 1e-4, batch: int = 2048):
        self.words, self.buckets, self.items, self.context, self.dims, self.noise, self.near, self.step, self.damp, self.batch = words, buckets, items, context, dims, noise, near, step, damp, batch
        self.classes = words + 1 + buckets  # the end token has a class too

    def bucket(self, word: Column) -> Column:
        """Class of a word without its own: by its last two letters, which tell languages apart."""
        return F.pmod(F.crc32(F.right(word, F.lit(2)).cast("binary")), F.lit(self.buckets)).cast("int") + self.words + 1

    def bucket_of(self, word: bytes) -> int:
        return zlib.crc32(word.decode()[-2:].encode()) % self.buckets + self.words + 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def light(batches, column: int, rows: int, most: int = 1 << 24):
    """Arrow batches of at most so many rows, and of at most about so many bytes of a column save where one row has more."""
    for batch in sliced(batches, rows):
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lowered, and how many each text has. Null: none."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, ""))))
    words, starts = lists.flatten(), lists.offsets.to_numpy()
    sizes = np.diff(starts)
    real = pc.not_equal(words, "")  # a text without a word is split into one empty one
    none = np.flatnonzero(~real.to_numpy(zero_copy_only=False))
    if len(none):
        sizes = sizes.copy()
        np.subtract.at(sizes, np.searchsorted(starts - starts[0], none, side="right") - 1, 1)
        words = words.filter(real)
    return words, sizes


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c): tokens of docs (text), words with A-Z lowered and one end for each row. Tasks count by batch, Spark adds up."""

    def counted(batches):
        for batch in light(batches, 0, 10_000):
            found = pc.value_counts(split(batch.column(0))[0])
            words, c = pa.concat_arrays([found.field(0), pa.array([END])]), np.append(found.field(1).to_numpy(), batch.num_rows)
            yield pa.RecordBatch.from_arrays([words, pa.array(c, pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, head: int) -> list[Row]:
    """The first ``head`` rows of counts (word, c) by falling c, then word.

    To the driver go, for each count there is, how many words have it (as many rows as the root of twice the
    number of tokens at most), then partitions of the sorted rows one at a time until there are enough. A limit would send
    it ``head`` rows of each partition.
    """
    least, above = 0, 0
    for r in sorted(counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if above < head:
            least, above = r["c"], above + r["n"]
    return list(islice(counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").toLocalIterator(), head))


class Model:
    """q = sum over positions of a context item's vector. s(class | context) = q . r(class) + b(class), and within
    a bucket s(item | bucket, context) = q . v(item) + e(item); both normalised over all there are.

    Items: one for each class of one word, then those of each bucket in turn, the last of them for all its other
    words. class_of: the class of each item; counts: how often each item is a training token. The number after the
    last item pads the start of a text.
    """

    def __init__(self, shape: Shape, class_of: np.ndarray, counts: np.ndarray):
        rng = np.random.default_rng(5)
        self.shape, self.class_of, self.first = shape, class_of, shape.words + 1
        per_class = np.bincount(class_of, weights=counts, minlength=shape.classes)
        self.noise = ((per_class + 1.0) / (per_class + 1.0).sum()).astype(np.float32)
        self.c = rng.normal(0, 0.1, (shape.context, len(class_of) + 1, shape.dims)).astype(np.float32)
        self.r = rng.normal(0, 0.1, (shape.classes, shape.dims)).astype(np.float32)
        self.b = np.log(self.noise)
        mine = class_of[self.first :]
        self.v = rng.normal(0, 0.1, (len(mine), shape.dims)).astype(np.float32)
        mass = counts[self.first :] + 1.0
        self.ends = np.searchsorted(mine, np.arange(self.first, shape.classes), side="right")
        self.starts = np.r_[0, self.ends[:-1]]
        total = np.bincount(mine - self.first, weights=mass, minlength=shape.buckets)
        self.near = (mass / total[mine - self.first]).astype(np.float32)  # an item's share of its bucket
        self.e = np.log(self.near)
        self.kept, self.instead = self.aliases()

    def aliases(self) -> tuple[np.ndarray, np.ndarray]:
        """Walker's tables for draws by ``near``: an item met evenly in its bucket is kept with this chance, else another item of the bucket comes instead."""
        kept, instead = np.ones(len(self.near)), np.arange(len(self.near))
        for lo, hi in zip(self.starts.tolist(), self.ends.tolist()):
            share = self.near[lo:hi].astype(np.float64)
            left = (share / share.sum() * (hi - lo)).tolist()
            small, large = [i for i, x in enumerate(left) if x < 1], [i for i, x in enumerate(left) if x >= 1]
            while small and large:
                i, j = small.pop(), large[-1]
                kept[lo + i], instead[lo + i] = left[i], lo + j
                left[j] -= 1 - left[i]
                if left[j] < 1:
                    small.append(large.pop())
        return kept, instead

    def values(self) -> tuple[np.ndarray, ...]:
        return (*self.c, self.r, self.b, self.v, self.e)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for x in self.values():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def weights(self, seen: np.ndarray) -> np.ndarray:
        """What each number of flat() counts in the average of copies: how often the copy met its item or class; never quite 0."""
        rows = [*[np.append(seen, seen.sum())] * self.shape.context, *[np.bincount(self.class_of, weights=seen, minlength=self.shape.classes)] * 2, *[seen[self.first :]] * 2]
        return np.concatenate([np.repeat(n + 1e-3, x.size // len(n)) for n, x in zip(rows, self.values())]).astype(np.float32)

    def tokens(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Items with the context's length of padding before each text, and where the tokens are."""
        k = self.shape.context
        pad = np.full(k, len(self.class_of), dtype=np.int64)
        flat = np.concatenate([x for t in texts for x in (pad, t)])
        at = np.ones(len(flat), dtype=bool)
        starts = np.cumsum([0, *(len(t) + k for t in texts[:-1])])
        for i in range(k):
            at[starts + i] = False
        return flat, np.flatnonzero(at)

    def contexts(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        q = self.c[0].take(flat.take(at - 1), axis=0)
        for i in range(1, self.shape.context):
            q += self.c[i].take(flat.take(at - 1 - i), axis=0)
        return q

    def drawn(self, rng, buckets: np.ndarray) -> np.ndarray:
        """For each token's bucket ``near`` of its items, at random by their shares."""
        x = rng.random((len(buckets), self.shape.near)) * (self.ends - self.starts)[buckets][:, None]
        k = x.astype(np.int64)
        x -= k
        k += self.starts[buckets][:, None]
        return np.where(x < self.kept.take(k), k, self.instead.take(k))

    def learn(self, flat: np.ndarray, at: np.ndarray, rng, squares: list[np.ndarray]) -> None:
        """One pass of noise-contrastive estimation, classes and items of buckets at once. Noise classes are shared in a
        mini-batch, noise items drawn for each token. squares: sums of squared gradients, as values().

        Within the pass a row holds a vector, then its bias, then zeros up to an even width; q has a one where the bias is.
        """
        s, dims, places = self.shape, self.shape.dims, len(self.class_of) + 1
        width = dims + 1 + (dims + 1) % 2
        parts = max(1, -(-len(at) // s.batch))
        off_r, off_v = np.log(self.noise) + np.float32(np.log(s.noise)), np.log(self.near) + np.float32(np.log(s.near))
        draws = rng.choice(s.classes, size=(parts, s.noise), p=self.noise.astype(np.float64) / self.noise.sum(dtype=np.float64))

        def wide(vectors, biases=None):
            out = np.zeros((len(vectors), width), dtype=np.float32)
            out[:, :dims] = vectors
            if biases is not None:
                out[:, dims] = biases
            return out

        def three(values):
            *c, r, b, v, e = values
            return wide(np.concatenate(c)), wide(r, b), wide(v, e)

        def pull(d):  # 1 - sigmoid
            np.exp(np.clip(d, -30, 30, out=d), out=d)
            d += 1
            return np.divide(1, d, out=d)

        def move(value, square, index, rows):
            """A step by the mean gradient: rows summed by index. rows(order) are those in this order."""
            order = np.argsort(index.astype(np.int16), kind="stable")  # short numbers sort by radix
            index = index.take(order)
            starts = np.append(0, np.flatnonzero(index[1:] != index[:-1]) + 1)
            g = np.add.reduceat(rows(order).view(np.complex64), starts, axis=0).view(np.float32)  # two sums at a time
            g *= np.float32(1 / len(pos))
            where = index.take(starts)
            to = square.take(where, axis=0)
            to += g * g
            square[where] = to
            np.sqrt(to, out=to)
            to += np.float32(1e-6)
            g *= np.float32(s.step)
            g /= to
            value[where] += g

        (c, r, v), (c_sq, r_sq, v_sq) = three(self.values()), three(squares)
        for j in range(parts):
            pos, noise = at[j::parts], draws[j]
            own = flat.take(pos)
            target = self.class_of.take(own)
            before = [flat.take(pos - 1 - i) + i * places for i in range(s.context)]
            q = c.take(before[0], axis=0)
            for x in before[1:]:
                q += c.take(x, axis=0)
            q[:, dims] = 1
            r_t, r_n = r.take(target, axis=0), r[noise]
            g_t = pull(np.einsum("ij,ij->i", q, r_t) - off_r.take(target))[:, None]
            g_n = -pull(off_r[noise] - q @ r_n.T)
            r_t *= g_t
            g_q = np.add(r_t, g_n @ r_n, out=r_t)
            g_one = np.concatenate([g_t * q, g_n.T @ q])

            inner = np.flatnonzero(own >= self.first)
            if len(inner):
                q_in = q.take(inner, axis=0)
                items = np.concatenate([own.take(inner)[:, None] - self.first, self.drawn(rng, target.take(inner) - self.first)], axis=1)
                v_n = v.take(items, axis=0)
                d = np.einsum("ij,ikj->ik", q_in, v_n)
                d -= off_v.take(items)
                d[:, 1:] *= -1
                h = pull(d)
                h[:, 1:] *= -1
                g_q[inner] += np.einsum("ik,ikj->ij", h, v_n)
                move(v, v_sq, items.ravel(), lambda order: h.take(order)[:, None] * q_in.take(order // h.shape[1], axis=0))
            move(r, r_sq, np.concatenate([target, noise]), lambda order: g_one.take(order, axis=0))
            g_q[:, dims:] = 0
            for x in before:
                move(c, c_sq, x, lambda order: g_q.take(order, axis=0))
        for values, (c, r, v) in ((self.values(), (c, r, v)), (squares, (c_sq, r_sq, v_sq))):
            for to, x in zip(values, (*np.split(c[:, :dims], s.context), r[:, :dims], r[:, dims], v[:, :dims], v[:, dims])):
                to[...] = x

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each position of a context the largest score that each item there gives to a class, and exp of the scores of all classes less that.

        As q is a sum over positions, exp of a token's scores of all classes is the product of its items' rows.
        """
        out = []
        for i in range(self.shape.context):
            x = self.c[i] @ self.r.T
            if i == 0:
                x += self.b
            most = x.max(axis=1)
            x -= most[:, None]
            out.append((most, np.exp(x, out=x)))
        return out

    def log10(self, flat: np.ndarray, at: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """log10 probability of each token's item: its class among all, by products of tables() (those of the model as it is), then
        the item among all of its bucket, by batched products with their vectors."""
        tables = tables or self.tables()
        r = np.ascontiguousarray(np.concatenate([self.r, self.b[:, None]], axis=1).T)
        v = np.ascontiguousarray(np.concatenate([self.v, self.e[:, None]], axis=1).T)
        q = np.concatenate([self.contexts(flat, at), np.ones((len(at), 1), np.float32)], axis=1)
        own = flat[at]
        classes = self.class_of[own]

        def own_share(q, vectors, own):
            out = np.empty(len(own), dtype=np.float32)
            reach = np.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->j", vectors, vectors).max())
            for i in range(0, len(own), 512):  # as much as a processor's cache holds
                scores = q[i : i + 512] @ vectors
                if not reach < 80:  # else no score leaves the range of exp
                    scores -= scores.max(axis=1, keepdims=True)
                mine = scores[np.arange(len(scores)), own[i : i + 512]]
                out[i : i + 512] = mine - np.log(np.exp(scores, out=scores).sum(axis=1))
            return out

        out = np.einsum("ij,ij->i", q, r.T.take(classes, axis=0)).astype(np.float64)
        total, ones = np.empty(len(at), dtype=np.float32), np.ones(self.shape.classes, dtype=np.float32)
        before = [flat.take(at - 1 - i) for i in range(self.shape.context)]
        for i in range(0, len(at), 256):
            x = tables[0][1].take(before[0][i : i + 256], axis=0)
            for (_, table), items in zip(tables[1:], before[1:]):
                x *= table.take(items[i : i + 256], axis=0)
            total[i : i + 256] = x @ ones
        low = np.flatnonzero(~(total > 1e-20))  # rows whose large numbers don't meet: products may have left the range
        total[low] = 1
        out -= np.log(total)
        for (most, _), items in zip(tables, before):
            out -= most.take(items)
        if len(low):
            out[low] = own_share(q[low], r, classes[low])
        order = np.argsort(classes.astype(np.int16), kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(self.first, self.shape.classes + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():  # of each bucket that occurs
            mine, lo, hi = order[cuts[k] : cuts[k + 1]], self.starts[k], self.ends[k]
            if hi - lo > 1:
                out[mine] += own_share(q.take(mine, axis=0), v[:, lo:hi], own[mine] - self.first - lo)
        return out / np.log(10)


def averaged(copies: DataFrame, flat: np.ndarray) -> np.ndarray:
    """Mean of the tasks' copies by weight. copies: (block, part, x, w), x and w Arrow bytes of BLOCK numbers; summed by block and part, then by block.

    As many numbers as the model has go to the driver, however many tasks there are.
    """

    def summed(table: pa.Table) -> pa.Table:
        x, w = (sum(np.frombuffer(b, np.float32).astype(np.float64) for b in table[n].to_pylist()).astype(np.float32).tobytes() for n in ("x", "w"))
        return pa.table({"block": table["block"][:1], "part": pa.array([0], pa.int32()), "x": pa.array([x], pa.binary()), "w": pa.array([w], pa.binary())})

    kind = "block int, part int, x binary, w binary"
    out = flat.copy()
    for r in copies.groupBy("block", "part").applyInArrow(summed, kind).groupBy("block").applyInArrow(summed, kind).collect():
        at = r["block"] * BLOCK
        out[at : at + BLOCK] = np.frombuffer(r["x"], np.float32) / np.frombuffer(r["w"], np.float32)
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None, head: int = 200_000, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Rows whose crc32 of the id as text is divisible by 10 are held out; the model learns from all others.
    1. Spark counts the training tokens. 2. Every text becomes items: the most frequent words are classes of
    their own, the ``items`` next ones (Shape) have items in the buckets of their endings, all others share one item a
    bucket. 3. In each of ``rounds`` rounds, each task trains a copy of the model on its training texts of that
    round, all texts in one round or another; Spark averages the copies by how often each met an item. 4. Tasks
    score all texts: the class, then the item in its bucket, both by the model; a word that shares an item by
    its smoothed share of the item's words. So the probabilities of all words, a new one per bucket included,
    sum to one.

    The ``head`` most frequent words (a bound) go to the tasks with their counts; others are joined.
    Null text: empty, one end token. Null id: as an empty one, held out. Repeated rows: each is scored. Very
    long texts: whole. No training rows: counts are 0 and the model stays as it starts. Empty table: no rows.
    """
    shape = shape or Shape()
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = keep(token_counts(rows.where(~held_out(F.col("doc_id")))))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, head)
    ends = counts.where(F.col("word") == END).first()
    named = [r["word"].encode() for r in top if r["word"] != END]
    own, nearer = named[: shape.words], named[shape.words :][: shape.items]
    count = {r["word"].encode(): float(r["c"]) for r in top} | {END.encode(): float(ends["c"]) if ends else 0.0}
    # Items of each bucket: its words of the head, by name, then one for all its others.
    in_bucket: list[list[bytes]] = [[] for _ in range(shape.buckets)]
    for w in sorted(nearer):
        in_bucket[shape.bucket_of(w) - shape.words - 1].append(w)
    item = {w: i for i, w in enumerate(own)} | {END.encode(): shape.words}
    class_of, item_c, rest_item = [*range(shape.words + 1)], np.zeros(shape.words + 1 + len(nearer) + shape.buckets), []
    for k, words in enumerate(in_bucket):
        for w in words:
            item[w] = len(class_of)
            class_of.append(shape.words + 1 + k)
        rest_item.append(len(class_of))
        class_of.append(shape.words + 1 + k)
    for w, i in item.items():
        item_c[i] = count[w]
    class_of, rest_item = np.array(class_of), np.array(rest_item)
    rest_c, rest_v = np.zeros(shape.buckets), np.zeros(shape.buckets)  # of the words that share a bucket's last item
    for r in counts.where(F.col("word") != END).groupBy(shape.bucket(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # one row for a bucket
        rest_c[r["k"] - shape.words - 1], rest_v[r["k"] - shape.words - 1] = r["c"], r["n"]
    for w in (*own, *nearer):
        rest_c[shape.bucket_of(w) - shape.words - 1] -= count[w]
        rest_v[shape.bucket_of(w) - shape.words - 1] -= 1
    item_c[rest_item] = rest_c
    rest_total = rest_c + SMOOTH * (rest_v + 1)
    places = {w: i for i, w in enumerate(count)}
    head_words = pa.array([w.decode() for w in places], pa.string())
    top_c = np.array(list(count.values()))
    place_item = np.array([item.get(w, -1) if w in item else rest_item[shape.bucket_of(w) - shape.words - 1] for w in places])
    shared = np.array([w not in item for w in places])
    place_base = np.log10((top_c + SMOOTH) / (n + SMOOTH * (v + 1)))
    place_share = np.where(shared, np.log10((top_c + SMOOTH) / rest_total[np.maximum(class_of[place_item] - shape.words - 1, 0)]), 0.0)
    new_base = float(np.log10(SMOOTH / (n + SMOOTH * (v + 1))))

    def encode(batches):
        end, place_known, place_kind = places[END.encode()], (top_c > 0).astype(np.int64), place_item.astype(np.int16)
        for batch in light(batches, 2, 1000):
            words, sizes = split(batch.column(2))
            place = pc.fill_null(pc.index_in(words, value_set=head_words), -1).to_numpy(zero_copy_only=False)
            known = place >= 0
            rest = words.filter(pa.array(~known))
            kind = place_kind.take(place, mode="clip")
            endings = pc.utf8_slice_codeunits(rest, -2).dictionary_encode()  # each ending of a batch is looked up once
            kind[~known] = np.array([rest_item[shape.bucket_of(w.encode()) - shape.words - 1] for w in endings.dictionary.to_pylist()], np.int16)[endings.indices.to_numpy()]
            # Of each word and each end in turn; an end comes after the words of its text.
            lengths = sizes + 1
            upto = np.cumsum(lengths)
            is_end = np.zeros(upto[-1], dtype=bool)
            is_end[upto - 1] = True
            kinds = np.full(upto[-1], shape.words, dtype=np.int16)
            kinds[~is_end] = kind

            def summed(x):
                out = np.full(upto[-1], x[end])
                out[~is_end] = np.where(known, x.take(place, mode="clip"), 0)
                return np.add.reduceat(out, upto - lengths)

            sums = [summed(x) for x in (place_known, place_base, place_share)]
            rest_upto = np.append(0, np.cumsum(~known))[np.append(0, np.cumsum(sizes))].astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, 2 * upto).astype(np.int32)), pa.py_buffer(kinds)])
            cols = [pa.array(lengths, pa.int64()), *(pa.array(x, k) for x, k in zip(sums, (pa.int64(), pa.float64(), pa.float64()))), raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, pa.ListArray.from_arrays(pa.array(rest_upto), rest)], ["rid", "doc_id", "n_tokens", "n_known", "base", "share", "kinds", "rest"])

    coded = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    coded = keep(coded.mapInArrow(encode, "rid long, doc_id long, n_tokens long, n_known long, base double, share double, kinds binary, rest array<string>"))

    flat = Model(shape, class_of, item_c).flat()
    training = coded.where(~held_out(F.col("doc_id")))

    def train(batches):
        model = Model(shape, class_of, item_c).load(flat)
        squares = [np.full_like(x, shape.damp) for x in model.values()]  # what met little moves little
        rng, seen = np.random.default_rng(11), np.zeros(len(class_of))
        part = 0
        for batch in light(batches, 0, 400):
            part = batch.column(1)[0].as_py()
            items, at = model.tokens([np.frombuffer(x, dtype=np.int16).astype(np.int64) for x in batch.column(0).to_pylist()])
            model.learn(items, at, rng, squares)
            seen += np.bincount(items[at], minlength=len(class_of))
        if seen.any():
            x, w = model.flat(), model.weights(seen)
            blocks = range(0, len(x), BLOCK)
            cols = [np.arange(len(blocks)), np.full(len(blocks), part), [(x[i : i + BLOCK] * w[i : i + BLOCK]).tobytes() for i in blocks], [w[i : i + BLOCK].tobytes() for i in blocks]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "x", "w"])

    for turn in range(rounds):
        texts = training.where(F.pmod(F.xxhash64("rid"), F.lit(rounds)) == turn).select("kinds", (F.spark_partition_id() % 64).alias("part"))
        flat = averaged(texts.mapInArrow(train, "block int, part int, x binary, w binary"), flat)

    def score(batches):
        model = Model(shape, class_of, item_c).load(flat)
        tables = model.tables()
        for batch in light(batches, 1, 400):
            texts = [np.frombuffer(x, dtype=np.int16).astype(np.int64) for x in batch.column(1).to_pylist()]
            tokens, at = model.tokens(texts)
            ends = np.cumsum([len(t) for t in texts])
            sums = np.add.reduceat(model.log10(tokens, at, tables), np.r_[0, ends[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], ["rid", "by_class"])

    by_class = keep(coded.select("rid", "kinds").mapInArrow(score, "rid long, by_class double"))
    totals = F.array(*[F.lit(float(x)) for x in rest_total])
    rare = counts.where(F.col("c") <= (top[-1]["c"] if top else 0)).withColumnRenamed("word", "w")
    rest = coded.select("rid", F.explode("rest").alias("w")).join(rare, "w", "left")
    c = F.coalesce("c", F.lit(0))
    share = F.log10((c + SMOOTH) / F.get(totals, shape.bucket(F.col("w")) - shape.words - 1))
    rest = rest.groupBy("rid").agg(
        F.count("c").alias("more_known"), F.sum(F.when(F.col("c").isNull(), new_base).otherwise(F.log10((c + SMOOTH) / (n + SMOOTH * (v + 1))))).alias("more_base"), F.sum(share).alias("more_share"),
    )
    zero = F.lit(0)
    out = coded.drop("kinds", "rest").join(by_class, "rid").join(rest, "rid", "left")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("by_class") + F.col("share") + F.coalesce("more_share", zero)).alias("score"),
    )
