"""Language identification: piece probabilities of each language over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, ship, sliced

#: Texts of a language that its probabilities are fitted on, about; drawn by hash from all its training texts.
TRAIN_TEXTS = 3000
#: Rounds of expectation and maximisation, and the part of each language's probabilities that is the mean of all: alike
#: for large and small languages, so that what none of them has met speaks for none.
ROUNDS, BACKOFF = 4, 0.02
#: Longest run, in characters, that is fitted on as one; longer ones are cut for the fit, never for prediction.
FIT_CHARS = 16
#: Part of a word's probability that comes from all languages alike, so that one foreign word can't decide a text.
SHARED = 0.02
UNKNOWN = "und"

_BASE, _TURN = np.uint64(1_099_511_628_211), np.uint64(0x9E3779B97F4A7C15)
_BITS = 18


@dataclass
class Pieces:
    """Byte strings in a hash table by their polynomial hash; a word starts with a space, as its first piece may."""

    names: list[bytes]
    keys: np.ndarray
    ids: np.ndarray
    probes: int
    longest: int

    @staticmethod
    def of(names: list[bytes]) -> Pieces:
        codes = [_hash(n) for n in names]
        if len(set(codes)) < len(names):
            raise ValueError("two pieces have one hash")
        size = 1 << _BITS
        keys, ids, probes = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 1
        for i, code in enumerate(codes):
            at = (code * int(_TURN) % (1 << 64)) >> (64 - _BITS)
            step = 0
            while ids[(at + step) % size] >= 0:
                step += 1
            keys[(at + step) % size], ids[(at + step) % size] = code, i
            probes = max(probes, step + 1)
        return Pieces(names, keys, ids, probes, max(map(len, names)))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        at = ((codes * _TURN) >> np.uint64(64 - _BITS)).astype(np.int64)
        found = np.where(self.keys[at] == codes, self.ids[at], -1)
        for step in range(1, self.probes):
            to = (at + step) & ((1 << _BITS) - 1)
            found = np.where((found < 0) & (self.keys[to] == codes), self.ids[to], found)
        return found


def _hash(name: bytes) -> int:
    h = 0
    for b in name:
        h = (h * int(_BASE) + b + 1) % (1 << 64)
    return h


def vocabulary(model: str) -> Pieces:
    """Lower-case letter pieces of a sentencepiece model, with or without a word's start before them, and every single byte."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (read.id_to_piece(i) for i in range(read.get_piece_size()))
    plain = {p.replace("▁", " ") for p in pieces if p.removeprefix("▁").isalpha() and p == p.lower()} | {" "}
    return Pieces.of(sorted({p.encode() for p in plain} | {bytes([b]) for b in range(256)}))


def spans(words: np.ndarray, pieces: Pieces):
    """For words of one length (rows of bytes), yield (start, end, rows, pieces) of all pieces in them, by end."""
    n, size = words.shape
    sums = np.zeros((size + 1, n), np.uint64)
    for i in range(size):
        sums[i + 1] = sums[i] * _BASE + words[:, i] + np.uint64(1)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(min(size, pieces.longest), _BASE)]))
    for end in range(1, size + 1):
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.find(sums[end] - sums[start] * power[end - start])
            rows = np.flatnonzero(found >= 0)
            if len(rows):
                yield start, end, rows, found[rows]


def log_probabilities(words: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations of the product of piece probabilities. p: (pieces, languages).

    A forward pass over bytes. Sums are scaled as it goes, each word and language for itself, so that words of any length stay finite.
    """
    n, size = words.shape
    ring = pieces.longest + 1
    ahead = np.zeros((ring, n, p.shape[1]))
    ahead[0] = 1
    scale, at = np.zeros((n, p.shape[1])), 0

    def settle(end: int) -> None:
        top = ahead.max(axis=0)
        top[top == 0] = 1
        ahead[:] /= top
        scale[:] += np.log(top)

    for start, end, rows, found in spans(words, pieces):
        if end != at:
            if at and at % 8 == 0 and size > 16:
                settle(at)
            at = end
            ahead[end % ring] = 0
        ahead[end % ring][rows] += ahead[start % ring][rows] * p[found]
    with np.errstate(divide="ignore"):
        return np.log(ahead[size % ring]) + scale


def expected(words: np.ndarray, weights: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """(pieces, languages): expected uses of each piece, over all segmentations of words of one length, weighted."""
    n, size = words.shape
    found = list(spans(words, pieces))
    ahead, back = np.zeros((2, size + 1, n, p.shape[1]))
    ahead[0] = back[size] = 1
    for start, end, rows, ids in found:
        ahead[end][rows] += ahead[start][rows] * p[ids]
    for start, end, rows, ids in sorted(found, key=lambda s: -s[0]):
        back[start][rows] += back[end][rows] * p[ids]
    total = ahead[size]
    share = np.divide(weights, total, out=np.zeros_like(total), where=total > 0)
    out = np.zeros(p.shape)
    for start, end, rows, ids in found:
        np.add.at(out, ids, ahead[start][rows] * back[end][rows] * p[ids] * share[rows])
    return out


def by_length(words: list[str], most: int):
    """(places, rows of bytes) of words with a space before them, of one length each, at most so many at a time."""
    coded = [b" " + w.encode() for w in words]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        for k in range(0, len(group), most):
            at = group[k : k + most]
            yield at, np.frombuffer(b"".join(coded[i] for i in at), np.uint8).reshape(len(at), -1)


def _at_once(languages: int) -> int:
    return max(64, (1 << 15) // languages)


def letters(text: Column) -> Column:
    """Lower-case letter runs, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray
    prior: np.ndarray

    def words(self, words: list[str], shared: float = SHARED) -> np.ndarray:
        """(words, languages): log probability of each word."""
        out = np.zeros((len(words), len(self.languages)))
        for at, rows in by_length(words, _at_once(len(self.languages))):
            x = log_probabilities(rows, self.pieces, self.p)
            mean = np.logaddexp.reduce(x, axis=1, keepdims=True) - np.log(x.shape[1])
            out[at] = np.logaddexp(np.log1p(-shared) + x, np.log(shared) + mean)
        return out


def fit(texts: DataFrame, pieces: Pieces, train_texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> Model | None:
    """Piece probabilities of each language by expectation-maximisation. texts: (lang, doc_id, text), lang not null.

    About ``train_texts`` texts of each language are drawn by hash, so that copies do not crowd a language out, and counted
    as words; the counts stay in Spark and each round goes over them there. The driver holds pieces times languages.
    """
    texts = texts.where(F.col("text").rlike(r"\p{L}"))
    counts = sorted((r["lang"], r["count"]) for r in texts.groupBy("lang").count().collect())  # a row for each language
    if not counts:
        return None
    names = [c[0] for c in counts]
    share = F.create_map(*[F.lit(v) for lang, n in counts for v in (lang, min(1.0, train_texts / n))])[F.col("lang")]
    drawn = texts.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 24)) < share * (1 << 24)).dropDuplicates(["lang", "text"])
    number = F.create_map(*[F.lit(v) for i, lang in enumerate(names) for v in (lang, i)])[F.col("lang")]
    runs = drawn.select(number.alias("lang"), F.explode(F.split(letters(F.col("text")), " ")).alias("run"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / FIT_CHARS)), lambda k: F.substring(F.col("run"), k.cast("int") * FIT_CHARS + 1, F.lit(FIT_CHARS)))
    words = keep(runs.where("run <> ''").select("lang", F.explode(cut).alias("word")).groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")))
    k, v = len(names), len(pieces.names)
    p = np.full((v, k), 1 / v)
    for _ in range(rounds):
        now = p

        def count(batches):
            total = np.zeros(now.shape)
            for batch in sliced(batches, 20_000):
                coded = batch.column(0).dictionary_encode()
                weights = np.zeros((len(coded.dictionary), k))
                np.add.at(weights, (coded.indices.to_numpy(), batch.column(1).to_numpy()), batch.column(2).to_numpy())
                for at, rows in by_length(coded.dictionary.to_pylist(), _at_once(k)):
                    total += expected(rows, weights[at], pieces, now)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        got = words.mapInArrow(count, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((v, k))
        total[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
        every = total / np.maximum(total.sum(axis=0), 1)
        p = (1 - BACKOFF) * every + BACKOFF * (0.99 * every.mean(axis=1, keepdims=True) + 0.01 / v)
    shares = np.array([c[1] for c in counts], dtype=float)
    return Model(names, pieces, p, np.log(shares / shares.sum()))


def predictor(model: Model, most_cached: int = 400_000):
    """Arrow batches (..., clean) to (..., lang_pred, score); words met before in the task are not scored again."""

    def predict(batches):
        known: dict[str, int] = {}
        scores = np.zeros((0, len(model.languages)))
        for batch in sliced(batches, 500):
            runs = pc.split_pattern(batch.column("clean").fill_null(""), " ")
            coded = runs.flatten().dictionary_encode()
            met = coded.dictionary.to_pylist()
            new = [w for w in met if w not in known]
            if len(known) + len(new) > most_cached:
                known, scores, new = {}, scores[:0], met
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                scores = np.concatenate([scores, model.words(new)])
            own = scores[[known[w] for w in met]] if met else scores[:0]
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(runs).to_numpy())
            at = coded.indices.to_numpy()
            total = np.stack([np.bincount(doc, weights=own[at, i], minlength=batch.num_rows) for i in range(own.shape[1])], axis=1) + model.prior
            best = total.argmax(axis=1)
            share = np.exp(total[np.arange(len(best)), best] - np.logaddexp.reduce(total, axis=1))
            none = np.array([not c for c in batch.column("clean").to_pylist()], dtype=bool)
            pred = [UNKNOWN if skip else model.languages[b] for b, skip in zip(best, none)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred), pa.array(np.where(none, 0.0, np.minimum(share, 1.0)))], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def language_id(docs: DataFrame, model_path: str, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang), whole texts.

    Learned from the texts whose lang is not null and whose crc32(doc_id as text) % 3 is not 1. A text's words
    (letter runs, in lower case) are scored for each language; score is the probability of the predicted one by these
    scores and the languages' shares among the training texts. Equal scores: the language first by code point.
    Null text, or none with a letter: und, score 0; so is every text where no language can be learned.
    Null doc_id: counted as empty text for the remainder. Very long texts and words: whole. Repeated rows: each predicted;
    in the fit one counts. Empty table: no rows. Other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = fit(docs.where(~held & F.col("lang").isNotNull()).select("lang", "doc_id", "text"), vocabulary(model_path), train_texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), letters(F.col("text")).alias("clean"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
