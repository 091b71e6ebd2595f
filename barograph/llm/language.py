"""Language identification as a multilingual mixture.

Per-language n-gram tables are learned from labelled documents (all of them, in one pass). Each word of a text has a likelihood
under each language from its n-grams; expectation-maximisation estimates the proportions of languages in the document, and the
set of languages is selected by penalised likelihood: from the best single language on, the language that gains most is added
for as long as the gain exceeds the penalty. Sets have no largest size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import common as C

#: Buckets of the hashed n-grams, of each order. A model is languages x orders x BUCKETS numbers.
BUCKETS = 1 << 15
ORDERS = (3, 4)
SLICE = 1 << 11
SMOOTHING = 0.05
#: Overlapping n-grams are not independent: a word's log-likelihood is their sum divided by this.
OVERLAP = 2.0
#: Penalty for each further language, in units of half the logarithm of the number of words.
PENALTY = 3.0
EM_STEPS = 16
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of folded text and the two n-gram buckets that end behind each, then the words over these letters:
    (first bucket, second bucket, start of each word among the letters, row of each word)."""
    folded = np.full(len(buf) + 4, 0x20, np.uint8)
    folded[2 : len(buf) + 2] = _FOLD[buf]
    start, end, row = C.words(folded[2 : len(buf) + 2], offs)
    size = end - start
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(int(size.sum())) + 2
    wide = folded.astype(np.uint32)
    before, here, after = wide[at - 1], wide[at], wide[at + 1]
    before[first] = 0x20
    after[first + size - 1] = 0x20
    earlier = np.full(len(at), 0x20, np.uint32)
    earlier[1:] = before[:-1]
    earlier[first] = 0x20
    three = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    four = three | (earlier << np.uint32(24))
    bits = np.uint32(32 - (BUCKETS - 1).bit_length())
    three = ((three + np.uint32(1)) * np.uint32(2654435761)) >> bits
    four = (((four ^ (four >> np.uint32(15))) + np.uint32(7)) * np.uint32(2246822519)) >> bits
    return three.astype(np.int64), four.astype(np.int64), first, row


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities by (order and bucket, language), of rows (text, lang). Null text or lang is left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, buf, offs in C.text_chunks(batch):
                three, four, first, row = grams(buf, offs)
                if not len(three):
                    continue
                codes = pc.dictionary_encode(part.column("lang"))
                names = codes.dictionary.to_pylist()
                of = codes.indices.to_numpy()[row]
                letter = np.repeat(of, np.diff(np.append(first, len(three))))
                for i, name in enumerate(names):
                    mine = letter == i
                    own = sums.setdefault(name, np.zeros(2 * BUCKETS, np.int64))
                    own[:BUCKETS] += np.bincount(three[mine], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(four[mine], minlength=BUCKETS)
        for name, own in sums.items():
            pieces = own.reshape(-1, SLICE)
            some = np.flatnonzero(pieces.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.astype(np.int32)), pa.array([pieces[i].tobytes() for i in some.tolist()], pa.binary())], ["lang", "slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, piece, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "slice", "counts")), strict=True):
                got = np.frombuffer(raw, np.int64)
                sums[name, piece] = sums[name, piece] + got if (name, piece) in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "slice", "counts"])

    schema = "lang string, slice int, counts binary"
    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(C.tidy(count), schema)
    found = rows.repartition(C.shuffle_partitions(docs.sparkSession), "lang", "slice").mapInArrow(C.tidy(add), schema).collect()  # languages x 2 BUCKETS numbers
    names = sorted({r["lang"] for r in found})
    counts = np.zeros((len(names), 2 * BUCKETS // SLICE, SLICE))
    for r in found:
        counts[names.index(r["lang"]), r["slice"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.reshape(len(names), 2, BUCKETS)
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=2, keepdims=True) + SMOOTHING * BUCKETS))
    return names, np.ascontiguousarray(logs.reshape(len(names), 2 * BUCKETS).T.astype(np.float32))


def word_likelihoods(model: np.ndarray, three: np.ndarray, four: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log P(word | language) less the best language's, for each word and language."""
    each = model[three]
    each += model[four + BUCKETS]
    sums = np.add.reduceat(each, first, axis=0) / np.float32(OVERLAP)
    return sums - sums.max(axis=1, keepdims=True)


def mixtures(likely: np.ndarray, first: np.ndarray, allowed: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) by document: EM over the words of documents that begin at `first`, languages `allowed`."""
    n = np.diff(np.append(first, len(likely)))
    of = np.repeat(np.arange(len(first)), n)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.zeros(len(first))
    for _ in range(steps + 1):
        joint = likely * share[of]
        every = np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        total = np.add.reduceat(np.log(every[:, 0]), first)
        last = share
        share = np.add.reduceat(joint / every, first, axis=0) / n[:, None]
    return last, total


def select_languages(logs: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Proportions by document of the language set of best penalised likelihood, by forward selection.

    `logs` are log-likelihoods of words less the best language's, documents begin at the words `begin`. A mixture's likelihood
    is at most that of each word's best language in the set: where this bound gains nothing, no mixture is estimated.
    """
    k = logs.shape[1]
    words = np.diff(np.append(begin, len(logs)))
    price = PENALTY * 0.5 * np.log(words + 1)  # of each further language
    likely = np.exp(logs)
    single = np.add.reduceat(logs, begin, axis=0)
    first = single.argmax(axis=1)
    value, chosen = single[np.arange(len(begin)), first], np.eye(k)[first]
    member = chosen > 0
    ceiling = logs[np.arange(len(logs)), np.repeat(first, words)]  # each word's best language in the set
    active = np.flatnonzero(value + price < 0)
    size = 1
    while len(active) and size < k:
        of, at, starts = words_of(active, begin, words)
        top = ceiling[at]
        gains = np.full((len(active), k), -np.inf)
        for m in range(k):
            bound = np.add.reduceat(np.maximum(top, logs[at, m]), starts)
            gains[:, m] = np.where(member[active, m], -np.inf, bound - size * price[active])
        doc, added = np.nonzero(gains > value[active][:, None])
        if not len(doc):
            break
        total, share = np.full((len(active), k), -np.inf), np.zeros((len(active), k, k))
        for m in np.unique(added).tolist():
            mine = doc[added == m]
            _, inside, cut = words_of(active[mine], begin, words)
            allowed = member[active[mine]].astype(float)
            allowed[:, m] = 1.0
            share[mine, m], total[mine, m] = mixtures(likely[inside], cut, allowed)
            total[mine, m] -= size * price[active[mine]]
        best = total.argmax(axis=1)
        better = total[np.arange(len(active)), best] > value[active]
        rows, best = np.flatnonzero(better), best[better]
        kept = active[rows]
        value[kept], chosen[kept], member[kept, best] = total[rows, best], share[rows, best], True
        of, at, _ = words_of(kept, begin, words)
        ceiling[at] = np.maximum(ceiling[at], logs[at, best[of]])
        active = kept
        size += 1
    return chosen


def words_of(docs: np.ndarray, begin: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the document, place of the word) of all words of some documents, and where each document's begin among them."""
    n = words[docs]
    starts = np.cumsum(n) - n
    of = np.repeat(np.arange(len(docs)), n)
    return of, np.arange(int(n.sum())) - starts[of] + begin[docs][of], starts


def languages_of(model: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, proportions) of every row; -1 where there are no words of letters."""
    n, k = len(offs) - 1, model.shape[1]
    best, shares = np.full(n, -1), np.zeros((n, k))
    three, four, first, row = grams(buf, offs)
    if not len(first) or not k:
        return best, shares
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    chosen = select_languages(word_likelihoods(model, three, four, first).astype(np.float64), begin)
    best[row[begin]], shares[row[begin]] = chosen.argmax(axis=1), chosen
    return best, shares


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row has a Unicode letter."""
    ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[buf] != 0x20) & (buf < 128))])
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


ADDED = ("lang_pred", "score", "lang_set")


def identify(docs: DataFrame, names: list[str], model: np.ndarray, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """All columns of docs, and under the names `added` the language, its share, and the set of languages (name, share).

    Null text, text without letters, and any text where nothing was learned: `und`, score 0, empty set. An empty input gives
    an empty result. Columns that clash with the added ones are replaced.
    """
    docs = docs.drop(*added)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {added[0]} string, {added[1]} double, {added[2]} array<struct<lang:string,share:double>>"
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            for part, buf, offs in C.text_chunks(batch):
                best, shares = languages_of(model, buf, offs)
                best = np.where(has_letter(buf, offs), best, -1)
                pred = [names[i] if i >= 0 else UNKNOWN for i in best.tolist()]
                score = np.where(best >= 0, shares[np.arange(len(best)), np.maximum(best, 0)] if len(names) else 0.0, 0.0)
                sets = [[(names[i], float(s[i])) for i in np.argsort(-s, kind="stable").tolist() if s[i] > 0] if b >= 0 else [] for b, s in zip(best.tolist(), shares, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred), pa.array(np.clip(score, 0.0, 1.0)), pa.array(sets, kind)], [*columns, *added])

    return docs.mapInArrow(C.tidy(run), schema)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null where the id is."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    names, model = learn(docs.where(~F.col("held_out")))
    found = identify(docs.select("doc_id", "held_out", "text"), names, model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join(F.col("lang_set")["lang"], ",").alias("lang_set"))
