"""Language identification as a mixture of languages.

A model holds, for each language, the log-probability of every hashed byte trigram, learnt from labelled documents. The
likelihood of a word under a language is the product over its trigrams; a document is a mixture of languages over its
words. Expectation-maximisation estimates the proportions; languages then enter in the order of their proportions for
as long as the likelihood, penalised for each further language, rises. The prediction is the largest proportion of the
chosen set.

Bounds: at most `SAMPLE` labelled documents of each language are learnt from (chosen by a hash of doc_id); the model
takes 256 KB for each language.

A text of more than a chunk is taken in stretches that end between words, and its distinct words are kept with their
counts, so that memory grows with its vocabulary alone.

Defined cases: a null text, or one without a letter, is `und` with score 0; texts are taken whole; repeated rows and ties
give equal results (ties go to the alphabetically first language); without a labelled row every text is `und`; an empty
table gives no rows; other columns are kept or ignored as the caller asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from vigilspark.llm import common

SAMPLE = 3000
BUCKETS = 1 << 16
PASSES = 8
#: Log-likelihood that a further language must gain, in units of half the logarithm of the number of words.
PENALTY = 6.0
#: A language of a smaller estimated share isn't tried.
LEAST_SHARE = 0.03

#: Bytes of text taken at once: each byte takes some 100 bytes of arrays.
CHUNK_BYTES = 1 << 18

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[b for b in range(128) if not 97 <= b <= 122]] = 32
_SEP = b" "


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def _prepared(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with everything but letters as spaces, a space around each row; and the rows' offsets."""
    rows = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = _SPACE[np.frombuffer(_SEP + _SEP.join(rows) + _SEP, dtype=np.uint8)]
    return data, np.concatenate([[1], 1 + np.cumsum([len(r) + 1 for r in rows])])


def _trigrams(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    return ((d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _text_chunks(col: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    _, offs, _ = common.text_buffers(col)
    for i, j in common.row_chunks(offs, CHUNK_BYTES):
        yield i, j, col.slice(i, j - i).to_pylist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, _, texts in _text_chunks(batch.column(1)):
            data, offs = _prepared(texts)
            for k in range(len(texts)):
                s, e = int(offs[k]) - 1, int(offs[k + 1]) - 1
                for at in range(s, e, CHUNK_BYTES):  # trigrams that start in a stretch
                    part = data[at : min(e, at + CHUNK_BYTES) + 2]
                    blank = (part[:-2] == 32) & (part[1:-1] == 32)
                    total[langs[i + k]] = total.get(langs[i + k], 0) + np.bincount(_trigrams(part)[~blank], minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "gram", "n"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from (doc_id, text, lang): at most about `sample` documents of each language."""
    rows = common.pick(labelled, "doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)
    grams = chosen.select("lang", "text").mapInArrow(common.released(_counts), "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    counts = np.zeros((BUCKETS, len(languages)))
    got = grams.toPandas()
    counts[got["gram"].to_numpy(), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    p = (counts + 0.1) / (counts.sum(axis=0) + 0.1 * 2 * seen)
    return Model(languages, np.log(p).astype(np.float32))


def _mixture(like: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods (beside the words' scale) of each document. first: its first word; weights: how often
    each word occurs (once, if not given)."""
    share, times = start, sizes if weights is None else np.add.reduceat(weights, first)
    for _ in range(PASSES):
        joint = np.repeat(share, sizes, axis=0)
        joint *= like
        joint /= joint.sum(axis=1, keepdims=True)
        if weights is not None:
            joint *= weights[:, None]
        share = np.add.reduceat(joint, first, axis=0) / times[:, None]
    total = np.log(np.maximum((np.repeat(share, sizes, axis=0) * like).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total if weights is None else total * weights, first)


def _chosen(like: np.ndarray, sizes_all: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The proportions of the chosen languages of each document: languages enter while the penalised likelihood rises."""
    n, width = len(sizes_all), like.shape[1]
    first = np.concatenate([[0], np.cumsum(sizes_all)[:-1]])
    times = sizes_all if weights is None else np.add.reduceat(weights, first)
    share, _ = _mixture(like, first, sizes_all, np.full((n, width), 1.0 / width), weights)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    best[np.arange(n), order[:, 0]] = 1.0
    single = np.log(np.maximum((np.repeat(best, sizes_all, axis=0) * like).sum(axis=1), 1e-300))
    value = np.add.reduceat(single if weights is None else single * weights, first)
    open_ = np.arange(n)
    for k in range(2, width + 1):
        open_ = open_[share[open_, order[open_, k - 1]] >= LEAST_SHARE]
        if not len(open_):
            break
        pick = np.zeros(n, dtype=bool)
        pick[open_] = True
        start = np.zeros((len(open_), width))
        for c in range(k):
            start[np.arange(len(open_)), order[open_, c]] = np.maximum(share[open_, order[open_, c]], 1e-3)
        start /= start.sum(axis=1, keepdims=True)
        sizes, held = sizes_all[open_], np.repeat(pick, sizes_all)
        got, log_like = _mixture(like[held], np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, start, None if weights is None else weights[held])
        log_like = log_like - PENALTY * 0.5 * np.log(times[open_] + 1.0)
        better = log_like > value[open_]
        open_, got, log_like = open_[better], got[better], log_like[better]
        best[open_], value[open_] = got, log_like
    return best


def _scaled(words: np.ndarray) -> np.ndarray:
    """Likelihoods of words from their logarithms, the best language of each word at 1."""
    return np.exp(np.maximum(words - words.max(axis=1, keepdims=True), -50.0))


def _word_sums(data: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of prepared bytes (which begin and end with a space), and their log-likelihoods."""
    solid = data != 32
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    if not len(starts):
        return starts, ends, np.zeros((0, len(model.languages)))
    total = np.zeros((len(data) - 1, len(model.languages)))
    np.cumsum(model.log_p[_trigrams(data)], axis=0, out=total[1:], dtype=np.float64)
    return starts, ends, total[ends - 1] - total[starts - 1]  # trigrams from the space before a word to the one after it


def _one_long_word(data: np.ndarray, model: Model, each: int) -> np.ndarray:
    """The log-likelihoods of a word of more than a chunk, the space before and after it included."""
    total = np.zeros(len(model.languages))
    for at in range(0, len(data) - 2, each):
        total += model.log_p[_trigrams(data[at : at + each + 2])].sum(axis=0, dtype=np.float64)
    return total


def predict_long(text: str, model: Model, each: int = CHUNK_BYTES) -> tuple[str, float]:
    """One text in stretches of about `each` bytes."""
    if not model.languages or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, _ = _prepared([text])
    raw = data.tobytes()
    hashes, likes, counts = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)), np.float64), np.zeros(0, np.int64)
    at = 0
    while at < len(data) - 1:
        stop = raw.find(b" ", min(at + each, len(data) - 1))
        if stop - at > 2 * each and (cut := raw.rfind(b" ", at, at + each)) > at:
            stop = cut
        part = data[at : stop + 1]
        if len(part) > 2 * each:  # one word
            starts, ends, sums = np.array([1]), np.array([len(part) - 1]), _one_long_word(part, model, each)[None, :]
        else:
            starts, ends, sums = _word_sums(part, model)
        at = stop
        if len(starts):
            now = np.concatenate([hashes, common.word_hashes(part, starts, ends)])
            hashes, where, place = np.unique(now, return_index=True, return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, np.ones(len(starts))]), minlength=len(hashes))
            likes = np.concatenate([likes, _scaled(sums)])[where]
    if not len(hashes):
        return "und", 0.0
    best = _chosen(likes, np.array([len(hashes)]), counts)[0]
    return model.languages[int(best.argmax())], min(1.0, float(best.max()))


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return langs, scores
    data, offs = _prepared(texts)
    starts, _, words = _word_sums(data, model)
    if not len(starts):
        return langs, scores
    like = _scaled(words)
    at = np.searchsorted(starts, offs)
    has = np.array([e > s and any(c.isalpha() for c in t or "") for s, e, t in zip(at[:-1], at[1:], texts, strict=True)])
    rows = np.flatnonzero(has)
    if not len(rows):
        return langs, scores
    bounds, sizes_all = at[rows], at[rows + 1] - at[rows]
    use = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(use, bounds, 1)
    np.add.at(use, bounds + sizes_all, -1)
    best = _chosen(like[np.cumsum(use[:-1]) > 0], sizes_all)
    top = best.argmax(axis=1)
    for r, t, s in zip(rows.tolist(), top.tolist(), best.max(axis=1).tolist(), strict=True):
        langs[r], scores[r] = model.languages[t], min(1.0, s)
    return langs, scores


def identifier(model: Model):
    """A column function: text to a struct of lang_pred and score."""

    @arrow_udf("struct<lang_pred:string,score:double>")
    def found(text: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[float] = []
        for _, _, texts in _text_chunks(text):
            if len(texts) == 1 and len(texts[0] or "") > CHUNK_BYTES:
                lang, score = predict_long(texts[0], model)
                got = [lang], [score]
            else:
                got = predict(texts, model)
            langs += got[0]
            scores += got[1]
        common.release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return found


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; without a model it learns from rows that aren't held out."""
    model = model or train(docs.filter(~held_out()))
    rows = common.pick(docs, "doc_id", "text").select(F.col("doc_id"), F.col("text").cast("string"))
    return rows.select("doc_id", held_out().alias("held_out"), identifier(model)("text").alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")
