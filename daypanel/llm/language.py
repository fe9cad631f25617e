"""Language identification: a mixture of languages per text, fitted by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm import spans
from daypanel.llm.text import named, numbered_columns

#: Cells that hashed n-grams are counted in.
CELLS = 1 << 14
#: Labelled documents per language that a model is fitted on, about, where there are more.
PER_LANGUAGE = 2_000
UNKNOWN = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of each n-gram: three bytes of the lower-case text, white space as one blank, inside one text."""
    low = spans.lower(data)
    low = np.where(spans.CLASSES[low] == spans.SPACE, np.uint8(32), low).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    text = np.searchsorted(offsets, np.arange(len(code)), "right") - 1
    # Letters carry a language; n-grams of signs, digits and blanks alone don't.
    letter = (spans.CLASSES[data] == spans.LETTER) | (data >= 128)
    inside = (np.arange(2, len(low)) < offsets[text + 1]) & (letter[:-2] | letter[1:-1] | letter[2:])
    cells = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - 14)
    return text[inside], cells.astype(np.int64)


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, n), sorted by text."""
    text, cells = _grams(*spans.buffers(texts))
    key = text * CELLS + cells
    if len(texts) * CELLS <= 1 << 24:
        n = np.bincount(key, minlength=1)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(key, return_counts=True)
    return found // CELLS, found % CELLS, n


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", per_language: int = PER_LANGUAGE) -> dict:
    """The n-gram probabilities of each language, from rows whose text and `lang` aren't null.

    About `per_language` rows of each language count, or all where there are
    fewer: those whose hash of `order` is small, drawn alike in every run; how
    many a share of the hashes hits varies by its root. The model has
    `CELLS` numbers per language and is small enough to send to every task.
    """
    known = labelled.filter(named(text).isNotNull() & named(lang).isNotNull())
    known = known.select(named(lang).alias("lang"), named(text).alias("text"), named(order).cast("string").alias("order"))
    sizes = known.groupBy("lang").count().collect()
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))]) if sizes else None
    if share is None:
        return {"languages": [], "logs": np.zeros((0, CELLS))}
    place = F.pmod(F.xxhash64("order"), F.lit(1 << 30)) / (1 << 30)
    sample = known.filter(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, part in spans.parts(batch.column(1)):
                langs = np.array(batch.column(0).slice(at, len(part)).to_pylist(), dtype=object)
                which, cell, n = _counted(part)
                for name in set(langs.tolist()):
                    own = langs[which] == name
                    total[name] = total.get(name, np.zeros(CELLS)) + np.bincount(cell[own], n[own], CELLS)
        for name, n in total.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(full)), pa.array(full, pa.int32()), pa.array(n[full].astype(np.int64))],
                ["lang", "cell", "n"],
            )

    rows = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    n = np.zeros((len(languages), CELLS))
    for r in rows:
        n[languages.index(r["lang"]), r["cell"]] = r["n"]
    smooth = n + 0.5
    return {"languages": languages, "logs": np.log(smooth / smooth.sum(axis=1, keepdims=True))}


def mixtures(texts: pa.Array, logs: np.ndarray, steps: int = 12, penalty: float = 2.0) -> np.ndarray:
    """(texts x languages): each text's proportions, 0 for languages that aren't in its set.

    The n-grams of a text are drawn from a mixture of the languages' models.
    Its language set grows greedily from the single best language: of the sets
    with one more, the likeliest, its proportions fitted by
    expectation-maximisation, is taken while it raises the log likelihood by
    more than `penalty` times half the logarithm of the text's n-grams for the
    parameter it adds (twice the Bayesian criterion's price at 2).
    """
    texts_n, k = len(texts), len(logs)
    which, cell, n = _counted(texts)
    weight = n.astype(float)
    total = np.bincount(which, weight, texts_n)
    bounds = np.searchsorted(which, np.arange(texts_n + 1))
    out = np.zeros((texts_n, k))
    if not k or not len(which):
        return out
    single = np.stack([np.bincount(which, weight * logs[j][cell], texts_n) for j in range(k)], axis=1)
    best = single.argmax(axis=1)
    out[np.arange(texts_n), best] = total > 0
    likely = single[np.arange(texts_n), best]
    price = penalty * 0.5 * np.log(np.maximum(total, 2.0))
    probs = np.exp(logs).T
    # A text can only gain if, n-gram by n-gram, the best of all languages beats its own by more than the price.
    bound = np.bincount(which, weight * logs.max(axis=0)[cell], texts_n)
    for i in np.flatnonzero(bound - likely > price).tolist():
        p, w = probs[cell[bounds[i] : bounds[i + 1]]], weight[bounds[i] : bounds[i + 1]]
        chosen, value, theta = [int(best[i])], likely[i], np.ones(1)
        # The mixture rises from its single language only where the gradient towards another exceeds 1.
        while len(chosen) < k:
            trials = []
            at = p[:, chosen] @ theta
            for j in set(range(k)) - set(chosen):
                if (w * p[:, j] / at).sum() <= total[i]:
                    continue
                own = p[:, [*chosen, j]]
                t = np.append(theta * 0.75, 0.25)
                for _ in range(steps):
                    part = own * t
                    t = w @ (part / part.sum(axis=1, keepdims=True)) / total[i]
                trials.append((float(w @ np.log(own @ t)), j, t))
            if not trials or max(trials)[0] - value <= price[i]:
                break
            value, j, theta = max(trials)
            chosen.append(j)
        out[i] = 0
        out[i, chosen] = theta
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: dict, text: str = "text", penalty: float = 2.0) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `lang_shares`, read from the whole text alone.

    `lang_shares` maps each language of the text's set to its proportion,
    `lang_pred` is the largest and `score` its proportion. A text that is null
    or has no letter, or any text under a model of no languages, is `und` with
    score 0. Equal proportions fall to the language first in order; letters too
    few for an n-gram give the first language with score 1 over their number.
    Repeated rows get equal answers, an empty table gives no rows, and all
    columns stay but for the three named, which are replaced. A very long text
    is counted by one task, which holds some 30 bytes for each of its bytes.
    """
    added = ("lang_pred", "score", "lang_shares", "text_has_letter")
    kept = [c for c in docs.columns if c not in added]
    own = numbered_columns(docs, kept)
    source = own.select("*", has_letter(F.col(f"c{kept.index(text)}")).alias("text_has_letter"))
    schema = own.select(
        "*",
        F.lit("").alias("lang_pred"),
        F.lit(0.0).alias("score"),
        F.create_map(F.lit(""), F.lit(0.0)).alias("lang_shares"),
    ).schema
    names, logs = model["languages"], model["logs"]
    sent = docs.sparkSession.sparkContext.broadcast(logs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in spans.parts(batch.column(kept.index(text)), 1 << 20):
                lettered = batch.column(len(kept)).slice(at, len(part)).to_numpy(zero_copy_only=False).astype(bool)
                shares = mixtures(part, sent.value, penalty=penalty)
                if names:
                    none = shares.sum(axis=1) == 0
                    shares[none] = 1 / len(names)
                lettered &= bool(names)
                top = shares.argmax(axis=1) if names else np.zeros(len(part), int)
                score = np.where(lettered, np.clip(shares.max(axis=1, initial=0), 0, 1), 0.0)
                lang = [names[j] if ok else UNKNOWN for j, ok in zip(top, lettered, strict=True)]
                pairs = [
                    [(names[j], float(row[j])) for j in np.flatnonzero(row)] if ok else []
                    for row, ok in zip(shares, lettered, strict=True)
                ]
                columns = [batch.column(i).slice(at, len(part)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lang, pa.string()), pa.array(score), pa.array(pairs, pa.map_(pa.string(), pa.float64()))],
                    schema.names,
                )

    return source.mapInArrow(predict, schema).toDF(*kept, "lang_pred", "score", "lang_shares")
