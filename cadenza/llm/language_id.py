"""Language identification with a bidirectional gated recurrent network over bytes.

Training. The model learns from rows whose language is known and whose
``crc32(doc_id as text) mod 4`` is not 2. Of each language at most ``sample_docs``
rows, those of least row hash, form the sample; training draws its windows
of ``WINDOW_CHARS`` characters at hashed places of their whole texts, ``draws`` of a row,
and only these windows reach the driver. The network is trained in numpy by
backpropagation through time.

Prediction. The lower-cased whole text is read in both directions in windows (``bigru.py``)
whose state is carried in from the bytes around them; every byte position of the text
gets label probabilities, and their mean over all positions is the document's.

Defined results: a null text, or one without a letter, gives ``und`` with score
0; ties go to the first label in code-point order; without any training row all
is ``und``; repeated rows give equal rows and count once in the sample; a null id counts as the text "" for
the split; columns other than id, text and language are ignored, and language
and source never enter a prediction; an empty table gives an empty table; more
than ``MAX_LABELS`` different languages are an error, not a sample of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bigru import BiGru
from .common import claim_worker, give_back, sliced

#: Rows of a language in the sample, and windows that training may draw from each.
SAMPLE_DOCS, DRAWS, WINDOW_CHARS = 250, 16, 48
MAX_LABELS = 200
#: Bytes of text that a task works on at a time; it takes some 12 times that in memory.
SLICE = 2 << 20


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS, draws: int = DRAWS) -> list:
    """(lang, window) rows of the bounded sample, in a fixed order."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = known.groupBy("lang").count().limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages in {lang_col}")
    if not counts:
        return []
    # of n rows some four times the sample pass by their hash; the least hashes of these are the sample
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * sample_docs / r["count"]))))
    h = F.xxhash64("id", "text")
    some = known.filter(F.col("text").rlike(r"\p{L}")).withColumn("h", h).filter(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * (1 << 40))
    at = lambda k: F.pmod(F.xxhash64("h", k), F.greatest(F.lit(1), F.char_length("text") - WINDOW_CHARS + 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda k: F.lower(F.substring(F.col("text"), at(k), F.lit(WINDOW_CHARS))))
    some = some.select("lang", "h", cut.alias("windows")).groupBy("lang", "h").agg(F.first("windows").alias("windows"))
    order = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h")
    picked = some.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample_docs)
    return sorted((r["lang"], w) for r in picked.collect() for w in r["windows"] if any(map(str.isalpha, w)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, draws: int = DRAWS, steps: int = 300) -> BiGru | None:
    """The trained network, or None if no row can be learned from."""
    rows = training_windows(docs, id_col, text_col, lang_col, sample_docs, draws)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    place = {x: i for i, x in enumerate(labels)}
    return BiGru(labels).train([w.encode() for _, w in rows], np.array([place[lang] for lang, _ in rows]), steps)


def _asked(model: BiGru | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(languages, scores) of texts."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if model is not None and lettered:
        raw = [texts[i].lower().encode() for i in lettered]
        # in 1/65536, so that sums do not depend on the order in which windows were read
        share = np.rint(model.sums(raw) / np.array([[len(r)] for r in raw]) * 65536) / 65536
        for i, best, score in zip(lettered, share.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
            langs[i], scores[i] = model.labels[best], min(1.0, round(score, 4))
    return langs, scores


def predict(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""

    def run(batches):
        import pyarrow as pa

        claim_worker("language")
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                langs, scores = _asked(model, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        whole = batch = None
        give_back()

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col].alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id")).mapInArrow(run, out)


def keep_known(docs: DataFrame, model: BiGru | None, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows, with all columns, whose language is recognised with at least ``min_score``."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        claim_worker("language")
        for whole in batches:
            for batch in sliced(whole, whole.schema.names[at], SLICE):
                langs, scores = _asked(model, batch.column(at).to_pylist())
                yield batch.filter(pa.array([x != "und" and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))
        whole = batch = None
        give_back()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Train on the labelled rows of ``docs`` and predict all its rows."""
    return predict(docs, fit(docs, id_col, text_col, lang_col, **options), id_col, text_col)


def query(spark, sf_dir):
    from .common import table

    return identify(table(spark, sf_dir, "documents"))
