"""Language identification by compression.

Each language has a zstandard raw-content dictionary: the lowered letters of labelled documents, whole, with match tables as large as the dictionary, so all of it is
searched. A text is lowered too and cut into blocks of BLOCK bytes; every block is compressed with every language's dictionary, and the language with the smallest
sum wins. Each block carries the same tail, which always compresses: without it zstandard stores short blocks raw, and their sizes would say nothing. One
rule serves texts of any length. A narrow margin between the two smallest sums rejects the text; its best language is still told. Of equal sums, the language
with more labelled documents wins, then the name that comes first; such texts are rejected.

Training takes ``per_language`` documents of a language at most, chosen by a hash of doc_id, and of these, in that order, as many as have
``characters`` in all (if the first alone is longer, the shortest one): documented parameters, as a dictionary must fit in memory. Prediction reads whole texts, and nothing but texts.

Null texts and texts without a letter are ``und`` with score 0 and rejected. If nothing is labelled, every text is ``und``. Labels of null documents are
not learned from. Rows that repeat are each judged on their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import core

BLOCK = 1024
PER_LANGUAGE = 150
CHARACTERS = 4 << 20
#: A text is rejected if the second language needs less than this share more.
MARGIN = 0.003
UNKNOWN = "und"
TAIL = b" " * 48
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lowered words of letters, each after one space; only ASCII tells non-letters apart."""
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Classifier:
    """A dictionary of each language; languages with more documents come first."""

    def __init__(self, texts: dict[str, list[str]], counts: dict[str, int] | None = None):
        counts = counts or {name: len(own) for name, own in texts.items()}
        self.names = sorted(texts, key=lambda name: (-counts[name], name))
        self.raw = [b" ".join(letters(t) for t in texts[name]) or b" " * 64 for name in self.names]
        self._ready = None

    def __getstate__(self):
        return {"names": self.names, "raw": self.raw, "_ready": None}

    def _compressors(self):
        if self._ready is None:
            import zstandard as z

            self._ready = []
            for raw in self.raw:
                log = min(max(len(raw).bit_length(), 10), 26)
                # matches from three bytes on, which short words need
                options = z.ZstdCompressionParameters.from_level(1, dict_size=len(raw), min_match=3, strategy=z.STRATEGY_LAZY2, window_log=log, hash_log=log, chain_log=log, search_log=4, write_content_size=False, write_checksum=False)
                content = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(compression_params=options)
                self._ready.append(z.ZstdCompressor(dict_data=content, compression_params=options).compress)
        return self._ready

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text with each language's dictionary."""
        data = letters(text)
        blocks = [b" " + data[a : a + BLOCK] + TAIL for a in range(0, len(data), BLOCK)]
        return np.array([sum(len(c(b)) for b in blocks) for c in self._compressors()], float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is too narrow."""
        if not text or not self.names or not has_letter(text):
            return UNKNOWN, 0.0, True
        size = self.sizes(text)
        best = int(size.argmin())
        lead = size - size[best]
        score = float(1 / np.exp2(-np.minimum(lead, 60)).sum())
        second = np.partition(lead, 1)[1] if len(lead) > 1 else np.inf
        return self.names[best], score, bool(second <= MARGIN * size[best])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, characters: int = CHARACTERS) -> Classifier:
    """Learns from documents (doc_id, text, lang) that have a label and are not held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("at"), F.col("text").cast("string").alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Classifier({})
    # thinned by hash first, so that a language's list stays short
    room = 1 << 60
    least = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(room * min(1.0, 3 * per_language / n)))])
    order = Window.partitionBy("lang").orderBy("at", "size", "text")
    thin = rows.filter(F.pmod("at", F.lit(room)) < F.element_at(least, F.col("lang"))).withColumn("size", F.length("text"))
    ranked = thin.withColumn("n", F.row_number().over(order)).withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("short", F.row_number().over(Window.partitionBy("lang").orderBy("size", "at", "text")))
    kept = ranked.filter(((F.col("n") <= per_language) & (F.col("total") <= characters)) | (F.col("short") == 1)).select("lang", "at", "text")
    lists: dict[str, list[str]] = {}
    for lang, _, text in sorted((tuple(r) for r in kept.collect())):
        lists.setdefault(lang, []).append(text)
    return Classifier(lists, counts)


def predictions(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and rejected (with an underscore after it where ``keep`` has that name); only texts are looked at."""
    spark = docs.sparkSession
    core.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)  # one dictionary for each language, of ``characters`` at most
    columns = docs.select(*[F.col(f"`{c}`").alias(f"keep{k}") for k, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    added = [c + "_" * (c in keep) for c in ("lang_pred", "score", "rejected")]
    kinds = S.StructType([S.StructField(c, docs.schema[c].dataType) for c in keep] + [S.StructField(c, t) for c, t in zip(added, (S.StringType(), S.DoubleType(), S.BooleanType()), strict=True)])

    def run(batches):
        for batch in core.released(batches):
            found = [shared.value.predict(t) for t in batch["text"].to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, *added])

    return columns.mapInArrow(run, kinds)


def accepted(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is not rejected."""
    spark = docs.sparkSession
    core.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)
    at = docs.columns.index("text")

    def run(batches):
        for batch in core.released(batches):
            yield batch.filter(pa.array([not shared.value.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
