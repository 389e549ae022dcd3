"""Language identification by compression.

Every language has a raw-content dictionary for zstandard, made of excerpts of labelled texts. A text is encoded with each of
them and belongs to the language whose dictionary leaves the fewest bytes; it is rejected when the runner-up is nearly as small.
Texts are encoded in pieces of ``PIECE`` bytes, each afresh: within one long frame a text would soon match itself rather than
the dictionary. Dictionaries come from a bounded sample; everything else is a map over whole texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import stored

SAMPLE_ROWS = 256  # labelled texts that a language's dictionary is made of, at most; equal texts count once
SAMPLE_CHARS = 2000  # characters of each of them, from a place that a hash of the text chooses
DICTIONARY_BYTES = 1 << 16
MOST_LANGUAGES = 512  # more different labels are an error, so that all dictionaries together stay below 32 MB
PIECE = 2048
UNDETERMINED = "und"
ROUND = 64  # rows that are identified at a time
_TOLD = "struct<nearest:string,margin:double,accepted:boolean>"


def _settings() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False)


def _normal(text: str) -> str:
    return text.lower()


@dataclass
class Model:
    """Languages, most learned rows first (then by name), each with its dictionary. ``min_margin``: the runner-up has to be larger by this share."""

    dictionaries: list[tuple[str, bytes]]
    min_margin: float = 0.01

    def encoders(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out, settings = [], _settings()
        for name, content in self.dictionaries:
            if len(content) < 8:  # nothing to refer to
                out.append((name, zstandard.ZstdCompressor(compression_params=settings)))
                continue
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=settings)
            out.append((name, zstandard.ZstdCompressor(dict_data=data, compression_params=settings)))
        return out

    def identify(self, encoders: list, text: str | None) -> tuple[str | None, float, bool]:
        """Nearest language, share by which the runner-up is larger, and whether that suffices; no language without a letter."""
        if text is None or not encoders or not any(map(str.isalpha, text)):
            return None, 0.0, False
        data = _normal(text).encode("utf-8", "surrogatepass")
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(e.compress(p)) for p in pieces) for _, e in encoders]
        best = sizes.index(min(sizes))  # ties go to the language with more learned rows
        margin = 1.0 - sizes[best] / min(sizes[:best] + sizes[best + 1:]) if len(sizes) > 1 else 1.0
        return encoders[best][0], margin, margin >= self.min_margin


def dictionary(excerpts: list[str], elsewhere: set[str]) -> bytes:
    """Lines of the excerpts, each once, without those that excerpts of other languages hold, too; cut at ``DICTIONARY_BYTES``."""
    seen: dict[str, None] = {}
    for text in excerpts:
        seen.update((line, None) for line in _lines(text) if line not in elsewhere)
    return "\n".join(seen).encode("utf-8", "surrogatepass")[:DICTIONARY_BYTES]


def _lines(text: str) -> list[str]:
    return [line for line in map(str.strip, _normal(text).split("\n")) if line]


def fit(samples: dict[str, list[str]], rows: dict[str, int]) -> Model:
    """Makes the dictionaries from excerpts by language; ``rows`` says how many labelled rows a language has."""
    owners: dict[str, set[str]] = {}
    for lang, texts in samples.items():
        for line in {x for t in texts for x in _lines(t)}:
            owners.setdefault(line, set()).add(lang)
    shared = {line for line, langs in owners.items() if len(langs) > 1}
    order = sorted(samples, key=lambda lang: (-rows[lang], lang))
    return Model([(lang, dictionary(samples[lang], shared)) for lang in order])


def train(docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang") -> Model:
    """Learns from the rows where ``learn`` holds and neither text nor language is null.

    At most ``SAMPLE_ROWS`` excerpts a language come to the driver, chosen by a hash of the text; a language with a third of all rows
    is cut to them in each task first. Tables without such rows give a model that knows no language.
    """
    labelled = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text, F.lit(13)).alias("h"))
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different languages")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = stored(labelled.select("lang", "h").distinct().withColumn("place", place).filter(F.col("place") <= SAMPLE_ROWS), "language-sample")
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    excerpt = F.substring(F.col("text"), (F.pmod("h", room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    excerpts = labelled.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "place").agg(F.min(excerpt).alias("text"))
    samples: dict[str, list[str]] = {name: [] for name in rows}
    for r in sorted(excerpts.collect(), key=lambda r: (r["lang"], r["place"])):
        samples[r["lang"]].append(r["text"])
    return fit(samples, rows)


def identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the struct ``_language``: ``nearest`` language, ``margin`` (0 to 1) and ``accepted``.

    Null texts and texts without a letter have no nearest language, margin 0 and are not accepted; so has every text if the model knows
    no language. With one known language the margin is 1. Equal sizes go to the language with more learned rows, then to the lesser
    name. A column called ``_language`` is replaced. Whole texts are encoded, however long; repeated rows get equal answers.
    """
    kept = docs.drop("_language")
    names, place = kept.columns, kept.columns.index(text)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES * DICTIONARY_BYTES at most
    kind = pa.struct([("nearest", pa.string()), ("margin", pa.float64()), ("accepted", pa.bool_())])

    def apply(batches):
        encoders = broadcast.value.encoders()
        for batch in batches:
            for i in range(0, batch.num_rows, ROUND):
                part = batch.slice(i, ROUND)
                found = [broadcast.value.identify(encoders, t.as_py()) for t in part.column(place)]
                told = pa.array([dict(zip(("nearest", "margin", "accepted"), f)) for f in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, told], [*names, "_language"])

    return kept.mapInArrow(apply, kept.select("*", F.lit(None).cast(_TOLD).alias("_language")).schema)
