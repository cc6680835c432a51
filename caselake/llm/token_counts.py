"""Token counts of the parts of a text, from one encoding of the whole.

A text is encoded once. Its tokens' byte spans are joined to the sections' spans, and a
token that crosses a border goes by an explicit rule: to the section where it starts, to the
one where it ends, or to each by its share of the token's bytes. The counts of a text's
sections always add up to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .tokens import VOCABULARY, encoder

RULES = ("start", "end", "share")
#: Texts whose sections a task gathers before it hands them on.
ROWS = 500


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section. `ends`: where tokens end; `borders`: where sections end; both in
    bytes from the same start to the same end, in order."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    if rule == "share":
        marks = np.unique(np.concatenate([ends, borders]))
        marks = marks[marks > 0]
        sizes = np.diff(marks, prepend=0)
        token = np.searchsorted(ends, marks, side="left")
        section = np.searchsorted(borders, marks, side="left")
        return np.bincount(section, sizes / (ends - starts)[token], minlength=len(borders))
    at = starts if rule == "start" else ends - 1
    return np.bincount(np.searchsorted(borders, at, side="right"), minlength=len(borders)).astype(float)


def section_ends(text: str, border: re.Pattern) -> list[int]:
    """Where sections end in characters: behind each match of `border`, and at the text's end."""
    ends = [m.end() for m in border.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def byte_ends(text: str, ends: Sequence[int]) -> np.ndarray:
    sizes = [len(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return np.cumsum(sizes)


def count_sections(docs: DataFrame, border: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: id, section (from 0), start and end (characters), n_tokens.

    Sections end behind each match of `border`. A null or empty text is one empty section
    without tokens. Rows that repeat an id are counted each by itself, those without one keep
    a null id; an empty table gives no rows, and other columns are left out.
    """

    schema = pa.schema([("id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cut = encoder(vocabulary), re.compile(border)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes, starts, stops, counts = [], [], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    ends = section_ends(text, cut)
                    counts.append(attribute(enc.byte_ends(enc.encode(text)), byte_ends(text, ends), rule))
                    stops.append(np.array(ends, dtype=np.int64))
                    starts.append(np.array([0, *ends[:-1]], dtype=np.int64))
                    sizes.append(len(ends))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                sections = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (sections, np.concatenate(starts), np.concatenate(stops), np.concatenate(counts)))], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(counted, "id long, section int, start long, end long, n_tokens double")
    return out.withColumnRenamed("id", id_col)


def count_fields(df: DataFrame, fields: Sequence[str], id_col: str, joiner: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row and field: id, field, n_tokens, for fields encoded as one text joined by `joiner`.

    The joiner belongs to the field before it. A null field is empty; the last one has no
    joiner. Ids keep their type. Rows that repeat an id are counted each by itself.
    """
    names = list(fields)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = []
            for row in zip(*batch.columns[1:], strict=True):
                texts = [(t.as_py() or "") + (joiner if k + 1 < len(names) else "") for k, t in enumerate(row)]
                borders = np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts])
                counts.append(attribute(enc.byte_ends(enc.encode("".join(texts))), borders, rule))
            flat = np.concatenate(counts) if counts else np.zeros(0)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(names))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names * batch.num_rows, type=pa.string()), pa.array(flat)], names=["id", "field", "n_tokens"])

    slim = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(names)])
    schema = StructType([StructField("id", slim.schema["id"].dataType), StructField("field", StringType()), StructField("n_tokens", DoubleType())])
    return slim.mapInArrow(counted, schema).withColumnRenamed("id", id_col)
