"""Raw delimited records: a quote-aware tokenizer that sets damaged records aside with a reason.

The tokenizer is a finite-state machine over bytes. A record is cut into chunks of fixed length; every chunk first
runs from all states at once, which gives its transition (where each entry state leads) without knowing what came
before. Composing the transitions along a record gives every chunk's true entry state, and a second run from there
marks delimiters and quotes. All chunks of a batch advance together, one byte position at a time, so the work is
vectorised however long single records are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 128
# states: at the start of a field, in a bare field, inside quotes, just after a quote inside quotes, after the
# closing quote, broken
START, BARE, QUOTED, CLOSING, AFTER, BROKEN = range(6)
# classes of bytes
OTHER, QUOTE, DELIMITER, BLANK, PAD = range(5)


def transition_table() -> np.ndarray:
    """``table[state, class]``: the next state. Padding changes nothing; a broken record stays broken."""
    t = np.full((6, 5), BROKEN, np.uint8)
    t[:, PAD] = np.arange(6)
    t[START, [OTHER, QUOTE, DELIMITER, BLANK]] = BARE, QUOTED, START, START
    t[BARE, [OTHER, DELIMITER, BLANK]] = BARE, START, BARE
    t[QUOTED, [OTHER, QUOTE, DELIMITER, BLANK]] = QUOTED, CLOSING, QUOTED, QUOTED
    t[CLOSING, [QUOTE, DELIMITER, BLANK]] = QUOTED, START, AFTER
    t[AFTER, [DELIMITER, BLANK]] = START, AFTER
    return t


TABLE = transition_table()


def classify(data: np.ndarray, delimiter: np.ndarray) -> np.ndarray:
    """Classes of bytes; ``delimiter`` holds each byte's own delimiter. A tab is a blank where it doesn't delimit."""
    out = np.zeros(len(data), np.uint8)
    out[(data == 32) | (data == 9)] = BLANK
    out[data == 34] = QUOTE
    out[data == delimiter] = DELIMITER
    return out


def entry_states(classes: np.ndarray, chunk_record: np.ndarray) -> np.ndarray:
    """Entry state of every chunk (rows of ``classes``); ``chunk_record`` is non-decreasing, one record per value.

    Transitions compose by doubling: after k steps a chunk's map covers the 2**k chunks that end with it, so a record
    of n chunks needs log2(n) steps.
    """
    n = len(classes)
    maps = np.tile(np.arange(6, dtype=np.uint8), (n, 1))
    for at in range(classes.shape[1]):
        maps = TABLE[maps, classes[:, at][:, None]]
    reach, span = maps, 1
    first = np.searchsorted(chunk_record, chunk_record, "left")
    while span < n and (np.arange(n) - first >= span).any():
        here = np.nonzero(np.arange(n) - first >= span)[0]
        joined = reach.copy()
        joined[here] = np.take_along_axis(reach[here], reach[here - span].astype(np.int64), 1)
        reach, span = joined, span * 2
    entry = np.full(n, START, np.uint8)
    inner = np.nonzero(np.arange(n) > first)[0]
    entry[inner] = reach[inner - 1, START]
    return entry


@dataclass
class Tokens:
    """What a batch of records looks like: per record the number of fields and the offset of the first break (-1 if
    none), and for all bytes whether they are delimiters between fields."""

    n_fields: np.ndarray
    broken_at: np.ndarray
    delimiter_at: np.ndarray
    delimiter_record: np.ndarray


def tokenize(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, delimiter: np.ndarray, chunk: int = CHUNK) -> Tokens:
    """Run the machine over the records ``data[starts[i]:ends[i]]`` with one delimiter byte each."""
    n = len(starts)
    lengths = ends - starts
    chunks = np.maximum(1, -(-lengths // chunk))
    chunk_record = np.repeat(np.arange(n), chunks)
    within = np.arange(len(chunk_record)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    offset = starts[chunk_record] + within * chunk
    position = offset[:, None] + np.arange(chunk)[None, :]
    inside = position < ends[chunk_record][:, None]
    flat = np.minimum(position, max(len(data) - 1, 0))
    classes = np.full(position.shape, PAD, np.uint8)
    if len(data):
        byte = data[flat]
        classes[inside] = classify(byte[inside], np.broadcast_to(delimiter[chunk_record][:, None], position.shape)[inside])
    state = entry_states(classes, chunk_record)
    cuts = np.zeros(position.shape, bool)
    breaks = np.full(len(state), -1, np.int64)
    for at in range(chunk):
        after = TABLE[state, classes[:, at]]
        cuts[:, at] = (classes[:, at] == DELIMITER) & (after == START)
        fresh = (after == BROKEN) & (state != BROKEN)
        breaks[fresh] = within[fresh] * chunk + at
        state = after
    last = np.cumsum(chunks) - 1
    final = state[last]
    broken_at = np.full(n, np.iinfo(np.int64).max)
    hit = breaks >= 0
    np.minimum.at(broken_at, chunk_record[hit], breaks[hit])
    broken_at[(final == QUOTED)] = np.minimum(broken_at[final == QUOTED], lengths[final == QUOTED])
    broken_at[broken_at == np.iinfo(np.int64).max] = -1
    row, col = np.nonzero(cuts)
    record = chunk_record[row]
    return Tokens(np.bincount(record, minlength=n) + 1, broken_at, position[row, col], record)


#: Fixed value: a plain decimal number, exponents allowed.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def unquote(fields: pd.Series) -> pd.Series:
    """Field contents: blanks around and enclosing quotes dropped, doubled quotes undone."""
    bare = fields.str.strip(" \t")
    quoted = bare.str.startswith('"') & (bare.str.len() >= 2)
    inner = bare.where(~quoted, bare.str.slice(1, -1).str.replace('""', '"', regex=False))
    return inner


def _parse(batch: pd.DataFrame, columns: Sequence[str], checked: Sequence[int], low: float, high: float) -> pd.DataFrame:
    text = batch["raw"].fillna("")
    raw = [x.encode("utf-8", "surrogatepass") for x in text]
    raw = [x[:-1] if x.endswith(b"\n") else x for x in raw]
    raw = [x[:-1] if x.endswith(b"\r") else x for x in raw]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    starts = ends - np.array([len(x) for x in raw], np.int64)
    joined = b"".join(raw)
    delimiter = batch["delimiter"].map(ord).to_numpy(np.uint8)
    tokens = tokenize(np.frombuffer(joined, np.uint8), starts, ends, delimiter)
    reason = np.full(len(raw), None, object)
    at = np.full(len(raw), -1, np.int64)
    broken = tokens.broken_at >= 0
    reason[broken], at[broken] = "quoting", tokens.broken_at[broken]
    wide = ~broken & (tokens.n_fields != len(columns))
    reason[wide] = "columns"
    good = np.nonzero(~broken & ~wide)[0]
    out = pd.DataFrame({c: pd.Series([None] * len(raw), dtype=object) for c in columns})
    keep = np.isin(tokens.delimiter_record, good)
    inner = tokens.delimiter_at[keep].reshape(len(good), len(columns) - 1)
    left = np.concatenate([starts[good][:, None], inner + 1], 1)
    right = np.concatenate([inner, ends[good][:, None]], 1)
    for c, name in enumerate(columns):
        values = [joined[a:b].decode("utf-8", "replace") for a, b in zip(left[:, c].tolist(), right[:, c].tolist())]
        out.loc[good, name] = unquote(pd.Series(values, index=good, dtype=object)) if len(good) else None
    for c in checked:
        column = out.loc[good, columns[c]].astype(str).str.strip(" \t")
        plain = column.str.fullmatch(NUMBER)
        number = pd.to_numeric(column.where(plain), errors="coerce")
        bad = ~number.between(low, high).to_numpy()
        fail = good[bad]
        fail = fail[np.equal(reason[fail], None)]
        reason[fail] = "value"
        at[fail] = left[np.isin(good, fail), c] - starts[fail]
    out["reason"], out["at"] = reason, at
    return out


def parse_records(records: DataFrame, id_cols: Sequence[str], raw: str, delimiter, columns: Sequence[str], checked: Sequence[str], *, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Split raw records into fields, or say why not.

    ``records`` holds one record per row in column ``raw``; ``delimiter`` is a column expression of one character.
    The result has ``id_cols``, the fields named ``columns`` as text, ``reason`` (null for a good record) and ``at``
    (the 0-based byte offset within the record where it breaks; -1 for a wrong number of columns).

    The reason is the first that applies: ``quoting`` (a field has double quotes but isn't wholly enclosed in them
    with inner ones doubled; blanks around it are allowed), ``columns`` (another number of fields than ``columns``;
    null and empty records have one), ``value`` (a ``checked`` field isn't a plain decimal number from ``low`` to
    ``high``). Ends of lines belong to no field. Fields of a record set aside for ``quoting`` or ``columns`` are
    null. No shuffle: records are parsed where they are read. An empty table gives an empty result.
    """
    columns, places = list(columns), [list(columns).index(c) for c in checked]
    picked = records.select(*[F.col(f"`{c}`").alias(f"_id{i}") for i, c in enumerate(id_cols)], F.col(f"`{raw}`").cast("string").alias("raw"), delimiter.alias("delimiter"))
    keys = [f"_id{i}" for i in range(len(id_cols))]
    schema = picked.select(*keys).schema.simpleString()[len("struct<") : -1]
    inner = [f"_f{i}" for i in range(len(columns))]
    schema = ", ".join([f"{k} {picked.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} string" for c in inner] + ["reason string", "at long"])
    arrow_fields = [pa.field(c, pa.string()) for c in inner] + [pa.field("reason", pa.string()), pa.field("at", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parsed = _parse(pd.DataFrame({"raw": batch.column("raw").to_pandas(), "delimiter": batch.column("delimiter").to_pandas()}), inner, places, low, high)
            arrays = [batch.column(k) for k in keys] + [pa.array(parsed[f.name], type=f.type, from_pandas=True) for f in arrow_fields]
            yield pa.RecordBatch.from_arrays(arrays, names=keys + [f.name for f in arrow_fields])

    out = picked.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, id_cols)], *[F.col(i).alias(c) for i, c in zip(inner, columns)], "reason", "at")
