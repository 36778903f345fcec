import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairweave.sources.raw_records import parse_records, tokenize

COLUMNS = ["a", "b", "c"]


def judged(line: str, sep: str) -> str | None:
    """One character at a time, by the definition."""
    line = line.removesuffix("\n").removesuffix("\r")
    fields, field, inside = [], "", False
    i = 0
    # a separator splits unless it stands inside quotes that opened at the start of the field
    while i < len(line):
        ch = line[i]
        if inside:
            if ch == '"' and line[i + 1 : i + 2] == '"':
                field += '""'
                i += 2
                continue
            if ch == '"':
                inside = False
            field += ch
        elif ch == sep:
            fields.append(field)
            field = ""
        else:
            if ch == '"' and not field.strip(" \t"):
                inside = True
            field += ch
        i += 1
    if inside:
        return "quoting"
    fields.append(field)
    for f in fields:
        if '"' in f:
            bare = f.strip(" \t" if sep != "\t" else " ")
            inner = bare[1:-1]
            if len(bare) < 2 or bare[0] != '"' or bare[-1] != '"' or inner.replace('""', "").count('"'):
                return "quoting"
    if len(fields) != len(COLUMNS):
        return "columns"
    value = fields[1].strip(" \t")
    if len(value) >= 2 and value[0] == '"':
        value = value[1:-1].replace('""', '"').strip(" \t")
    try:
        number = float(value)
    except ValueError:
        return "value"
    if any(x in value.lower() for x in ("n", "_")) or not 0 <= number <= 1:
        return "value"
    return None


def parsed(spark, lines: list[str | None], sep=","):
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(lines)], "id long, line string, reason string")
    return parse_records(df, ["id"], "line", F.lit(sep), COLUMNS, ["b"]).orderBy("id").collect()


def test_cases(spark):
    lines = ['x,0.5,z', '"x, 1",1,z', 'x,"0.5",z', ' "x" , 0.5 ,z\r', '"x""y",0,z', 'x"y,0.5,z', '"x"y,0.5,z', '"x,0.5,z', '""x",0.5,z', "x,0.5", "x,0.5,z,", "", None, "x,1.5,z", "x,,z", "x,nan,z", "x,1e-3,z", "x,0x1,z", "x,0,5,z", "x,0.5,z\n", "x,0.5,z\r\n"]
    got = [r["reason"] for r in parsed(spark, lines)]
    assert got == [None, None, None, None, None, "quoting", "quoting", "quoting", "quoting", "columns", "columns", "columns", "columns", "value", "value", "value", None, "value", "columns", None, None]
    rows = parsed(spark, ['"x""y", "0.5" ,z'])
    assert (rows[0]["a"], rows[0]["b"], rows[0]["c"]) == ('x"y', "0.5", "z")


def test_against_characters(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice(['"', '""', ",", " ", "x", "0.5", "\t", "é", ","]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    lines += ["x,0.5," + "y" * n for n in (125, 126, 127, 128, 129, 5000)] + ['"' + "y," * 300 + '",0.5,z', '"' + "y" * 1000]
    for sep in (",", "\t"):
        got = [r["reason"] for r in parsed(spark, lines, sep)]
        assert got == [judged(x, sep) for x in lines]


def test_offsets_and_long_records(spark):
    long = "x" * 700 + '"y,0.5,z'
    assert parsed(spark, [long])[0]["at"] == 700
    assert parsed(spark, ['"' + "x" * 300])[0]["at"] == 301


def test_empty_table(spark):
    assert parsed(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='"",a \t', max_size=40), min_size=1, max_size=8), st.integers(1, 9))
def test_chunks_do_not_matter(lines, chunk):
    raw = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    starts = ends - np.array([len(x) for x in raw], np.int64)
    data, comma = np.frombuffer(b"".join(raw), np.uint8), np.full(len(raw), ord(","), np.uint8)
    one, many = tokenize(data, starts, ends, comma, chunk), tokenize(data, starts, ends, comma, 64)
    assert (one.n_fields == many.n_fields).all() and (one.broken_at == many.broken_at).all()
    assert sorted(one.delimiter_at) == sorted(many.delimiter_at)


def test_fields_survive_a_round_trip(spark):
    values = ["a", "a,b", 'a"b', "", " a ", "é\tü"]
    lines = [",".join('"' + v.replace('"', '""') + '"' for v in (x, "0.5", y)) for x in values for y in values]
    got = parsed(spark, lines)
    assert [(r["a"], r["c"]) for r in got] == [(x, y) for x in values for y in values]
    assert pd.Series([r["reason"] for r in got]).isna().all()
