"""Extraction by any extractor, run in Arrow batches: its rows are checked against its schema, and what fails is reported, not lost."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Extractor = Callable[[str], Iterable[dict]]

# Units, and the properties that they are of.
UNITS = [("mAh/g", "capacity"), ("Wh/kg", "energy"), ("mg/cm2", "loading"), ("S/cm", "conductivity"), ("°C", "temperature"), ("V", "voltage"), ("%", "share")]
MEASURES = T.StructType([T.StructField("property", T.StringType(), False), T.StructField("value", T.DoubleType(), False), T.StructField("unit", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("subject", T.StringType())])
_NUMBER = re.compile(r"([0-9]+(?:\.[0-9]+)?)\s?(" + "|".join(re.escape(u) for u, _ in UNITS) + r")(?![A-Za-z0-9/])")
_SUBJECT = re.compile(r"(?:Li|Na)[A-Za-z0-9.]*[A-Z0-9][A-Za-z0-9.]*|NCM[0-9]{3}|LFP|LCO|[Gg]raphite")


def measures(text: str) -> Iterator[dict]:
    """The extractor that needs no model: numbers with a unit, and the material named last before them in the same sentence."""
    kinds = dict(UNITS)
    for m in _NUMBER.finditer(text):
        begins = max(text.rfind(x, 0, m.start()) for x in (". ", "\n", "; "))
        named = _SUBJECT.findall(text, begins + 1, m.start())
        yield {"property": kinds[m[2]], "value": float(m[1]), "unit": m[2], "start": m.start(), "subject": named[-1] if named else None}


def _checked(row: dict, schema: T.StructType) -> str | None:
    """What is wrong with a row, None if nothing is."""
    if not isinstance(row, dict):
        return f"not a row: {type(row).__name__}"
    if unknown := sorted(set(row) - set(schema.names)):
        return f"unknown fields: {', '.join(unknown)}"
    for f in schema.fields:
        value = row.get(f.name)
        if value is None:
            if not f.nullable:
                return f"{f.name} is missing"
            continue
        try:
            if isinstance(value, bool) and not isinstance(f.dataType, T.BooleanType):
                raise pa.ArrowInvalid
            pa.scalar(value, to_arrow_type(f.dataType))
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
            return f"{f.name} is no {f.dataType.simpleString()}: {value!r}"
    return None


def extracted(docs: DataFrame, extract: Extractor = measures, schema: T.StructType = MEASURES, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, n int (from 0, by order), the fields of ``schema``, error string: a row for each that ``extract`` gives of a text.

    A row that does not fit the schema has its error and null fields. An extractor that raises gives a row with what it raised
    behind those it gave before; other documents are not touched. Null texts give no rows. Every call sees one whole text, so ``extract`` may be a model's client."""
    kept = [c for c in docs.columns if c not in (text, "n", "error", *schema.names)]
    nullable = [T.StructField(f.name, f.dataType) for f in schema.fields]
    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n", T.IntegerType()), *nullable, T.StructField("error", T.StringType())])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, rows, errors = [], [], [], []

            def add(i: int, n: int, row: dict, error: str | None) -> None:
                at.append(i), numbers.append(n), rows.append({} if error else row), errors.append(error)

            for i, value in enumerate(batch.column(len(kept))):
                n = 0
                if value.is_valid:
                    try:
                        for row in extract(value.as_py()):
                            add(i, n, row, _checked(row, schema))
                            n += 1
                    except Exception as e:  # noqa: BLE001  whatever an extractor raises is that document's
                        add(i, n, {}, f"{type(e).__name__}: {e}")
            take = pa.array(at, pa.int64())
            columns = [*[batch.column(k).take(take) for k in range(len(kept))], pa.array(numbers, pa.int32())]
            columns += [pa.array([r.get(f.name) for r in rows], kind) for f, kind in zip(schema.fields, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], out.names)

    return docs.select(*kept, text).mapInArrow(run, out)
