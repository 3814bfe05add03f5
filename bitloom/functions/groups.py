"""Work on whole groups of rows in Arrow, without touching what is not worked on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

_WHOLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}
_MADE = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def add_by_group(df: DataFrame, keys: list[str], reads: list[str], added: dict[str, str], work: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """df with the columns of ``added`` (name to type), which ``work`` gives for each group; one that df has already is replaced.

    work gets a frame of the columns in ``reads`` and gives a list or array per added column, in the frame's order. Whole
    numbers with nulls stay whole numbers, and columns that are not read pass by in Arrow: pandas would make floating
    point of a long column with a null, which changes numbers above 2 ** 53. A group is one task's: keys must bound it.
    """
    names = [f.name for f in df.schema.fields]
    fields = [StructField(f.name, _type(added[f.name])) if f.name in added else f for f in df.schema.fields]
    fields += [StructField(n, _type(t)) for n, t in added.items() if n not in names]

    def one(table: pa.Table) -> pa.Table:
        made = work(table.select(list(dict.fromkeys(reads))).to_pandas(types_mapper=_WHOLE.get))
        for name, kind in added.items():
            column = pa.array(made[name], type=_MADE[kind], from_pandas=True)
            table = table.set_column(names.index(name), name, column) if name in names else table.append_column(name, column)
        return table

    return df.groupBy(*keys).applyInArrow(one, StructType(fields))


def add_in_order(df: DataFrame, keys: list[str], order: str, reads: str, added: str, kind: str, start: Callable[[], Callable]) -> DataFrame:
    """df with a column that a pass over each group's rows in order gives; start() gives a function for one group, from a row's value of ``reads`` to what is added.

    Rows are sorted by Spark and gone through in Arrow batches of any number of groups, so that small groups cost no call each and large ones no memory.
    """
    names = [f.name for f in df.schema.fields]
    fields = [StructField(f.name, _type(kind)) if f.name == added else f for f in df.schema.fields]
    fields += [] if added in names else [StructField(added, _type(kind))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            out = []
            for key, value in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(reads).to_pylist(), strict=True):
                if step is None or not all(a == b or (a != a and b != b) for a, b in zip(key, last, strict=True)):
                    last, step = key, start()
                out.append(step(value))
            column, columns = pa.array(out, type=_MADE[kind]), list(batch.columns)
            if added in names:
                columns[names.index(added)] = column
            else:
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(walk, StructType(fields))


def _type(ddl: str):
    return StructType.fromDDL(f"x {ddl}").fields[0].dataType


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b the smallest node that each reaches: the larger of two linked labels takes the smaller, until all links agree."""
    label = np.arange(n)
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label != label[label]).any():
            label = label[label]
    return label
