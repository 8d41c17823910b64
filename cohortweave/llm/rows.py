"""Functions of texts over Arrow batches, which leave the other columns of a row as they are.

A nullable integer that passes through pandas becomes a float, and ids above 2**53 are then no longer what they were.
Here the kept columns stay Arrow arrays from end to end, and only texts become Python objects, a few MB at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Rows and bytes of text that a function gets at once, unless one text alone has more.
ROWS, BYTES = 512, 4 << 20
_TEXT = "__text"


def _type(name: str):
    import pyarrow as pa

    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.list_(plain[name[6:-1]]) if name.startswith("array<") else plain[name]


def slices(texts) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of at most ROWS rows and BYTES bytes of an Arrow array of texts."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(size):
        end = min(at + ROWS, max(at + 1, int(np.searchsorted(size, before + BYTES, "right"))))
        yield at, end
        at, before = end, int(size[end - 1])


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], tuple]], fields: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of docs, unchanged, and fields ("name type, ...") that a function gives for some texts at a time.

    make() is called once a task and returns that function: a list of texts, of which some may be None, to a tuple with
    a list or array for each field. Rows stay in order and number; nothing is shuffled.
    """
    made = [x.strip().rsplit(" ", 1) for x in fields.split(",")]
    some = docs.select(*keep, F.col(text).alias(_TEXT))
    kept = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{name} {kind}" for name, kind in made])

    def run(batches):
        import pyarrow as pa

        function = make()
        types = [_type(kind) for _, kind in made]
        for batch in batches:
            names = [*batch.schema.names[:-1], *(name for name, _ in made)]
            for a, b in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                values = function(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(v, t) for v, t in zip(values, types))], names=names)
        # the worker stays for later tasks; what Arrow has put by goes
        pa.default_memory_pool().release_unused()

    return some.mapInArrow(run, schema)
