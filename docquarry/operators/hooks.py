"""A user's own model within a plan: scores of documents by batches, checked against a declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Model = Callable[[pd.DataFrame], pd.DataFrame]


def scored(df: DataFrame, load: Callable[[], Model], inputs: Sequence[str], outputs: str | T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of ``df`` and what the model says of each row.

    ``load`` runs once in each task (a model is loaded where it is used, not shipped); what it returns is called with a
    batch of the ``inputs`` and gives a row for each, with the columns of ``outputs`` and no others, convertible to
    their types. Anything else is an error that names the column. Batches are Arrow's; rows keep their order."""
    kinds = T._parse_datatype_string(outputs) if isinstance(outputs, str) else outputs
    clash = sorted({f.name.lower() for f in kinds} & {c.lower() for c in keep})
    missing = [c for c in [*inputs, *keep] if c not in df.columns]
    if clash or missing:
        raise ValueError(f"columns {clash} are kept and scored" if clash else f"columns {missing} are not there")
    names, wanted = [f.name for f in kinds], list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or load()
            out = model(batch[list(inputs)].copy())
            if not isinstance(out, pd.DataFrame) or len(out) != len(batch):
                raise ValueError(f"the model gave {len(out) if hasattr(out, '__len__') else type(out).__name__} rows for {len(batch)}")
            if sorted(out.columns) != sorted(names):
                raise ValueError(f"the model gave the columns {sorted(map(str, out.columns))}, not {sorted(names)}")
            whole = [f.name for f in kinds if isinstance(f.dataType, T.NumericType)]
            for c in whole:
                try:
                    pd.to_numeric(out[c])
                except (TypeError, ValueError) as e:
                    raise ValueError(f"column {c} of the model holds no numbers: {e}") from None
            yield pd.concat([batch[wanted].reset_index(drop=True), out[names].reset_index(drop=True)], axis=1)

    schema = T.StructType([*(df.schema[c] for c in keep), *kinds])
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)
