"""Tables as frames of other libraries, on the driver."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrix.errors import SparrixError

if TYPE_CHECKING:
    import pandas as pd

    from sparrix.core import MatrixTable


def wide(table: MatrixTable) -> DataFrame:
    """``id`` and a column for each sample, zeros filled in. Samples are columns, so they must be few."""
    samples = [r["id"] for r in table.ids("sample").collect()]
    pivoted = table.cells.groupBy(F.col("obs_id").alias("id")).pivot("samp_id", samples).agg(F.first("value"))
    joined = table.obs.select("id", "ord").join(pivoted, "id", "left").orderBy("ord").drop("ord")
    return joined.na.fill(0.0)


def to_pandas(table: MatrixTable, dense: bool = False) -> pd.DataFrame:
    """A pandas frame, observations down; sparse columns unless ``dense``."""
    import pandas as pd

    pdf = wide(table).toPandas().set_index("id").rename_axis(None)
    return pdf if dense else pdf.astype(pd.SparseDtype("float", 0.0))


def metadata_to_pandas(table: MatrixTable, axis: str) -> pd.DataFrame:
    return table.metadata_columns(axis).toPandas().set_index("id").rename_axis(None)


def to_anndata(table: MatrixTable, transpose: bool = True, dtype: str = "float32") -> Any:
    """An AnnData object of dense values, samples down if ``transpose``."""
    try:
        import anndata
    except ImportError as e:
        raise SparrixError("anndata is not installed") from e
    axes = {a: metadata_to_pandas(table, a) if table.has_metadata(a) else None for a in ("sample", "observation")}
    pdf = to_pandas(table, dense=True)
    if transpose:
        return anndata.AnnData(pdf.T.to_numpy(dtype), obs=axes["sample"], var=axes["observation"])
    return anndata.AnnData(pdf.to_numpy(dtype), obs=axes["observation"], var=axes["sample"])
