"""Small tables, and tables as plain Python values."""

import numpy as np

from sparrix.core import MatrixTable


def make(spark, rows, obs, samp, obs_md=None, samp_md=None, **props):
    from sparrix.core import Props

    return MatrixTable.from_data(spark, np.array(rows, float).reshape(len(obs), len(samp)), obs, samp, obs_md, samp_md, Props(**props) if props else None)


def ids(table, axis="sample"):
    return [r["id"] for r in table.ids(axis).collect()]


def dense(table):
    """The matrix in the order of its axes."""
    o, s = ids(table, "observation"), ids(table)
    out = np.zeros((len(o), len(s)))
    for r in table.cells.collect():
        out[o.index(r["obs_id"]), s.index(r["samp_id"])] += r["value"]
    return out.tolist()


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}
