import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def walk(n: int = 120, assets: int = 4, seed: int = 0) -> pd.DataFrame:
    """A wide frame of positive prices by date."""
    r = np.random.default_rng(seed).normal(0, 0.02, (n, assets))
    return pd.DataFrame(100 * np.exp(r.cumsum(0)), index=pd.date_range("2021-01-01", periods=n), columns=[f"A{k}" for k in range(assets)])


def panel(spark, wide: pd.DataFrame):
    rows = [(c, t.strftime("%Y-%m-%d"), k, None if pd.isna(v) else float(v)) for c in wide for k, (t, v) in enumerate(wide[c].items())]
    return spark.createDataFrame(rows, "asset string, ts string, pos long, price double").withColumn("ts", F.to_date("ts"))


def wide_of(df, value: str) -> pd.DataFrame:
    pdf = df.select("asset", "pos", value).toPandas()
    return pdf.pivot(index="pos", columns="asset", values=value).astype(float)


def same(got: pd.DataFrame, want: pd.DataFrame, tol: float = 1e-9) -> None:
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=tol, atol=tol)
