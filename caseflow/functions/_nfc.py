"""Unicode NFC normalisation as an Arrow-batched pandas UDF (the only Python function in the library).

Kept in its own module without postponed annotations: pandas UDF type hints
must be real types.
"""
import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("string")
def nfc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFC")
