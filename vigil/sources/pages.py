"""Fetched bytes to text, with the encodings old boards use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which the Korean encodings are announced.
KOREAN = ["euc-kr", "euckr", "ks_c_5601-1987", "ksc5601"]


def decoded(body: Column, client_encoding: Column, content_type: Column) -> Column:
    """Text by the header's charset, else the client's (unless it is the default), else the page's own, else UTF-8."""

    @F.pandas_udf("string")
    def decode(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
        def one(raw, name):
            if raw is None:
                return None
            for codec in (name, "cp949", "utf-8"):
                try:
                    return bytes(raw).decode(codec)
                except (LookupError, UnicodeDecodeError):
                    continue
            return bytes(raw).decode("utf-8", errors="replace")

        return pd.Series([one(b, e) for b, e in zip(bodies, encodings)])

    some = lambda c: F.nullif(c, F.lit(""))
    header = some(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([a-zA-Z0-9_\-]+)", 1))
    client = F.when(~F.lower(client_encoding).isin("utf-8", "utf8", "ascii"), some(client_encoding))
    top = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    meta = some(F.regexp_extract(top, r"""(?i)charset\s*=\s*["']?\s*([a-zA-Z0-9_\-]+)""", 1))
    name = F.lower(F.coalesce(header, client, meta, F.lit("utf-8")))
    return decode(body, F.when(name.isin(KOREAN), "cp949").otherwise(name))


def client_ip(headers: Column, peer: Column) -> Column:
    """The first forwarded address, else the proxy's, else the peer's."""
    forwarded = F.nullif(F.trim(F.get(F.split(headers["x-forwarded-for"], ","), F.lit(0))), F.lit(""))
    return F.coalesce(forwarded, F.trim(F.nullif(headers["x-real-ip"], F.lit(""))), peer, F.lit("unknown"))
