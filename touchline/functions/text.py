"""Text as columns: cleaning, keys and names.  All of it stays in the JVM but for ``decode``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they are without accents.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēėęěğīįıłńňōőřśšşťţūůűųźžż"
UNACCENTED = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeegiiilnnoorsssttuuuuzzz"


def cleaned(x: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.trim(x), F.lit(""))


def name_key(x: Column) -> Column:
    """Lower case, without accents, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(x), ACCENTED, UNACCENTED), "[^a-z0-9]+", "")


def last_number(x: Column) -> Column:
    """The last white-space separated token as a number, or null: ``Regular Season - 7`` gives 7."""
    return F.element_at(F.split(F.trim(x), r"\s+"), -1).try_cast("int")


def season_label(year: Column) -> Column:
    """2023 gives 2023/24; years before 2010 are not padded."""
    return F.concat(year.cast("string"), F.lit("/"), (year + 1 - 2000).cast("string"))


def code_year(code: Column) -> Column:
    """The first year of a season code: 2324 gives 2023."""
    return (F.substring(code, 1, 2).try_cast("int") + 2000).cast("int")


def season_code(year: Column) -> Column:
    return F.concat(F.lpad((year % 100).cast("string"), 2, "0"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def fixture_key(home: Column, away: Column) -> Column:
    return F.concat_ws(" vs ", home, away)


FORCED = r"^([^:]+):([^:]+):(\d+)-(\d+)$"


def forced_result(x: Column) -> Column:
    """``home:away:2-1`` as a struct, or null for any other text."""
    part = lambda i: F.regexp_extract(x, FORCED, i)
    return F.when(x.rlike(FORCED), F.struct(F.trim(part(1)).alias("home"), F.trim(part(2)).alias("away"), part(3).try_cast("int").alias("home_goals"), part(4).try_cast("int").alias("away_goals")))


def code_of(x: Column) -> Column:
    """A code from a name: upper case, blanks to underscores, 50 characters at most."""
    return F.substring(F.replace(F.upper(x), F.lit(" "), F.lit("_")), 1, 50)


def feature_hash(values: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of a map's JSON, keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(values)))
    return F.substring(F.sha1(F.to_json(ordered).cast("binary")), 1, 16)


def body_tag(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def decoded(data: bytes) -> str:
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda data: None if data is None else decoded(data))


def decode(raw: Column) -> Column:
    """Bytes of unknown encoding as text: UTF-8 (with or without a mark), then Windows-1252, then Latin-1."""
    return F.pandas_udf(_decode, "string")(raw)
