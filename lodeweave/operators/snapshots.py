"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeweave.session import small


def delivery_links(rounds: DataFrame, scope: str, number: str) -> DataFrame:
    """Each delivery with the one before and after it in its scope."""
    w = Window.partitionBy(scope).orderBy(number)
    return rounds.withColumns({"_prev": F.lag(number).over(w), "_next": F.lead(number).over(w)})


def _merge(values: list[str], scope: str, key: str):
    """The merge over one sorted range: two pointers walk over neighbouring rows of a key.

    Batches are handled as arrays; the last row of a batch is carried into the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: pd.DataFrame | None = None

        def emit(rows: pd.DataFrame, closed: bool) -> pd.DataFrame:
            """Changes at the borders between neighbours; ``closed`` ends the last row's key too."""
            nxt = rows.shift(-1)
            same = (rows[scope] == nxt[scope]) & (rows[key] == nxt[key])
            adjacent = same & (nxt["_prev"] == rows["_no"])
            differ = pd.Series(False, index=rows.index)
            for v in values:
                both_null = rows[v].isna() & nxt[v].isna()
                differ |= ~((rows[v] == nxt[v]) | both_null)
            last = pd.Series(False, index=rows.index)
            last.iloc[-1] = not closed
            gone = ~adjacent & ~last & rows["_next"].notna()
            came = same & ~adjacent
            changed = adjacent & differ
            out = [
                pd.DataFrame({scope: rows[scope][gone], "_no": rows["_next"][gone], key: rows[key][gone], "change": "removed"}),
                pd.DataFrame({scope: rows[scope][came], "_no": nxt["_no"][came], key: rows[key][came], "change": "added"}),
                pd.DataFrame({scope: rows[scope][changed], "_no": nxt["_no"][changed], key: rows[key][changed], "change": "changed"}),
            ]
            fresh = ~same & ~last & nxt["_prev"].notna()
            fresh.iloc[-1] = False
            out.append(pd.DataFrame({scope: nxt[scope][fresh], "_no": nxt["_no"][fresh], key: nxt[key][fresh], "change": "added"}))
            return pd.concat(out).astype({"_no": "int64"})

        for batch in batches:
            if not len(batch):
                continue
            if carry is None:
                first = batch.iloc[:1]
                if first["_prev"].notna().iloc[0]:
                    yield pd.DataFrame({scope: first[scope], "_no": first["_no"].astype("int64"), key: first[key], "change": "added"})
                rows = batch
            else:
                rows = pd.concat([carry, batch], ignore_index=True)
            yield emit(rows.reset_index(drop=True), False)
            carry = rows.iloc[-1:]
        if carry is not None:
            yield emit(carry.reset_index(drop=True), True)

    return run


def snapshot_changes(rows: DataFrame, *, scope: str, number: str, key: str, values: list[str]) -> DataFrame:
    """(scope, number, key, change) of every key that differs from the delivery before.

    ``rows`` holds one row per scope, delivery and key, with ``_prev`` and ``_next``, the
    neighbouring deliveries (see :func:`delivery_links`). The deliveries are brought into
    key ranges and sorted by key and delivery, so that each delivery and the one before
    it run side by side; two pointers stream over each range with one row in hand. A key
    lies in one range, and a range holds many keys of a large scope, so a scope of any
    size is spread over the ranges.

    change is added, removed (number is the delivery it is missing from) or changed (any of
    ``values`` differs; null equals null). Rows with a null scope, number or key are left
    out. The first delivery of a scope has no changes."""
    schema = T.StructType(
        [T.StructField(scope, T.StringType()), T.StructField("_no", T.LongType()), T.StructField(key, T.StringType()), T.StructField("change", T.StringType())]
    )
    kept = rows.select(F.col(scope), F.col(key), F.col(number).cast("double").alias("_no"), F.col("_prev").cast("double").alias("_prev"), F.col("_next").cast("double").alias("_next"), *values).where(
        F.col(scope).isNotNull() & F.col(key).isNotNull() & F.col("_no").isNotNull()
    )
    ranged = kept.repartitionByRange(F.col(scope), F.col(key)).sortWithinPartitions(scope, key, "_no")
    out = ranged.mapInPandas(_merge(values, scope, key), schema)
    return out.select(scope, F.col("_no").cast("int").alias(number), key, "change")


def price_changes(pages: DataFrame, extractions: DataFrame, rounds: DataFrame) -> DataFrame:
    """(domain, round_no, url, change) of prices between the rounds of each domain.

    A url is present in a round if it was fetched there with status 200; its price is that
    of the extraction of highest id of the latest such fetch (fetched_at, then id). A fetch
    without extraction has a null price. Fetches outside every round and rows with a null
    url or domain are left out; repeated fetches and repeated rows count once."""
    links = delivery_links(rounds.select("domain", F.col("round_no").alias("round_no"), "opened_at", "closed_at").where("domain is not null and round_no is not null"), "domain", "round_no")
    ok = pages.where("http_status = 200 and url is not null and domain is not null").select("domain", "url", F.col("id").alias("_sid"), "fetched_at")
    placed = ok.join(small(links), "domain").where("fetched_at >= opened_at and fetched_at < closed_at")
    latest = placed.groupBy("domain", "url", "round_no").agg(F.max(F.struct("fetched_at", "_sid")).alias("_last"), F.max("_prev").alias("_prev"), F.max("_next").alias("_next"))
    latest = latest.select("domain", "url", "round_no", "_prev", "_next", F.col("_last._sid").alias("_sid"))
    valid = extractions.where("snapshot_id is not null and id is not null").groupBy(F.col("snapshot_id").alias("_sid")).agg(F.max(F.struct("id", F.col("gia.kind").alias("kind"), F.col("gia.amount").alias("amount"))).alias("_e"))
    priced = latest.join(valid, "_sid", "left").select("domain", "url", "round_no", "_prev", "_next", F.col("_e.kind").alias("_kind"), F.col("_e.amount").alias("_amount"))
    return snapshot_changes(priced, scope="domain", number="round_no", key="url", values=["_kind", "_amount"])
