"""Stratified samples under caps that reach across strata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_sample(rows: DataFrame, stratum: str, url: str, host: str, identity: str, seed: str, quotas: dict[str, int], host_cap: int = 2) -> DataFrame:
    """Strata in the order of ``quotas``; in each, pages in seeded digest order until its quota is full, skipping
    pages already taken and hosts with ``host_cap`` picks over all strata. Adds sample_id page-001, page-002, …

    What is taken in a stratum depends on the strata before it, so the last step is one
    pass; its input is pruned to a bound that does not depend on the data. At most
    ``host_cap`` identities of a host can be taken before and as many be taken now, so the
    first 2 * host_cap identities per stratum and host suffice; at most all quotas'
    sum of hosts can be blocked, each hiding that many rows, so the first
    quota + 2 * host_cap * sum of quotas rows of a stratum suffice.

    Defined results: null strata, urls and hosts are left out; equal digests keep the
    order of the least record id; strata without quota give nothing.
    """
    total = sum(quotas.values())
    per_host = 2 * host_cap
    depth = max(quotas.values(), default=0) + per_host * total
    usable = rows.where(F.col(stratum).isin(list(quotas)) & F.col(url).isNotNull() & F.col(host).isNotNull())
    keyed = usable.select(F.col(stratum).alias("stratum"), F.col(host).alias("host"), F.col(identity).alias("identity"), F.col(url).alias("url"), "record_id")
    keyed = keyed.withColumn("digest", F.sha2(F.concat_ws("|", F.lit(seed), "url"), 256))
    first = keyed.groupBy("stratum", "host", "identity").agg(F.min(F.struct("digest", "record_id", "url")).alias("f")).select("stratum", "host", "identity", "f.*")
    of_host = Window.partitionBy("stratum", "host").orderBy("digest", "record_id")
    near = first.withColumn("h", F.row_number().over(of_host)).where(F.col("h") <= per_host)
    of_stratum = Window.partitionBy("stratum").orderBy("digest", "record_id")
    near = near.withColumn("s", F.row_number().over(of_stratum)).where(F.col("s") <= depth).drop("h", "s")
    order = {name: i for i, name in enumerate(quotas)}

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(rank=pdf["stratum"].map(order)).sort_values(["rank", "digest", "record_id"])
        hosts: dict[str, int] = {}
        seen: set[str] = set()
        used: dict[str, int] = {}
        out = []
        for row in pdf.itertuples():
            if used.get(row.stratum, 0) >= quotas[row.stratum] or row.identity in seen or hosts.get(row.host, 0) >= host_cap:
                continue
            seen.add(row.identity)
            hosts[row.host] = hosts.get(row.host, 0) + 1
            used[row.stratum] = used.get(row.stratum, 0) + 1
            out.append((f"page-{len(out) + 1:03d}", row.stratum, row.host, row.url, row.record_id))
        return pd.DataFrame(out, columns=["sample_id", "stratum", "host", "url", "record_id"])

    schema = "sample_id string, stratum string, host string, url string, record_id bigint"
    return near.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: take(pdf), schema)
