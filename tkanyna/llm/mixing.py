"""Combining sources to target shares of tokens, by pivotal rounding of copy counts.

A source's share of the budget, over its own tokens, says how often each of its documents is wanted: a whole part, and
a fraction that is the chance of one copy more. Sources that the cap on repeats keeps below their share give all they
may, and the others take up what is missing in proportion to their targets. Fractions become 0 or 1 by pairing: of two
documents, mass moves at random until one of them is settled, so that a source's copies add up to what is wanted, to
less than one document. Documents meet in buckets, ordered by size so that pairs are alike; each bucket leaves at most
one unsettled document, and those meet again in a tree of buckets until one a source is left, settled by chance.

Null sources and sources without a target take no part, nor do documents without tokens (null and empty texts); a
target source without documents is reported with a share of 0. Chances come from hashes of ids and a seed, so the same
input gives the same mixture.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tkanyna.session import written

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern by which that vocabulary's tokenizer splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET = 20_000  # documents that are settled together
FAN_IN = 64
_ENCODERS: dict = {}


def encoder(path: str, pattern: str):
    """The tokenizer of a rank file, read once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, key: str, text: str, source: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, source, tokens) of every document with a source and a text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks, pattern).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({key: batch["row"], "source": batch["source"], "tokens": [len(encode(t)) for t in batch["text"].tolist()]})

    given = documents.select(F.col(key).alias("row"), F.col(source).alias("source"), F.col(text).alias("text")).filter("row is not null and source is not null and text is not null")
    return given.mapInPandas(count, f"{key} bigint, source string, tokens bigint")


def wanted_copies(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None) -> dict[str, float]:
    """How often a document of each source is wanted, at most its cap. budget: tokens; by default those there are."""
    there = {s: tokens.get(s, 0) for s in targets}
    left = float(sum(there.values()) if budget is None else budget)
    copies: dict[str, float] = {s: 0.0 for s in targets}
    free = {s for s in targets if there[s] > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    while free:
        total = sum(targets[s][0] for s in free)
        over = {s for s in free if left * targets[s][0] / total >= targets[s][1] * there[s]}
        if not over:
            for s in free:
                copies[s] = left * targets[s][0] / total / there[s]
            break
        for s in over:
            copies[s] = float(targets[s][1])
            left -= targets[s][1] * there[s]
        free -= over
    return copies


def chance(*of: object) -> float:
    return xxhash.xxh3_64_intdigest("|".join(map(str, of))) / 2**64


def settle(frame: pd.DataFrame, seed: int, held: dict) -> pd.DataFrame:
    """Pivotal rounding along the rows; held: the unsettled document of the bucket so far. Gives what is settled."""
    out = []
    for row in frame.itertuples(index=False):
        at = (row.source, row.bucket)
        if at != held.get("at"):
            if "doc" in held:
                out.append((*held["doc"], held["p"], False))
            held.clear()
            held["at"] = at
        doc, p = (row.doc, row.source, row.bucket, row.tokens, row.whole), row.p
        if p <= 0 or p >= 1:
            out.append((*doc, p, True))
            continue
        if "doc" not in held:
            held |= {"doc": doc, "p": p}
            continue
        one, q = held["doc"], held["p"]
        u = chance(seed, one[0], doc[0])
        if p + q < 1:
            winner = u * (p + q) < q
            lost, kept = (doc, one) if winner else (one, doc)
            out.append((*lost, 0.0, True))
            rest = p + q
        else:
            winner = u * (2 - p - q) < 1 - p
            won, kept = (one, doc) if winner else (doc, one)
            out.append((*won, 1.0, True))
            rest = p + q - 1
        if rest < 1e-12 or rest > 1 - 1e-12:
            out.append((*kept, float(round(rest)), True))
            held.pop("doc")
        else:
            held |= {"doc": kept, "p": rest}
    return pd.DataFrame(out, columns=["doc", "source", "bucket", "tokens", "whole", "p", "settled"])


ROWS = "doc bigint, source string, bucket bigint, tokens bigint, whole int, p double, settled boolean"


def _level(rows: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            yield settle(batch, seed, held)
        if "doc" in held:
            yield pd.DataFrame([(*held["doc"], held["p"], False)], columns=["doc", "source", "bucket", "tokens", "whole", "p", "settled"])

    return rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "tokens", "doc").mapInPandas(run, ROWS)


def mixture(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, budget: float | None = None, seed: int = 42, ranks: str = RANKS, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, tokens, copies; documents taken at least once), and the report by source."""
    spark = documents.sparkSession
    sized = written(token_counts(documents, key, text, source, ranks, pattern))
    aims = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.filter("source is not null").collect()}
    listed = spark.createDataFrame([(s, *v) for s, v in aims.items()], "source string, target_share double, max_repeats int")
    own = sized.filter("tokens > 0").join(F.broadcast(listed.select("source")), "source", "left_semi")
    totals = {r.source: (r.tokens, r.docs) for r in own.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    copies = wanted_copies({s: t for s, (t, _) in totals.items()}, aims, budget)
    plan = spark.createDataFrame([(s, int(math.floor(c + 1e-12)), max(0.0, c - math.floor(c + 1e-12)), max(1, -(-totals.get(s, (0, 0))[1] // BUCKET))) for s, c in copies.items()], "source string, whole int, p double, buckets int")
    rows = own.join(F.broadcast(plan), "source").withColumn("bucket", F.pmod(F.xxhash64(key, F.lit(seed)), F.col("buckets")).cast("bigint"))
    rows = rows.select(F.col(key).alias("doc"), "source", "bucket", "tokens", "whole", "p")
    done, most = None, max([b for _, _, _, b in plan.collect()], default=1)
    while True:
        level = written(_level(rows, seed))
        part = level.filter("settled")
        done = part if done is None else done.unionByName(part)
        open_ = level.filter(~F.col("settled")).drop("settled")
        if most <= 1:
            done = done.unionByName(open_.withColumn("p", (F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 30)) < F.col("p") * (1 << 30)).cast("double")).withColumn("settled", F.lit(True)))
            break
        most = -(-most // FAN_IN)
        rows = open_.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    mixed = done.select(F.col("doc").alias(key), "source", "tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")).filter("copies > 0")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.sum("copies").alias("copies"), F.max("copies").alias("repeats_used"))
    there = own.groupBy("source").agg(F.sum("tokens").alias("tokens_there"), F.count(F.lit(1)).alias("docs"))
    total = got.agg(F.sum("tokens_used").alias("total"))
    report = (
        listed.join(there, "source", "left")
        .join(got, "source", "left")
        .join(F.broadcast(total), how="left")
        .select(
            "source", "target_share", F.coalesce(F.col("tokens_used") / F.col("total"), F.lit(0.0)).alias("share_reached"), "max_repeats", F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"),
            F.coalesce(F.col("copies") / F.col("docs"), F.lit(0.0)).alias("mean_repeats"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens_there", F.lit(0)).alias("tokens_there"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        )
    )
    return mixed, report
