"""URL filters: a blocked Bloom filter in front of an exact hash join.

A rule is a canonical host and path ("example.com", "/en/7"). A url's candidate keys are its domains of as many
labels as rules have, each with the prefixes of its path at the lengths that such rules have. A blocked Bloom
filter of the listed keys (one 256-bit block a key, eight bits in it) passes possible hits; only those are
joined to the list by hash, which removes false positives. The longest rule that fits gives the verdict.

The filter has a bounded size: a longer list makes it pass more, never too little. Pages that it rejects take no
part in any shuffle; the others are dealt out by row where the longest rule is picked, so a host that holds a third
of all pages is spread.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import common

#: Bits of filter a key, and the filter's size at most (bytes). Rules of up to BROADCAST_BYTES are sent to all tasks.
BITS_A_KEY, MOST_BYTES, BROADCAST_BYTES = 16, 16 << 20, 8 << 20
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)

#: The rules of op3: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def canonical(url) -> tuple:
    """(host, path) columns. The host lies between the first :// and the next /, ? or #, A-Z lower-cased; the path
    goes on up to ? or #. Both are empty for null and for a url without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def build_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """A blocked Bloom filter (blocks of eight 32-bit words) of keys (column h: hash), built in tasks and united."""
    blocks = 1 << max(0, min(MOST_BYTES // 32, -(-n_keys * BITS_A_KEY // 256)).bit_length() - 1)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            block, bits = _places(f["h"].to_numpy(), blocks)
            part = pd.DataFrame(bits.astype(np.int64), columns=[f"w{i}" for i in range(8)])
            part.insert(0, "block", block)
            yield part.groupby("block", as_index=False).agg(lambda x: int(np.bitwise_or.reduce(x.to_numpy())))

    words = [f"w{i}" for i in range(8)]
    parts = keys.select("h").mapInPandas(mark, "block bigint, " + ", ".join(f"{w} bigint" for w in words))
    out = np.zeros((blocks, 8), np.uint32)
    for row in parts.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).toLocalIterator():  # at most MOST_BYTES
        out[row["block"]] = [row[w] for w in words]
    return out


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and, for each of its eight words, the bit."""
    u = h.astype(np.int64).view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    return block, np.uint32(1) << ((u.astype(np.uint32)[:, None] * _SALTS) >> np.uint32(27))


def _keys(lengths: dict[int, list[int]], longest: int):
    """The candidate keys (host, path) of a row of host and path, as one column whose size doesn't follow the rules.

    lengths: for each number of labels that rules have, the path lengths of those rules, ascending; longest: characters
    of the longest listed host.
    """
    shapes = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in lengths.items()])), "array<struct<k:int,n:array<int>>>")  # one constant, however long
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1

    def of(shape):
        domain = F.call_function("substring_index", F.col("host"), F.lit("."), -shape["k"])
        some = F.filter(shape["n"], lambda n: (n <= F.length("path")) & (F.length(domain) <= longest))
        return F.transform(some, lambda n: F.struct(domain.alias("host"), F.call_function("substring", F.col("path"), F.lit(1), n).alias("path")))

    return F.flatten(F.transform(F.filter(shapes, lambda shape: shape["k"] <= labels), of))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (with a column url) with host, path, rule and verdict added; columns of those names are replaced.

    rules: verdict, host, path; repeated rules count once, of two verdicts for one host and path the least in
    order stays. A rule fits its host and all subdomains when the page's path starts with the rule's. The
    longest rule (host and path together, then host) gives the verdict, without one it is `default` and rule is
    null. Null urls and those without :// have an empty host and path. Repeated rows stay. Rules with nulls are
    left out. Pages may have columns of any other name. Pages that the filter passes are stored, with the number that
    brings a page's keys together again; only they are joined and shuffled, and for them pages is read a second time. A
    url costs in proportion to its labels and to the path lengths of rules that it reaches: only domains of as many labels
    and characters as rules have are looked at. The plan has one size for any list.
    """
    spark = pages.sparkSession
    rules = rules.select("verdict", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path").dropna()
    rules = common.saved(rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")), "url-rules")
    n, longest, size = rules.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("host")), F.lit(0)), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()
    lengths: dict[int, list[int]] = {}
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct()
    for r in shape.orderBy("labels", "length").toLocalIterator():  # as many as kinds of rules, not as rules
        lengths.setdefault(r.labels, []).append(r.length)
    bloom = spark.sparkContext.broadcast(build_filter(rules.select(F.xxhash64("host", "path").alias("h")), n))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, host, path and, for the hashes of the keys, the places of those that the filter passes."""
        for b in batches:
            hashes = b.column(3)
            block, bits = _places(hashes.flatten().to_numpy(), len(bloom.value))
            hit = np.flatnonzero(((bloom.value[block] & bits) == bits).all(axis=1))
            ends = hashes.offsets.to_numpy().astype(np.int64) - hashes.offsets[0].as_py()
            at = np.searchsorted(hit, ends)
            inside = hit - np.repeat(ends[:-1], np.diff(at))
            places = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(inside.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], places], names=["row", "host", "path", "at"])

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = canonical(F.col("url"))
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)  # pages' columns lie in one, no name can clash
    rows = pages.select(row.alias("row"), host.alias("host"), path.alias("path"))
    columns = [F.col("row." + f"`{c}`") for c in kept]
    if not lengths:
        return rows.select(*columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = _keys(lengths, longest)
    hashed = rows.withColumn("hashes", F.transform(keys, lambda k: F.xxhash64(k["host"], k["path"])))
    rows = hashed.mapInArrow(probe, StructType([*rows.schema.fields, StructField("at", ArrayType(IntegerType()))]))
    clean = rows.where("size(at) = 0").select(*columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    passed = common.saved(rows.where("size(at) > 0").withColumn("id", F.monotonically_increasing_id()), "passed-pages")  # stored, so that the ids stay
    asked = passed.select("id", "row", "host", "path", F.explode(F.transform("at", lambda i: F.get(keys, i))).alias("key"))
    exact = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    exact = F.broadcast(exact) if size <= BROADCAST_BYTES else exact
    joined = asked.join(exact, (F.col("key.host") == F.col("rule_host")) & (F.col("key.path") == F.col("rule_path")), "left")
    found = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("n_host"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = joined.groupBy("id").agg(F.any_value("row").alias("row"), F.any_value("host").alias("host"), F.any_value("path").alias("path"), F.max(F.when(F.col("rule_host").isNotNull(), found)).alias("best"))
    return clean.unionByName(best.select(*columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(common.read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE_SQL = {
    "op3_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(v, h, t) AS (VALUES """
    + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    + r"""),
f AS (SELECT page_id, arg_max(h || t, length(h) + length(t)) AS rule, arg_max(v, length(h) + length(t)) AS verdict FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN f USING (page_id)""",
}
