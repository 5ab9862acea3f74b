"""URL rules: a blocked Bloom filter of the listed keys, then an exact join of the possible hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import hot_join, stored
from textloom.operators.lookup import fits_broadcast

WORDS = 4
#: A block has 256 bits and is made for this many keys: of others it lets about one in a thousand through.
KEYS_A_BLOCK = 12
#: Blocks of a filter at most, 8 MB, for three million keys. Beyond that each block holds more keys and lets more rows through
#: to the exact join, which then is the way for all of them; the result is the same.
MAX_BLOCKS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty for null and for texts without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    found = F.coalesce(at > 0, F.lit(False))
    return F.when(found, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(found, path).otherwise("")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each word of the key's block."""
    bits = F.xxhash64(F.lit("bits"), key)

    def bit(i: int) -> Column:
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def blocks_for(keys: DataFrame) -> int:
    """How many blocks a filter of these keys has: a power of two from 64 on, by their number."""
    wanted = keys.limit(MAX_BLOCKS * KEYS_A_BLOCK).count() / KEYS_A_BLOCK
    blocks = 64
    while blocks < wanted:
        blocks *= 2
    return min(blocks, MAX_BLOCKS)


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row, ``filter``: the words of all blocks in order. Its size is ``blocks`` times 32 bytes."""
    if not 0 < blocks <= MAX_BLOCKS:
        raise ValueError(f"blocks must be from 1 to {MAX_BLOCKS}")
    marked = keys.select(_block(F.col(key), blocks).alias("block"), F.array(*_masks(F.col(key))).alias("mask"))
    filled = marked.groupBy("block").agg(*[F.bit_or(F.col("mask")[w]).alias(f"w{w}") for w in range(WORDS)])
    words = F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(WORDS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    rows = every.join(filled, "block", "left").select(F.struct("block", words.alias("words")).alias("b"))
    return rows.agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["words"]).alias("filter"))


def may_contain(words_of: Column, key: Column, blocks: int) -> Column:
    words = F.get(words_of, _block(key, blocks))
    sure = F.lit(True)
    for w, mask in enumerate(_masks(key)):
        sure = sure & (words[w].bitwiseAND(mask) == mask)
    return sure


def only_possible(rows: DataFrame, keys: DataFrame, key: str, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be among ``keys``, all that are and few others; and the rows that have none of them.

    Only the first part has to meet the keys in a join, so what moves follows the keys and not the rows. ``keys`` is
    counted, so it should be stored.
    """
    blocks = blocks or blocks_for(keys)
    known = keys.select(F.col(key).cast("string").alias("_key"))
    filtered = rows.withColumn("_filter", bloom_filter(known, "_key", blocks).scalar())
    may = F.coalesce(may_contain(F.col("_filter"), F.col(key).cast("string"), blocks), F.lit(False))
    return filtered.where(may).drop("_filter"), filtered.where(~may).drop("_filter")


def _rule_keys(rules: DataFrame) -> DataFrame:
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    keyed = rules.select(host.alias("_rule_host"), path.alias("_rule_path"), "verdict")
    # A rule that is listed twice counts once; blocking wins over allowing.
    return keyed.groupBy("_rule_host", "_rule_path").agg(F.max("verdict").alias("_verdict")).select(
        "*", F.concat("_rule_host", F.lit("\n"), "_rule_path").alias("_key")
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    blocks: int | None = None,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the path starts
    with the rule's; the longest rule wins, among equals the one with the longer host. Each distinct
    (host, path) offers one key per shape of the rules (labels of the host, length of the path). Keys
    that the filter lets through meet the rules in an exact join: broadcast if their size allows it, else by
    shuffle. Without a rule, ``rule`` is null and the verdict is ``default``.

    Null and malformed urls have empty host and path and no rule. Repeated pages give repeated rows.
    The shapes that occur in the list are one array: at most labels of a host times lengths of a path.
    """
    keyed = stored(_rule_keys(rules))
    blocks = blocks or blocks_for(keyed)
    labels, length = F.size(F.split("_rule_host", "\\.", -1)), F.length("_rule_path")
    shapes = keyed.agg(F.sort_array(F.collect_set(F.struct(labels.alias("labels"), length.alias("length")))).alias("shapes"))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    urls = rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n")).where("_host <> '' or _path <> ''")

    def offer(shape: Column) -> Column:
        suffix = F.array_join(F.slice("_parts", -shape["labels"], shape["labels"]), ".")
        return F.concat(suffix, F.lit("\n"), F.substring(F.col("_path"), F.lit(1), shape["length"]))

    fits = F.filter("_shapes", lambda s: (F.size("_parts") >= s["labels"]) & (F.length("_path") >= s["length"]))
    offers = F.transform(fits, offer)
    words = bloom_filter(keyed, "_key", blocks).scalar()
    possible = F.filter("_offers", lambda key: may_contain(F.col("_filter"), key, blocks))
    cut = urls.withColumns({"_parts": F.split("_host", "\\.", -1), "_shapes": shapes.scalar()}).withColumn("_offers", offers)
    hits = cut.withColumn("_filter", words).select("_host", "_path", "_n", F.explode(possible).alias("_key"))
    small = fits_broadcast(keyed)
    matched = hits.join(F.broadcast(keyed) if small else keyed, "_key")
    rule = F.concat("_rule_host", "_rule_path")
    ranked = F.struct(F.length(rule), F.length("_rule_host"), F.struct(rule.alias("rule"), "_verdict").alias("r"))
    best = matched.groupBy("_host", "_path").agg(F.max(ranked)["r"].alias("r"), F.max("_n").alias("_n"))
    found = stored(best.select("_host", "_path", "_n", F.col("r.rule").alias("_rule"), F.col("r._verdict")))
    joined = hot_join(rows, found, ["_host", "_path"], "_n", ["_rule", "_verdict"])
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"),
    )
