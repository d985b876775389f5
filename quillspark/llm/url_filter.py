"""URL rules by host and path: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import hot_join, saved

#: A block is one 64-bit word; a key sets up to KEY_BITS bits of its block; a listed key gets BITS_PER_KEY bits of filter.
KEY_BITS, BITS_PER_KEY = 4, 16
#: Most rules whose filter is sent to every executor (some 10 bytes each), and whose exact keys are (some 100 bytes each).
SENT_FILTER, SENT_RULES = 4_000_000, 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``; ``verdict`` is allow or block."""

    host: str
    path: str
    verdict: str


def rules_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """Rules as a table (host, path, verdict); a long list is read from storage in this form instead."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    listed = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules])
    return spark.range(1).select(F.inline(listed))


def _after_scheme(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + F.lit(3), F.length(url))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if the URL has no ``://``."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _key(host: Column, path: Column) -> Column:
    """Canonical key of a listed URL prefix: a host has no slash, so the first one parts it from the path."""
    return F.concat(host, F.lit("\n"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Bits that a key sets in its block, from six bits of a second hash each."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(KEY_BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (block, word) of its blocks that aren't empty."""
    key = _key(F.col("host"), F.col("path"))
    return rules.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(key)).alias("word"))


def apply_url_rules(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", sent_rules: int = SENT_RULES, sent_filter: int = SENT_FILTER) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``, by the longest rule that fits each URL.

    Candidate keys of a URL are its host's domain suffixes, each with every prefix of its path of a length that some
    rule has. Those that the blocked Bloom filter passes go to a hash join on the exact (host, path), which removes
    false positives. The filter is a table of blocks, met by block: up to ``sent_filter`` rules it is sent to all tasks
    (some 10 bytes a rule), so only what it passes is shuffled to meet more than ``sent_rules`` exact keys (some 100 bytes
    each). Beyond its own bound it is dealt by block too; hot blocks and keys, such as that of ``com``, are split. The steps
    and results are the same. Only distinct (host, path) go through all this; the pages meet the
    outcome once. The longest rule is the one with most characters in host and path; at a tie the longer host.

    Null URLs and URLs without ``://`` have empty host and path, so no rule with a host fits: ``rule`` null, verdict
    ``otherwise``. Empty pages give no rows; an empty rule table leaves all to ``otherwise``; repeated rows stay
    repeated. Of repeated rules one counts, ``block`` before ``allow``. Columns of ``pages`` with the names of the
    new ones are replaced.
    """
    rules = saved(rules.select("host", "path", "verdict").filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    known = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    base = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    if not known["n"]:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    blocks = max(1, -(-known["n"] * BITS_PER_KEY // 64))
    depth = F.least(F.size(F.split("host", r"\.")), F.lit(known["labels"]))
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    lengths = F.filter(F.lit(sorted(known["lengths"])), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring("path", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    urls = base.select("host", "path").distinct()
    tried = urls.select("host", "path", F.explode(pairs).alias("c")).select("host", "path", "c.h", "c.p", _block(_key(F.col("c.h"), F.col("c.p")), blocks).alias("block"))
    words, exact = bloom_blocks(rules, blocks), rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")

    def meet(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
        return left.join(F.broadcast(right), keys) if known["n"] <= most else hot_join(saved(left), right, keys)

    mask = _mask(_key(F.col("h"), F.col("p")))
    passed = meet(tried, words, ["block"], sent_filter).filter(F.col("word").bitwiseAND(mask) == mask).select("host", "path", "h", "p")
    fits = F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("hn"), F.concat("h", "p").alias("rule"), F.col("verdict").alias("verdict"))
    best = meet(passed, exact, ["h", "p"], sent_rules).groupBy("host", "path").agg(F.max(fits).alias("__best"))
    joined = base.join(best, ["host", "path"], "left")
    return joined.select(*[c for c in base.columns], F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(otherwise)).alias("verdict"))
