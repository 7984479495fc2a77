"""URL rules by a sort-merge range join.

A host is written with its labels reversed, each followed by a dot, so that a
host and its subdomains are one interval of keys: all that begin with the
rule's host. Pages and rules meet in range partitions of the key; within one,
a sorted sweep keeps a stack of the rules' hosts that are open at the present
key, which are nested. The paths of a host's rules are intervals too, nested
by a sweep of their own, so a page looks at few of them, however many there are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import own, table

#: Rules (host, path, verdict) of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How many keys are sampled for the partitions' bounds, for each partition; fixed, whatever the input.
KEYS_PER_PART = 64


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels in reverse order, each followed by a dot: a prefix of the keys of its subdomains."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Paths:
    """The rules of one host: their paths in order, each with the next one that it begins with."""

    def __init__(self) -> None:
        self.rules: dict[str, tuple[str, str]] = {}
        self.order: list[str] | None = None
        self.wider: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.rules or verdict == "block":  # of equal rules, block holds
            self.rules[path] = (rule, verdict)
        self.order = None

    def best(self, path: str) -> tuple[str, str] | None:
        """The rule of the longest path that ``path`` begins with.

        All that begin with a path follow it in order. So the last path up to
        this one is the wanted one, or lies within it.
        """
        if self.order is None:
            self.order, self.wider, open_ = sorted(self.rules), [], []
            for k, p in enumerate(self.order):
                while open_ and not p.startswith(self.order[open_[-1]]):
                    open_.pop()
                self.wider.append(open_[-1] if open_ else -1)
                open_.append(k)
        at = bisect_right(self.order, path) - 1
        while at >= 0 and not path.startswith(self.order[at]):
            at = self.wider[at]
        return self.rules[self.order[at]] if at >= 0 else None


class Sweep:
    """Hosts with rules that are open at the present key, the widest at the bottom."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Paths]] = []

    def to(self, key: str) -> None:
        """Leave the intervals that end before ``key``."""
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.to(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, Paths()))
        self.stack[-1][1].add(path, rule, verdict)

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits; of equally long ones that of the longer host."""
        self.to(key)
        found = None
        for _, paths in reversed(self.stack):
            hit = paths.best(path)
            if hit and (found is None or len(hit[0]) > len(found[0])):
                found = hit
        return found


def _bounds(points: DataFrame, parts: int) -> list[str]:
    """Sort keys that cut the pages into parts of like size, from a sample of fixed size by hash."""
    some = points.select("at").orderBy(F.xxhash64("at"), "at").limit(parts * KEYS_PER_PART).collect()
    keys = sorted(r["at"] for r in some)
    return sorted({keys[k * len(keys) // parts] for k in range(1, parts)}) if keys else []


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT
) -> DataFrame:
    """Rule and verdict for every page; one row per input row.

    ``rules`` has host, path and verdict (allow or block); null parts count as
    empty, a rule of an empty host fits every host. Columns of the result:
    page_id, host, path, rule (null if none fits), verdict (then ``default``).
    Null urls and urls without ``://`` have an empty host and path; repeated
    rows stay. Pages with one key are told apart by a hash, so they don't have
    to share a task; a rule goes to each part that its interval overlaps, which
    is the parts it has pages in. Empty tables give empty results.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = own(pages, page_id=id_col, url=url_col)
    kind = rows.schema["page_id"].dataType.simpleString()
    points = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    points = points.withColumn("key", host_key(F.col("host")))
    points = points.withColumn("at", F.concat("key", F.lit("\x01"), F.col("path"), F.lit("\x01"), F.hex(F.xxhash64("page_id"))))
    cuts = _bounds(points, parts)

    own_rules = own(rules, host="host", path="path", verdict="verdict").select(
        F.translate(F.coalesce("host", F.lit("")), _CAPITALS, _SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
    own_rules = own_rules.withColumn("key", host_key(F.col("host"))).withColumn("at", F.col("key"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array([bisect_right(cuts, at) for at in batch.column("at").to_pylist()], pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = bisect_right(cuts, row["key"])
                last = bisect_left(cuts, row["key"] + "\U0010ffff")
                wide = [row | {"part": part} for part in range(first, last + 1)]
                yield pa.RecordBatch.from_pylist(wide, schema=batch.schema.append(pa.field("part", pa.int32())))

    def schema_of(df: DataFrame) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", part int"

    left = points.mapInArrow(numbered, schema_of(points)).select("part", "at", F.lit(1).alias("kind"), "key", "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    right = own_rules.mapInArrow(spread, schema_of(own_rules)).select("part", "at", F.lit(0).alias("kind"), "key", F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict")
    events = left.unionByName(right).repartition(parts, "part").sortWithinPartitions("part", "at", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = Sweep(), None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("page_id", "host", "path", "rule", "verdict")}
            for at_part, is_page, key, page, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "key", "page_id", "host", "path", "verdict"))):
                if at_part != part:
                    now, part = Sweep(), at_part
                if not is_page:
                    now.open(key, path, host + path, verdict)
                    continue
                best = now.best(key, path)
                for c, v in zip(out, (page, host, path, best and best[0], best[1] if best else default)):
                    out[c].append(v)
            types = [batch.schema.field("page_id").type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return events.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
              ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') END AS raw_host,
         CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
              ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages
), h AS (
  SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT h.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.rhost OR h.host LIKE '%.' || r.rhost) AND starts_with(h.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
