"""Main text of web pages, by wrappers inferred for each host."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import as_bytes, fresh, map_text, small_batches
from .storage import written
from .wrappers import CONSTANT_PAGES, CONSTANT_SHARE, Layout, extract, page_blocks, text_keys

#: Nodes, paths and constants of layouts that a task holds before it hands them on.
HELD_NODES = 500_000
#: Hosts up to which their numbers of pages are broadcast.
BROADCAST_HOSTS = 100_000
#: Characters of all wrappers up to which they are broadcast.
BROADCAST_CHARS = 32 << 20
#: Parts into which each host's pages are dealt if they aren't.
SALTS = 64


def host_of(url: Column) -> Column:
    """The host in lower case without www. and port; "" if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))), r"^www\.", "")


def page_reports(pages: DataFrame) -> DataFrame:
    """One reading of all whole pages (host, html): for each page a row with its hash and
    the keys of its texts, and for each host in each task rows with the layout of its
    pages there. No page moves; layouts are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[str, Layout] = {}
        held = 0

        def handed_on():
            names = list(layouts)
            return _reports(names, [None] * len(names), [None] * len(names), [layouts[n].dumped() for n in names])

        for b in batches:
            hosts, keys = b.column(0).to_pylist(), []
            for host, page in zip(hosts, as_bytes(b.column(2)), strict=True):
                blocks = page_blocks(page.decode())
                keys.append([None, *text_keys(blocks)])
                mine, layout = Layout.of(blocks), layouts.get(host)
                if layout is None:
                    layouts[host] = layout = mine
                else:
                    held -= layout.size
                    layout.add(mine)
                held += layout.size
                if held > HELD_NODES:
                    yield handed_on()
                    layouts.clear()
                    held = 0
            yield _reports(hosts, b.column(1), keys, [None] * len(hosts))
        yield handed_on()

    source = pages.where(F.length("html") > 0).select("host", F.xxhash64("html").alias("page"), "html")
    return written(small_batches(source).mapInArrow(run, "host string, page long, keys array<long>, layout string"))


def _reports(hosts, pages, keys, layouts) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    columns = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip((hosts, pages, keys, layouts), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["host", "page", "keys", "layout"])


def host_regions(reports: DataFrame) -> DataFrame:
    """host and region, by the wrapper of all its pages: the tasks' layouts are added,
    SALTS parts of a host apart and then those."""
    parts = reports.where(F.col("layout").isNotNull()).select("host", F.pmod(F.xxhash64("layout"), F.lit(SALTS)).alias("part"), "layout")
    return _added(_added(parts, ["host", "part"], lambda x: x.dumped(), "layout").withColumn("part", F.lit(0)), ["host"], lambda x: x.region(), "region")


def _added(parts: DataFrame, keys: list[str], finish: Callable[[Layout], str], name: str) -> DataFrame:
    """host and finish(sum of the layouts) for each value of keys, one layout at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, host, total = None, None, None

        def made():
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([finish(total)], pa.string())], names=["host", name])

        for b in batches:
            for h, part, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (h, part) != at:
                    if total is not None:
                        yield made()
                    at, host, total = (h, part), h, Layout.loaded(text)
                else:
                    total.add(Layout.loaded(text))
        if total is not None:
            yield made()

    dealt = parts.select("host", "part", "layout").repartition(*keys).sortWithinPartitions("host", "part", "layout")
    return small_batches(dealt).mapInArrow(run, f"host string, {name} string")


def host_constants(reports: DataFrame) -> DataFrame:
    """host and constants: keys of the texts that stand on CONSTANT_SHARE of the host's
    different pages and on CONSTANT_PAGES at least.

    Copies of a page count once; the null key counts pages.
    """
    once = reports.where(F.col("layout").isNull()).groupBy("host", "page").agg(F.first("keys").alias("keys"))
    counts = written(once.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONSTANT_PAGES))
    hosts = counts.where(F.col("key").isNull()).select("host", F.col("n").alias("pages"))
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    found = _with_host(counts.where(F.col("key").isNotNull()), hosts, "host", "key", small, "inner")
    return found.where(F.col("n") >= F.ceil(F.col("pages") * CONSTANT_SHARE)).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("constants"))


def _with_host(rows: DataFrame, hosts: DataFrame, host: str, key: str, small: bool, how: str) -> DataFrame:
    """rows joined with hosts (a row for each host). If these aren't small, each goes
    to SALTS places, and the rows of a host are dealt among them by key."""
    if small:
        return rows.join(F.broadcast(hosts), host, how)
    salt = fresh(rows, "__salt")
    salted = hosts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(f"`{key}`"), F.lit(SALTS)).cast("int")).join(salted, [host, salt], how).drop(salt)


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages with text and n_chars (its code points).

    text is the article without page furniture, markup and texts that stand on nearly
    all different pages of the host, counted over all of them: character references decoded, white space inside a
    block as one space, blocks joined by one space. Null and empty pages give "".
    Pages without a url share the wrapper of host "". Very long pages are read
    whole. Columns called text or n_chars are replaced.
    """
    host, found = fresh(pages, "__host"), fresh(pages, "__wrapper")
    named = pages.withColumn(host, host_of(F.col(f"`{url_col}`")))
    bodies = named.select(F.col(host).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    reports = page_reports(bodies)
    known = host_regions(reports).join(host_constants(reports), "host", "left")
    slim = written(known.select(F.col("host").alias(host), F.to_json(F.struct("region", F.coalesce("constants", F.array().cast("array<bigint>")).alias("constants"))).alias(found)))
    size = slim.agg(F.coalesce(F.sum(F.length(found)), F.lit(0))).first()[0]
    joined = _with_host(named, slim, host, html_col, size <= BROADCAST_CHARS, "left")

    def make():
        known: dict[str, dict] = {}

        def each(texts, wrappers_):
            out = []
            for t, w in zip(texts, wrappers_, strict=True):
                if w is not None and w not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[w] = json.loads(w)
                out.append(extract(t.decode() if t else None, known.get(w)))
            return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

        return each

    return map_text(joined.drop(host), make, [("text", T.StringType()), ("n_chars", T.LongType())], html_col, keep, [found])

