"""Main text of web pages by deducing the template of each host from equivalence classes of tokens.

Every page is read once into tokens: block elements known by their path, and texts known by path and content. The occurrence
vector of a token counts it on each page of its host; vectors are compared by fingerprints that add up, so one aggregate
without any list finds them, and the vectors over all hosts follow from those of the hosts. Tokens with one vector form a class. A
class is valid if its tokens come in one order on all pages and always in the same gap of the class that holds the pages together, that
is, if it nests; the valid classes of a host are its template. The gaps between template tokens are the slots. What the pages of a
host say in a slot decides whether it holds main text; each page then gives the blocks that stand in such slots.

Hosts with few pages use the template of all hosts. Pages of one host with and without a marked article are told apart.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import pages
from fieldmark.llm.common import BROADCAST_BYTES, look_up, materialize, table

#: Pages that a host needs for a template of its own.
LEAST_PAGES = 5
#: A template token stands on one page in SHARE at least, so a template has at most SHARE times the tokens of a mean page.
SHARE = 50
#: A text that the pages of a host repeat is part of the template on this share of them, and if there are so many.
REPEATED_SHARE, REPEATED_PAGES = 0.9, 10
#: Repeated text beyond this share of the main text comes from copies of pages, not from a template.
COPIES_SHARE = 0.3
#: Without a marked article, a slot is main if it has this share of the text of the host's largest slot, less than half of it links.
SLOT_SHARE = 0.25
#: Stands for all hosts.
ANY = "*"
_LOW = 0xFFFFFFFF
_TOKENS = "host string, rank int, page bigint, keys array<bigint>, texts array<boolean>, sizes array<int>, links array<int>, main array<boolean>, bag array<struct<key:bigint,n:int>>"


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without its port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page and how often each occurs; token 0 stands once on every page."""
    for batch in batches:
        out = defaultdict(list)
        for page in batch.column("html"):
            events = pages.read(page.as_py() or "")
            rank = pages.rank_of(events)
            keys = [_signed(e.key) for e in events]
            out["rank"].append(rank)
            out["keys"].append(keys)
            out["texts"].append([e.text is not None for e in events])
            out["sizes"].append([len(e.text or "") for e in events])
            out["links"].append([e.links for e in events])
            out["main"].append([e.text is not None and not e.aside and e.rank >= rank for e in events])
            out["bag"].append([{"key": k, "n": n} for k, n in (Counter(keys) | {0: 1}).items()])
        kinds = {"rank": pa.int32(), "keys": pa.list_(pa.int64()), "texts": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()),
                 "links": pa.list_(pa.int32()), "main": pa.list_(pa.bool_()), "bag": pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())]))}
        columns = {"host": batch.column("host"), **{k: pa.array(out[k], t) for k, t in kinds.items()}, "page": batch.column("page")}
        names = [c.split()[0] for c in _TOKENS.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def occurrence_vectors(tokens: DataFrame) -> DataFrame:
    """(host, rank, key, n, low, high): pages of each token and the fingerprint of its vector, by host and over all hosts (``*``).

    ``n`` of key 0 is the number of pages.
    """
    each = tokens.select("host", "rank", "page", F.explode("bag").alias("t")).select("host", "rank", F.col("t.key").alias("key"), F.xxhash64("page", "t.n").alias("h"))
    by_host = each.groupBy("host", "rank", "key").agg(
        F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(_LOW))).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"))
    by_host = materialize(by_host, "vectors")
    overall = by_host.groupBy("rank", "key").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    return by_host.unionByName(overall.select(F.lit(ANY).alias("host"), "rank", "key", "n", "low", "high"))


def classes(vectors: DataFrame) -> DataFrame:
    """(host, rank, pages, classes): for each host with enough pages the classes of two tokens or more, with their pages and keys."""
    enough = vectors.filter((F.col("n") >= LEAST_PAGES) & ((F.col("host") != ANY) | (F.col("n") >= 2 * LEAST_PAGES)))
    whole = enough.filter("key = 0").select(F.col("host").alias("_host"), F.col("rank").alias("_rank"), F.col("n").alias("pages"))
    same = (F.col("host") == F.col("_host")) & (F.col("rank") == F.col("_rank"))
    frequent = enough.filter("key <> 0").join(whole, same).filter(F.col("n") * SHARE >= F.col("pages"))
    grouped = frequent.groupBy("host", "rank", "low", "high").agg(
        F.array_sort(F.collect_list("key")).alias("keys"), F.max("n").alias("n"), F.max("pages").alias("pages"))
    grouped = grouped.filter(F.size("keys") >= 2)
    found = grouped.groupBy("host", "rank").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("n", "keys")), asc=False).alias("classes"))
    return found


class _Known:
    """Values by host and rank inside a task: a host's own, read once for each batch, or those of all hosts."""

    def __init__(self, general: dict):
        self.general, self.own = general, {}

    def of(self, host: str, rank: int, cell: pa.Scalar):
        """(value or None, the host that it comes from)."""
        if host not in self.own:
            self.own[host] = {v["rank"]: v["value"] for v in cell.as_py() or ()}
        own = self.own[host].get(rank)
        return (own, host) if own is not None else (self.general.get(rank), ANY)


def _beside(rows: DataFrame, templates: DataFrame, value: str, spread: str) -> tuple[DataFrame, dict]:
    """``rows`` (with their host) with ``own``, the values of their host by rank, and the values of all hosts by rank.

    ``templates`` is a written table (host, rank, pages, value). The values of all hosts are four rows at most, of a size that
    :data:`SHARE` bounds. Those of single hosts are broadcast below a measured size, else joined, with hot hosts set apart.
    """
    general = {r["rank"]: r[value] for r in _plain(templates.filter(F.col("host") == ANY).select("rank", value))}
    single = templates.filter(F.col("host") != ANY).groupBy(F.col("host").alias("key")).agg(
        F.sum("pages").alias("pages"), F.collect_list(F.struct("rank", F.col(value).alias("value"))).alias("own"))
    size, total = single.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("own")))), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    keyed = rows.withColumn("key", F.col("host"))
    if size <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(single.drop("pages")), "key", "left").drop("key"), general
    single = materialize(single, "by-host")
    return look_up(keyed, single, "key", "pages", total, F.col(spread)).drop("key"), general


def _plain(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _nesting(batches: Iterator[pa.RecordBatch], general: dict) -> Iterator[pa.RecordBatch]:
    """(of, rank, class, least, most, whole): smallest and largest hash of the order of a class on a page, and if it is a repetition."""
    for batch in batches:
        known, owners = _Known(general), {}
        seen: dict[tuple, list] = {}
        for k, (host, rank) in enumerate(zip(batch.column("host").to_pylist(), batch.column("rank").to_pylist())):
            found, of = known.of(host, rank, batch.column("own")[k])
            if not found:
                continue
            if (of, rank) not in owners:
                owners[of, rank] = {key: c for c, group in enumerate(found) for key in group["keys"]}
            owner = owners[of, rank]
            orders: dict[int, list] = defaultdict(list)
            gap = 0
            for key in batch.column("keys")[k].as_py():
                c = owner.get(key)
                if c == 0:
                    gap = key
                    orders[0].append(key)
                elif c is not None:
                    orders[c].append((gap, key))
            for c, order in orders.items():
                size = len(found[c]["keys"])
                times, rest = divmod(len(order), size)
                whole = not rest and len(set(order[:size])) == size and order == order[:size] * times
                mark = hash(tuple(order[:size])) if whole else 0  # of whole numbers, so the same in every process
                entry = seen.setdefault((of, rank, c), [mark, mark, True])
                entry[:] = min(entry[0], mark), max(entry[1], mark), entry[2] and whole
        yield _rows([(*k, *v) for k, v in seen.items()], _ORDERS)


_ORDERS = {"of": pa.string(), "rank": pa.int32(), "class": pa.int32(), "least": pa.int64(), "most": pa.int64(), "whole": pa.bool_()}
_SLOTS = {"of": pa.string(), "rank": pa.int32(), "slot": pa.int64(), "size": pa.int64(), "links": pa.int64(), "fixed": pa.int64()}


def _rows(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def nest(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(host, rank, pages, template): (key, n) of the tokens of the valid classes. ``found`` is the written table of :func:`classes`."""
    rows, general = _beside(tokens.select("host", "rank", "page", "keys"), found, "classes", "page")
    orders = rows.select("host", "rank", "keys", "own").mapInArrow(
        lambda batches: _nesting(batches, general), "of string, rank int, class int, least bigint, most bigint, whole boolean")
    valid = orders.groupBy("of", "rank", "class").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.bool_and("whole").alias("whole")).filter("whole AND a = b")
    valid = valid.select(F.col("of").alias("_of"), F.col("rank").alias("_rank"), F.col("class").alias("_class"))
    each = found.select("host", "rank", "pages", F.posexplode("classes").alias("class", "c"))
    kept = each.join(valid, (F.col("host") == F.col("_of")) & (F.col("rank") == F.col("_rank")) & (F.col("class") == F.col("_class")))
    keys = kept.groupBy("host", "rank").agg(F.max("pages").alias("pages"), F.flatten(F.collect_list(
        F.transform("c.keys", lambda k: F.struct(k.alias("key"), F.col("c.n").alias("n"))))).alias("template"))
    return keys


def _slots(batches: Iterator[pa.RecordBatch], general: dict) -> Iterator[pa.RecordBatch]:
    """(of, rank, slot, size, links, fixed): text outside asides in each slot, that inside links, and that of template texts."""
    for batch in batches:
        known, owns = _Known(general), {}
        seen: dict[tuple, list] = defaultdict(lambda: [0, 0, 0])
        columns = [batch.column(c).to_pylist() for c in ("host", "rank", "keys", "texts", "sizes", "links", "main")]
        for k, (host, rank, *events) in enumerate(zip(*columns)):
            template, of = known.of(host, rank, batch.column("own")[k])
            if (of, rank) not in owns:
                owns[of, rank] = {t["key"] for t in template or ()}
            own, slot = owns[of, rank], 0
            for key, is_text, size, link, is_main in zip(*events):
                if key in own:
                    slot = key
                if is_main:
                    entry = seen[of, rank, slot]
                    entry[0] += size
                    entry[1] += link
                    if key in own:
                        entry[2] += size
        yield _rows([(*k, *v) for k, v in seen.items()], _SLOTS)


def main_slots(tokens: DataFrame, template: DataFrame) -> DataFrame:
    """(host, rank, pages, plan): the template's keys, those of them that are repeated texts to leave out, and the main slots."""
    rows, general = _beside(tokens.drop("bag"), template, "template", "page")
    slots = rows.select("host", "rank", "keys", "texts", "sizes", "links", "main", "own").mapInArrow(
        lambda batches: _slots(batches, general), "of string, rank int, slot bigint, size bigint, links bigint, fixed bigint")
    slots = materialize(slots.groupBy("of", "rank", "slot").agg(F.sum("size").alias("size"), F.sum("links").alias("links"), F.sum("fixed").alias("fixed")), "slots")
    largest = slots.groupBy("of", "rank").agg(F.max(F.col("size") - F.col("links")).alias("most"), F.sum("size").alias("all"), F.sum("fixed").alias("fixed"))
    largest = largest.select(F.col("of").alias("_of"), F.col("rank").alias("_rank"), "most", "all", F.col("fixed").alias("_fixed"))
    judged = slots.join(largest, (F.col("of") == F.col("_of")) & (F.col("rank") == F.col("_rank")))
    dense = (F.col("size") - F.col("links") >= SLOT_SHARE * F.col("most")) & (2 * F.col("links") <= F.col("size"))
    chosen = judged.filter((F.col("rank") > 0) | dense)
    by_host = chosen.groupBy(F.col("of").alias("_of"), F.col("rank").alias("_rank")).agg(
        F.collect_list("slot").alias("slots"), F.max(F.col("_fixed") > COPIES_SHARE * F.col("all")).alias("copies"))
    joined = by_host.join(template, (F.col("host") == F.col("_of")) & (F.col("rank") == F.col("_rank")), "left")
    common = F.filter("template", lambda t: (t["n"] >= REPEATED_PAGES) & (t["n"] >= REPEATED_SHARE * F.col("pages")))
    repeated = F.when(F.col("copies"), F.array().cast("array<bigint>")).otherwise(F.transform(common, lambda t: t["key"]))
    plan = F.struct(F.transform("template", lambda t: t["key"]).alias("template"), repeated.alias("repeated"), "slots")
    return joined.select(F.col("_of").alias("host"), F.col("_rank").alias("rank"), F.coalesce("pages", F.lit(1).cast("bigint")).alias("pages"), plan.alias("plan"))


def _extract(batches: Iterator[pa.RecordBatch], general: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known, sets = _Known(general), {}
        texts, sizes = [], []
        for k, (page, host) in enumerate(zip(batch.column("html"), batch.column("host").to_pylist())):
            events = pages.read(page.as_py() or "")
            rank = pages.rank_of(events)
            plan, of = known.of(host, rank, batch.column("own")[k])
            if (of, rank) not in sets:
                sets[of, rank] = [frozenset((plan or {}).get(c) or ()) for c in ("template", "repeated", "slots")]
            own, repeated, slots = sets[of, rank]
            slot, blocks = 0, []
            for e in events:
                key = _signed(e.key)
                if key in own:
                    slot = key
                if e.text is not None and not e.aside and e.rank >= rank and slot in slots and key not in repeated:
                    blocks.append(e.text)
            texts.append("\n".join(blocks))
            sizes.append(len(texts[-1]))
        done = [pa.array(texts, pa.string()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *done], ["id", "url", "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``df``: id, url, ``text`` (blocks of the main text, joined by line feeds) and ``n_chars``.

    Character references are decoded and white space inside a block is one space. Null and empty pages have an empty text. Pages with a
    null or odd URL share the empty host. Repeated rows and ids stay; a page that is copied counts as often as it occurs.
    Pages are read whole, whatever their length. An empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    page = F.xxhash64("url", "html")
    tokens = materialize(rows.select("host", page.alias("page"), "html").mapInArrow(_read, _TOKENS), "tokens")
    found = materialize(classes(occurrence_vectors(tokens)), "classes")
    template = materialize(nest(tokens, found), "template")
    plans = materialize(main_slots(tokens, template), "plans")
    kind = {c: df.schema[n].dataType.simpleString() for c, n in (("id", id_col), ("url", url_col))}
    planned, general = _beside(rows.withColumn("page", page), plans, "plan", "page")
    done = planned.select("id", "url", "host", "html", "own").mapInArrow(
        lambda batches: _extract(batches, general), f"id {kind['id']}, url {kind['url']}, text string, n_chars bigint")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op12_html_extract": op12}
#: Reads the element that these tables mark as the article, with the few references they hold; pages without one are covered by tests.
ORACLE = {"op12_html_extract": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS inner_html FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(inner_html, '</?(?:p|h1)>'), lambda x:
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS blocks FROM a),
t AS (SELECT page_id, url, regexp_replace(array_to_string(blocks, chr(10)), '&amp;?', '&', 'g') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""}
