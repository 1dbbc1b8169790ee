"""Source divergence audit: how the word use of each source departs from that of the other sources of its language, and by which terms.

Terms are counted once: a task sums up what it has read for each language, source and term before anything is shuffled. All arithmetic is on integers.

Pairs of sources. A term that neither source uses adds the same value for all terms (the baseline); so a pair's sum is the baseline for all kept terms, plus
corrections for those that one source uses, and for those that both use. The first need only how many terms a source has of each count, the second a term's
sources. These are dealt to blocks of ``BLOCK`` sources; a group is a term and two blocks at most, and a task adds up its groups and writes one row for each pair of
sources.

Terms of a source. The first ``TOP`` by value come from a radix select: a histogram over ten bits of the value for each group names the digit of the
group's kth value; larger digits are in, smaller ones out, and only rows of that digit are looked at again with the next bits. Where equal values are left
beyond k, histograms over the bytes of the terms continue, from the first byte in which the terms that are left differ. No group's rows are sorted or gathered.

Defined cases: null text, lang and source are empty strings; rows count as documents, so a repeated row counts twice; a group without terms has its
rows for pairs, with counts of zero; a language without kept terms gives pairs of value 0 and no terms; equal values go by the UTF-8 bytes of the item;
extra columns are ignored; an empty table gives an empty result; a text of any length is read in pieces, its distinct terms are held.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.llm.common import bound_batches, discard, materialize

MIN_DOCUMENTS, TOP, SCALE = 10, 10, 1_000_000_000
#: Sources of a language in one block of the pairs' groups.
BLOCK = 256
#: Bits of a value that one histogram looks at; f never exceeds SCALE, so values have 30.
DIGIT, VALUE_BITS = 10, 30
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_NOT_TERM = re.compile(rb"[^A-Za-z\x80-\xff]")
_PIECE, _HELD, _ROWS = 1 << 20, 200_000, 50_000
_GROUP = ["lang", "source"]


def terms_of(data: bytes) -> Counter:
    """Terms of a whole text, read in pieces that end where no term is cut."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        cut = _NOT_TERM.search(data, at + _PIECE) if at + _PIECE < len(data) else None
        end = cut.end() if cut else len(data)
        found.update(_TERM.findall(data[at:end].lower()))
        at = end
    return found


def count_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows in which the term occurs."""
    bound_batches(documents.sparkSession)
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def written(held: dict) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), terms in held.items():
            for term, (n, docs) in terms.items():
                for column, value in zip(columns, (lang, source, term, n, docs), strict=True):
                    column.append(value)
        for at in range(0, len(columns[0]), _ROWS):
            part = [c[at : at + _ROWS] for c in columns]
            strings = [pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*strings, pa.array(part[3], pa.int64()), pa.array(part[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            for lang, source, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                terms = held.setdefault((lang, source), {})
                size -= len(terms)
                for term, n in terms_of(data).items():
                    if entry := terms.get(term):
                        entry[0] += n
                        entry[1] += 1
                    else:
                        terms[term] = [n, 1]
                size += len(terms)
                if size > _HELD:
                    yield from written(held)
                    held, size = {}, 0
        yield from written(held)

    rows = documents.select(*(F.coalesce(documents[c].cast("string"), F.lit("")).alias(c) for c in _GROUP), F.coalesce(documents["text"].cast("binary"), F.lit(b"")).alias("data"))
    return rows.mapInArrow(run, schema).groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b).cast("bigint")


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """p: the smoothed share in parts of SCALE, exactly whatever the counts are; null without kinds."""
    size = F.when(kinds > 0, total + 2 * kinds).cast("decimal(20,0)")
    return 1 + _quotient(F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), size)


def _departure(p: Column, q: Column) -> Column:
    """f; the square stays below 2 to the power of 60."""
    return _quotient((p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def both_use(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): what a pair's sum gains over the corrections for one source by the terms that both use. entries: lang, term,
    source, p and none, the share of a term that the source does not use. sources: lang and its number of sources."""
    bound_batches(entries.sparkSession)
    dealt = entries.join(sources.select("lang", F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks")), "lang")
    dealt = dealt.withColumn("block", F.pmod(F.hash("source"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy("lang", "term", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    lists = groups.agg(F.collect_list(F.struct("source", "p", "none", "block")).alias("uses")).where(F.size("uses") > 1)  # the sources of two blocks
    return lists.select("lang", (F.col("low") == F.col("high")).alias("inside"), "uses").mapInArrow(_add_up, "lang string, source string, item string, value bigint")


def _add_up(batches: Iterator[pa.RecordBatch], most_pairs: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str, str], int] = {}

    def written() -> pa.RecordBatch:
        keys = list(sums)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])

    for batch in batches:
        uses = batch.column("uses")
        sizes = np.diff(uses.offsets.to_numpy())
        flat = uses.flatten()
        names, source = np.unique(np.array(flat.field("source").to_pylist(), object), return_inverse=True)
        p, none, block = (flat.field(c).to_numpy() for c in ("p", "none", "block"))
        langs, lang = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        inside = batch.column("inside").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        later = ends[row] - 1 - np.arange(len(row))  # entries of the row after each
        done = np.concatenate(([0], np.cumsum(later)))
        at = 0
        while at < len(later):
            end = max(at + 1, int(np.searchsorted(done, done[at] + most_pairs, "right")) - 1)
            a = np.repeat(np.arange(at, end), later[at:end])
            b = a + 1 + np.arange(len(a)) - (done[a] - done[at])
            keep = inside[row[a]] | (block[a] != block[b])
            a, b = a[keep], b[keep]
            value = _f(p[a], p[b]) - _f(p[a], none[b]) - _f(none[a], p[b]) + _f(none[a], none[b])
            low, high = np.minimum(source[a], source[b]), np.maximum(source[a], source[b])
            kinds, which = np.unique((lang[row[a]] * len(names) + low) * len(names) + high, return_inverse=True)
            total = np.zeros(len(kinds), np.int64)
            np.add.at(total, which, value)
            for key, v in zip(kinds.tolist(), total.tolist(), strict=True):
                rest, j = divmod(key, len(names))
                k, i = divmod(rest, len(names))
                name = (langs[k], names[i], names[j])
                sums[name] = sums.get(name, 0) + v
            if len(sums) > _HELD:
                yield written()
                sums.clear()
            at = end
    yield written()


def pair_sums(shares: DataFrame, groups: DataFrame, salts: int = 16) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language. shares: lang, source, term, p, none. groups: lang, source, kinds, none."""
    columns = ["lang", "source", "item", "value"]
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    own = groups.withColumn("salt", F.pmod(F.hash("source"), F.lit(salts)))
    apart = F.col("source") != F.col("item")
    baseline = own.join(others, ["lang", "salt"]).where(apart).select("lang", "source", "item", F.coalesce(F.col("kinds") * _departure(F.col("none"), F.col("item_none")), F.lit(0)).alias("value"))
    alike = shares.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("terms")).withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(salts)))
    gained = F.col("terms") * (_departure(F.col("p"), F.col("item_none")) - _departure(F.col("none"), F.col("item_none")))
    one = alike.join(others, ["lang", "salt"]).where(apart).groupBy("lang", "source", "item").agg(F.sum(gained).alias("value"))
    one = materialize(one.unionByName(both_use(shares, groups.groupBy("lang").agg(F.count("*").alias("sources")))), "divergence")
    every = baseline.select(columns).unionByName(one.select(columns)).unionByName(turned(one))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def largest(rows: DataFrame, k: int, bits: int = VALUE_BITS) -> DataFrame:
    """Of each (lang, source) the k rows of the largest value, equal ones by the least item. Values are below 2 to the power of bits, items of a group distinct."""
    live, chosen, tables = rows.withColumn("need", F.lit(k).cast("bigint")), [], []

    def round_of(live: DataFrame, digit: Column, order: Column) -> DataFrame:
        cells = live.withColumn("digit", digit)
        running = Window.partitionBy(*_GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over digits
        bins = cells.groupBy(*_GROUP, "need", "digit").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(running))
        bins = bins.where(F.col("upto") - F.col("n") < F.col("need"))
        named = bins.select(*_GROUP, "digit", (F.col("upto") <= F.col("need")).alias("whole"), (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
        step = materialize(cells.drop("need").join(named, [*_GROUP, "digit"]), "select")
        tables.append(step)
        chosen.append(step.where("whole").select(*rows.columns))
        return step.where(~F.col("whole")).select(*rows.columns, F.col("left").alias("need"))

    for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
        live = round_of(live, F.shiftright("value", shift).bitwiseAND((1 << DIGIT) - 1), F.desc("digit"))
    while not live.isEmpty():
        ends = live.groupBy(*_GROUP).agg(F.min("item").alias("least"), F.max("item").alias("most"))
        same = F.zip_with(F.split("least", ""), F.split("most", ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
        ends = ends.select(*_GROUP, F.array_position(same, False).cast("int").alias("place"))
        # the UTF-8 bytes of the first letter in which they differ; of a term that ends there, none
        live = round_of(live.join(ends, _GROUP), F.expr("substring(item, place, 1)"), F.asc("digit"))
    out = materialize(functools.reduce(DataFrame.unionByName, chosen), "largest")
    for table in tables:
        discard(table)
    return out


def audit_sources(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` holds the other sources of the language, part ``term`` the first terms of the source."""
    counts = materialize(count_terms(documents), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents).drop("docs")
    used = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "used")
    discard(counts)
    terms = used.groupBy("lang", "term").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_size"))
    sizes = used.groupBy(*_GROUP).agg(F.sum("n").alias("size"))
    groups = documents.select(*(F.coalesce(documents[c].cast("string"), F.lit("")).alias(c) for c in _GROUP)).distinct().join(langs, "lang", "left").join(sizes, _GROUP, "left")
    groups = groups.select(*_GROUP, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("kinds", "lang_size", "size")))
    groups = materialize(groups.withColumn("none", _share(F.lit(0), F.col("size"), F.col("kinds"))), "groups")
    shares = used.join(groups, _GROUP).select(*_GROUP, "term", "none", _share(F.col("n"), F.col("size"), F.col("kinds")).alias("p"), _share(F.col("total"), F.col("lang_size"), F.col("kinds")).alias("q"))
    shares = materialize(shares, "shares")
    discard(used)
    own = shares.where("p > q").select(*_GROUP, F.col("term").alias("item"), _departure(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("part", *_GROUP).orderBy(F.desc("value"), "item"))  # a group's other sources, or TOP rows
    parts = [df.select(*_GROUP, F.lit(part).alias("part"), "item", "value") for part, df in (("pair", pair_sums(shares, groups)), ("term", largest(own, top)))]
    out = materialize(parts[0].unionByName(parts[1]).withColumn("rank", rank), "audit")
    discard(shares)
    return out
