"""Source divergence: how far the term shares of sources lie apart, by row-wise accumulation over a term-major index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import slices, written
from .words import LOWER

LEAST_DOCS = 10  # documents of a language that must hold a term
SCALE = 1_000_000_000
HELD = 1 << 18  # counts held by a task before they are passed on
POSTINGS = 1 << 16  # of a block of terms
CHUNK = 1 << 20  # postings scattered at a time
TERM = re.compile(rb"[a-z\x80-\xff]+")
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _counted(most: int):
    """(lang, source, term, n, docs) of a task, added up until it holds ``most``; a null term says that the group occurs."""
    lower = LOWER.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in slices(batches, 2):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(TERM.findall(text.encode().translate(lower)))
                n.update(own)
                docs.update(own.keys())
            if sum(len(n) for n, _ in found.values()) > most:
                yield _counts(found)
                found = {}
        if found:
            yield _counts(found)
    return run


def _counts(found: dict[tuple, tuple[Counter, Counter]]) -> pa.RecordBatch:
    rows = [(lang, source, None, 0, 0) for lang, source in found]
    rows += [(lang, source, t.decode(), k, docs[t]) for (lang, source), (n, docs) in found.items() for t, k in n.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if c < 3 else pa.int64()) for c in range(5)],
                                      names=["lang", "source", "term", "n", "docs"])


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); exact, since shares stay below 2^31."""
    return (p - q) ** 2 // (p + q)


def accumulated(source: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray, n_terms: int,
                chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """For each source in turn, the sums over the block's terms of ``apart`` to every source.

    A term that neither has costs the distance of the two zero baselines. The own terms replace the own baseline and the peer's
    terms the peer's, each distinct share once with the times it occurs; then every own term scatters, through the term-major
    index, what a term of both differs from these two steps into one accumulator with a cell per peer.
    """
    by_term = np.argsort(term, kind="stable")
    start = np.searchsorted(term[by_term], np.arange(n_terms + 1))
    peer, share = source[by_term], p[by_term]
    pairs, times = np.unique(np.stack([source, p]), axis=1, return_counts=True)
    by_source = np.argsort(source, kind="stable")
    rows = np.searchsorted(source[by_source], np.arange(len(zero) + 1))
    for g in range(len(zero)):
        total = n_terms * apart(zero[g], zero)
        np.add.at(total, pairs[0], times * (apart(zero[g], pairs[1]) - apart(zero[g], zero[pairs[0]])))
        for value, often in zip(pairs[1][pairs[0] == g], times[pairs[0] == g], strict=True):
            total += often * (apart(value, zero) - apart(zero[g], zero))
        own = by_source[rows[g]:rows[g + 1]]
        length = start[term[own] + 1] - start[term[own]]
        ends = np.cumsum(length)
        at = 0
        while at < len(own):  # the postings of some terms, about ``chunk`` at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
            n = length[at:to]
            flat = np.repeat(start[term[own[at:to]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h, q, mine = peer[flat], share[flat], np.repeat(p[own[at:to]], n)
            np.add.at(total, h, apart(mine, q) - apart(mine, zero[h]) - apart(zero[g], q) + apart(zero[g], zero[h]))
            at = to
        yield g, total


def _block(chunk: int):
    """Partial sums of all ordered pairs of sources of a language over one block of terms."""
    def run(table: pa.Table) -> pa.Table:
        heads = table.filter(pa.compute.is_null(table.column("term")))
        names = heads.column("source").to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i])
        names, zero = [names[i] for i in order], heads.column("p").to_numpy()[order]
        posts = table.filter(pa.compute.is_valid(table.column("term")))
        place = pa.compute.index_in(posts.column("source"), value_set=pa.array(names, pa.string()))
        coded = posts.column("term").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        lang, out = table.column("lang")[0].as_py(), []
        for g, total in accumulated(place.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64),
                                    posts.column("p").to_numpy(), zero, len(coded.dictionary), chunk):
            others = [i for i in range(len(names)) if i != g]
            out.append(pa.table([pa.array([lang] * len(others), pa.string()), pa.array([names[g]] * len(others), pa.string()),
                                 pa.array([names[i] for i in others], pa.string()), pa.array(total[others], pa.int64())], schema=_PAIRS))
        return pa.concat_tables(out)
    return run


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals so that no count overflows; 1 without terms."""
    exact = lambda c: c.cast("decimal(19,0)")
    whole = F.call_function("div", (exact(count) + 2) * F.lit(SCALE), exact(total) + exact(terms) * 2)
    return F.when(terms > 0, 1 + whole).otherwise(1).cast("bigint")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      least_docs: int = LEAST_DOCS, top: int = 10) -> DataFrame:
    """Distances between the sources of each language and the terms that set a source apart:
    ``lang, source, part, item, value, rank``.

    Terms are runs of letters and of characters outside ASCII, A-Z lowered; a language keeps those in at least ``least_docs`` of its
    documents. A source gives each of the V kept terms the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its count of kept
    terms; so does the language. Part ``pair`` adds floor((p - q)^2 / (p + q)) over all kept terms for every other source; part
    ``term`` has this value for the ``top`` occurring terms with the largest ones among those with p above the language's.

    1. One pass counts terms within a task; sums by (language, source, term) follow, and by (language, term) for the kept ones.
    2. Terms are dealt into blocks of about 65,536 postings, each with one row per source of the language for its zero baseline. In a
       block every source's row is accumulated densely (see ``accumulated``): no pair of postings leaves the task, only one
       partial sum per pair of sources. The partial sums of the blocks are added.

    All arithmetic is on integers. Null language, source or text count as empty; a group without terms takes part with its
    baselines; without kept terms all pairs are 0 and there are no terms. Repeated rows count as further documents. Ties
    are ranked by the item's UTF-8 bytes. An empty table gives no rows. Further columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = written(source.mapInArrow(_counted(HELD), "lang string, source string, term string, n bigint, docs bigint")
                     .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = written(counts.where("term IS NOT NULL").groupBy("lang", "term")
                   .agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), F.count("*").alias("postings"))
                   .where(F.col("docs") >= least_docs), "kept")
    posts = written(counts.where("term IS NOT NULL").select("lang", "source", "term", "n")
                    .join(kept.select("lang", "term", "whole"), ["lang", "term"]), "postings")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("whole_total"), F.sum("postings").alias("postings"))
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                     .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                                 for c in ("total", "terms", "whole_total", "postings"))), "groups")
    parts = F.greatest(F.lit(1), F.ceil(F.col("postings") / POSTINGS)).cast("int")
    shared = written(posts.join(groups, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), parts).cast("int").alias("block"), "source", "term",
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("whole"), F.col("whole_total"), F.col("terms")).alias("q")), "shares")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"),
                          _share(F.lit(0), F.col("total"), F.col("terms")).alias("p"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (shared.drop("q").unionByName(heads).repartition(tasks, "lang", "block").groupBy("lang", "block")
             .applyInArrow(_block(CHUNK), "lang string, source string, item string, value bigint")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    terms = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
